"""Near-duplicate texts by HyperMinHash registers, banded, estimated and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .job import saved, ship
from .text import shingles, words

ship(__name__)

REGISTERS, MANTISSA, ROWS = 128, 10, 5
# The chance that a pair at the limit misses all bands, at most.
MISSED = 4.4e-7
EMPTY = 0xFFFF
# Sets up to SMALL are entered into every register under its own permutation,
# as they would leave most buckets empty; sets from LARGE into one bucket a
# shingle.  Between the two both are kept, so that no pair falls between.
SMALL, LARGE = 300, 240
# Members of a bucket whose pairs become rows, of a block of a larger one, and shingles compared at once.
SMALL_BUCKET, BLOCK, STRIP = 8, 1024, 4096
# Rows sketched at once.
AT_ONCE = 1_000


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa of each 64-bit minimum."""
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    return (zeros * (1 << MANTISSA) + ((mantissa * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)


def small_registers(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of sets that lie one after the other in ``flat``, none empty."""
    mix = np.random.default_rng(20_240_501).integers(1, 1 << 63, (2, REGISTERS), dtype=np.uint64)
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        x = flat * (mix[0, i] | np.uint64(1)) + mix[1, i]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = compressed(np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts))
    return out


def large_registers(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One bucket per shingle by its top bits, the least of the other bits kept."""
    bits = REGISTERS.bit_length() - 1
    at = owner * REGISTERS + (flat >> np.uint64(64 - bits)).astype(np.int64)
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, at, flat << np.uint64(bits))
    filled = np.zeros(n * REGISTERS, bool)
    filled[at] = True
    return np.where(filled, compressed(least), EMPTY).astype(np.uint16).reshape(n, REGISTERS)


def band_rows(percent: int) -> int:
    """Registers of a band: as many, up to ``ROWS``, as keep the chance to miss a pair at the limit within ``MISSED``."""
    chances = {r: (1 - (percent / 100) ** r) ** (REGISTERS // r) for r in range(1, ROWS + 1)}
    return max((r for r, c in chances.items() if c <= MISSED), default=1)


def band_keys(registers: np.ndarray, salt: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band of ``size`` registers, and whether any of them is filled."""
    bands = REGISTERS // size
    rows = registers[:, : bands * size].reshape(-1, bands, size).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(salt * bands + 1), rows.shape[:2]).copy()
    for i in range(size):
        key = (key ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64), (rows != EMPTY).any(axis=2)


def sketched(size: int):
    """Adds the digest of the set, its registers and keys of bands of ``size`` to rows with ``_set``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            sets = batch.column(batch.schema.get_field_index("_set"))
            offsets = sets.offsets.to_numpy().astype(np.int64)
            flat = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(offsets)
            digests = [
                hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest()
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            registers, bands = {}, [[] for _ in sizes]
            for salt, (name, chosen) in enumerate(
                (("_small", (sizes > 0) & (sizes <= SMALL)), ("_large", sizes >= LARGE))
            ):
                rows = np.flatnonzero(chosen)
                found: list = [None] * len(sizes)
                if len(rows):
                    own = np.repeat(chosen, sizes)
                    part = flat[offsets[0] : offsets[-1]][own]
                    starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
                    if name == "_small":
                        made = small_registers(part, starts)
                    else:
                        made = large_registers(part, np.repeat(np.arange(len(rows)), sizes[rows]), len(rows))
                    keys, filled = band_keys(made, salt, size)
                    for k, row in enumerate(rows):
                        found[row] = made[k].view(np.int16)
                        bands[row].append(keys[k][filled[k]])
                registers[name] = pa.array(found, pa.list_(pa.int16()))
            joined = [np.concatenate(b) if b else np.empty(0, np.int64) for b in bands]
            kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            yield pa.RecordBatch.from_pydict(
                kept | {"_node": pa.array(digests, pa.binary()), **registers, "_bands": pa.array(joined, pa.list_(pa.int64()))}
            )

    return run


def with_nodes(sets: DataFrame, keep: str, percent: int) -> DataFrame:
    return sets.mapInArrow(
        sketched(band_rows(percent)), f"{keep}, _set array<bigint>, _node binary, _small array<smallint>, _large array<smallint>, _bands array<bigint>"
    )


def chance(n: str) -> list[str]:
    """SQL for the chance of each count of leading zeros in a bucket that holds ``n`` hashes."""
    return [f"(pow(1 - pow(2D, -{i + 1}), {n}) - pow(1 - pow(2D, -{i}), {n}))" for i in range(40)]


def estimate(a: str, b: str, n: str, m: str) -> str:
    """SQL for the resemblance from two arrays of registers, corrected for chance collisions.

    Two different minima of ``n`` and ``m`` hashes share a register if they
    have as many leading zeros and then the same mantissa.
    """
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y and x <> -1, 1, 0)), 0, (s, x) -> s + x)"
    used = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x <> -1 or y <> -1, 1, 0)), 0, (s, x) -> s + x)"
    met = f"(({' + '.join(f'{x} * {y}' for x, y in zip(chance(n), chance(m), strict=True))}) / {1 << MANTISSA})"
    return f"(({same} / greatest(1, {used})) - {met}) / (1 - {met})"


def linked(df: DataFrame, text: str, nodes: DataFrame, percent: int) -> DataFrame:
    """Components of the links between distinct shingle sets, with no link lost.

    Nodes that share a band are a bucket.  First each bucket's member with most
    company meets all others, which joins most of what belongs together.  Of
    the buckets that still hold several components the small ones compare all
    pairs, and the large ones are dealt in blocks to tasks that compare whole
    blocks and return only what joins components.  So no pair of a large bucket
    becomes a row, yet each is decided.
    """
    members = nodes.selectExpr("_node", "n", "explode(_bands) as _band")
    shared = members.groupBy("_band").agg(F.expr("count(1) as _size")).where("_size > 1")
    buckets = saved(members.join(shared, "_band"))
    company = buckets.groupBy("_node").agg(F.expr("sum(_size) as _company"))
    wanted = saved(company.join(nodes.select("_node", "n", "_text", "_small", "_large"), "_node"))
    split = df.selectExpr(f"xxhash64(coalesce(`{text}`, '')) as _text", f"coalesce(`{text}`, '') as _t")
    fetched = split.join(wanted.select("_text").distinct(), "_text", "left_semi")
    sets = fetched.selectExpr(f"{words('_t')} as _w").selectExpr(f"sort_array({shingles('_w')}) as _set")
    digested = sets.mapInArrow(digests, "_set array<bigint>, _node binary")
    sets = saved(digested.join(wanted.select("_node"), "_node", "left_semi").dropDuplicates(["_node"]))

    open_ = buckets.join(company, "_node")
    hubs = open_.selectExpr(
        "_band", "_node as _pivot", "n as m",
        "row_number() over (partition by _band order by _company desc, _node) as _rank",
    ).where("_rank = 1")
    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    stars = buckets.join(hubs, "_band").where(f"_node <> _pivot and {close}")
    links = saved(verified(_pairs(stars, "_node", "_pivot"), wanted, sets, percent))

    labels = components(links).withColumnRenamed("node", "_node")
    labelled = saved(
        buckets.join(labels, "_node", "left").selectExpr("_band", "_size", "_node", "n", "coalesce(label, _node) as _label")
    )
    torn = labelled.groupBy("_band").agg(F.expr("min(_label) <> max(_label) as _torn")).where("_torn").select("_band")
    labelled = saved(labelled.join(torn, "_band"))
    few = labelled.where(f"_size <= {SMALL_BUCKET}")
    other = few.selectExpr("_band", "_node as _pivot", "n as m", "_label as _own")
    pairs = few.join(other, "_band").where(f"_node < _pivot and _label <> _own and {close}")
    small = verified(_pairs(pairs, "_node", "_pivot"), wanted, sets, percent)

    blocks = f"cast(ceil(_size / {BLOCK}) as int)"
    many = labelled.where(f"_size > {SMALL_BUCKET}").selectExpr(
        "_band", "_node", "_label", f"{blocks} as _blocks", f"pmod(hash(_node), {blocks}) as _own"
    ).selectExpr("_band", "_node", "_label", "_own", "explode(sequence(0, _blocks - 1)) as _with")
    dealt = many.selectExpr(
        "_band", "_node", "_label", "least(_own, _with) as _lo", "greatest(_own, _with) as _hi"
    ).join(sets, "_node").select("_band", "_lo", "_hi", "_node", "_label", "_set")
    large = dealt.groupBy("_band", "_lo", "_hi").applyInArrow(within(percent), "a binary, b binary")
    return components(saved(links.unionByName(small).unionByName(large)))


def _pairs(df: DataFrame, one: str, two: str) -> DataFrame:
    return df.selectExpr(f"least({one}, {two}) as a", f"greatest({one}, {two}) as b").distinct()


def verified(pairs: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are as alike as asked; only those that registers find near are compared."""
    facts = facts.selectExpr("_node", "n", "_small as s", "_large as l")
    one = facts.withColumnsRenamed({"_node": "a", "s": "s1", "l": "l1"})
    two = facts.withColumnsRenamed({"_node": "b", "n": "m", "s": "s2", "l": "l2"})
    # Six standard deviations of the estimate below the limit.
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    near = pairs.join(one, "a").join(two, "b").where(
        f"case when s1 is not null and s2 is not null then {estimate('s1', 's2', 'n', 'm')} "
        f"else {estimate('l1', 'l2', f'n / {REGISTERS}', f'm / {REGISTERS}')} end >= {least}D"
    )
    return (
        near.select("a", "b", "n", "m")
        .join(sets.selectExpr("_node as a", "_set as _one"), "a")
        .join(sets.selectExpr("_node as b", "_set as _two"), "b")
        .selectExpr("a", "b", "n", "m", "cast(size(array_intersect(_one, _two)) as bigint) as _both")
        .where(f"100 * _both >= {percent} * (n + m - _both)")
        .select("a", "b")
    )


def within(percent: int):
    """Compares all sets of a block with each other by one product of matrices of what they hold.

    Of the links between components it returns as many as join them.
    """

    def run(table: pa.Table) -> pa.Table:
        nodes, labels = table.column("_node").to_pylist(), table.column("_label").to_pylist()
        codes = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)[1]
        sets = table.column("_set").combine_chunks()
        offsets = sets.offsets.to_numpy()
        flat = sets.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        column, times = np.unique(flat, return_inverse=True, return_counts=True)[1:]
        common = times[column] > 1
        # Only what two sets hold can count; it is numbered anew and taken in strips.
        column, owner = np.cumsum(times > 1)[column[common]] - 1, owner[common]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(nodes), len(nodes)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
            at = slice(*np.searchsorted(column, (start, start + STRIP)))
            holds = np.zeros((len(nodes), STRIP), np.float32)
            holds[owner[at], column[at] - start] = 1
            both += holds @ holds.T
        parent, out = list(range(int(codes.max()) + 1)), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(len(nodes) - 1):
            near = 100 * both[i, i + 1 :] >= percent * (sizes[i] + sizes[i + 1 :] - both[i, i + 1 :])
            for j in (np.flatnonzero(near & (codes[i + 1 :] != codes[i])) + i + 1).tolist():
                x, y = root(int(codes[i])), root(int(codes[j]))
                if x != y:
                    parent[x] = y
                    out.append((nodes[i], nodes[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch.column(0)
        offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False)
        made = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_pydict({"_set": sets, "_node": pa.array(made, pa.binary())})


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Rows (``key``, ``n_shingles``, ``component_id``, ``kept``), one for each row of ``df``.

    Rows are linked if at least ``percent`` of 100 of their distinct five-word
    shingles, of both together, are common to both; a component's id is the
    smallest key in it, null keys aside.  Rows with equal sets are one node
    from the start.  A text without words is linked with nothing, other such
    texts included, and keeps its own key.  ``kept`` marks the rows whose key
    is the component's; a key that is repeated is kept as often.
    """
    kind = df.schema[key].dataType.simpleString()
    split = df.selectExpr(f"`{key}` as _key", f"xxhash64(coalesce(`{text}`, '')) as _text", f"{words(f'`{text}`')} as _w")
    sets = split.selectExpr("_key", "_text", f"sort_array({shingles('_w')}) as _set").selectExpr(
        "_key", "_text", "size(_set) as n", "_set"
    )
    rows = saved(with_nodes(sets, f"_key {kind}, _text bigint, n int", percent).drop("_set"))
    nodes = saved(
        rows.where("n > 0").groupBy("_node").agg(
            F.expr("min(_text) as _text"), *(F.expr(f"first({c}) as {c}") for c in ("n", "_small", "_large", "_bands"))
        )
    )
    labels = linked(df, text, nodes, percent)
    labelled = (
        rows.select("_key", "n", "_node")
        .join(labels.withColumnsRenamed({"node": "_node", "label": "_label"}), "_node", "left")
        .selectExpr("_key", "n", "if(n = 0, null, coalesce(_label, _node)) as _label")
    )
    ids = labelled.where("_label is not null").groupBy("_label").agg(F.expr("min(_key) as _least"))
    return labelled.join(ids, "_label", "left").selectExpr(
        f"_key as `{key}`", "cast(n as bigint) as n_shingles", "if(n = 0, _key, _least) as component_id",
        "if(n = 0, true, _key <=> _least) as kept",
    )
