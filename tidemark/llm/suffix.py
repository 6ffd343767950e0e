"""Removal of byte strings that occur more than once in a corpus, by bounded interval expansion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import saved, ship

ship(__name__)

GRAM = 40
# Chunks of one group before it is cut finer, bytes that a task expands at once,
# and the most texts whose hashes are broadcast.
MOST_CHUNKS, BYTES_AT_ONCE, MOST_BROADCAST = 2_000, 500_000, 500_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(known.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        known[base] = np.multiply.accumulate(out)
    return known[base][:n]


class Hashes:
    """Polynomial hashes modulo 2**64 of any part of some bytes.

    They deal strings into groups; structured strings collide in them, so they
    never decide that strings are equal.
    """

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values among valid places."""
    new = np.flatnonzero(valid & np.concatenate(([True], (least[1:] != least[:-1]) | ~valid[:-1])))
    if not len(new):
        return new, new
    ends = np.flatnonzero(valid & np.concatenate(((least[1:] != least[:-1]) | ~valid[1:], [True])))
    return new, ends


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """MD5 of parts of some bytes, as two whole numbers each; what decides that parts are equal."""
    view = memoryview(np.ascontiguousarray(data))
    told = b"".join(hashlib.md5(view[a:b]).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(told, np.int64).reshape(-1, 2)


def cut(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Chunks of the texts at ``offsets``: text, first start, size in bytes, group, two halves of a digest, twice.

    Each string of ``length`` bytes belongs to the group of the least hash of
    its ``GRAM``-grams, wherever it stands; neighbours of one group are a chunk.
    Only a chunk that has the group's gram ``twice`` can repeat a string itself.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none.astype(bool)
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams, width = hashes.of(at, at + GRAM), length - GRAM + 1
    least = window_min(grams, width)
    starts, sizes = np.arange(len(least)), np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    valid = starts + length <= np.repeat(offsets[1:], sizes)[: len(least)]
    # Runs must not pass from one text to the next; invalid places lie between texts.
    first, last = runs(least, valid)
    end = last + length
    content = digests(data, first, end)
    return (
        owner[first], first - offsets[owner[first]], end - first, least[first].view(np.int64),
        content[:, 0], content[:, 1], counted(grams, least, first, last + width - 1) > 1,
    )


def counted(grams: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often the least gram of the window at ``first`` stands between ``first`` and ``last``, both included."""
    width = len(grams) - len(least) + 1
    edge = np.zeros(width - 1, np.uint64)
    most = ~window_min(~np.concatenate((edge, least, edge)), width)
    anchors = np.flatnonzero(grams == most)
    values, ids = np.unique(grams[anchors], return_inverse=True)
    keys = np.sort(ids * len(grams) + anchors)
    own = np.searchsorted(values, least[first]) * len(grams)
    return np.searchsorted(keys, own + last, side="right") - np.searchsorted(keys, own + first)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``most`` bytes, so that memory follows that or the longest text."""
    sizes = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        upto = (sizes[start - 1] if start else 0) + most
        end = max(start + 1, int(np.searchsorted(sizes, upto, side="right")))
        yield batch.slice(start, end - start)
        start = end


def chunks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            data, offsets = flat_bytes(part.column(0))
            owner, start, size, group, content, content2, twice = cut(data, offsets, length)
            keys = part.column(1).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(group), pa.array(content), pa.array(content2), pa.array(twice)],
                ["text_key", "start", "size", "grp", "content", "content2", "twice"],
            )

    return run


def finer(length: int):
    """Fetches the bytes of chunks; those of a crowded group are cut by further hashes first."""

    names = ["text_key", "start", "alone", "grp", "bytes"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            out = []
            for text, key, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for w in wanted:
                    part = text[w["start"] : w["start"] + w["size"]]
                    pieces = [(0, len(part), w["grp"])]
                    if w["rounds"]:
                        data = np.frombuffer(part, np.uint8)
                        at = np.arange(len(data) - GRAM + 1)
                        grams = Hashes(data).of(at, at + GRAM)
                        ids = np.full(len(data) - length + 1, w["grp"], np.int64).view(np.uint64)
                        for i in range(w["rounds"]):
                            salted = mixed(grams ^ np.uint64(i + 1))
                            ids = mixed(ids ^ window_min(salted, length - GRAM + 1))
                        first, last = runs(ids, np.ones(len(ids), bool))
                        pieces = [(a, b + length, int(ids[a].view(np.int64))) for a, b in zip(first, last, strict=True)]
                    out += [(key, w["start"] + a, w["alone"], g, part[a:b]) for a, b, g in pieces]
            yield told(out)

    return run


def windows(length: int):
    """Rows (``text_key``, ``s``, ``alone``, ``grp``, ``h``, ``h2``) for every string of ``length`` bytes of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            data, offsets = flat_bytes(part.column(0))
            many = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(many)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = offsets[owner] + at
            keys, starts, alone, grp = (part.column(i).take(pa.array(owner)) for i in range(1, 5))
            places = pa.array(starts.to_numpy(zero_copy_only=False) + at, pa.int64())
            told = digests(data, start, start + length)
            yield pa.RecordBatch.from_arrays(
                [keys, places, alone, grp, pa.array(told[:, 0]), pa.array(told[:, 1])], ["text_key", "s", "alone", "grp", "h", "h2"]
            )

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text ordered by at least their first ``depth`` symbols, ties in any order."""
    n = len(text)
    key, known = np.zeros(n, np.int64), 7
    for i in range(known):
        key = key * 257 + np.roll(text, -i)
    open_, rank = np.arange(n), np.zeros(n, np.int64)
    while True:
        # Those of equal rank stand together; each gets the place of the first that equals it in one more part.
        by = np.lexsort((key, rank[open_])) if len(open_) < n else np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        at, new_old = np.arange(len(open_)), np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], key[1:] != key[:-1]))
        place = old + at - np.maximum.accumulate(np.where(new_old, at, 0))
        rank[open_] = place[np.maximum.accumulate(np.where(new, at, 0))]
        several = ~(new & np.append(new[1:], True))
        open_ = open_[several]
        if known >= depth or not len(open_):
            return np.argsort(rank, kind="stable")
        key = rank[(open_ + known) % n]
        known *= 2


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, whether the string of ``length`` bytes at each place occurs anywhere else in the pieces.

    The pieces are joined by separators and their Burrows-Wheeler transform is
    taken.  From the empty string, all strings found are extended by one symbol
    to the left, level by level; an extension that ends at a boundary between
    suffixes not seen before sets that boundary's common prefix to the level
    and is extended further, the others end.  After ``length`` levels the
    boundaries left have a common prefix of ``length`` or more.
    """
    text = np.concatenate([np.concatenate((np.frombuffer(p, np.uint8).astype(np.int64) + 1, [0])) for p in pieces])
    n = len(text)
    order = suffix_order(text, length)
    last = text[order - 1]
    # Where the suffix one to the left stands: symbols keep their order.
    left = np.empty(n, np.int64)
    left[np.argsort(last, kind="stable")] = np.arange(n)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        size = hi - lo
        one = size == 1
        new_lo, new_hi = [left[lo[one]]], [left[lo[one]] + 1]
        if not one.all():
            wide, many = lo[~one], size[~one]
            at = np.repeat(wide - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            key = np.repeat(np.arange(len(wide)), many) * 257 + last[at]
            by = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
            begin = left[at[by[heads]]]
            new_lo.append(begin)
            new_hi.append(begin + np.diff(np.append(heads, len(by))))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~found[hi]
        lo, hi = lo[fresh], hi[fresh]
        # Two strings of one level can end at one boundary only if one is the other's suffix set; keep the first.
        hi, pick = np.unique(hi, return_index=True)
        lo = lo[pick]
        found[hi] = True
        if not len(lo):
            break
    same = ~found
    hit = np.zeros(n, bool)
    hit[order[same[:-1] | same[1:]]] = True
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return [hit[e - len(p) - 1 : e - length] for p, e in zip(pieces, ends, strict=True)]


def expanded(length: int):
    def spans(group: list[tuple]) -> pa.RecordBatch:
        out = []
        if any(alone for _, _, alone, _ in group):
            for (key, start, alone, piece), hit in zip(group, repeated([g[3] for g in group], length), strict=True):
                if alone and hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    out += [(key, start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["text_key", "s", "e"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for key, start, alone, grp, piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if grp != group and size >= BYTES_AT_ONCE:
                    yield spans(held)
                    held, size = [], 0
                group = grp
                held.append((key, start, alone, piece))
                size += len(piece)
        if held:
            yield spans(held)

    return run


def kept(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, 4 << 20)):
            sizes, removed, counts, digests, texts = [], [], [], [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                edges = [0, *(x for span in merged for x in span), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                counts.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
                ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def repeated_spans(df: DataFrame, length: int) -> DataFrame:
    """Rows (``text_key``, ``s``, ``e``): byte spans of each distinct text that occur elsewhere too.

    ``df`` has ``text_key`` and ``bytes``.  Chunks that are equal as a whole
    are repeated and need no expansion, however often they occur; of the other
    chunks of their group one copy each is expanded.  A crowded group is cut by
    further content hashes, twice as many for each doubling of its chunks; its
    pieces are settled as chunks are, see ``crowded``.
    """
    found = df.select("bytes", "text_key").mapInArrow(
        chunks(length), "text_key string, start bigint, size bigint, grp bigint, content bigint, content2 bigint, twice boolean"
    )
    found = saved(found)
    groups = found.groupBy("grp").agg(
        F.expr("count(1) as _n"),
        F.expr("min(content) <> max(content) or min(content2) <> max(content2) or max(twice) as torn"),
    )
    shared = saved(found.drop("twice").join(groups.where("_n > 1 or torn").drop("_n"), "grp"))
    same = ["grp", "content", "content2", "size"]
    copies = shared.groupBy(*same, "torn").agg(
        F.expr("count(1) as n"), F.expr("min(struct(text_key, start)) as one")
    )
    copies = saved(copies)
    whole = shared.join(copies.where("n > 1").select(*same), same).selectExpr(
        "text_key", "start as s", "start + size as e"
    )
    kinds = copies.where("torn").groupBy("grp").agg(F.expr("count(1) as kinds"), F.expr("min(n) as least"))
    crowd = f"if(kinds > {MOST_CHUNKS}, cast(2 * ceil(log2(kinds / {MOST_CHUNKS}D)) as int), 0)"
    wanted = (
        copies.where("torn").join(kinds.where("least = 1"), "grp")
        .selectExpr("one.text_key as text_key", f"struct(one.start, size, grp, n = 1 as alone, {crowd} as rounds) as w")
        .groupBy("text_key").agg(F.expr("collect_list(w) as wanted"))
    )
    wanted = saved(wanted)
    few, names = wanted.count() <= MOST_BROADCAST, ["text_key", "start", "alone", "grp", "bytes"]

    def fetched(which: str) -> DataFrame:
        asked = wanted.selectExpr("text_key", f"filter(wanted, w -> {which}) as wanted").where("size(wanted) > 0")
        texts = df.select("bytes", "text_key")
        if few:
            texts = texts.join(F.broadcast(asked.select("text_key")), "text_key", "left_semi")
        return (
            texts.join(asked, "text_key").dropDuplicates(["text_key"]).select("bytes", "text_key", "wanted")
            .mapInArrow(finer(length), "text_key string, start bigint, alone boolean, grp bigint, bytes binary")
        )

    pieces = fetched("w.rounds = 0")
    if wanted.where("exists(wanted, w -> w.rounds > 0)").take(1):
        settled, left = crowded(saved(fetched("w.rounds > 0")), length)
        whole, pieces = whole.unionByName(settled), pieces.unionByName(left.select(*names))
    parts = pieces.repartition("grp").sortWithinPartitions("grp")
    torn = parts.mapInArrow(expanded(length), "text_key string, s bigint, e bigint")
    return whole.unionByName(torn).distinct()


def crowded(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans settled of the pieces of crowded groups, and the pieces left to expand.

    Equal pieces are counted before the shuffle; those that occur twice or more
    are repeated as a whole, and one copy of each kind is left.  Groups that
    still have more than ``MOST_CHUNKS`` kinds are settled by the digests of all
    their strings instead, so that no task holds such a group.
    """
    at = ["grp", "content", "size"]
    pieces = pieces.selectExpr("*", "md5(bytes) as content", "length(bytes) as size")
    kinds = pieces.groupBy(*at).agg(
        F.expr("count(1) as n"), F.expr("max(alone) as alone"), F.expr("min(struct(text_key, start)) as one"),
        F.expr("first(bytes) as bytes"),
    ).selectExpr(*at, "n", "n = 1 and alone as alone", "one.text_key as text_key", "one.start as start", "bytes")
    kinds = saved(kinds)
    whole = pieces.where("alone").join(kinds.where("n > 1").select(*at), at).selectExpr("text_key", "start as s", "start + size as e")
    groups = kinds.groupBy("grp").agg(F.expr("count(1) as kinds"), F.expr("max(alone) as open")).where("open").drop("open")
    left = kinds.select("bytes", "text_key", "start", "alone", "grp").join(groups, "grp")
    strings = left.where(f"kinds > {MOST_CHUNKS}").select("bytes", "text_key", "start", "alone", "grp").mapInArrow(
        windows(length), "text_key string, s bigint, alone boolean, grp bigint, h bigint, h2 bigint"
    )
    string = ["grp", "h", "h2"]
    several = strings.groupBy(*string).agg(F.expr("count(1) as n")).where("n > 1").select(*string)
    found = strings.where("alone").join(several, string).selectExpr("text_key", "s", f"s + {length} as e")
    return whole.unionByName(found), left.where(f"kinds <= {MOST_CHUNKS}")


def without_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, with_bytes: bool = True
) -> DataFrame:
    """Rows (``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``), one for each row of ``df``.

    ``kept`` is the text's UTF-8 bytes without those in a string of ``length``
    bytes that also starts anywhere else in ``df``, repeated rows included.  A
    null text is empty; texts shorter than ``length`` stay whole.  Without
    ``with_bytes`` the column ``kept`` is null.
    """
    kind = df.schema[key].dataType.simpleString()
    keyed = df.selectExpr(
        f"`{key}` as _key", f"cast(coalesce(`{text}`, '') as binary) as bytes", f"md5(coalesce(`{text}`, '')) as text_key"
    )
    spans = repeated_spans(keyed, length).groupBy("text_key").agg(F.expr("collect_list(struct(s, e)) as spans"))
    done = keyed.join(spans, "text_key", "left").select("bytes", "_key", "spans").mapInArrow(
        kept(with_bytes),
        f"_key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )
    return done.withColumnRenamed("_key", key)
