"""Hard negatives by a shuffle that sorts packed scores."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .job import saved, ship

ship(__name__)

ROWS_EACH, ANCHORS_EACH, LEAST_EACH = 32_768, 8_192, 1_024
SCORED_AT_ONCE = (256, 8_192)
# A key is an anchor, a score that falls, positives before negatives, and an id; its bytes sort as these do.
KEY = ">QQBQ"
KEYS = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
HALF = 1 << 63
POSITIVE, NEGATIVE = 0, 1
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys of pairs, as bytes."""
    out = np.zeros(len(ids), KEYS)
    half = np.uint64(HALF)
    out["anchor"], out["fall"] = anchor.astype(np.int64).view(np.uint64) + half, ~(score.astype(np.int64).view(np.uint64) + half)
    out["kind"], out["id"] = kind, ids.astype(np.int64).view(np.uint64) + half
    data, n = out.tobytes(), KEYS.itemsize
    return [data[i : i + n] for i in range(0, len(data), n)]


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, fall, kind, id_ = struct.unpack(KEY, key)
    return anchor - HALF, HALF - 1 - fall, kind, id_ - HALF


def by_length(table: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers in the order of ids, and whole-number components, of the vectors of each length."""
    vectors = table.column("_vector").combine_chunks()
    ids = table.column("_id").to_numpy()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[n] = rows, values[starts[rows][:, None] + np.arange(n)]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    if any(not -HALF <= x < HALF for x in exact.ravel().tolist()):
        raise OverflowError("an inner product does not fit a bigint")
    return exact.astype(np.int64)


def best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the places ``among`` with the highest scores, ties by place."""
    if len(among) <= k:
        return among
    found = scores[among]
    least = np.partition(found, len(found) - k)[len(found) - k]
    above, equal = among[found > least], among[found == least]
    return np.concatenate((above, equal[: k - len(above)]))


def scored(pick: Callable, scale: int, k: int) -> Callable:
    """Scores a group of rows against a block of anchors, part by part, and keeps the keys that ``pick`` takes."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        anchors = anchors.rename_columns([c.removeprefix("a") for c in anchors.column_names])
        of_rows, of_anchors = by_length(rows, scale), by_length(anchors, scale)
        ids, labels = rows.column("_id").to_numpy(), rows.column("_label").to_numpy()
        wanted = anchors.select(["_id", "_label", "_windows"]).to_pydict()
        n_anchors, n_rows = SCORED_AT_ONCE
        for n in of_rows.keys() & of_anchors.keys():
            (at, vectors), (asked, own) = of_rows[n], of_anchors[n]
            for i in range(0, len(asked), n_anchors):
                for j in range(0, len(at), n_rows):
                    part = at[j : j + n_rows]
                    part_ids, part_labels = ids[part], labels[part]
                    found = products(own[i : i + n_anchors], vectors[j : j + n_rows])
                    for who, scores in zip(asked[i : i + n_anchors].tolist(), found):
                        anchor = wanted["_id"][who]
                        taken = pick(scores, part_ids, part_labels, anchor, wanted["_label"][who], wanted["_windows"][who], k)
                        kind = NEGATIVE if wanted["_windows"][who] is not None else POSITIVE
                        keys += packed(np.full(len(taken), anchor), scores[taken], kind, part_ids[taken])
        return pa.table({"key": pa.array(keys, pa.binary())})

    return run


def nearest_alike(scores, ids, labels, anchor, label, windows, k):
    """Places of the best ``k`` other rows with the anchor's label."""
    return best(scores, np.flatnonzero((labels == label) & (ids != anchor)), k)


def within_windows(share: int) -> Callable:
    def pick(scores, ids, labels, anchor, label, windows, k):
        """Places of the best ``k`` rows of other labels under each positive's score."""
        low = min(-(-share * p // 100) for p in windows)
        among = np.flatnonzero((labels != label) & (scores >= low) & (scores <= max(windows)))
        found = scores[among]
        taken = [best(scores, among[(found >= -(-share * p // 100)) & (found <= p)], k) for p in dict.fromkeys(windows)]
        return np.unique(np.concatenate(taken))

    return pick


def opened(keys: Iterator[tuple[bytes, None]], k: int, share: int) -> Iterator[tuple]:
    """Results from sorted keys: a positive opens a window, which takes the next ``k`` negatives down to its lower end.

    What is held is the open windows of one anchor, of which there are no more
    than its positives.
    """
    last, windows = None, []
    for key, _ in keys:
        anchor, score, kind, id_ = unpacked(key)
        if anchor != last:
            last, windows = anchor, []
        windows = [w for w in windows if w[2] < k and share * w[1] <= 100 * score]
        if kind == POSITIVE:
            windows.append([id_, score, 0])
            continue
        for w in windows:
            w[2] += 1
            yield anchor, w[0], w[2], id_, w[1], score


def hard_negatives(
    df: DataFrame,
    anchors: str,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    rows_each: int = ROWS_EACH,
    anchors_each: int = ANCHORS_EACH,
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives, as rows of ``RESULT``.

    ``anchors`` is SQL over the columns that is true for anchors.  A component
    counts as ``floor(scale * x)``, a score is the whole-number inner product,
    and higher scores come first, ties by smaller key.  Positives are an
    anchor's first ``positives`` other rows of its label; negatives of one are
    the first ``negatives`` rows of other labels that score from ``share``
    hundredths of its score up to its score.

    Every row meets every anchor, group by group and block by block.  A first
    pass finds the positives; a second one keeps, of each group, the rows that
    can still be first under one of them, a handful for each anchor.  These
    pairs become keys of anchor, falling score and id; a shuffle sorts them by
    key, and an iterator over the sorted keys opens a window at each positive
    and gives out negatives as they come, so no anchor's rows are gathered.
    Groups hold some ``rows_each`` rows and ``anchors_each`` anchors whatever
    the labels and vectors are, so equal vectors and large labels make no task
    larger.  Nothing is broadcast.

    Rows with a null key, label or vector or with a component that is null or
    not finite take no part.  Of rows with one key only the least by label and
    vector does, so repeated rows count once.  Vectors of different lengths do
    not meet.  Keys and labels are whole numbers; an inner product beyond a
    bigint is an error.  An empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    usable = (
        df.selectExpr(f"cast(`{key}` as bigint) as _id", f"cast(`{label}` as bigint) as _label", f"`{vector}` as _vector", f"({anchors}) as _asks")
        .where("_id is not null and _label is not null and _vector is not null")
        .where("forall(_vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    )
    rows = saved(
        usable.groupBy("_id").agg(F.expr("min(struct(_label, _vector, _asks)) as _one")).selectExpr("_id", "_one.*")
    )
    total, asked = rows.selectExpr("count(1)", "count_if(_asks)").first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-total // rows_each), min(parts, -(-total // LEAST_EACH)), 1)
    blocks = max(-(-asked // anchors_each), 1)
    kept = rows.where("_asks").drop("_asks")

    def met(asking: DataFrame, pick: Callable, k: int) -> DataFrame:
        """Keys of the pairs that ``pick`` takes of each group and block."""
        left = rows.drop("_asks").selectExpr(
            "*", f"pmod(xxhash64(_id, 1), {groups}L) as _group", f"explode(sequence(0L, {blocks - 1}L)) as _block"
        )
        right = asking.selectExpr(
            "_id as a_id", "_label as a_label", "_vector as a_vector", "_windows as a_windows",
            f"pmod(xxhash64(_id, 2), {blocks}L) as _block", f"explode(sequence(0L, {groups - 1}L)) as _group",
        )
        grouped = left.groupBy("_group", "_block").cogroup(right.groupBy("_group", "_block"))
        return grouped.applyInArrow(scored(pick, scale, k), "key binary")

    nothing = "cast(null as array<bigint>) as _windows"
    near = saved(met(kept.selectExpr("*", nothing), nearest_alike, positives))
    # A key's parts in SQL: the score falls, so the first keys of an anchor are its best.
    first = near.selectExpr("key", "substr(key, 1, 8) as _of").selectExpr(
        "key", "_of", "row_number() over (partition by _of order by key) as _rank"
    ).where(f"_rank <= {positives}")
    positive = saved(
        first.selectExpr("key", f"cast({signed(1)} as bigint) as _id", f"cast(-1 - {signed(9)} as bigint) as _score")
    )
    windows = positive.groupBy("_id").agg(F.expr("collect_list(_score) as _windows"))
    under = met(kept.join(windows, "_id"), within_windows(share), negatives)
    keys = positive.select("key").unionByName(under)

    sort = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        parts, partitionFunc=lambda k: zlib.crc32(k[:8])
    )
    return spark.createDataFrame(
        sort.mapPartitions(lambda ks: opened(ks, negatives, share)), T._parse_datatype_string(RESULT), verifySchema=False
    )


def signed(start: int) -> str:
    """SQL for the number at a place of a key, without what was added to keep its order."""
    return f"(cast(conv(hex(substr(key, {start}, 8)), 16, 10) as decimal(20, 0)) - 9223372036854775808BD)"
