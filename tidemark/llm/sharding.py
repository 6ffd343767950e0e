"""Weighted rendezvous hashing of records to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 4096


def score(keys: list[str], shard: int, weight: float) -> str:
    """SQL for how strongly a record wants a shard: -weight / ln(u), u uniform in (0, 1)."""
    u = f"(shiftrightunsigned(xxhash64({', '.join(keys)}, {shard}), 11) + 0.5D) / 9007199254740992D"
    return f"-{float(weight)!r}D / ln({u})"


def shard_of(keys: list[str], shards: dict[int, float]) -> str:
    """SQL for the shard with the highest score; the higher shard number wins a tie."""
    bids = ", ".join(f"struct({score(keys, s, w)} as score, {s} as shard)" for s, w in shards.items())
    return f"array_max(array({bids})).shard"


def place(df: DataFrame, keys: list[str], shards: dict[int, float], name: str = "shard") -> DataFrame:
    """Add the shard of each row.  No shuffle.

    A score depends on the keys, one shard and its weight alone.  A shard that
    is added, or whose weight grows, only takes rows; one that goes only gives
    rows.  Rows with equal keys share a shard; null is a key like any other.
    """
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need positive weights")
    return df.withColumn(name, F.expr(shard_of(keys, shards)))


def slots(df: DataFrame, order: list[str], shard: str = "shard", blocks: int = BLOCKS) -> DataFrame:
    """Add ``slot``, numbering the rows of each shard from 0 without gaps.

    A shard is cut into ``blocks`` by the hash of the ``order`` columns, so no
    task sorts a whole shard.  Rows are counted by block first; there are at
    most shards times blocks counts, which bounds what is broadcast.  Rows
    equal in all of ``order`` take neighbouring slots in any order.
    """
    block = f"cast(pmod(xxhash64({', '.join(order)}), {blocks}) as int) as _block"
    cut = df.selectExpr("*", block)
    before = (
        cut.groupBy(F.col(shard).alias("_shard"), F.col("_block").alias("_at")).agg(F.expr("count(1) as _n"))
        .selectExpr("_shard", "_at", "sum(_n) over (partition by _shard order by _at) - _n as _before")
    )
    numbered = cut.selectExpr(
        "*", f"row_number() over (partition by {shard}, _block order by {', '.join(order)}) - 1 as _rank"
    )
    at = f"{shard} <=> _shard and _block = _at"
    joined = numbered.join(F.broadcast(before), F.expr(at), "left")
    return joined.selectExpr(*(f"`{c}`" for c in df.columns), "cast(_before + _rank as bigint) as slot")
