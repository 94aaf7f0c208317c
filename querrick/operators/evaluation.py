"""Retrieval quality: samples of queries, ranks of what they should find, and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

T = TypeVar("T")


def random_numbers(seed: int) -> Callable[[], float]:
    """A generator of numbers from 0 to 1 by 32-bit mixing; equal seeds give equal rows of numbers."""
    mask, state = 0xFFFFFFFF, [seed & 0xFFFFFFFF]

    def draw() -> float:
        state[0] = (state[0] + 0x6D2B79F5) & mask
        x = state[0]
        x = (x ^ x >> 15) * (x | 1) & mask
        x ^= (x + ((x ^ x >> 7) * (x | 61) & mask)) & mask
        return (x ^ x >> 14) / 2**32

    return draw


def seeded_sample(items: Sequence[T], n: int, seed: int) -> list[T]:
    """``n`` of the items by shuffling from the end; all, in order, if there are no more."""
    if n <= 0:
        return []
    out = list(items)
    if len(out) <= n:
        return out
    draw = random_numbers(seed)
    for at in reversed(range(1, len(out))):
        other = int(draw() * (at + 1))
        out[at], out[other] = out[other], out[at]
    return out[:n]


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows whose keys hash least with the seed: the same rows at any partitioning, without gathering the table."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(n)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def rank_of(wanted: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """``wanted`` (``query_id``, ``id``) with ``rank``: the place of the id in the query's hits (``query_id``, ``id``, ``pos``), 0 if it is not among the first ``most``."""
    found = hits.where(F.col("pos") <= most).groupBy("query_id", "id").agg(F.min("pos").alias("rank"))
    return wanted.join(found, ["query_id", "id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))


def span_hits(wanted: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """``wanted`` (``query_id``, ``file_path``, ``start_line``, ``end_line``) with ``hit``: whether one of the first ``most`` hits overlaps it in its file."""
    some = hits.where(F.col("pos") <= most).select("query_id", "file_path", F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    near = wanted.join(some, ["query_id", "file_path"]).where("__s <= end_line and __e >= start_line").select("query_id").distinct().withColumn("hit", F.lit(True))
    return wanted.join(near, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ratio(condition: Column) -> Column:
    """The share of rows that meet the condition, rounded; 0 of no rows."""
    return F.round(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)), 6)


def reciprocal_rank(rank: Column) -> Column:
    """The mean reciprocal rank (0 where it is 0), rounded; 0 of no rows."""
    return F.round(F.coalesce(F.avg(F.when(rank > 0, 1 / rank).otherwise(F.lit(0.0))), F.lit(0.0)), 6)


def nearest_rank(column: str, p: float) -> Column:
    """The percentile of a column as one of its values; 0 of no rows."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by `{column}`)"), F.lit(0.0))


def failures(ranks: DataFrame, hits: DataFrame, most: int = 10, top: int = 5) -> DataFrame:
    """The first ``most`` queries of rank 0 with the ids of their first ``top`` hits."""
    bad = ranks.where("rank = 0").orderBy("query_id").limit(most)
    best = hits.where(F.col("pos") <= top).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("top_hits"))
    return bad.join(best, "query_id", "left")
