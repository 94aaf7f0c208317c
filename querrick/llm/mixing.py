"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

#: Beyond this count of rows in all, rows that share a size class and a source are dealt over 16, 256, ... parts by hash; results do not depend on it.
ROWS_A_PART = 20_000


def word_count(text):  # noqa: ANN001, ANN201
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source):  # noqa: ANN001, ANN201
    """A key that is never null and sorts as the sources do, by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def plan(sizes: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """``(key, source_size, target, phase)`` of ``(key, source_size)``, one row a source.

    Sources in the order of their keys take the weights in turn. The water
    level L at which ``sum(least(cap * size, weight * L))`` is ``share`` of all
    sizes is found in closed form: with sources ordered by the level at which
    they are full, L is the greatest of the levels that follow from filling
    0, 1, 2, ... of them.
    """
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1)
    table = sizes.withColumn("weight", turn).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    table = table.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(whole) - before("most")) / (F.sum("weight").over(whole) - before("weight")))
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "key")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return table.select("key", "source_size", F.least("most", F.col("weight") * F.max("level").over(whole)).alias("target"), phase.alias("phase"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies``: how often the mix takes each row.

    A source's documents stand in order of size class (so that large documents
    are spread evenly over what is taken), then by a hash of the doc_id, then by
    size and a hash of the text, so that rows of one id have an order too. Each
    expects ``target / source_size`` copies; these are prefix-summed, one random
    offset a source (from ``seed``) is added, and a document is emitted once for
    every whole number crossed. ``copies`` is at most ``ceil(cap)``.

    The prefix sums take two levels: a small table has one row for each source,
    size class and (beyond ROWS_A_PART rows) hash prefix; within such a part
    rows are numbered. No source is gathered into one task.

    Null texts have size 0; a source without words takes no copies; null sources
    are one source, last in order; null ids count as the empty string; repeated
    rows are rows like others (which of two equal rows gets a copy does not
    matter, as long as their other columns are equal too); an empty table gives no rows. Columns of the four names above are
    replaced.
    """
    own = ("size", "source_size", "target", "copies")
    rest = [c for c in docs.columns if c not in own]
    sized = docs.select(*rest, source_key(F.col(source_col)).alias("__key"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__md5"), F.xxhash64(F.col(text_col)).alias("__text"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("__cls", F.expr("cast(length(bin(size)) * 64 + shiftright(size, greatest(length(bin(size)) - 6, 0)) as int)"))
    total = docs.count()
    digits = next((d for d in range(4) if total <= ROWS_A_PART * 16**d), 4)
    fine = sized.groupBy(F.col("__key").alias("key"), F.col("__cls").alias("cls"), F.substring("__md5", 1, digits).alias("hex")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    fine = checkpoint(fine, total)
    parts = fine.select("key", "cls", "hex", "n")
    upto = Window.partitionBy("key").orderBy("cls", "hex").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    table = parts.join(plan(fine.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap, seed), "key")
    table = table.select(F.col("key").alias("__key"), F.col("cls").alias("__cls"), F.col("hex").alias("__hex"), F.col("before").alias("__before"), "source_size", "target", F.col("phase").alias("__phase"))
    sized = sized.withColumn("__hex", F.substring("__md5", 1, digits))
    place = F.row_number().over(Window.partitionBy("__key", "__cls", "__hex").orderBy("__md5", F.col(id_col), "size", "__text"))
    joined = sized.withColumn("__place", place).join(table, ["__key", "__cls", "__hex"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("__before") + F.col("__place")).cast("double")
    copies = F.floor(rank * rate + F.col("__phase")) - F.floor((rank - 1) * rate + F.col("__phase"))
    return joined.select(*rest, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mixed corpus: each row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``."""
    taken = mix(docs, **options).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*docs.columns) if not {"size", "source_size", "target", "copies"} & set(docs.columns) else _restored(docs, options)


def _restored(docs: DataFrame, options: dict) -> DataFrame:
    """``mixture`` of a table that itself has columns of the names that ``mix`` adds."""
    names = {c: f"__own_{c}" for c in ("size", "source_size", "target", "copies") if c in docs.columns}
    return mixture(docs.withColumnsRenamed(names), **options).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM src),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER f, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW f AS (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT key, source_size, least(most, weight * max(level) OVER ()) AS target, ('0x' || substr(md5('1|' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS phase FROM levels),
ranked AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.phase, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
  (row_number() OVER (PARTITION BY s.key ORDER BY length(bin(s.size)) * 64 + (s.size >> greatest(length(bin(s.size)) - 6, 0)), h, s.doc_id))::DOUBLE AS rank
  FROM sized s JOIN goal g USING (key))
SELECT doc_id, size, source_size, target, ((floor(rank * rate + phase) - floor((rank - 1) * rate + phase)) * size)::BIGINT AS taken FROM ranked
"""
