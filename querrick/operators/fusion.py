"""From ranked channels to results: fusion of ranks, priors, diversity, top k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import is_test_path, parts_of, query_parts


def weight(intent: str) -> Column:
    """The weight of a row's channel for an intent."""
    out = F.when(F.col("channel") == "vector", F.lit(fixed.OTHER_VECTOR_WEIGHT)).otherwise(F.lit(fixed.OTHER_TEXT_WEIGHT))
    for source, value in fixed.CHANNEL_WEIGHTS[intent].items():
        out = F.when(F.col("source") == source, F.lit(value)).otherwise(out)
    return out


def merge(channels: list[DataFrame], intent: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a query and candidate: ``(query_id, table, id, rrf, ord, has_fts, has_vector, channels)`` and the columns ``carry`` of the candidate.

    ``rrf`` sums ``weight / (61 + rank)`` over the channels that found the
    candidate; ``ord`` is its first place in the channels' order, ``channels``
    what each said.
    """
    return merged(reduce(DataFrame.unionByName, (c.withColumn("nth", F.lit(n)) for n, c in enumerate(channels))), intent, carry)


def merged(rows: DataFrame, intent: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``merge`` of channels in one table, numbered by ``nth``."""
    said = F.struct("nth", "rank", "source", "channel", "raw_score")
    return rows.groupBy("query_id", "table", "id").agg(
        F.round(F.sum(weight(intent) / (fixed.RRF_K + 1 + F.col("rank"))), 9).alias("rrf"),
        F.min(F.col("nth") * 1_000_000 + F.col("rank")).cast("long").alias("ord"),
        F.max(F.col("channel") == "fts").alias("has_fts"),
        F.max(F.col("channel") == "vector").alias("has_vector"),
        F.array_sort(F.collect_list(said)).alias("channels"),
        *(F.first(c).alias(c) for c in carry),
    )


def export_prior() -> Column:
    return F.when((F.col("table") == "symbols") & F.coalesce(F.col("is_exported"), F.lit(False)), F.lit(fixed.EXPORT_BOOST)).otherwise(F.lit(1.0))


def ref_kind_prior() -> Column:
    out = F.lit(1.0)
    for kind, value in fixed.REF_KIND_PRIORS.items():
        out = F.when(F.col("ref_kind") == kind, F.lit(value)).otherwise(out)
    return out


def test_path_prior() -> Column:
    return F.when(is_test_path(F.col("file_path")), F.lit(fixed.TEST_PATH_PRIOR)).otherwise(F.lit(1.0))


def overlap(query: Column, surface: Column) -> Column:
    """How many parts of the query the surface has."""
    return F.size(F.array_intersect(query_parts(query), parts_of(surface)))


def surface() -> Column:
    """What overlap is measured on: title, snippet and path."""
    return F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "file_path")


def overlap_prior() -> Column:
    return F.when(F.col("has_vector") & (F.col("overlap") > 0), 1 + F.least(F.lit(fixed.OVERLAP_MOST), F.col("overlap") * fixed.OVERLAP_STEP)).otherwise(F.lit(1.0))


def no_overlap_prior(asked: Column) -> Column:
    """Counts against candidates of vectors alone that share no part with a query that has parts (``asked``)."""
    return F.when(F.col("has_vector") & ~F.col("has_fts") & (F.col("overlap") == 0) & asked, F.lit(fixed.NO_OVERLAP_PRIOR)).otherwise(F.lit(1.0))


def with_priors(candidates: DataFrame, intent: str, export: bool = False, tests: bool = True, lexical: bool = True) -> DataFrame:
    """Candidates (with attributes and, for ``lexical``, ``query``) with ``score`` and ``priors`` (name and value of each that applies)."""
    factors: dict[str, Column] = {}
    if export:
        factors["export_boost"] = export_prior()
    if intent == "usage":
        factors["ref_kind_prior"] = ref_kind_prior()
    if tests:
        factors["test_path_demotion"] = test_path_prior()
    if lexical:
        candidates = candidates.withColumn("overlap", F.when(F.col("has_vector"), overlap(F.col("query"), surface())))  # counts there only
        factors["lexical_overlap_boost"] = overlap_prior()
        if intent in ("definition", "similar_code"):
            factors["vector_no_overlap_demotion"] = no_overlap_prior(F.size(query_parts(F.col("query"))) > 0)
    score = reduce(lambda s, f: s * f, factors.values(), F.col("rrf"))
    told = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), f.alias("value")) for n, f in factors.items())), lambda p: p["value"] != 1.0) if factors else F.array().cast("array<struct<name:string,value:double>>")
    return candidates.withColumn("score", F.round(score, 9)).withColumn("priors", told)


def diversify(scored: DataFrame, k: int | None) -> DataFrame:
    """The best ``k`` rows of each query after each further hit of a file is worth less; column ``pos`` from 1.

    Candidates of a query number hundreds at most, so a query is one window.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord", "id")
    rows = scored.withColumn("__first", F.row_number().over(order))
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy("__first")) - 1
    penalty = 1 / (1 + F.col("__nth") * fixed.DIVERSITY_STEP)
    rows = rows.withColumn("__nth", nth).withColumn("score", F.round(F.col("score") * penalty, 9))
    if "priors" in rows.columns:
        told = F.array(F.struct(F.lit("diversity_penalty").alias("name"), penalty.alias("value")))
        rows = rows.withColumn("priors", F.when(F.col("__nth") > 0, F.concat("priors", told)).otherwise(F.col("priors")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "__first")))
    return (rows if k is None else rows.where(F.col("pos") <= k)).drop("__first", "__nth")


def dedupe_usages(candidates: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Usages of the same place and kind as one row, of the channels of all.

    The row that was found by its qualified name, or whose token has a dot, is
    preferred, then the first; the columns ``carry`` are its own. Candidates have
    the places, kinds and token texts of their references.
    """
    rows = candidates.withColumns({"__s": F.coalesce("start_byte", "start_line"), "__e": F.coalesce("end_byte", "end_line")})
    preferred = (F.col("source") == "refs.token_texts_qualified") | F.exists("token_texts", lambda t: t.contains("."))
    order = Window.partitionBy("query_id", "file_path", "__s", "__e", "ref_kind").orderBy(F.col("__preferred").desc(), "nth", "rank", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = {c: F.first(c).over(whole).alias(c) for c in ("id", *carry)}
    rows = rows.withColumn("__preferred", preferred)
    return rows.select("query_id", "table", chosen.pop("id"), "source", "channel", "rank", "raw_score", "nth", *chosen.values())


def prefer_exact(rows: DataFrame, apart: bool = False) -> DataFrame:
    """Only the rows with ``is_exact`` of each query that has any; all rows of the others.

    ``apart``: rows are not grouped by query yet and many; only those that are not exact are shuffled then.
    """
    if apart:
        exact, others = rows.where("is_exact"), rows.where("not is_exact")
        return exact.unionByName(others.join(exact.select("query_id").distinct(), "query_id", "left_anti").select(*rows.columns))
    some = F.max("is_exact").over(Window.partitionBy("query_id"))
    return rows.withColumn("__some", some).where(F.col("is_exact") | ~F.col("__some")).drop("__some")


def grouped_usages(rows: DataFrame) -> DataFrame:
    """``(query_id, file_path, refs, n)``: usages by file, in order of their first lines; refs hold what ``rows`` have of them."""
    named = {"start_line": "start_line", "end_line": "end_line", "id": "ref_id", "ref_kind": "ref_kind", "token_text": "token_text", "snippet": "context_snippet", "score": "score"}
    ref = F.struct(*(F.col(c).alias(name) for c, name in named.items() if c in rows.columns))
    return rows.groupBy("query_id", "file_path").agg(F.array_sort(F.collect_list(ref)).alias("refs"), F.count(F.lit(1)).alias("n"))


def next_actions(groups: dict[str, list[dict]]) -> list[dict]:
    """What to look at next, five at most, from the first hits of the groups ``definitions``, ``files``, ``usages`` and ``blocks``."""
    read = lambda h, a, b: {"tool": "read_file_lines", "args": {"file_path": h["file_path"], "start_line": a, "end_line": b}}
    around = lambda h: {"tool": "get_surrounding_code", "args": {"table": h["table"], "id": h["id"]}}
    first = {name: hits[0] for name, hits in groups.items() if hits}
    plan: list[dict] = []
    symbol = first.get("definitions")
    symbol = symbol if symbol and symbol["table"] == "symbols" else None
    if symbol:
        plan += [{"tool": t, "args": {"symbol_id": symbol["id"]}} for t in ("get_symbol_details", "find_references")]
        plan.append(read(symbol, symbol["start_line"], symbol["end_line"]))
    if (file := first.get("files")) and file["table"] == "files":
        plan += [read(file, 1, 200), around(file)]
    if symbol:
        plan.append(around(symbol))
    for name in ("usages", "blocks"):
        if hit := first.get(name):
            plan.append(read(hit, hit["start_line"], hit["end_line"]))
            if name == "blocks":
                plan.append(around(hit))
    return [a for n, a in enumerate(plan) if a not in plan[:n]][:5]
