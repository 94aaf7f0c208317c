"""Searches as plans: for each intent its channels, their fusion and the priors that apply.

Each takes entity tables and a table of queries and returns the hits of all
queries: ``(query_id, grp, pos, table, id, file_path, start_line, end_line, title,
snippet, score, channels, priors)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as intents
from ..functions.text import code_to_query, simple_tokens, strip, whitespace_tokens
from ..operators import fusion
from ..operators.channels import bm25, bm25_prefixes, fuzzy, nearest, oversample, token_match
from ..operators.scope import Scope

Tables = Mapping[str, DataFrame]
HIT = ("query_id", "grp", "pos", "table", "id", "file_path", "start_line", "end_line", "title", "snippet", "score", "channels", "priors")


#: Candidates that may be sent to every executor; more are joined by id.
MAX_SENT = 100_000


def few(queries: DataFrame, each: int) -> bool:
    """Whether ``each`` candidates a query are few enough to be sent."""
    return queries.limit(MAX_SENT // each + 1).count() * each <= MAX_SENT


def sent(rows: DataFrame, queries: DataFrame, each: int) -> DataFrame:
    """``rows``, of which there are ``each`` a query at most, to be broadcast if the queries are few enough: so the tables they join are not shuffled."""
    return F.broadcast(rows) if few(queries, each) else rows


def terms(queries: DataFrame, tokens: Column) -> DataFrame:
    return queries.select("query_id", tokens.alias("terms"))


def literal_tokens(literals: str) -> Column:
    """Tokens of a list of strings."""
    return F.flatten(F.transform(literals, lambda x: simple_tokens(x)))


def _column(rows: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in rows.columns else otherwise


def vectors(tables: Tables, queries: DataFrame, name: str, column: str) -> DataFrame | None:
    """The rows that have vectors: those kept apart as ``name.column``, else the table's own; None if queries or rows have none."""
    if "vector" not in queries.columns:
        return None
    apart = tables.get(f"{name}.{column}")
    return apart if apart is not None else tables[name] if column in tables[name].columns else None


def attributes(tables: Tables, names: list[str]) -> DataFrame:
    """What hits show of the entities of those tables, by ``table`` and ``id``."""
    out = []
    none = F.lit(None).cast("string")
    for name in names:
        rows = tables[name]
        if name == "symbols":
            sign = F.nullif(strip(_column(rows, "signature", none)), F.lit(""))
            out.append(rows.select(F.lit(name).alias("table"), F.col("symbol_id").alias("id"), "file_path", "start_line", "end_line", F.col("qualname").alias("title"), F.coalesce(sign, F.substring("code_text", 1, 200)).alias("snippet"), "is_exported"))
        elif name == "chunks":
            out.append(rows.select(F.lit(name).alias("table"), F.col("chunk_id").alias("id"), "file_path", "start_line", "end_line", F.col("chunk_kind").alias("title"), F.substring("code_text", 1, 240).alias("snippet"), F.lit(False).alias("is_exported")))
        else:
            out.append(rows.select(F.lit(name).alias("table"), F.col("file_id").alias("id"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("file_path").alias("title"), F.substring("file_summary_text", 1, 240).alias("snippet"), F.lit(False).alias("is_exported")))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done


def _ranked(tables: Tables, queries: DataFrame, channels: list[DataFrame], limit: int, intent: str, group: str, k: int, **priors: bool) -> DataFrame:
    """Fusion, priors and diversity; attributes join the few candidates (``limit`` a channel) only after the channels' limits."""
    names = [n for n in ("symbols", "chunks", "files") if any(n in c for c in group.split("+"))]
    asked = queries.select("query_id", "query")
    if few(queries, limit * len(channels)):
        merged = F.broadcast(fusion.merge(channels, intent).join(asked, "query_id"))
    else:  # candidates meet their query before their attributes, so that snippets are shuffled by id only
        merged = fusion.merge([c.repartition("query_id") for c in channels], intent).join(asked, "query_id")
    shown = attributes(tables, names).join(merged, ["table", "id"])
    best = fusion.diversify(fusion.with_priors(shown, intent, **priors), k)
    label = {"symbols": "definitions", "files": "files"}.get(group, "blocks")
    return best.withColumn("grp", F.lit(label)).select(*HIT)


def definitions(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Symbols by prefixes of their names, inexact names, identifiers and vectors."""
    symbols, keep, n = tables["symbols"], (scope or Scope()).flag(), oversample("ranked", k)
    q = F.col("query")
    planned = queries.select("query_id", intents.fuzzy_plan(q).alias("p")).where("p is not null").select("query_id", "p.*")
    channels = [
        bm25_prefixes(queries, symbols, F.col("symbol_name"), 2, 8, "symbol_id", n, "symbols.name", keep),
        bm25_prefixes(queries, symbols, F.col("qualname"), 2, 12, "symbol_id", n, "symbols.qualname", keep),
        fuzzy(planned, symbols, F.col("symbol_name"), "symbol_id", n, "symbols.name_fuzzy", keep=keep),
        fuzzy(planned, symbols, F.col("qualname"), "symbol_id", n, "symbols.qualname_fuzzy", "qual_token", keep),
        bm25(terms(queries, whitespace_tokens(q)), symbols, whitespace_tokens(F.col("identifiers_text")), "symbol_id", n, "symbols.identifiers", keep),
    ]
    if (held := vectors(tables, queries, "symbols", "vec_summary")) is not None:
        channels.append(nearest(queries, held, "vec_summary", "symbol_id", n, "symbols.vec_summary", keep))
    return _ranked(tables, queries, channels, n, "definition", "symbols", k, export=True)


def files(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Files by their summaries and vectors."""
    rows, keep, n = tables["files"], (scope or Scope()).flag(), oversample("files", k)
    channels = [bm25(terms(queries, simple_tokens(F.col("query"))), rows, simple_tokens(F.col("file_summary_text")), "file_id", n, "files.fts", keep)]
    if (held := vectors(tables, queries, "files", "vec_file")) is not None:
        channels.append(nearest(queries, held, "vec_file", "file_id", n, "files.vec_file", keep))
    return _ranked(tables, queries, channels, n, "concept", "files", k, lexical=False)


def blocks(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Chunks by identifiers, search text and vectors."""
    rows, keep, n = tables["chunks"], (scope or Scope()).flag(), oversample("ranked", k)
    channels = [
        bm25(terms(queries, whitespace_tokens(F.col("query"))), rows, whitespace_tokens(F.col("identifiers_text")), "chunk_id", n, "chunks.identifiers", keep),
        bm25(terms(queries, simple_tokens(F.col("query"))), rows, simple_tokens(F.col("search_text")), "chunk_id", n, "chunks.search_text", keep),
    ]
    if (held := vectors(tables, queries, "chunks", "vec_code")) is not None:
        channels.append(nearest(queries, held, "vec_code", "chunk_id", n, "chunks.vec_code", keep))
    return _ranked(tables, queries, channels, n, "concept", "chunks", k, lexical=False)


def concept(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Files, definitions and blocks, each with its share of ``k``."""
    few, half = max(5, int(k / 3 + 0.5)), max(10, int(k / 2 + 0.5))
    return files(tables, queries, few, scope).unionByName(definitions(tables, queries, half, scope)).unionByName(blocks(tables, queries, half, scope))


def exact_text(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Chunks and symbols by their string literals and code; tests are not demoted."""
    keep, n = (scope or Scope()).flag(), oversample("exact", k)
    asked = terms(queries, simple_tokens(F.col("query")))
    key = {"chunks": "chunk_id", "symbols": "symbol_id"}
    channels = [bm25(asked, tables[t], literal_tokens("string_literals"), key[t], n, f"{t}.string_literals", keep) for t in ("chunks", "symbols")]
    channels += [bm25(asked, tables[t], simple_tokens(F.col("code_text")), key[t], n, f"{t}.code_text", keep) for t in ("chunks", "symbols")]
    return _ranked(tables, queries, channels, n, "exact_text", "symbols+chunks", k, tests=False, lexical=False)


def similar_code(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Chunks and symbols by vectors or, for queries without one, by the words of their identifiers."""
    keep, n = (scope or Scope()).flag(), oversample("ranked", k)
    channels = []
    plain = queries
    if (held := vectors(tables, queries, "chunks", "vec_code")) is not None:
        channels = [nearest(queries, held, "vec_code", "chunk_id", n, "chunks.vec_code", keep), nearest(queries, vectors(tables, queries, "symbols", "vec_summary"), "vec_summary", "symbol_id", n, "symbols.vec_summary", keep)]
        plain = queries.where("vector is null")
    asked = terms(plain, simple_tokens(code_to_query(F.col("query"))))
    channels += [
        bm25(asked, tables["chunks"], simple_tokens(F.col("search_text")), "chunk_id", n, "chunks.search_text", keep),
        bm25(asked, tables["symbols"], simple_tokens(F.col("search_text")), "symbol_id", n, "symbols.search_text", keep),
    ]
    return _ranked(tables, queries, channels, n, "similar_code", "symbols+chunks", k)


#: What usages keep of their references.
USAGE = ("file_path", "start_line", "end_line", "ref_kind", "token_texts", "context_snippet")


def _places(refs: DataFrame) -> DataFrame:
    """``refs`` with the bytes of their places, null where they have none."""
    return refs.withColumns({c: F.lit(None).cast("int") for c in ("start_byte", "end_byte") if c not in refs.columns})


def _usage_rows(rows: DataFrame) -> DataFrame:
    """Merged usages with what is shown of them; ``token_text`` is the token that ``needle`` names, else one that contains it, else the first."""
    low = F.lower("needle")
    same = F.filter("token_texts", lambda t: F.lower(t) == low)
    within = F.filter("token_texts", lambda t: F.lower(t).contains(low))
    token = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(within, F.lit(1)), F.try_element_at("token_texts", F.lit(1)), F.lit(""))
    rows = rows.withColumn("token_text", token).withColumn("is_exact", F.lower("token_text") == low)
    return rows.withColumns({"title": F.concat("ref_kind", F.lit(": "), "token_text"), "snippet": F.substring(F.coalesce("context_snippet", F.lit("")), 1, 240), "is_exported": F.lit(False)})


def usages(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """References by qualified name; by the bare name too where those are fewer than ``k``.

    Queries of equal names are searched once; what is known of references goes
    with them, so that their table is not joined again.
    """
    refs, keep, n = _places(tables["refs"]), (scope or Scope()).flag(), oversample("usage", k)
    asked = queries.select("query_id", intents.usage_tokens(F.col("query")).alias("t")).where("t is not null").select("query_id", "t.base", "t.qualified")
    asked = asked.withColumn("__like", F.min("query_id").over(Window.partitionBy(F.lower("base"), F.lower("qualified"))))
    every, asked = asked.select("__like", "query_id"), asked.where("query_id = __like").dropDuplicates(["query_id"]).drop("__like")
    carry = (*USAGE, "start_byte", "end_byte")
    both = asked.select("query_id", F.posexplode(F.array("qualified", "base")).alias("nth", "token")).select(F.struct("query_id", "nth").alias("query_id"), "token")
    both = token_match(both, refs, "token_texts", "ref_id", n, "refs.token_texts", "token", keep, carry)
    both = both.withColumns({"nth": F.col("query_id.nth"), "query_id": F.col("query_id.query_id")}).withColumn("source", F.when(F.col("nth") == 0, "refs.token_texts_qualified").otherwise(F.col("source")))
    enough = F.count_if(F.col("nth") == 0).over(Window.partitionBy("query_id")) >= k
    both = both.repartition("query_id").withColumn("__enough", enough).where("nth = 0 or not __enough").drop("__enough")
    one = fusion.dedupe_usages(both, USAGE)
    merged = fusion.merged(one, "usage", USAGE)
    rows = _usage_rows(merged.join(asked.select("query_id", F.coalesce("qualified", "base").alias("needle")), "query_id"))
    best = fusion.diversify(fusion.with_priors(rows, "usage", lexical=False), k)
    best = best.withColumn("grp", F.lit("usages")).select(*HIT).withColumnRenamed("query_id", "__like")
    return best.join(every, "__like").select(*HIT)


def find_usages(tables: Tables, names: DataFrame, k: int = 200, scope: Scope | None = None) -> DataFrame:
    """All places that name a symbol (``query_id``, ``symbol_name``): rows ``(query_id, pos, id, file_path, start_line, end_line, ref_kind, token_text, snippet, score)``.

    Exact names only, where there are any. ``fusion.grouped_usages`` groups them by file.
    """
    refs, keep, n = tables["refs"], (scope or Scope()).flag(), oversample("all_usages", k)
    asked = names.select("query_id", F.col("symbol_name").alias("needle"))
    found = token_match(asked, refs, "token_texts", "ref_id", n, "refs.token_texts", "needle", keep, USAGE)
    rows = _usage_rows(fusion.merge([found.repartition("query_id")], "usage", USAGE).join(asked, "query_id"))
    rows = fusion.prefer_exact(fusion.diversify(fusion.with_priors(rows, "usage", lexical=False), None))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("pos") <= k)
    return rows.select("query_id", "pos", "id", "file_path", "start_line", "end_line", "ref_kind", "token_text", "snippet", "score")


BY_INTENT = {"definition": definitions, "concept": concept, "exact_text": exact_text, "similar_code": similar_code, "usage": usages}


def search(tables: Tables, queries: DataFrame, k: int = 20, scope: Scope | None = None) -> DataFrame:
    """Hits of a table of queries of any intents: each query is routed, and the plans of the intents are one union."""
    routed = queries.withColumn("intent", intents.route(F.col("query")))
    out = None
    for name, plan in BY_INTENT.items():
        part = plan(tables, routed.where(F.col("intent") == name).drop("intent"), k, scope).withColumn("intent", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
