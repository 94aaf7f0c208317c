"""Registered queries of operators on single values, changes, sources, vectors of texts and the evaluation's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.rows import grammars
from ..functions import sanitise, text
from ..operators import embedding, evaluation, fusion, lookup, snapshots
from ..sources import ignore, listing
from ..sources.corpus import Corpus
from ..streaming import changes
from . import sqltext as q
from .registry import AFTER, FILE_COLUMNS, SCRUBBED, SELECT_FILES, before_and_after, query

# Sources and changes -------------------------------------------------------------------------------------------


@query(AFTER + " SELECT file_path, 'new' AS change, 'no old side' AS side FROM fresh UNION ALL SELECT file_path, 'deleted', 'no new side' FROM old UNION ALL SELECT file_path, 'new', 'forced' FROM fresh")
def snapshot_one_side(c: Corpus) -> DataFrame:
    old, new = before_and_after(c)
    sides = {"no old side": snapshots.diff(None, new), "no new side": snapshots.diff(old, None), "forced": snapshots.forced(new)}
    first, *others = (rows.withColumn("side", F.lit(side)) for side, rows in sides.items())
    for rows in others:
        first = first.unionByName(rows)
    return first


@query(SELECT_FILES + "NOT (ends_with(file_path, '.go') OR list_contains(string_split(file_path, '/'), 'en') OR starts_with(file_path, 'src/src1/'))")
def path_exclude(c: Corpus) -> DataFrame:
    return c.files.where(~snapshots.excluded(F.col("file_path"), ("*.go", "en", "src/src1"))).select(*FILE_COLUMNS)


#: Of the ids' own kinds: every seventh an image by its name, every eleventh a text with a NUL at its start.
ODD = "CASE WHEN doc_id % 7 = 0 THEN file_path || '.PNG' ELSE file_path END"


@query(f"SELECT {ODD} AS file_path, doc_id % 7 = 0 AS binary_by_name, doc_id % 7 = 0 OR doc_id % 11 = 0 AS is_binary FROM files")
def binary_filter(c: Corpus) -> DataFrame:
    path = F.when(F.col("doc_id") % 7 == 0, F.concat("file_path", F.lit(".PNG"))).otherwise(F.col("file_path"))
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\0"), "content")).otherwise(F.col("content"))
    return c.files.select(path.alias("file_path"), listing.is_binary(path).alias("binary_by_name"), listing.is_binary(path, content).alias("is_binary"))


@query(SELECT_FILES + "extension IN ('.py', '.md')")
def extension_filter(c: Corpus) -> DataFrame:
    return listing.of_extensions(c.files, (".py", ".md")).select(*FILE_COLUMNS)


IGNORE_LINES = ("# comment", "*.go", "src/src1/", "!src/src1/en/", "/src/src0/*/doc_1*", "doc_?2.*")


@query(
    "SELECT file_path, CASE WHEN regexp_matches(file_path, '/doc_.2\\.[^/]*$') THEN true WHEN regexp_matches(file_path, '^src/src0/[^/]*/doc_1[^/]*$') THEN true WHEN starts_with(file_path, 'src/src1/en/') THEN false "
    "WHEN starts_with(file_path, 'src/src1/') THEN true ELSE ends_with(file_path, '.go') END AS ignored FROM files"
)
def ignore_rules(c: Corpus) -> DataFrame:
    return c.files.select("file_path", ignore.ignored(F.col("file_path"), IGNORE_LINES).alias("ignored"))


@query("SELECT * FROM (VALUES ('node_modules/', '**/node_modules/**'), ('/build/', 'build/**'), ('/top.txt', 'top.txt'), ('dist', '**/dist/**'), ('*.log', '**/*.log'), ('a/**/b', 'a/**/b'), ('docs/x.md', '**/docs/x.md')) v(pattern, as_glob)", "")
def ignore_globs(c: Corpus) -> DataFrame:
    patterns = ("node_modules/", "/build/", "/top.txt", "dist", "*.log", "a/**/b", "docs/x.md")
    return c.spark.createDataFrame([(p, ignore.to_glob(p)) for p in patterns], "pattern string, as_glob string")


@query("SELECT file_path AS path, CASE WHEN doc_id % 4 = 0 THEN 'unlink' ELSE 'change' END AS kind FROM files WHERE doc_id % 4 = 0 OR extension IN ('.py', '.ts') OR regexp_matches(file_path, '/doc_3\\.')")
def event_filter(c: Corpus) -> DataFrame:
    events = c.files.select(F.col("file_path").alias("path"), F.when(F.col("doc_id") % 4 == 0, "unlink").otherwise("change").alias("kind"))
    named = tuple(f"doc_3{e}" for e in (".py", ".ts", ".md", ".test.ts", ".go"))
    return changes.filtered(events, (".py", ".ts"), named)


@query("SELECT file_path, extension, CASE extension WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.go' THEN 'go' END AS language FROM files")
def language_of_files(c: Corpus) -> DataFrame:
    return c.files.select("file_path", "extension", text.language_hint(F.col("extension")).alias("language"))


@query("SELECT * FROM (VALUES ('javascript', '.js .mjs .cjs', true), ('typescript', '.ts .mts .cts', true), ('tsx', '.tsx', true), ('python', '.py', true), ('go', '.go', true), ('rust', '.rs', true), ('java', '.java', true), ('csharp', '.cs', true), ('dart', '.dart', false), ('swift', '.swift', true), ('kotlin', '.kt .kts', true), ('php', '.php', true)) v(language, extensions, enabled)", "")
def grammar_report(c: Corpus) -> DataFrame:
    return grammars(c.spark)


# Values --------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT token, length(token) >= 2 AND regexp_matches(token, '^([A-Z][A-Za-z0-9]*|[A-Z][A-Z0-9_]+)$') AS symbolish FROM refs")
def symbolish_tokens(c: Corpus) -> DataFrame:
    return c.refs.select("token").distinct().select("token", text.is_symbolish(F.col("token")).alias("symbolish"))


@query("SELECT doc_id, left(trim(regexp_replace(regexp_replace(content, '(?m)^[\\x09-\\x0D\\x20/*#-]+', '', 'g'), '[\\x09-\\x0D\\x20]+', ' ', 'g')), 160) AS query FROM files")
def doc_queries(c: Corpus) -> DataFrame:
    return c.files.select("doc_id", text.normal_doc(F.col("content")).alias("query"))


VERSIONS = "SELECT p_partkey, p_partkey % 3 AS a1, p_size % 4 AS a2, p_partkey % 50 AS a3, p_size % 3 AS b1, p_partkey % 4 AS b2, p_size AS b3, p_partkey % 9 = 0 AS broken FROM part"


@query(f"SELECT p_partkey, CASE WHEN broken THEN 0 WHEN [a1, a2, a3]::BIGINT[] < [b1, b2, b3]::BIGINT[] THEN -1 WHEN [a1, a2, a3]::BIGINT[] > [b1, b2, b3]::BIGINT[] THEN 1 ELSE 0 END AS compared FROM ({VERSIONS})", "")
def version_compare(c: Corpus) -> DataFrame:
    """Versions ``v1.2.3`` and ``1.2.3-rc`` of numbers of parts; every ninth is none."""
    n = lambda column, of: (F.col(column) % of).cast("string")
    a = F.concat(F.lit("v"), n("p_partkey", 3), F.lit("."), n("p_size", 4), F.lit("."), n("p_partkey", 50))
    b = F.concat(n("p_size", 3), F.lit("."), n("p_partkey", 4), F.lit("."), F.col("p_size").cast("string"), F.lit("-rc"))
    return c.raw("part").select("p_partkey", text.compare_versions(F.when(F.col("p_partkey") % 9 == 0, "latest").otherwise(a), b).alias("compared"))


def _cut(value: str) -> str:
    return f"CASE WHEN length({value}) <= 2000 THEN {value} ELSE left({value}, 2000) || '…(truncated)…' END"


@query(f"SELECT doc_id, {_cut(SCRUBBED)} AS query, {_cut('content')} AS title, file_path, sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS byte_count, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END::BIGINT AS line_count FROM files")
def sanitised_requests(c: Corpus) -> DataFrame:
    rows = c.files.select("doc_id", F.col("content").alias("query"), F.col("content").alias("title"), "file_path", F.col("content").alias("code_text"))
    return sanitise.sanitised(rows).select("doc_id", "query", "title", "file_path", "code_text.*")


@query("SELECT doc_id, sha256(content) AS query_sha256, length(content)::BIGINT AS query_length, sha256(file_path) AS path_sha256, CASE WHEN regexp_matches(label, '[\\x09-\\x0D\\x20]') OR length(label) > 80 THEN sha256(label) END AS label_sha256, CASE WHEN regexp_matches(label, '[\\x09-\\x0D\\x20]') OR length(label) > 80 THEN NULL ELSE label END AS label FROM (SELECT *, coalesce(nullif(left(content, 12), ''), 'none') AS label FROM files)")
def stripped_requests(c: Corpus) -> DataFrame:
    label = F.coalesce(F.nullif(F.substring("content", 1, 12), F.lit("")), F.lit("none"))
    rows = sanitise.sanitised(c.files.select("doc_id", F.col("content").alias("query"), "file_path", label.alias("label")), stripped=True)
    return rows.select("doc_id", F.col("query.sha256").alias("query_sha256"), F.col("query.length").alias("query_length"), F.col("file_path.sha256").alias("path_sha256"), F.col("label.sha256").alias("label_sha256"), F.col("label.value").alias("label"))


# Entities and results ------------------------------------------------------------------------------------------


@query("SELECT symbol_id, repo_id, revision, file_path, extension, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, symbol_kind, symbol_name, qualname, is_exported, context_header, content_hash, file_hash, length(code_text) > 300 AS code_truncated, CASE WHEN length(code_text) <= 300 THEN code_text ELSE left(code_text, 300) || chr(10) || '…(truncated)…' END AS code_text FROM symbols")
def symbol_details(c: Corpus) -> DataFrame:
    rows = lookup.details(c.symbols, most=300).drop("identifiers", "string_literals")
    return rows.withColumns({n: F.col(n).cast("long") for n in ("start_line", "end_line")})


@query("SELECT name, query_id, ref_id FROM (SELECT lower(token) AS query_id, ref_id, 'token' AS name, token = lower(token) AS is_exact, bool_or(token = lower(token)) OVER (PARTITION BY lower(token)) AS has_exact FROM refs) WHERE is_exact OR NOT has_exact")
def exact_preference(c: Corpus) -> DataFrame:
    """Of the words that differ in case only, those in lower case, if there are any."""
    rows = c.refs.select(F.lower("token").alias("query_id"), "ref_id", F.lit("token").alias("name"), (F.col("token") == F.lower("token")).alias("is_exact"))
    return fusion.prefer_exact(rows, apart=True).select("name", "query_id", "ref_id")


@query(f"SELECT symbol_id, round(round(1 / 61::DOUBLE, 9) * CASE WHEN is_exported THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {q.TEST_PATH} THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score, concat_ws(' ', CASE WHEN is_exported THEN 'export_boost=1.2' END, CASE WHEN {q.TEST_PATH} THEN 'test_path_demotion=0.6' END) AS priors FROM symbols")
def explained_priors(c: Corpus) -> DataFrame:
    rows = fusion.with_priors(c.symbols.withColumns({"table": F.lit("symbols"), "rrf": F.round(F.lit(1.0) / 61, 9)}), "definition", export=True, lexical=False)
    told = F.array_join(F.transform("priors", lambda p: F.concat(p["name"], F.lit("="), p["value"].cast("string"))), " ")
    return rows.select("symbol_id", F.round("score", 6).alias("score"), told.alias("priors"))


# Vectors of texts ----------------------------------------------------------------------------------------------

#: The hash of a text by its characters, and the components of the unit vector that follows from it.
HASHED = """+ inputs AS (SELECT DISTINCT sha256(left(content, 200)) AS input_hash, left(content, 200) AS input FROM files),
seeds AS (SELECT input_hash, list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(input, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT)), lambda h, u: xor(h * 33, u) & 4294967295) AS seed FROM inputs),
units AS (SELECT input_hash, list_transform(range(1, 9), lambda s: fmod(floor(fmod(seed::DOUBLE * s::DOUBLE * 1103515245.0::DOUBLE + 12345.0::DOUBLE, 4294967296.0::DOUBLE)), 2147483647.0::DOUBLE) / 2147483647.0::DOUBLE * 2 - 1) AS u FROM seeds),
vectors AS (SELECT input_hash, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) AS v FROM units)"""


@query(HASHED + " SELECT file_id, len(v)::INT AS dimensions, round(v[1]::FLOAT::DOUBLE, 4) AS v1, round(v[2]::FLOAT::DOUBLE, 4) AS v2, round(v[8]::FLOAT::DOUBLE, 4) AS v8 FROM files JOIN vectors ON input_hash = sha256(left(content, 200))")
def embed_and_attach(c: Corpus) -> DataFrame:
    """Vectors of distinct texts, of which the cache holds a part, joined to their files."""
    rows = c.files.withColumn("input", F.substring("content", 1, 200)).withColumn("embed_hash", F.sha2("input", 256))
    inputs = rows.select(F.col("embed_hash").alias("input_hash"), "input")
    embedder = embedding.HashEmbedder(8)
    cache = embedding.embed(embedding.unique_inputs(inputs.where("input_hash < '8'")), embedder)
    fresh = embedding.refreshed(inputs, cache, embedder, now="2000-01-01T00:00:00.000Z")
    held = embedding.attach(rows, cache.unionByName(fresh.select("input_hash", "vector")), "vec")
    at = lambda n: F.round(F.col("vec")[n].cast("double"), 4)
    return held.select("file_id", F.size("vec").alias("dimensions"), at(0).alias("v1"), at(1).alias("v2"), at(7).alias("v8"))


# Evaluation ----------------------------------------------------------------------------------------------------


@query("SELECT symbol_id, symbol_name FROM (SELECT symbol_id, symbol_name, row_number() OVER (PARTITION BY symbol_name ORDER BY file_path, start_line) AS n FROM symbols) WHERE n = 1")
def eval_first_by_name(c: Corpus) -> DataFrame:
    return evaluation.first_by(c.symbols, ["symbol_name"], ["file_path", "start_line"]).select("symbol_id", "symbol_name")


@query("+ hits AS (SELECT file_path AS query_id, symbol_id AS id, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS pos FROM symbols), wanted AS (SELECT query_id, max_by(id, pos) AS id, max(pos) AS last FROM hits GROUP BY 1), bad AS (SELECT * FROM wanted WHERE last > 3 ORDER BY query_id LIMIT 10) SELECT b.query_id, b.id, 0::BIGINT AS rank, string_agg(h.id, ' ' ORDER BY pos) AS top_hits FROM bad b JOIN hits h ON h.query_id = b.query_id AND pos <= 2 GROUP BY ALL")
def eval_failures(c: Corpus) -> DataFrame:
    """The last symbol of a file is wanted, the first three are found: longer files fail. The report is the first ten."""
    from pyspark.sql import Window

    hits = c.symbols.select(F.col("file_path").alias("query_id"), F.col("symbol_id").alias("id"), F.row_number().over(Window.partitionBy("file_path").orderBy("start_line")).alias("pos"))
    wanted = hits.groupBy("query_id").agg(F.max_by("id", "pos").alias("id"))
    return evaluation.failures(evaluation.rank_of(wanted, hits, 3), hits, 10, 2).withColumn("top_hits", F.array_join("top_hits", " "))
