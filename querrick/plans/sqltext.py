"""SQL (of DuckDB) that says what the registered queries return, from common parts."""

from __future__ import annotations

from .. import fixed

WS = r"[\x09-\x0D\x20]"
IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
CHAIN = IDENT + r"(?:(?:\.|::|#)" + IDENT + ")*"


def words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The entity tables of ``sources.corpus``.
ENTITIES = r"""
files AS (SELECT *, sha256(repo_id || '|' || revision || '|' || file_path) AS file_id, 'File: ' || file_path || chr(10) || string_split(content, chr(10))[1] AS file_summary_text, sha256(content) AS file_hash,
    regexp_extract(file_path, '(\.[^./]*)\z', 1) AS extension
  FROM (SELECT doc_id, source, coalesce(text, '') AS content, sha256('corpus') AS repo_id, 'working' AS revision,
    'src/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id::VARCHAR || ['.py', '.ts', '.md', '.test.ts', '.go'][(doc_id % 5 + 1)::INT] AS file_path FROM documents)),
split AS (SELECT *, string_split(content, chr(10)) AS ls FROM files),
cut AS (SELECT doc_id, source, repo_id, revision, file_path, extension, file_hash, len(ls) AS n, ls, unnest(range(0, ((len(ls) - 1) // 4 + 1)::BIGINT)) AS block FROM split),
blocks AS (SELECT *, array_to_string(ls[block * 4 + 1 : block * 4 + 4], chr(10)) AS code_text, block * 4 + 1 AS start_line, least(block * 4 + 4, n) AS end_line, '// File: ' || file_path AS context_header FROM cut),
named AS (SELECT *, sha256(context_header || chr(10) || code_text) AS content_hash, array_to_string(list_sort(list_distinct(regexp_extract_all(code_text, '[A-Za-z_][A-Za-z0-9_]*'))), ' ') AS identifiers_text,
    list_filter(string_split(code_text, chr(10)), lambda x: length(x) BETWEEN 8 AND 160) AS string_literals FROM blocks),
chunks AS (SELECT *, 'block' AS chunk_kind, sha256('|' || file_path || '|' || start_line || '|' || end_line || '|' || content_hash) AS chunk_id,
    concat_ws(chr(10), context_header, nullif(identifiers_text, ''), nullif(code_text, '')) AS search_text FROM named),
symbols AS (SELECT *, sha256(repo_id || '|' || file_path || '|function|' || qualname || '|' || symbol_name || '|' || start_line) AS symbol_id, regexp_matches(symbol_name, '^\p{Lu}') AS is_exported,
    concat_ws(chr(10), symbol_name, qualname, context_header, nullif(identifiers_text, '')) AS search_text
  FROM (SELECT * EXCLUDE (search_text), coalesce(source, 'none') || '.' || symbol_name AS qualname, 'function' AS symbol_kind FROM (SELECT *, regexp_extract(code_text, '\p{L}{4,}') AS symbol_name FROM chunks) WHERE symbol_name <> '')),
rows_of AS (SELECT source, repo_id, revision, file_path, extension, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS start_line FROM split),
toks AS (SELECT * EXCLUDE (line), left(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), 240) AS context_snippet, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM (SELECT *, regexp_extract_all(line, '[\p{L}\p{N}_]+') AS ts FROM rows_of)),
refs AS (SELECT *, sha256(repo_id || '|' || revision || '|' || file_path || '|' || ref_kind || '|' || start_line || '|' || pos || '||') AS ref_id, start_line AS end_line, pos AS start_byte, pos + 1 AS end_byte,
    CASE WHEN pos % 2 = 0 THEN [token] ELSE [token, coalesce(source, 'none') || '.' || token] END AS token_texts FROM (SELECT *, ['call', 'import', 'identifier'][pos % 3 + 1] AS ref_kind FROM toks))
"""

VECTORS = """
vec_files AS (SELECT files.*, embedding::DOUBLE[] AS vec FROM files LEFT JOIN embeddings ON vec_id = doc_id),
vec_chunks AS (SELECT chunks.*, CASE WHEN block = 0 THEN embedding::DOUBLE[] END AS vec FROM chunks LEFT JOIN embeddings ON vec_id = doc_id),
vec_symbols AS (SELECT symbols.*, CASE WHEN block = 0 THEN embedding::DOUBLE[] END AS vec FROM symbols LEFT JOIN embeddings ON vec_id = doc_id)
"""


def whitespace_tokens(x: str, longest: int | None = 128) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS}+'), lambda t: t <> ''" + (f" AND length(t) <= {longest})" if longest else ")")


def simple_tokens(x: str, longest: int | None = 256) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''" + (f" AND length(t) <= {longest})" if longest else ")")


def prefix_tokens(x: str, least: int, most: int) -> str:
    return f"list_transform(range({least}, least(length({x}), {most}) + 1), lambda n: left(lower({x}), n))"


def parts(x: str) -> str:
    """Parts of identifiers of a text, two characters at least; repeats stay."""
    joined = f"array_to_string(regexp_extract_all({x}, '{IDENT}'), ' ')"
    spaced = f"regexp_replace(regexp_replace(regexp_replace({joined}, '[-_]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({spaced}), '{WS}+'), lambda p: length(p) >= 2)"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def query_parts(x: str) -> str:
    """The first 32 distinct parts that are no stop words."""
    kept = f"list_filter({parts(x)}, lambda p: NOT list_contains({words(fixed.QUERY_STOP_WORDS)}, p))"
    return f"(WITH e AS (SELECT v, min(i) AS i FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT {kept} AS l)) GROUP BY v) SELECT coalesce(list(v ORDER BY i)[1:32], []) FROM e)"


def bm25(name: str, queries: str, rows: str, tokens: str, key: str, limit: int, where: str = "true") -> str:
    """CTEs that end in ``name``: (query_id, id, rank, raw_score). ``queries`` has query_id and terms."""
    a = name
    return f"""
{a}_t AS (SELECT {key} AS id, ({where}) AS keep, {tokens} AS toks FROM {rows}),
{a}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM {a}_t),
{a}_q AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM {queries}),
{a}_e AS (SELECT id, keep, len(toks) AS dl, unnest(toks) AS term FROM {a}_t),
{a}_h AS (SELECT id, keep, dl, term, count(*) AS tf FROM {a}_e WHERE term IN (SELECT term FROM {a}_q) GROUP BY ALL),
{a}_i AS (SELECT term, ln(1 + ((SELECT n FROM {a}_s) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {a}_h GROUP BY term),
{a}_c AS (SELECT query_id, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM {a}_s)))), 6) AS raw_score FROM {a}_h JOIN {a}_i USING (term) JOIN {a}_q USING (term) WHERE keep GROUP BY query_id, id),
{a} AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, id) - 1 AS rank, raw_score FROM {a}_c) WHERE rank < {limit})"""


def nearest(name: str, queries: str, rows: str, key: str, limit: int, where: str = "true") -> str:
    """CTE ``name``: (query_id, id, rank, raw_score) by squared distance; ``queries`` has query_id and vector."""
    return f"""
{name}_d AS (SELECT query_id, {key} AS id, round(list_sum(list_transform(list_zip(vec, vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM {rows} JOIN (SELECT * FROM {queries} WHERE vector IS NOT NULL) ON vec IS NOT NULL AND len(vec) = len(vector) WHERE {where}),
{name} AS (SELECT query_id, id, rank, round(1 / (1 + d), 6) AS raw_score FROM (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS rank FROM {name}_d) WHERE rank < {limit})"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def unquoted(x: str) -> str:
    v = strip(x)
    return f"(CASE WHEN length({v}) >= 2 AND left({v}, 1) = right({v}, 1) AND left({v}, 1) IN ('\"', '''', '`') THEN {strip(f'substr({v}, 2, length({v}) - 2)')} ELSE {v} END)"


def bare(x: str, lead: bool) -> str:
    out = unquoted(x)
    for pattern in (["^@+"] if lead else []) + [rf"\(\){WS}*\z", rf"\({WS}*\z", rf"\){WS}*\z", r"[;,:]+\z"]:
        out = f"regexp_replace({out}, '{pattern}', '')"
    return out


def fuzzy_plan(queries: str) -> str:
    """(query_id, query, symbol_token, qual_token, fuzziness, prefix_length)."""
    return rf"""(SELECT query_id, query, lower(tok) AS symbol_token, CASE WHEN raw LIKE '%.%' OR raw LIKE '%::%' OR raw LIKE '%#%' THEN lower(raw) END AS qual_token,
    CASE WHEN length(tok) <= 2 THEN 0 WHEN length(tok) <= 5 THEN 1 ELSE 2 END AS fuzziness, CASE WHEN length(tok) >= 10 THEN 2 WHEN length(tok) >= 6 THEN 1 ELSE 0 END AS prefix_length
  FROM (SELECT *, string_split_regex(string_split(raw, '::')[-1], '[.#]')[-1] AS tok FROM (SELECT query_id, query, {bare('query', True)} AS raw FROM {queries})) WHERE regexp_matches(raw, '^{CHAIN}\z') AND length(tok) >= 4)"""


#: The function counts bytes; tokens are ASCII, so a letter that is not may be any one byte that no token has.
ONE_BYTE = r"regexp_replace(name, '[^\x00-\x7F]', '?', 'g')"


def fuzzy(name: str, plans: str, rows: str, value: str, key: str, limit: int, token: str = "symbol_token", where: str = "true") -> str:
    return f"""
{name}_n AS (SELECT DISTINCT lower({value}) AS name FROM {rows}),
{name}_x AS (SELECT query_id, name, d FROM (SELECT query_id, name, levenshtein({ONE_BYTE}, {token}) AS d, row_number() OVER (PARTITION BY query_id ORDER BY levenshtein({ONE_BYTE}, {token}), name) AS place FROM {plans} p JOIN {name}_n ON {token} IS NOT NULL AND left(name, p.prefix_length) = left({token}, p.prefix_length) AND abs(length(name) - length({token})) <= fuzziness WHERE levenshtein({ONE_BYTE}, {token}) <= fuzziness) WHERE place <= {fixed.MAX_EXPANSIONS}),
{name} AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, id) - 1 AS rank, raw_score FROM (SELECT query_id, {key} AS id, 1 / (1 + d)::DOUBLE AS raw_score FROM {name}_x JOIN {rows} ON lower({value}) = name WHERE {where})) WHERE rank < {limit})"""


def usage_token(x: str) -> str:
    dotted = f"regexp_replace({bare(x, False)}, '::|#', '.', 'g')"
    ps = rf"list_filter(list_transform(string_split({dotted}, '.'), lambda p: {strip('p')}), lambda p: p <> '')"
    return rf"(SELECT CASE WHEN regexp_matches(base, '^{IDENT}\z') THEN struct_pack(base := base, qualified := CASE WHEN regexp_matches(recv, '^{IDENT}\z') AND recv NOT IN ('this', 'self', 'super', 'cls') THEN recv || '.' || base END) END FROM (SELECT ps[-1] AS base, ps[-2] AS recv FROM (SELECT {ps} AS ps)))"


def usage_tokens(x: str) -> str:
    q = strip(x)
    chains = f"list_filter(regexp_extract_all({q}, '{CHAIN}'), lambda c: NOT list_contains({words(fixed.USAGE_STOP_WORDS)}, lower(c)))"
    return f"coalesce({usage_token(f'nullif(regexp_extract({q}, ' + chr(39) + '`([^`]+)`' + chr(39) + ', 1), ' + chr(39) * 2 + ')')}, {usage_token(f'nullif(regexp_extract({q}, ' + chr(39) + '[' + chr(34) + chr(39) * 2 + ']([^' + chr(34) + chr(39) * 2 + ']+)[' + chr(34) + chr(39) * 2 + ']' + chr(39) + ', 1), ' + chr(39) * 2 + ')')}, {usage_token(f'{chains}[-1]')})"


ROUTE = r"""CASE WHEN starts_with(lower(q), 'where used') OR starts_with(lower(q), 'find usages') OR (starts_with(lower(q), 'where is') AND contains(lower(q), 'used')) THEN 'usage'
  WHEN contains(q, '"') OR contains(q, '''') OR contains(q, '`') OR regexp_matches(q, '(?i)error:|exception|traceback') THEN 'exact_text'
  WHEN contains(q, chr(10)) OR regexp_matches(q, '[{};]|=>|(^|[^A-Za-z0-9_])(class|function|def|import|export|return)([^A-Za-z0-9_]|\z)') THEN 'similar_code'
  WHEN regexp_matches(q, '[A-Za-z_][A-Za-z0-9_]*[\x09-\x0D\x20]*\(|[A-Za-z0-9_]+\.[A-Za-z0-9_]+|[A-Za-z0-9_]+::[A-Za-z0-9_]+|[A-Z][a-z]+[A-Z][A-Za-z0-9]*') OR contains(lower(q), 'defined') OR contains(lower(q), 'definition') THEN 'definition'
  ELSE 'concept' END"""

TEST_PATH = "(contains(lower(file_path), '__tests__') OR contains(lower(file_path), '/test/') OR contains(lower(file_path), '.spec.') OR contains(lower(file_path), '.test.'))"


def fused(channels: list[tuple[str, str, str]], intent: str, attributes: str, k: int, export: bool = False, tests: bool = True, lexical: str | None = None, kinds: bool = False) -> str:
    """CTEs ending in ``hits``. ``channels``: (CTE, source, channel); ``attributes``: a relation (tbl, id, file_path, title, snippet, is_exported, ref_kind); ``lexical``: the relation of queries, if overlap counts."""
    weights = fixed.CHANNEL_WEIGHTS[intent]
    union = " UNION ALL ".join(f"SELECT query_id, '{s.split('.')[0]}' AS tbl, id, rank, {n} AS nth, '{c}' AS channel, {weights.get(s, fixed.OTHER_VECTOR_WEIGHT if c == 'vector' else fixed.OTHER_TEXT_WEIGHT)}::DOUBLE AS w FROM {cte}" for n, (cte, s, c) in enumerate(channels))
    score = "rrf"
    if export:
        score += f" * (CASE WHEN tbl = 'symbols' AND is_exported THEN {fixed.EXPORT_BOOST}::DOUBLE ELSE 1 END)"
    if kinds:
        score += " * (CASE ref_kind WHEN 'call' THEN 1.15::DOUBLE WHEN 'import' THEN 1.1::DOUBLE WHEN 'string_literal' THEN 0.75::DOUBLE ELSE 1 END)"
    if tests:
        score += f" * (CASE WHEN {TEST_PATH} THEN 0.6::DOUBLE ELSE 1 END)"
    over = ""
    if lexical:
        score += " * (CASE WHEN has_vector AND overlap > 0 THEN 1 + least(0.25::DOUBLE, overlap * 0.05::DOUBLE) ELSE 1 END)"
        if intent in ("definition", "similar_code"):
            score += " * (CASE WHEN has_vector AND NOT has_fts AND overlap = 0 AND len(qp) > 0 THEN 0.9::DOUBLE ELSE 1 END)"
        over = f", qparts AS (SELECT query_id, {query_parts('query')} AS qp FROM {lexical}), shown AS (SELECT s.*, qp, len(list_intersect(qp, {parts('concat_ws(chr(10), title, snippet, file_path)')})) AS overlap FROM shown0 s JOIN qparts USING (query_id))"
    else:
        over = ", shown AS (SELECT * FROM shown0)"
    return f"""
said AS ({union}),
merged AS (SELECT query_id, tbl, id, round(sum(w / (61 + rank)), 9) AS rrf, min(nth * 1000000 + rank) AS ord, bool_or(channel = 'fts') AS has_fts, bool_or(channel = 'vector') AS has_vector FROM said GROUP BY ALL),
shown0 AS (SELECT * FROM merged JOIN {attributes} USING (tbl, id)){over},
scored AS (SELECT *, round({score}, 9) AS score FROM shown),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, id) AS f FROM scored),
nths AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY f) - 1 AS nth FROM firsts),
spread AS (SELECT * REPLACE (round(score * (1 / (1 + nth * 0.25::DOUBLE)), 9) AS score) FROM nths),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS pos FROM spread) WHERE pos <= {k})"""


SYMBOL_HITS = "(SELECT 'symbols' AS tbl, symbol_id AS id, file_path, start_line, end_line, qualname AS title, left(code_text, 200) AS snippet, is_exported, NULL AS ref_kind FROM symbols)"
CHUNK_HITS = "(SELECT 'chunks' AS tbl, chunk_id AS id, file_path, start_line, end_line, chunk_kind AS title, left(code_text, 240) AS snippet, false AS is_exported, NULL AS ref_kind FROM chunks)"
FILE_HITS = "(SELECT 'files' AS tbl, file_id AS id, file_path, 1 AS start_line, 1 AS end_line, file_path AS title, left(file_summary_text, 240) AS snippet, false AS is_exported, NULL AS ref_kind FROM files)"
BOTH_HITS = f"(SELECT * FROM {SYMBOL_HITS} UNION ALL SELECT * FROM {CHUNK_HITS})"
