"""Requests of one caller: checked, planned, run, and shaped into plain values."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import fixed
from ..functions import intent as intents
from ..functions import text
from ..operators import evaluation, fusion, lookup
from ..operators.embedding import Embedder
from ..operators.scope import Scope
from ..sources.store import Store
from . import search as plans
from .indexing import Indexer


def bounded(name: str, value: int) -> int:
    """The value, if it is within the bounds of the request."""
    low, high = fixed.BOUNDS[name]
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def plain(value: object) -> object:
    """Rows, arrays and numbers of other libraries as lists, dicts and numbers."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value.item() if hasattr(value, "item") and not isinstance(value, (str, bytes)) else value


def fit(make: Callable[[int, bool], dict], k: int, explain: bool, most: int = fixed.RESPONSE_BYTES) -> dict:
    """The answer within ``most`` bytes of JSON: first without explanations, then for half of ``k``, and so on."""
    most = min(most, fixed.RESPONSE_BYTES_MOST)
    while True:
        answer = make(k, explain)
        if len(json.dumps(answer, ensure_ascii=False).encode()) <= most or (k <= 1 and not explain):
            return answer
        explain, k = False, (k if explain else max(1, k // 2))


def safe_path(root: str, path: str) -> Path:
    """A file below the root; other paths raise ValueError."""
    top = Path(root).resolve()
    full = (top / path.replace("\\", "/").lstrip("/")).resolve()
    if full == top:
        raise ValueError("a file path is needed, not the root")
    if top not in full.parents:
        raise ValueError(f"{path} is outside of the root")
    return full


class Engine:
    """Searches and lookups over a store's current version. Refuses stores of another schema."""

    def __init__(self, store: Store, embedder: Embedder | None = None, root: str | None = None) -> None:
        self.store, self.embedder, self.root = store, embedder, root

    def tables(self) -> dict[str, DataFrame]:
        told = self.store.compatibility()
        if told["status"] != "compatible":
            raise RuntimeError(f"{told['status']}: {told['message'] or 'nothing is indexed'}")
        manifest = self.store.manifest()
        return {n: self.store.read(n, manifest) for n in ("symbols", "chunks", "files", "refs")}

    def _query(self, text_: str) -> tuple[DataFrame, list[str]]:
        """The query as a table of one row; without its vector, and with a warning, if there is none to be had."""
        vector, warnings = None, []
        if self.embedder is None:
            warnings.append("embeddings_unavailable")
        else:
            try:
                vector = self.embedder.embed([text_])[0]
            except Exception as error:  # noqa: BLE001  search goes on without vectors
                warnings.append(f"embeddings_error: {error}")
        return self.store.spark.createDataFrame([(0, text_, vector)], "query_id int, query string, vector array<double>"), warnings

    def route(self, query: str) -> str:
        return self.store.spark.createDataFrame([(query,)], "q string").select(intents.route(F.col("q"))).first()[0]

    def search(self, query: str, intent: str = "auto", k: int = fixed.DEFAULT_K, scope: Scope | None = None, explain: bool = True) -> dict:
        """Hits in the groups ``definitions``, ``usages``, ``files`` and ``blocks``, with warnings and what to look at next."""
        if not query or not query.strip():
            raise ValueError("the query is empty")
        bounded("k", k)
        if intent not in ("auto", *plans.BY_INTENT):
            raise ValueError(f"unknown intent {intent}")
        tables = self.tables()
        used = self.route(query) if intent == "auto" else intent
        asked, warnings = self._query(query)
        hits = plans.BY_INTENT[used](tables, asked, k, scope).orderBy("grp", "pos").collect()
        groups: dict[str, list[dict]] = {n: [] for n in ("definitions", "usages", "files", "blocks")}
        for h in hits:
            row = plain(h)
            hit = {c: row[c] for c in ("table", "id", "file_path", "start_line", "end_line", "title", "snippet")} | {"score": round(row["score"], 8)}
            groups[row["grp"]].append(hit | ({"why": {"channels": row["channels"], "priors": row["priors"]}} if explain else {}))
        return {"query": query, "intent": used, "groups": groups, "warnings": warnings, "next_actions": fusion.next_actions(groups)}

    def get_symbol(self, symbol: str, with_code: bool = True, most: int = fixed.MAX_CODE_CHARS) -> dict | None:
        row = lookup.symbol_details(self.tables()["symbols"], symbol, with_code, most).first()
        return plain(row) if row else None

    def find_usages(self, symbol_id: str | None = None, symbol_name: str | None = None, k: int = 200, scope: Scope | None = None) -> dict:
        """References of a symbol by file; ``total`` counts them."""
        bounded("usages_k", k)
        tables, name = self.tables(), (symbol_name or "").strip()
        if symbol_id and (row := lookup.by_id(tables["symbols"], "symbol_id", symbol_id.strip()).select("symbol_name").first()):
            name = row[0]
        if not name:
            raise ValueError("a symbol id or name is needed")
        asked = self.store.spark.createDataFrame([(0, name)], "query_id int, symbol_name string")
        rows = fusion.grouped_usages(plans.find_usages(tables, asked, k, scope)).orderBy("file_path").collect()
        files = [{"file_path": r["file_path"], "refs": plain(r["refs"])} for r in rows]
        return {"symbol_name": name, "by_file": files, "total": sum(r["n"] for r in rows)}

    def expand_context(self, table: str, entity: str, limit: int = 25) -> dict:
        """An entity with its file, neighbours, chunks and owner; ``found`` is false if it is not there."""
        bounded("limit", limit)
        tables = self.tables()
        missing = {"found": False, "table": table, "id": entity}
        if table not in ("symbols", "chunks", "files"):
            return missing
        key, columns = {"symbols": ("symbol_id", lookup.SYMBOL_COLUMNS), "chunks": ("chunk_id", lookup.CHUNK_COLUMNS), "files": ("file_id", lookup.FILE_COLUMNS)}[table]
        row = lookup.project(lookup.by_id(tables[table], key, entity), columns).first()
        if row is None:
            return missing
        some = lambda rows, shown: [plain(r) for r in lookup.project(rows, shown).collect()]
        path = row["file_path"]
        out = {"found": True, "table": table, table[:-1]: plain(row), "neighbors": some(lookup.by_path(tables["symbols"], path, limit), ("symbol_id", "symbol_kind", "symbol_name", "qualname", "start_line", "end_line", "signature", "is_exported"))}
        if table != "files":
            out["file"] = next(iter(some(lookup.by_path(tables["files"], path, 1), lookup.FILE_COLUMNS)), None)
        if table == "symbols":
            out["chunks"] = some(lookup.chunks_of(tables["chunks"], entity, limit), lookup.CHUNK_COLUMNS)
        if table == "chunks":
            owner = row["owner_symbol_id"]
            out["owner_symbol"] = self.get_symbol(owner) if owner else None
            out["sibling_chunks"] = some(lookup.chunks_of(tables["chunks"], owner, limit), lookup.CHUNK_COLUMNS) if owner else []
        return out

    def read_file_lines(self, path: str, start: int, end: int, most: int = 200) -> dict:
        """Lines of a file of the tree, at most ``most``."""
        bounded("max_lines", most)
        if self.root is None:
            raise RuntimeError("the engine has no source tree")
        rows = safe_path(self.root, path).read_text(encoding="utf-8", errors="replace").split("\n")
        start = max(1, int(start))
        last = max(start, int(end))
        stop = min(last, start + most - 1)
        return {"file_path": path, "start_line": start, "end_line": min(stop, len(rows)), "total_lines": len(rows), "truncated": stop < last, "lines": rows[start - 1 : stop]}

    def status(self) -> dict:
        """Compatibility, counts and times of the store."""
        told = self.store.compatibility()
        if told["status"] != "compatible":
            return told
        manifest = self.store.manifest()
        return told | {"stats": manifest.stats, "created_at": manifest.created_at, "updated_at": manifest.updated_at, "revision": manifest.revision}

    def build_index(self, indexer: Indexer, force: bool = False) -> dict:
        return indexer.index(force)

    def evaluate(self, seed: int = fixed.EVAL_SEED, samples: dict[str, int] | None = None, scope: Scope | None = None) -> dict:
        """Metrics of the five kinds of queries, each sampled from the store and run as one batch."""
        tables, out = self.tables(), {}
        for name, (n, k) in fixed.EVAL_BUCKETS.items():
            n = bounded("samples", (samples or {}).get(name, n))
            asks = evaluation_queries(tables, name, n, seed)
            rows = asks.collect()
            if not rows:
                out[name] = {"queries": 0, "metrics": {}, "latency_ms": 0, "failures": []}
                continue
            began = time.monotonic()
            asked = self.store.spark.createDataFrame(rows, asks.schema)
            if self.embedder is not None:
                vectors = [(r["query_id"], v) for r, v in zip(rows, self.embedder.embed([r["query"] for r in rows]), strict=True)]
                asked = asked.join(self.store.spark.createDataFrame(vectors, "query_id string, vector array<double>"), "query_id")
            hits = plans.BY_INTENT[name](tables, asked, k, scope).select("query_id", "grp", "pos", "id", "file_path", "start_line", "end_line").persist()
            hits.count()
            took = (time.monotonic() - began) * 1000
            ranks = evaluation.rank_of(asked.select("query_id", "id"), hits, k)
            if name in ("definition", "similar_code"):
                metrics = ranks.agg(evaluation.reciprocal_rank(F.col("rank")).alias("mrr_at_10"), evaluation.ratio(F.col("rank").between(1, 3)).alias("top3_rate"))
            elif name == "exact_text":
                metrics = evaluation.span_hits(asked.select("query_id", "file_path", "start_line", "end_line"), hits, k).agg(evaluation.ratio(F.col("hit")).alias("hit_at_5"))
            elif name == "usage":
                metrics = ranks.agg(evaluation.ratio(F.col("rank") > 0).alias("hit_at_20"))
            else:
                near = hits.join(asked.select("query_id", F.col("id").alias("__id"), F.col("file_path").alias("__path")), "query_id").where("id = __id or file_path = __path").select("query_id").distinct().withColumn("hit", F.lit(True))
                metrics = asked.select("query_id").join(near, "query_id", "left").agg(evaluation.ratio(F.coalesce("hit", F.lit(False))).alias("recall_at_50"))
            bad = [plain(r) for r in evaluation.failures(ranks, hits).collect()]
            out[name] = {"queries": len(rows), "metrics": plain(metrics.first()), "latency_ms": round(took / len(rows), 3), "failures": bad}
            hits.unpersist()
        return out


def evaluation_queries(tables: dict[str, DataFrame], bucket: str, n: int, seed: int) -> DataFrame:
    """``(query_id, query, id, file_path, start_line, end_line)``: sampled queries and what each should find."""
    span = ("file_path", "start_line", "end_line")
    if bucket == "definition":
        rows = evaluation.sample_rows(tables["symbols"].select(F.col("symbol_id").alias("id"), "symbol_name", *span), "id", n, seed)
        both = F.array(F.struct(F.lit("#n").alias("n"), F.col("symbol_name").alias("q")), F.struct(F.lit("#m").alias("n"), text.middle_deleted(F.col("symbol_name")).alias("q")))
        return rows.withColumn("a", F.explode(both)).where("a.q is not null").select(F.concat("id", "a.n").alias("query_id"), F.col("a.q").alias("query"), "id", *span)
    if bucket == "concept":
        rows = tables["symbols"].select(F.col("symbol_id").alias("id"), text.normal_doc(F.coalesce("docstring", "signature", F.lit(""))).alias("query"), *span).where(F.length("query") >= 12)
    elif bucket == "exact_text":
        fit_ = F.filter("string_literals", lambda x: F.length(x).between(8, 160))
        rows = tables["chunks"].unionByName(tables["symbols"].withColumnRenamed("symbol_id", "chunk_id"), allowMissingColumns=True).withColumn("query", F.try_element_at(fit_, F.lit(1))).where("query is not null").select(F.col("chunk_id").alias("id"), "query", *span)
    elif bucket == "similar_code":
        rows = tables["chunks"].where(F.length(F.trim("code_text")) >= 40).select(F.col("chunk_id").alias("id"), F.substring("code_text", 1, 600).alias("query"), *span)
    else:
        token = F.col("token_texts")[0]
        rows = tables["refs"].where(F.col("ref_kind").isin("call", "import") & F.length(token).between(2, 80)).select(F.col("ref_id").alias("id"), F.concat(F.lit("where is `"), token, F.lit("` used")).alias("query"), *span)
    return evaluation.sample_rows(rows, "id", n, seed).select(F.col("id").alias("query_id"), "query", "id", *span)


def report(result: dict) -> str:
    """An evaluation as lines of text."""
    out = []
    for name, r in result.items():
        told = ", ".join(f"{k} {v}" for k, v in r["metrics"].items())
        out.append(f"{name}: {r['queries']} queries, {told or 'nothing to ask'}, {r['latency_ms']} ms a query, {len(r['failures'])} failures shown")
    return "\n".join(out)


def stats_lines(stats: dict[str, int]) -> str:
    """Counters of an indexing run as lines of text."""
    return "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in stats.items())
