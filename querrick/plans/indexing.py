"""From a source tree to the tables of a store: list, compare, extract, embed, merge."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract.rows import extracted, tables
from ..operators import embedding, snapshots
from ..sources.config import Config
from ..sources.listing import listed, snapshot, with_texts
from ..sources.store import BY_FILE, KEYS, Store, upserted, without_files

VECTORS = {"symbols": "vec_summary", "chunks": "vec_code", "files": "vec_file"}


class Incompatible(RuntimeError):
    """The store's schema is another one; index again with force."""


class Cancelled(RuntimeError):
    """An indexing run was told to stop."""


@dataclass
class Indexer:
    """Indexes the tree at ``root`` into ``store``. One run at a time: callers that come meanwhile get the running one's result."""

    store: Store
    root: str
    embedder: embedding.Embedder
    config: Config = Config()
    on_phase: Callable[[str], None] = lambda phase: None

    def __post_init__(self) -> None:
        self._lock, self._running, self._cancel = threading.Lock(), None, threading.Event()

    def cancel(self) -> None:
        """The run stops before its next phase and leaves the store as it was; running jobs of its group are interrupted."""
        self._cancel.set()
        self.store.spark.interruptTag("index")

    def index(self, force: bool = False) -> dict[str, int]:
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = {"done": threading.Event(), "result": None, "error": None}
            run = self._running
        if not mine:
            run["done"].wait()
            if run["error"]:
                raise run["error"]
            return run["result"]
        try:
            self._cancel.clear()
            self.store.spark.addTag("index")
            run["result"] = self._index(force)
            return run["result"]
        except Exception as error:
            run["error"] = error
            raise
        finally:
            self.store.spark.removeTag("index")
            with self._lock:
                self._running = None
            run["done"].set()

    def _phase(self, name: str) -> None:
        if self._cancel.is_set():
            raise Cancelled(name)
        self.on_phase(name)

    def _index(self, force: bool) -> dict[str, int]:
        spark, store = self.store.spark, self.store
        self._phase("init")
        told = store.compatibility()
        if told["status"] in ("needs_reindex", "corrupt_manifest") and not force:
            raise Incompatible(told["message"])
        if force:
            manifest = store.reset() if told["status"] == "compatible" else store.save(type(store.manifest())())
        else:
            manifest = store.manifest()
        self._phase("scan")
        previous = store.read("snapshot", manifest) if "snapshot" in manifest.tables else None
        now = store.write("snapshot", snapshot(listed(spark, self.root, self.config.extensions), previous, self.root))
        current = spark.read.schema(store.schema("snapshot")).parquet(f"{store.root}/{now}")
        changes = snapshots.diff(previous, current).persist()
        count = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        stats = {"files_new": count.get("new", 0), "files_modified": count.get("modified", 0), "files_deleted": count.get("deleted", 0)}
        if not any(stats.values()):
            changes.unpersist()
            return manifest.stats | stats | {"embeddings_computed": 0, "embeddings_cached": 0}
        self._phase("chunk")
        texts = with_texts(current.join(changes.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi").select("file_path", "size", "mtime"), self.root)
        staged = f"{store.root}/staging/{uuid.uuid4().hex}"
        texts.select("file_path", F.col("hash").alias("file_hash"), "content").write.parquet(f"{staged}/texts")
        held = spark.read.parquet(f"{staged}/texts")
        extracted(held, self.config.chunk_max_size).write.parquet(f"{staged}/rows")
        made = tables(spark.read.parquet(f"{staged}/rows"), held, self.root)
        self._phase("embed")
        inputs = None
        for name in VECTORS:
            some = made[name].select(F.col("embed_hash").alias("input_hash"), F.col("embed_input").alias("input"))
            inputs = some if inputs is None else inputs.unionByName(some)
        cache = store.read("embedding_cache", manifest)
        wanted, _ = embedding.split_by_cache(embedding.unique_inputs(inputs), cache)
        stats["embeddings_cached"] = wanted.count()
        embedding.refreshed(inputs, cache, self.embedder).write.parquet(f"{staged}/vectors")
        fresh = spark.read.schema(store.schema("embedding_cache")).parquet(f"{staged}/vectors")
        stats["embeddings_computed"] = fresh.count()
        vectors = cache.unionByName(fresh)
        self._phase("persist")
        files = embedding.attach(made["files"], vectors, "vec_file")
        rows = {"files": files} | {n: embedding.attach(made[n], vectors, VECTORS[n], files=files) for n in ("symbols", "chunks")}
        rows["refs"] = made["refs"].join(files.select("file_path").distinct(), "file_path", "left_semi")
        folders = {"embedding_cache": store.write("embedding_cache", upserted(cache, fresh, "input_hash"))}
        for name in BY_FILE:
            kept = without_files(store.read(name, manifest), changes)
            folders[name] = store.write(name, upserted(kept, store._typed(name, rows[name]), KEYS[name]))
        # files that got no vector are looked at again next time
        indexed = spark.read.schema(store.schema("files")).parquet(f"{store.root}/{folders['files']}").select("file_path")
        folders["snapshot"] = store.write("snapshot", current.join(indexed, "file_path", "left_semi"))
        self._phase("finalize")
        manifest.tables |= folders
        manifest.repo_id = manifest.repo_id or spark.range(1).select(F.sha2(F.lit(self.root), 256)).first()[0]
        store.save(manifest)
        manifest.stats = store.counts()
        store.save(manifest)
        changes.unpersist()
        fs, path = store._path("staging")
        fs.delete(path, True)
        store.vacuum()
        return manifest.stats | stats

    def on_changes(self, paths: DataFrame) -> None:
        """For a watcher: whatever the paths, the tree is compared as a whole."""
        self.index()
