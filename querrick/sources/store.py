"""Entity tables as Parquet in versions: a change writes a new version, then moves the pointer.

Readers resolve the pointer once, so they see a whole version; a write that
fails leaves the old one in place. All paths go through Hadoop's file systems,
so a store may be anywhere that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import REVISION, SCHEMA_VERSION

KEYS = {"symbols": "symbol_id", "chunks": "chunk_id", "files": "file_id", "refs": "ref_id", "embedding_cache": "input_hash"}
BY_FILE = ("symbols", "chunks", "files", "refs")

SCHEMAS = {
    "symbols": "symbol_id STRING, repo_id STRING, revision STRING, file_path STRING, extension STRING, language_hint STRING, start_line INT, end_line INT, start_byte INT, end_byte INT, symbol_kind STRING, symbol_name STRING, qualname STRING, parent_symbol_id STRING, signature STRING, docstring STRING, is_exported BOOLEAN, decorator_names ARRAY<STRING>, context_header STRING, code_text STRING, search_text STRING, identifiers_text STRING, identifiers ARRAY<STRING>, identifier_parts ARRAY<STRING>, called_names ARRAY<STRING>, string_literals ARRAY<STRING>, content_hash STRING, file_hash STRING, vec_summary ARRAY<FLOAT>",
    "chunks": "chunk_id STRING, repo_id STRING, revision STRING, file_path STRING, extension STRING, start_line INT, end_line INT, start_byte INT, end_byte INT, owner_symbol_id STRING, chunk_kind STRING, context_header STRING, code_text STRING, search_text STRING, identifiers_text STRING, identifiers ARRAY<STRING>, identifier_parts ARRAY<STRING>, called_names ARRAY<STRING>, string_literals ARRAY<STRING>, content_hash STRING, file_hash STRING, vec_code ARRAY<FLOAT>",
    "files": "file_id STRING, repo_id STRING, revision STRING, file_path STRING, extension STRING, file_hash STRING, imports ARRAY<STRING>, exports ARRAY<STRING>, top_level_doc STRING, file_summary_text STRING, vec_file ARRAY<FLOAT>",
    "refs": "ref_id STRING, repo_id STRING, revision STRING, file_path STRING, extension STRING, start_line INT, end_line INT, start_byte INT, end_byte INT, ref_kind STRING, token_texts ARRAY<STRING>, context_snippet STRING, module_name STRING, imported_name STRING",
    "embedding_cache": "input_hash STRING, vector ARRAY<FLOAT>, created_at STRING",
    "snapshot": "file_path STRING, hash STRING, size BIGINT, mtime DOUBLE",
}


def upserted(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of equal key. Of source rows with equal keys one is taken, the first by its columns."""
    rows = source.select(*target.columns)
    one = rows.groupBy(key).agg(F.min(F.struct(*(c for c in target.columns if c != key))).alias("__r")).select(key, "__r.*").select(*target.columns)
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(one)


def without_files(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of other files than the changed ones (``file_path``), by one anti-join."""
    return rows.join(changed.select("file_path").distinct(), "file_path", "left_anti")


def deleted_counts(tables: dict[str, DataFrame], changed: DataFrame) -> DataFrame:
    """``(name, n)``: rows of each table that belong to the changed files."""
    return counts({n: t.join(changed.select("file_path").distinct(), "file_path", "left_semi") for n, t in tables.items()})


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)`` of all tables in one plan."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: How long versions that are no longer current are kept for those who read them.
KEEP_SECONDS = 3600.0


@dataclass
class Manifest:
    """What the store holds; read with defaults for what is missing."""

    repo_id: str = ""
    revision: str = REVISION
    version: int = 1
    schema_version: int = SCHEMA_VERSION
    created_at: str = ""
    updated_at: str = ""
    stats: dict[str, int] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)


class Store:
    """Tables below a folder. ``manifest.json`` names the current folder of each."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int = 64) -> None:
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions

    def _path(self, name: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = path.getFileSystem(conf)
        # beside checksum files a rename takes two steps
        return (jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw() if fs.getUri().getScheme() == "file" else fs), path

    def _read_text(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        fs, path = self._path(name)
        fs, beside = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # one step: readers find the old text or the new one
        if fs.getUri().getScheme() == "file":
            fs.rename(beside, path)
            return
        context = self.spark.sparkContext
        options = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = context._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        whole = fs.makeQualified(path)
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), whole, over)

    def compatibility(self) -> dict[str, object]:
        """``status`` (not_indexed, corrupt_manifest, needs_reindex, compatible), the version needed and the one found, and a message."""
        out = {"required": SCHEMA_VERSION, "found": None, "message": None}
        text = self._read_text("manifest.json")
        if text is None:
            return out | {"status": "not_indexed"}
        try:
            found = json.loads(text).get("schema_version")
        except (ValueError, AttributeError):
            return out | {"status": "corrupt_manifest", "message": "the manifest is unreadable; index again with force"}
        if not isinstance(found, int):
            return out | {"status": "corrupt_manifest", "message": "the manifest has no schema version; index again with force"}
        if found != SCHEMA_VERSION:
            return out | {"status": "needs_reindex", "found": found, "message": f"the index has schema {found}, not {SCHEMA_VERSION}; index again with force"}
        return out | {"status": "compatible", "found": found}

    def manifest(self) -> Manifest:
        text = self._read_text("manifest.json")
        held = json.loads(text) if text else {}
        return Manifest(**{k: v for k, v in held.items() if k in Manifest.__dataclass_fields__})

    def save(self, manifest: Manifest) -> Manifest:
        """Stamps and writes the manifest: from here on readers see what it names."""
        now = datetime.now(UTC).isoformat()
        manifest.created_at, manifest.updated_at = manifest.created_at or now, now
        self._write_text("manifest.json", json.dumps(asdict(manifest)))
        return manifest

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(SCHEMAS[name])

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """A table of the current version; empty and typed if there is none. Vectors of another length than the store's do not count as such."""
        folder = (manifest or self.manifest()).tables.get(name)
        if folder is None:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.root}/{folder}")

    def write(self, name: str, rows: DataFrame) -> str:
        """Writes a new version of a table and returns its folder; it is not current before ``save``."""
        folder = f"{name}/v-{uuid.uuid4().hex}"
        wanted = self.schema(name)
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
        full.write.parquet(f"{self.root}/{folder}")
        return folder

    def upsert(self, changes: dict[str, DataFrame], manifest: Manifest | None = None) -> Manifest:
        """Merges rows into tables by their keys, all tables becoming current at once."""
        manifest = manifest or self.manifest()
        fresh = {n: self.write(n, upserted(self.read(n, manifest), self._typed(n, rows), KEYS[n])) for n, rows in changes.items()}
        manifest.tables |= fresh
        return self.save(manifest)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to the current version of a table."""
        manifest = self.manifest()
        folder = manifest.tables.get(name)
        if folder is None:
            manifest.tables[name] = self.write(name, rows)
            self.save(manifest)
        else:
            self._typed(name, rows).write.mode("append").parquet(f"{self.root}/{folder}")

    def delete_files(self, changed: DataFrame) -> Manifest:
        """Rows of the changed files go from all four tables."""
        manifest = self.manifest()
        manifest.tables |= {n: self.write(n, without_files(self.read(n, manifest), changed)) for n in BY_FILE if n in manifest.tables}
        return self.save(manifest)

    def reset(self, drop_cache: bool = False) -> Manifest:
        """Empty tables; the embedding cache stays unless it is dropped too."""
        manifest = self.manifest()
        manifest.tables = {} if drop_cache else {n: f for n, f in manifest.tables.items() if n == "embedding_cache"}
        manifest.stats = {}
        return self.save(manifest)

    def counts(self) -> dict[str, int]:
        manifest = self.manifest()
        return {r["name"]: r["n"] for r in counts({n: self.read(n, manifest) for n in BY_FILE}).collect()}

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Removes folders that the manifest does not name and that are older than that: readers finish with the version that they began with. Returns how many."""
        manifest, gone = self.manifest(), 0
        newest = (time.time() - keep_seconds) * 1000
        for name in SCHEMAS:
            fs, top = self._path(name)
            if not fs.exists(top):
                continue
            for status in fs.listStatus(top):
                folder = f"{name}/{status.getPath().getName()}"
                if folder != manifest.tables.get(name) and status.getModificationTime() <= newest:
                    gone += bool(fs.delete(status.getPath(), True))
        return gone

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(name)))
