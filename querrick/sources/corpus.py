"""Driver tables as entity tables: documents stand for files, blocks of lines for chunks and symbols, words for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import REVISION
from ..functions import ids
from ..functions.text import collapse, extension

BLOCK_LINES = 4
#: Bytes of text dealt to one task by file; its references take some fifty times as much memory.
DEALT_BYTES = 2_000_000
EXTENSIONS = (".py", ".ts", ".md", ".test.ts", ".go")
REPO = "corpus"
WORD = r"[\p{L}\p{N}_]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Corpus:
    """The entity tables of a folder of driver tables. Nothing is computed before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.repo_id = F.sha2(F.lit(REPO), 256)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def files(self) -> DataFrame:
        """A file a document; its extension follows from the id, so that some paths are tests."""
        path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int")))
        rows = self.raw("documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("content"), path.alias("file_path"))
        rows = rows.withColumns({"repo_id": self.repo_id, "revision": F.lit(REVISION), "extension": extension(F.col("file_path")), "file_hash": F.sha2("content", 256)})
        summary = F.concat(F.lit("File: "), F.col("file_path"), F.lit("\n"), F.element_at(F.split("content", "\n"), 1))
        return rows.withColumns({"file_id": ids.file_id(F.col("repo_id"), F.col("revision"), F.col("file_path")), "file_summary_text": summary})

    @property
    def lines(self) -> DataFrame:
        return self._lines(self.files)

    @staticmethod
    def _lines(files: DataFrame) -> DataFrame:
        return files.select("doc_id", "source", "repo_id", "revision", "file_path", "extension", F.posexplode(F.split("content", "\n")).alias("n", "line"))

    @property
    def chunks(self) -> DataFrame:
        """Blocks of BLOCK_LINES lines, cut within the row."""
        split = F.col("__lines")
        rows = self.files.withColumn("__lines", F.split("content", "\n"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(split) - 1) / BLOCK_LINES).cast("int")), lambda b: F.array_join(F.slice(split, b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), "\n"))
        rows = rows.select("doc_id", "source", "repo_id", "revision", "file_path", "extension", "file_hash", F.size(split).alias("__n"), F.posexplode(blocks).alias("block", "code_text"))
        header = F.concat(F.lit("// File: "), F.col("file_path"))
        rows = rows.withColumns({"start_line": F.col("block") * BLOCK_LINES + 1, "end_line": F.least((F.col("block") + 1) * BLOCK_LINES, F.col("__n")), "chunk_kind": F.lit("block"), "context_header": header})
        rows = rows.withColumn("content_hash", ids.content_hash(F.col("context_header"), F.col("code_text")))
        identifiers = F.array_distinct(F.regexp_extract_all("code_text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
        literals = F.filter(F.split("code_text", "\n"), lambda x: F.length(x).between(8, 160))
        rows = rows.withColumns({"chunk_id": ids.chunk_id(F.lit(""), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content_hash")), "identifiers": identifiers, "string_literals": literals})
        rows = rows.withColumn("identifiers_text", F.array_join("identifiers", " "))
        return rows.withColumn("search_text", F.concat_ws("\n", "context_header", F.nullif(F.col("identifiers_text"), F.lit("")), F.nullif(F.col("code_text"), F.lit("")))).drop("__n")

    @property
    def symbols(self) -> DataFrame:
        """A symbol a block that has a word of four letters; the first such word is its name."""
        rows = self.chunks.withColumn("symbol_name", F.regexp_extract("code_text", r"\p{L}{4,}", 0)).where("symbol_name <> ''")
        rows = rows.withColumns({"symbol_kind": F.lit("function"), "qualname": F.concat(F.coalesce("source", F.lit("none")), F.lit("."), F.col("symbol_name")), "is_exported": F.col("symbol_name").rlike(r"^\p{Lu}")})
        key = ids.symbol_id(F.col("repo_id"), F.col("file_path"), F.col("symbol_kind"), F.col("qualname"), F.lit(None).cast("string"), F.col("symbol_name"), F.col("start_line"))
        text = F.concat_ws("\n", "symbol_name", "qualname", "context_header", F.nullif(F.col("identifiers_text"), F.lit("")))
        return rows.withColumns({"symbol_id": key, "search_text": text})

    @property
    def refs(self) -> DataFrame:
        """A reference a word; kinds take turns, and every other word is qualified by the source."""
        return self._refs(self.lines)

    @property
    def refs_by_file(self) -> DataFrame:
        """``refs`` dealt by file: the texts are shuffled, not the many times larger references, which what goes by file then finds in place."""
        files = self.files.select("doc_id", "source", "content", "file_path", "repo_id", "revision", "extension")
        size = self.raw("documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return self._refs(self._lines(files.repartition(max(8, -(-size // DEALT_BYTES)), "file_path")))

    @staticmethod
    def _refs(lines: DataFrame) -> DataFrame:
        words = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
        rows = lines.select("source", "repo_id", "revision", "file_path", "extension", (F.col("n") + 1).alias("start_line"), F.substring(collapse(F.col("line")), 1, 240).alias("context_snippet"), F.posexplode(words).alias("pos", "token"))
        kind = F.element_at(F.array(F.lit("call"), F.lit("import"), F.lit("identifier")), F.col("pos") % 3 + 1)
        qualified = F.concat(F.coalesce("source", F.lit("none")), F.lit("."), F.col("token"))
        rows = rows.withColumns({"end_line": F.col("start_line"), "start_byte": F.col("pos"), "end_byte": F.col("pos") + 1, "ref_kind": kind, "token_texts": F.when(F.col("pos") % 2 == 0, F.array("token")).otherwise(F.array("token", qualified))})
        none = F.lit(None).cast("string")
        key = ids.ref_id(F.col("repo_id"), F.col("revision"), F.col("file_path"), F.col("ref_kind"), F.col("start_line"), F.col("pos"), none, none)
        return rows.withColumn("ref_id", key).drop("pos")

    def vectors_of(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``(key, file_path, extension, name)``: the document's embedding, of a file its own, of chunks and symbols at the first block only; rows without one go.

        Ids and paths alone meet the embeddings, so that no text is shuffled for them.
        """
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias(name))
        first = rows.where("block = 0") if "block" in rows.columns else rows
        return first.select("doc_id", key, "file_path", "extension").join(vectors, "doc_id").drop("doc_id")

    def tables(self) -> dict[str, DataFrame]:
        """The entity tables, and apart from them their vectors, which only searches by vector read."""
        vectors = {"files.vec_file": self.vectors_of(self.files, "file_id", "vec_file"), "chunks.vec_code": self.vectors_of(self.chunks, "chunk_id", "vec_code"), "symbols.vec_summary": self.vectors_of(self.symbols, "symbol_id", "vec_summary")}
        return {"files": self.files, "chunks": self.chunks, "symbols": self.symbols, "refs": self.refs} | vectors
