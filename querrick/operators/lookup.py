"""Reads of single entities and of what surrounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import MAX_CODE_CHARS
from ..functions.text import clamp_lines, collapse, truncate

SYMBOL_COLUMNS = ("symbol_id", "repo_id", "revision", "file_path", "extension", "start_line", "end_line", "symbol_kind", "symbol_name", "qualname", "parent_symbol_id", "signature", "docstring", "is_exported", "decorator_names", "context_header", "code_text", "identifiers", "identifier_parts", "called_names", "string_literals", "content_hash", "file_hash")
CHUNK_COLUMNS = ("chunk_id", "repo_id", "revision", "file_path", "extension", "start_line", "end_line", "owner_symbol_id", "chunk_kind", "context_header", "code_text", "identifiers", "identifier_parts", "called_names", "string_literals", "content_hash", "file_hash")
FILE_COLUMNS = ("file_id", "repo_id", "revision", "file_path", "extension", "file_hash", "imports", "exports", "top_level_doc", "file_summary_text")


def project(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Those of the columns that the table has."""
    return rows.select(*(c for c in columns if c in rows.columns))


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of that id (the filter reaches the scan); no row if there is none."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def by_path(rows: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Rows of a file, in order of their first lines."""
    found = rows.where(F.col("file_path") == F.lit(path))
    if "start_line" in rows.columns:
        found = found.orderBy("start_line", *(c for c in ("symbol_id", "chunk_id", "ref_id") if c in rows.columns))
    return found if limit is None else found.limit(limit)


def chunks_of(chunks: DataFrame, symbol: str, limit: int) -> DataFrame:
    """Chunks that a symbol owns, in order of their first lines."""
    return chunks.where(F.col("owner_symbol_id") == F.lit(symbol)).orderBy("start_line", "chunk_id").limit(limit)


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """``(file_path, line_no, line)`` of all lines, numbered from 1."""
    return files.select("file_path", F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("n", "line")).select("file_path", (F.col("n") + 1).alias("line_no"), "line")


def line_ranges(files: DataFrame, ranges: DataFrame, most: int = 200, content: str = "content") -> DataFrame:
    """``(file_path, start, end, truncated, text)`` of each range ``(file_path, start_line, end_line)``, cut to ``most`` lines from 1 on and to the file's end.

    Slices the split text of the file; lines are not exploded. Ranges of unknown
    files have no row; null content is empty.
    """
    clamped = ranges.select("file_path", clamp_lines(F.col("start_line"), F.col("end_line"), most).alias("r")).select("file_path", "r.*")
    split = F.split(F.coalesce(F.col(content), F.lit("")), "\n")
    text = F.array_join(F.slice(split, F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    return files.select("file_path", content).join(clamped, "file_path").select("file_path", "start", "end", "truncated", text.alias("text"))


def snippet(content: Column, line: Column, most: int = 240) -> Column:
    """The lines around a line (one before and one after), white space collapsed, cut."""
    first = F.greatest(line - 1, F.lit(1))
    return F.substring(collapse(F.array_join(F.slice(F.split(content, "\n"), first.cast("int"), (line + 2 - first).cast("int")), " ")), 1, most)


def details(symbols: DataFrame, with_code: bool = True, most: int = MAX_CODE_CHARS) -> DataFrame:
    """Symbols, their code cut to ``most`` characters, flagged by ``code_truncated``, or left out."""
    rows = project(symbols, SYMBOL_COLUMNS)
    if not with_code:
        return rows.drop("code_text")
    return rows.withColumn("code_truncated", F.length("code_text") > most).withColumn("code_text", truncate(F.col("code_text"), most, "\n…(truncated)…"))


def symbol_details(symbols: DataFrame, symbol: str, with_code: bool = True, most: int = MAX_CODE_CHARS) -> DataFrame:
    """One symbol's ``details``."""
    return details(by_id(symbols, "symbol_id", symbol), with_code, most)


def surroundings(tables: dict[str, DataFrame], table: str, ids: DataFrame, limit: int = 25) -> DataFrame:
    """What surrounds each entity of ``ids`` (column ``id``): ``(id, relation, pos, related_id)``.

    For a symbol: its file, the symbols of that file (``limit``) and its chunks;
    for a chunk: its file, the symbols of the file, its owner and the owner's
    chunks; for a file: its symbols. Ids that are not there have no rows.
    """
    symbols, chunks, files = (tables[t] for t in ("symbols", "chunks", "files"))
    from pyspark.sql import Window

    def first(rows: DataFrame, of: str, related: str, *order: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(of).orderBy(*order))
        return rows.select(of, related, *order[:-1]).withColumn("pos", place.cast("long")).where(F.col("pos") <= limit).select(of, F.col(related).alias("related_id"), "pos")

    def said(rows: DataFrame, relation: str) -> DataFrame:
        return rows.select("id", F.lit(relation).alias("relation"), "pos", "related_id")

    # what surrounds a file or belongs to an owner is found once, however many of its entities are asked for
    key = {"symbols": "symbol_id", "chunks": "chunk_id", "files": "file_id"}[table]
    own = ["file_path"] + (["owner_symbol_id"] if table == "chunks" else [])
    base = ids.select("id").distinct().join(tables[table].select(F.col(key).alias("id"), *own), "id")
    out = said(base.join(first(symbols, "file_path", "symbol_id", "start_line", "symbol_id"), "file_path"), "neighbor")
    if table != "files":
        out = out.unionByName(said(base.join(first(files, "file_path", "file_id", "file_id"), "file_path"), "file"))
        owner = base.withColumn("owner_symbol_id", F.col("id")) if table == "symbols" else base.where("owner_symbol_id is not null")
        held = owner.join(first(chunks.where("owner_symbol_id is not null"), "owner_symbol_id", "chunk_id", "start_line", "chunk_id"), "owner_symbol_id")
        out = out.unionByName(said(held, "chunk" if table == "symbols" else "sibling"))
    if table == "chunks":
        owned = base.join(symbols.select(F.col("symbol_id").alias("owner_symbol_id")), "owner_symbol_id")
        out = out.unionByName(owned.select("id", F.lit("owner").alias("relation"), F.lit(1).cast("long").alias("pos"), F.col("owner_symbol_id").alias("related_id")))
    return out
