"""Rows of files, symbols, chunks and references from file texts, in one pass over the files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LANGUAGES, MARKDOWN_EXTENSIONS, MAX_CHUNK_CHARS, OVERLAP_LINES, OWNED_CHUNK_CHARS, REVISION
from ..functions import ids
from ..functions.text import language_hint
from .parse import Lines, dedupe, facts, parse, unique
from .pieces import Piece, by_lines, by_statements, markdown, merge_small

TEXTS = "ARRAY<STRING>"
#: One row a symbol, chunk, reference or file; ``entity`` says which, and columns of others are null.
TAGGED = f"entity STRING, ord INT, file_path STRING, extension STRING, file_hash STRING, kind STRING, name STRING, class_name STRING, start_line INT, end_line INT, start_byte INT, end_byte INT, signature STRING, docstring STRING, is_exported BOOLEAN, decorator_names {TEXTS}, context_header STRING, code_text STRING, identifiers {TEXTS}, identifier_parts {TEXTS}, called_names {TEXTS}, string_literals {TEXTS}, token_texts {TEXTS}, context_snippet STRING, module_name STRING, imported_name STRING, imports {TEXTS}, exports {TEXTS}, status STRING, owned BOOLEAN"


def header(path: str, owner: str | None = None, function: str | None = None, continued: bool = False) -> str:
    """The line that says where a piece of code is."""
    parts = [f"File: {path}"] + ([f"Class: {owner}"] if owner else []) + ([f"Function: {function}"] if function else []) + (["(continued)"] if continued else [])
    return "// " + ", ".join(parts)


def top_level_doc(text: str, language: str | None, ext: str) -> str | None:
    """What a file says of itself: the leading block comment or docstring, or the first paragraph of Markdown."""
    body = re.sub(r"\A#![^\n]*\n", "", text.lstrip("﻿"))
    if ext in MARKDOWN_EXTENSIONS:
        rows = body.split("\n")[:40]
        kept: list[str] = []
        for row in rows:
            if row.strip():
                kept.append(row.strip())
            elif kept:
                break
        return " ".join(kept) or None
    if language == "python":
        found = re.match(r"\s*(?:#[^\n]*\n\s*)*[rRuU]?(\"\"\"|''')(.*?)\1", body, re.S)
        return found[2].strip() or None if found else None
    if language in ("typescript", "tsx", "javascript"):
        found = re.match(r"\s*/\*\*(.*?)\*/", body, re.S)
        return "\n".join(x for x in (re.sub(r"^\s*\*\s?", "", r).rstrip() for r in found[1].split("\n")) if x).strip() or None if found else None
    return None


def snippet(rows: list[str], line: int) -> str:
    return re.sub(r"\s+", " ", " ".join(rows[max(0, line - 2) : line + 1])).strip()


def analyse(path: str, text: str, most: int = MAX_CHUNK_CHARS) -> Iterator[dict]:
    """Tagged rows of a file. Places are bytes of UTF-8.

    ``status`` of the file is ``markdown``, ``unsupported``, ``parse_failed`` or
    ``parsed``. Parsed files give their definitions; a file in another language,
    or one that can't be parsed, gives pieces by lines.
    """
    ext = re.search(r"(\.[^./]*)?$", path)[0]
    language = LANGUAGES.get(ext)
    rows, lines = text.split("\n"), Lines(text)
    ascii_only = text.isascii()
    byte = lambda place: place if ascii_only else len(text[:place].encode("utf-8", "surrogatepass"))
    base = {"file_path": path, "extension": ext}
    parsed = parse(text, language) if language and language != "dart" else None
    is_markdown = ext in MARKDOWN_EXTENSIONS
    status = "markdown" if is_markdown else "unsupported" if parsed is None else "parse_failed" if parsed.failed else "parsed"
    exports: list[str] = []
    chunk = 0

    def line_bytes(piece: Piece) -> tuple[int, int]:
        start = lines.starts[piece.start - 1]
        return byte(start), byte(min(len(text), lines.starts[piece.end] - 1 if piece.end < len(lines.starts) else len(text)))

    def chunk_row(piece: Piece, kind: str, name: str | None, owner: str | None, top: str, owned: bool, span: tuple[int, int] | None = None) -> dict:
        nonlocal chunk
        chunk += 1
        a, b = lines.starts[piece.start - 1], lines.starts[piece.end] if piece.end < len(lines.starts) else len(text)
        whole = piece.text if piece.start == piece.end else None
        told = facts(None, whole, 0, len(whole)) if whole is not None and parsed is None else facts(parsed, text, a, b)
        start, end = span or line_bytes(piece)
        return base | told | {"entity": "chunk", "ord": chunk, "kind": kind, "name": name, "class_name": owner, "start_line": piece.start, "end_line": piece.end, "start_byte": start, "end_byte": end, "context_header": top, "code_text": piece.text, "owned": owned}

    if status == "parsed":
        for n, d in enumerate(parsed.definitions):
            whole = "\n".join(rows[d.start_line - 1 : d.end_line])
            if d.exported:
                exports.append(d.name)
            function = d.name if d.kind == "function" else None
            owner = d.name if d.kind == "class" else d.owner
            top = header(path, d.owner if d.kind != "class" else None, function)
            yield base | facts(parsed, text, d.start, d.end) | {
                "entity": "symbol", "ord": n, "kind": d.kind, "name": d.name, "class_name": d.owner, "start_line": d.start_line, "end_line": d.end_line, "start_byte": byte(d.start), "end_byte": byte(d.end),
                "signature": d.signature, "docstring": d.docstring, "is_exported": d.exported, "decorator_names": d.decorators, "context_header": top, "code_text": whole,
            }
            pieces = [Piece(d.start_line, d.end_line, whole)]
            if len(whole) > most and d.kind != "class" and d.statements:
                pieces = by_statements(rows, d.start_line, d.end_line, d.statements, most)
            cut = [q for p in pieces for q in ([p] if len(p.text) <= most else by_lines(rows[p.start - 1 : p.end], p.start, most))]
            # a definition in one piece is known by its symbol; only long ones are chunks besides
            for i, p in enumerate(merge_small(cut, most)):
                if len(whole) >= OWNED_CHUNK_CHARS:
                    yield chunk_row(p, d.kind, d.name, d.owner, header(path, owner if d.kind == "class" else d.owner, (d.name if d.kind != "class" else None) if i else function, i > 0), True)
    else:
        pieces = markdown(text, most) if is_markdown else by_lines(rows, 1, most, OVERLAP_LINES)
        if not is_markdown:
            pieces = merge_small(pieces, most)
        for i, p in enumerate(pieces):
            yield chunk_row(p, "module", None, None, header(path, continued=i > 0), False)
    imports: list[str] = []
    if parsed is not None and not parsed.failed:
        for n, r in enumerate(dedupe(parsed.refs)):
            first = lines.of(r.start)
            if r.kind == "import" and r.module:
                imports.append(r.module)
            yield base | {"entity": "ref", "ord": n, "kind": r.kind, "start_line": first, "end_line": lines.of(max(r.start, r.end - 1)), "start_byte": byte(r.start), "end_byte": byte(r.end), "token_texts": r.texts, "context_snippet": snippet(rows, first), "module_name": r.module, "imported_name": r.imported}
    yield base | {"entity": "file", "ord": 0, "docstring": top_level_doc(text, language, ext), "imports": unique(imports), "exports": exports, "status": status}


def chunk_file(path: str, text: str, most: int = MAX_CHUNK_CHARS) -> list[dict]:
    """The chunks of one file by itself: its definitions in pieces, or the file as pieces if it has none."""
    rows = list(analyse(path, text, most))
    found = [r | {"entity": "chunk"} for r in rows if r["entity"] == "symbol" and len(r["code_text"]) < OWNED_CHUNK_CHARS] + [r for r in rows if r["entity"] == "chunk"]
    if found or not text:
        return sorted(found, key=lambda r: (r["start_line"], r["end_line"]))
    pieces = merge_small(by_lines(text.split("\n"), 1, most), most)
    return [facts(None, p.text, 0, len(p.text)) | {"entity": "chunk", "kind": "module", "name": None, "file_path": path, "start_line": p.start, "end_line": p.end, "context_header": header(path), "code_text": p.text, "is_exported": True} for p in pieces]


def extracted(files: DataFrame, most: int = MAX_CHUNK_CHARS, path: str = "file_path", content: str = "content") -> DataFrame:
    """Tagged rows (TAGGED) of all files. A file is read and parsed once; one that breaks the parser gives pieces by lines."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(TAGGED)]

    def kind(name: str, ddl: str) -> pa.DataType:
        return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}.get(ddl, pa.list_(pa.string()))

    shape = pa.schema([(f.name, kind(f.name, f.dataType.simpleString())) for f in StructType.fromDDL(TAGGED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                for row in analyse(p.as_py(), t.as_py() or "", most):
                    out.append(row)
                    size += len(row.get("code_text") or "") + 200
                if size > 8 << 20:
                    yield _batch(out, names, shape)
                    out, size = [], 0
        if out:
            yield _batch(out, names, shape)

    return files.select(F.col(path).alias("file_path"), F.col(content).alias("content")).mapInArrow(run, TAGGED)


def _batch(rows: list[dict], names: list[str], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], shape.field(n).type) for n in names], schema=shape)


def _text(*parts: Column) -> Column:
    return F.concat_ws("\n", *(F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts))


def tables(tagged: DataFrame, hashes: DataFrame, repo: str, revision: str = REVISION) -> dict[str, DataFrame]:
    """The entity tables of tagged rows. ``hashes`` (``file_path``, ``file_hash``) gives the hashes of the files' contents."""
    repo_id, rev = F.sha2(F.lit(repo), 256), F.lit(revision)
    rows = tagged.drop("file_hash").join(hashes.select("file_path", "file_hash"), "file_path", "left").withColumns({"repo_id": repo_id, "revision": rev})
    qual = F.when((F.col("kind") == "method") & F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."), "name")).otherwise(F.col("name"))
    joined = F.array_join("identifiers", " ")
    symbols = rows.where("entity = 'symbol'").withColumns({"qualname": qual, "symbol_kind": F.col("kind"), "symbol_name": F.col("name"), "identifiers_text": joined, "language_hint": language_hint(F.col("extension")), "content_hash": ids.content_hash(F.col("context_header"), F.col("code_text"))})
    symbols = symbols.withColumn("symbol_id", ids.symbol_id(F.col("repo_id"), F.col("file_path"), F.col("kind"), F.col("qualname"), F.col("signature"), F.col("name"), F.coalesce("start_byte", "start_line")))
    symbols = symbols.withColumn("search_text", _text(F.col("name"), F.col("qualname"), F.col("signature"), F.col("docstring"), F.col("context_header"), joined))
    symbols = symbols.withColumn("embed_input", _text(F.col("signature"), F.col("docstring"), F.col("context_header")))
    symbols = symbols.groupBy("symbol_id").agg(F.min_by(F.struct(*(c for c in symbols.columns if c != "symbol_id")), F.struct("start_byte", "ord")).alias("r")).select("symbol_id", "r.*")
    classes = symbols.where("kind = 'class'").groupBy("file_path", F.col("name").alias("class_name")).agg(F.max_by("symbol_id", "ord").alias("parent_symbol_id"))
    symbols = symbols.join(classes, ["file_path", "class_name"], "left")
    owners = symbols.groupBy("file_path", F.col("kind"), F.col("qualname").alias("q")).agg(F.max_by("symbol_id", "ord").alias("owner_symbol_id"))
    chunks = rows.where("entity = 'chunk'").withColumn("q", qual).join(owners, ["file_path", "kind", "q"], "left").where("not owned or owner_symbol_id is not null")
    ext = F.lower("extension")
    chunk_kind = F.when(ext.isin(*MARKDOWN_EXTENSIONS), "markdown_section").when(F.col("kind") == "module", "block").otherwise("statement_group")
    chunks = chunks.withColumns({"chunk_kind": chunk_kind, "identifiers_text": joined, "content_hash": ids.content_hash(F.col("context_header"), F.col("code_text")), "search_text": _text(F.col("context_header"), joined, F.col("code_text")), "embed_input": F.concat("context_header", F.lit("\n"), "code_text")})
    chunks = chunks.withColumn("chunk_id", ids.chunk_id(F.col("owner_symbol_id"), F.col("file_path"), F.coalesce("start_byte", "start_line"), F.coalesce("end_byte", "end_line"), F.col("content_hash"))).dropDuplicates(["chunk_id"])
    refs = rows.where("entity = 'ref'").withColumn("ref_kind", F.col("kind"))
    refs = refs.withColumn("ref_id", ids.ref_id(F.col("repo_id"), F.col("revision"), F.col("file_path"), F.col("kind"), F.coalesce("start_byte", "start_line"), F.coalesce("end_byte", "end_line"), F.col("module_name"), F.col("imported_name"))).dropDuplicates(["ref_id"])
    files = rows.where("entity = 'file'").withColumn("top_level_doc", F.col("docstring"))
    files = files.withColumn("file_id", ids.file_id(F.col("repo_id"), F.col("revision"), F.col("file_path")))
    listed = lambda name, column: F.when(F.size(column) > 0, F.concat(F.lit(f"{name}: "), F.array_join(column, ", ")))
    files = files.withColumn("file_summary_text", _text(F.concat(F.lit("File: "), "file_path"), listed("Exports", "exports"), listed("Imports", "imports"), F.col("top_level_doc")))
    files = files.withColumn("embed_input", F.col("file_summary_text"))
    hashed = lambda t, own: t.withColumn("embed_hash", F.col("content_hash") if own else F.sha2("embed_input", 256))
    return {"files": hashed(files, False), "symbols": hashed(symbols, False), "chunks": hashed(chunks, True), "refs": refs}


def grammars(spark) -> DataFrame:  # noqa: ANN001
    """``(language, extensions, enabled)``: what is parsed."""
    by: dict[str, list[str]] = {}
    for ext, language in LANGUAGES.items():
        by.setdefault(language, []).append(ext)
    return spark.createDataFrame([(n, " ".join(e), n != "dart") for n, e in by.items()], "language string, extensions string, enabled boolean")
