"""Extraction over a generated tree: one source file a document, in a language by its id, whose definitions and references are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract import rows
from ..sources.corpus import REPO, Corpus
from .registry import query

#: What a file holds by its extension: ``%N%`` stands for the document's id, ``%w%`` and ``%W%`` for its first word of four letters.
TEMPLATES = {
    ".py": '''"""Notes of %w%."""
import os
from pkg.mod%N% import make as Build%N%


class %W%%N%(Base):
    """Holds %w%."""

    @cached
    def run_%w%(self, n):
        return self.helper%N%(n) + os.getcwd("call_in_text(1)")


def _%w%%N%(x):
    # not_called(2)
    return fetch_%w%(x)
''',
    ".ts": """/** Notes of %w%. */
import { make as build%N% } from './mod%N%';
import * as Net from '../net';

export class %W%%N% extends Base {
  @memo
  run%W%(n: number) {
    return this.helper%N%(n) + build%N%("callInText(1)");
  }
}

/** Does %w%. */
export function do%W%(x: string): string {
  // notCalled(2)
  return fetch%N%(x);
}

const plain%N% = (y: number) => Net.send(y);
""",
    ".go": """package gen

import "fmt"

// %W%%N% holds %w%.
type %W%%N% struct {
	n int
}

func (a *%W%%N%) Run%N%(n int) int {
	return helper%N%(n)
}

func make%N%(x int) string {
	return fmt.Sprint("call_in_text(1)", x)
}
""",
    ".java": """package gen;

import gen.util.Helper%N%;

/** Holds %w%. */
public class %W%%N% {
  private int n;

  public %W%%N%(int n) {
    this.n = n;
  }

  @Override
  public String show%N%(int x) {
    return Helper%N%.text("call(1)") + compute%N%(x);
  }

  private int plain() {
    return n;
  }
}
""",
    ".md": """# Notes of %w% %N%

First words of `%w%`.

## Part %N%

More words.
""",
}

#: What the templates define: extension, kind, name, class, lines, signature, docstring, exported, decorators, called names, literals, language.
SYMBOLS = (
    (".py", "class", "%W%%N%", None, 6, 11, "class %W%%N%(Base):", "Holds %w%.", True, "", "self.helper%N% helper%N% os.getcwd getcwd", "Holds %w%.|call_in_text(1)", "python"),
    (".py", "method", "run_%w%", "%W%%N%", 10, 11, "def run_%w%(self, n):", None, True, "cached", "self.helper%N% helper%N% os.getcwd getcwd", "call_in_text(1)", "python"),
    (".py", "function", "_%w%%N%", None, 14, 16, "def _%w%%N%(x):", None, False, "", "fetch_%w%", "", "python"),
    (".ts", "class", "%W%%N%", None, 5, 10, "export class %W%%N% extends Base", None, True, "", "this.helper%N% helper%N% build%N%", "callInText(1)", "typescript"),
    (".ts", "method", "run%W%", "%W%%N%", 7, 9, "run%W%(n: number)", None, False, "memo", "this.helper%N% helper%N% build%N%", "callInText(1)", "typescript"),
    (".ts", "function", "do%W%", None, 13, 16, "export function do%W%(x: string): string", "Does %w%.", True, "", "fetch%N%", "", "typescript"),
    (".ts", "function", "plain%N%", None, 18, 18, "const plain%N% = (y: number) =>", None, False, "", "Net.send send", "", "typescript"),
    (".go", "class", "%W%%N%", None, 6, 8, "type %W%%N% struct", "%W%%N% holds %w%.", True, "", "", "", "go"),
    (".go", "function", "make%N%", None, 14, 16, "func make%N%(x int) string", None, False, "", "fmt.Sprint Sprint", "call_in_text(1)", "go"),
    (".java", "class", "%W%%N%", None, 6, 21, "public class %W%%N%", "Holds %w%.", True, "", "Helper%N%.text text compute%N%", "call(1)", "java"),
    (".java", "method", "show%N%", "%W%%N%", 14, 16, "public String show%N%(int x)", None, True, "Override", "Helper%N%.text text compute%N%", "call(1)", "java"),
    (".java", "method", "plain", "%W%%N%", 18, 20, "private int plain()", None, False, "", "", "", "java"),
)

#: The references: extension, kind, tokens, module, imported name, line.
REFS = (
    (".py", "import", "os", "os", None, 2),
    (".py", "import", "Build%N% make", "pkg.mod%N%", "make", 3),
    (".py", "identifier", "Base", None, None, 6),
    (".py", "call", "helper%N%", None, None, 11),
    (".py", "call", "getcwd os.getcwd", None, None, 11),
    (".py", "call", "fetch_%w%", None, None, 16),
    (".ts", "import", "build%N% make", "./mod%N%", "make", 2),
    (".ts", "import", "Net", "../net", "*", 3),
    (".ts", "identifier", "Base", None, None, 5),
    (".ts", "call", "helper%N%", None, None, 8),
    (".ts", "call", "build%N%", None, None, 8),
    (".ts", "call", "fetch%N%", None, None, 15),
    (".ts", "call", "send Net.send", None, None, 18),
    (".ts", "identifier", "Net", None, None, 18),
    (".go", "import", "fmt", "fmt", None, 3),
    (".go", "identifier", "%W%%N%", None, None, 10),
    (".go", "call", "helper%N%", None, None, 11),
    (".go", "call", "Sprint fmt.Sprint", None, None, 15),
    (".go", "identifier", "Run%N%", None, None, 10),
    (".java", "identifier", "%W%%N%", None, None, 9),
    (".java", "import", "Helper%N%", "gen.util.Helper%N%", "Helper%N%", 3),
    (".java", "identifier", "Override", None, None, 13),
    (".java", "identifier", "String", None, None, 14),
    (".java", "call", "text Helper%N%.text", None, None, 15),
    (".java", "identifier", "Helper%N%", None, None, 15),
    (".java", "call", "compute%N%", None, None, 15),
)

#: The files: extension, status, what it says of itself, imports, exports.
FILES = (
    (".py", "parsed", "Notes of %w%.", "os, pkg.mod%N%", "%W%%N%, run_%w%"),
    (".ts", "parsed", "Notes of %w%.", "./mod%N%, ../net", "%W%%N%, do%W%"),
    (".go", "parsed", None, "fmt", "%W%%N%"),
    (".java", "parsed", None, "gen.util.Helper%N%", "%W%%N%, show%N%"),
    (".md", "markdown", "# Notes of %w% %N%", None, None),
)


def _literal(value: str | int | bool | None) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, bool)) else "'" + value.replace("'", "''") + "'"


def _values(names: str, table: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in table) + f") v({names})"


_EXTENSIONS = [*TEMPLATES]
GENERATED = f"""gen AS (SELECT 'gen/doc_' || N || ext AS file_path, * FROM (SELECT doc_id::VARCHAR AS N, {_EXTENSIONS}[(doc_id % {len(_EXTENSIONS)} + 1)::INT] AS ext, w, upper(w[1]) || w[2:] AS W_
  FROM (SELECT doc_id, coalesce(nullif(lower(regexp_extract(text, '[A-Za-z]{{4,}}')), ''), 'none') AS w FROM documents)))"""


def _filled(column: str) -> str:
    return f"replace(replace(replace({column}, '%N%', N), '%w%', w), '%W%', W_)"


def generated(c: Corpus) -> DataFrame:
    """``(file_path, content, file_hash)``: the templates with the documents' ids and words."""
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)), F.lit("")), F.lit("none"))
    files = c.raw("documents").select(F.col("doc_id").cast("string").alias("n"), (F.col("doc_id") % len(TEMPLATES) + 1).cast("int").alias("at"), word.alias("w"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("at"))

    def filled(column: Column) -> Column:
        capital = F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)"))
        return F.replace(F.replace(F.replace(column, F.lit("%N%"), F.col("n")), F.lit("%w%"), F.col("w")), F.lit("%W%"), capital)

    made = files.select(F.concat(F.lit("gen/doc_"), "n", pick(TEMPLATES)).alias("file_path"), filled(pick(TEMPLATES.values())).alias("content"))
    return made.withColumn("file_hash", F.sha2("content", 256))


def extracted_tables(c: Corpus) -> dict[str, DataFrame]:
    files = generated(c)
    return rows.tables(rows.extracted(files), files, REPO)


_SYMBOLS = f"""{GENERATED}, found AS (SELECT file_path, ext, kind, {_filled('name')} AS name, {_filled('owner')} AS owner, start_line, end_line, {_filled('sig')} AS signature, {_filled('doc')} AS docstring, exported, deco, {_filled('called')} AS called, {_filled('lits')} AS literals, lang
  FROM gen JOIN {_values('x, kind, name, owner, start_line, end_line, sig, doc, exported, deco, called, lits, lang', SYMBOLS)} ON x = ext),
described AS (SELECT *, CASE WHEN kind = 'method' THEN owner || '.' || name ELSE name END AS qualname,
  '// File: ' || file_path || CASE WHEN kind <> 'class' AND owner IS NOT NULL THEN ', Class: ' || owner ELSE '' END || CASE WHEN kind = 'function' THEN ', Function: ' || name ELSE '' END AS context_header FROM found)"""


@query("WITH " + _SYMBOLS + " SELECT file_path, kind, name, qualname, start_line, end_line, signature, docstring, exported AS is_exported, deco AS decorators, called, literals, lang AS language_hint, context_header, concat_ws(chr(10), signature, docstring, context_header) AS embed_input, owner AS parent FROM described", "")
def extract_symbols(c: Corpus) -> DataFrame:
    """A parent is the class of its methods' class name, so that its own row is not looked up by extracting all files again."""
    told = extracted_tables(c)["symbols"].withColumn("parent", F.when(F.col("parent_symbol_id").isNotNull(), F.col("class_name")))
    return told.select(
        "file_path", "kind", "name", "qualname", "start_line", "end_line", "signature", "docstring", "is_exported", F.array_join("decorator_names", " ").alias("decorators"),
        F.array_join("called_names", " ").alias("called"), F.array_join("string_literals", "|").alias("literals"), "language_hint", "context_header", "embed_input", "parent",
    )


@query(f"WITH {GENERATED} SELECT file_path, kind AS ref_kind, {_filled('tokens')} AS tokens, {_filled('module')} AS module_name, {_filled('imported')} AS imported_name, line AS start_line FROM gen JOIN {_values('x, kind, tokens, module, imported, line', REFS)} ON x = ext", "")
def extract_refs(c: Corpus) -> DataFrame:
    found = extracted_tables(c)["refs"]
    return found.select("file_path", "ref_kind", F.array_join("token_texts", " ").alias("tokens"), "module_name", "imported_name", "start_line")


@query(f"WITH {GENERATED} SELECT file_path, status, {_filled('doc')} AS top_level_doc, concat_ws(chr(10), 'File: ' || file_path, 'Exports: ' || {_filled('exports')}, 'Imports: ' || {_filled('imports')}, {_filled('doc')}) AS file_summary_text FROM gen JOIN {_values('x, status, doc, imports, exports', FILES)} ON x = ext", "")
def extract_files(c: Corpus) -> DataFrame:
    return extracted_tables(c)["files"].select("file_path", "status", "top_level_doc", "file_summary_text")
