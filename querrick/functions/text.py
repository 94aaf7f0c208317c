"""Text as Column expressions: tokens, identifier parts, scrubbing, summaries. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

#: ASCII white space, written out: engines differ in what ``\s`` holds.
WS = r"[\x09-\x0D\x20]"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
CHAIN = IDENTIFIER + r"(?:(?:\.|::|#)" + IDENTIFIER + ")*"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def _short(tokens: Column, longest: int | None) -> Column:
    return F.filter(tokens, (lambda x: (x != "") & (F.length(x) <= longest)) if longest else (lambda x: x != ""))


def whitespace_tokens(text: Column, longest: int | None = 128) -> Column:
    """Lower-cased tokens between white space; longer ones than ``longest`` go. Null text: no tokens."""
    return _short(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"{WS}+"), longest)


def simple_tokens(text: Column, longest: int | None = 256) -> Column:
    """Lower-cased runs of letters and digits; longer ones than ``longest`` go. Null text: no tokens."""
    return _short(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), longest)


def prefix_tokens(value: Column, least: int, most: int) -> Column:
    """The prefixes of ``least`` to ``most`` characters of the whole lower-cased value."""
    low = F.lower(F.coalesce(value, F.lit("")))
    upto = F.least(F.length(low), F.lit(most))
    return F.when(upto >= least, F.transform(F.sequence(F.lit(least), F.greatest(upto, F.lit(least))), lambda n: F.substring(low, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def identifiers(text: Column) -> Column:
    """Identifiers in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def identifier_parts(text: Column) -> Column:
    """Lower-cased parts of identifiers (blank-separated, if several) at hyphens, underscores, camel humps and acronyms."""
    spaced = F.regexp_replace(text, "[-_]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, rf"{WS}+"), F.lower), lambda x: x != "")


def indexed_parts(identifier: Column) -> Column:
    """Parts as the index has them: at other than letters and digits, then acronyms, humps and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(identifier, F.lit("")), F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def parts_of(text: Column) -> Column:
    """Distinct parts, of two characters at least, of all identifiers in the text, in order."""
    return F.array_distinct(F.filter(identifier_parts(F.array_join(identifiers(text), " ")), lambda x: F.length(x) >= 2))


def query_parts(query: Column, most: int = 32) -> Column:
    """The first ``most`` parts of a query that are no stop words."""
    stop = F.array(*map(F.lit, fixed.QUERY_STOP_WORDS))
    return F.slice(F.filter(parts_of(query), lambda x: ~F.array_contains(stop, x)), 1, most)


def code_to_query(code: Column) -> Column:
    """The full-text query of a piece of code: parts of identifiers of two characters at least, joined; null if there are none."""
    long = F.array_join(F.filter(identifiers(code), lambda x: F.length(x) >= 2), " ")
    return F.nullif(F.array_join(query_parts(long), " "), F.lit(""))


def scrub(text: Column) -> Column:
    """The text with e-mail addresses and likely secrets replaced."""
    for pattern, any_case, new in fixed.SCRUB_RULES:
        text = F.regexp_replace(text, ("(?i)" if any_case else "") + pattern, new)
    return text


def text_summary(text: Column) -> Column:
    """``struct(sha256, byte_count, line_count)``; an empty text has no lines."""
    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))
    return F.struct(F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("byte_count"), lines.cast("long").alias("line_count"))


def string_summary(text: Column) -> Column:
    """``struct(sha256, length)``, the length in code points."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("length"))


def truncate(text: Column, most: int, mark: str = fixed.TRUNCATED) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(mark)))


def clamp_lines(start: Column, end: Column, most: Column | int) -> Column:
    """``struct(start, end, truncated)``: a range of lines from 1 on of at most ``most`` lines."""
    most = F.greatest(F.lit(1), F.floor(F.lit(most) if isinstance(most, int) else most))
    first = F.greatest(F.lit(1), F.floor(start))
    last = F.greatest(first, F.floor(end))
    return F.struct(first.cast("long").alias("start"), F.least(last, first + most - 1).cast("long").alias("end"), (last - first + 1 > most).alias("truncated"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the leading three numbers; 0 if either has none."""

    def triplet(v: Column) -> Column:
        part = lambda n: F.try_to_number(F.regexp_extract(strip(v), r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)", n), F.lit("9" * 18))
        return F.array(*(part(n).cast("decimal(18,0)") for n in (1, 2, 3)))

    x, y = triplet(a), triplet(b)
    known = F.forall(x, lambda v: v.isNotNull()) & F.forall(y, lambda v: v.isNotNull())
    return F.when(known & (x < y), -1).when(known & (x > y), 1).otherwise(0)


def is_symbolish(token: Column) -> Column:
    """Whether a token looks like a type or constant."""
    return (F.length(token) >= 2) & token.rlike(r"^[A-Z][A-Za-z0-9]*\z|^[A-Z][A-Z0-9_]+\z")


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for part in fixed.TEST_PATH_PARTS:
        out = out | low.contains(part)
    return out


def extension(path: Column) -> Column:
    """From the last dot of the last segment on; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def normal_doc(text: Column, most: int = 160) -> Column:
    """A query from a comment: comment signs at line starts go, white space collapses, the first ``most`` characters stay."""
    return F.substring(collapse(F.regexp_replace(text, r"(?m)^[\x09-\x0D\x20/*#-]+", "")), 1, most)


def middle_deleted(name: Column) -> Column:
    """A name without its middle character; null below six."""
    at = F.floor(F.length(name) / 2).cast("int")
    return F.when(F.length(name) >= 6, strip(F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)))))


def language_hint(ext: Column) -> Column:
    known = {k: v for k, v in fixed.LANGUAGES.items() if v != "dart"} | {e: "markdown" for e in fixed.MARKDOWN_EXTENSIONS}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.try_element_at(table, F.lower(ext))
