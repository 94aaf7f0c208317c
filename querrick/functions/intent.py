"""What a query asks for, as Column expressions over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import CHAIN, IDENTIFIER, WS, strip

#: Words that make a query code; boundaries are ASCII, as in the patterns below.
CODE = r"[{};]|=>|(^|[^A-Za-z0-9_])(class|function|def|import|export|return)([^A-Za-z0-9_]|\z)"
SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*[\x09-\x0D\x20]*\(|[A-Za-z0-9_]+\.[A-Za-z0-9_]+|[A-Za-z0-9_]+::[A-Za-z0-9_]+|[A-Z][a-z]+[A-Z][A-Za-z0-9]*"


def route(query: Column) -> Column:
    """``usage``, ``exact_text``, ``similar_code``, ``definition`` or ``concept``: the first whose signs the query shows."""
    q = strip(query)
    low = F.lower(q)
    usage = low.startswith("where used") | low.startswith("find usages") | (low.startswith("where is") & low.contains("used"))
    quoted = q.contains('"') | q.contains("'") | q.contains("`")
    return (
        F.when(usage, "usage")
        .when(quoted | q.rlike("(?i)error:|exception|traceback"), "exact_text")
        .when(q.contains("\n") | q.rlike(CODE), "similar_code")
        .when(q.rlike(SYMBOL) | low.contains("defined") | low.contains("definition"), "definition")
        .otherwise("concept")
    )


def unquoted(value: Column) -> Column:
    """Without a pair of equal quotes around it."""
    v = strip(value)
    ends = F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1))
    return F.when((F.length(v) >= 2) & ends.isin('""', "''", "``"), strip(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)


def _bare(value: Column, lead: bool) -> Column:
    """Without quotes and the punctuation of calls."""
    out = unquoted(value)
    for pattern in (["^@+"] if lead else []) + [rf"\(\){WS}*\z", rf"\({WS}*\z", rf"\){WS}*\z", r"[;,:]+\z"]:
        out = F.regexp_replace(out, pattern, "")
    return out


def fuzzy_plan(query: Column) -> Column:
    """``struct(symbol_token, qual_token, fuzziness, prefix_length, max_expansions)``, lower-cased; null if names can't be looked up inexactly."""
    raw = _bare(query, True)
    token = F.element_at(F.split(F.element_at(F.split(raw, "::"), -1), "[.#]"), -1)
    qualified = raw.contains(".") | raw.contains("::") | raw.contains("#")
    size = F.length(token)
    fields = F.struct(
        F.lower(token).alias("symbol_token"),
        F.when(qualified, F.lower(raw)).alias("qual_token"),
        F.when(size <= 2, 0).when(size <= 5, 1).otherwise(2).alias("fuzziness"),
        F.when(size >= 10, 2).when(size >= 6, 1).otherwise(0).alias("prefix_length"),
        F.lit(fixed.MAX_EXPANSIONS).alias("max_expansions"),
    )
    return F.when(raw.rlike(rf"^{CHAIN}\z") & (size >= 4), fields)


def usage_token(raw: Column) -> Column:
    """``struct(base, qualified)`` of a name: its last part, and that with its receiver unless the receiver is the object itself; null if it is no name."""
    dotted = F.regexp_replace(_bare(raw, False), "::|#", ".")
    parts = F.filter(F.transform(F.split(dotted, r"\."), strip), lambda x: x != "")
    base = F.try_element_at(parts, F.lit(-1))
    receiver = F.try_element_at(parts, F.lit(-2))
    own = receiver.isin("this", "self", "super", "cls")
    name = rf"^{IDENTIFIER}\z"
    qualified = F.when(receiver.rlike(name) & ~own, F.concat(receiver, F.lit("."), base))
    return F.when(base.rlike(name), F.struct(base.alias("base"), qualified.alias("qualified")))


def usage_tokens(query: Column) -> Column:
    """The name whose usages a query asks for: in backticks, else in quotes, else its last chain of identifiers that is no stop word."""
    q = strip(query)
    none = F.lit("")
    tick = F.nullif(F.regexp_extract(q, "`([^`]+)`", 1), none)
    quoted = F.nullif(F.regexp_extract(q, "[\"']([^\"']+)[\"']", 1), none)
    stop = F.array(*map(F.lit, fixed.USAGE_STOP_WORDS))
    chains = F.filter(F.regexp_extract_all(q, F.lit(CHAIN), F.lit(0)), lambda x: ~F.array_contains(stop, F.lower(x)))
    return F.coalesce(usage_token(tick), usage_token(quoted), usage_token(F.try_element_at(chains, F.lit(-1))))
