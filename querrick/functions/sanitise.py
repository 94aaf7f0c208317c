"""What may be told of requests and answers: contents as digests, secrets replaced, sizes bounded."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CONTENT_KEYS, SCRUB_RULES, TRUNCATED
from . import text

# Bounds of what is kept.
MAX_DEPTH, MAX_ITEMS, MAX_KEYS, MAX_CHARS, FREEFORM_CHARS = 6, 20, 80, 2000, 80
FREE_KEYS = ("query", "notes")
RULES = [(re.compile(p, re.I if any_case else 0), new) for p, any_case, new in SCRUB_RULES]


def scrub(value: str) -> str:
    """``text.scrub`` for one string."""
    for rule, new in RULES:
        value = rule.sub(new, value)
    return value


def _sha(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def summary_of_text(value: str) -> dict:
    return {"sha256": _sha(value), "byte_count": len(value.encode("utf-8", "surrogatepass")), "line_count": value.count("\n") + 1 if value else 0}


def summary_of_string(value: str) -> dict:
    return {"sha256": _sha(value), "length": len(value)}


def is_content(key: str | None) -> bool:
    return key is not None and re.sub(r"[^a-z_]", "", key.lower()) in CONTENT_KEYS


def is_path(key: str) -> bool:
    low = key.lower()
    return low.endswith("path") or "file_path" in low or "filepath" in low


def _string(value: str, key: str | None, stripped: bool, most: int) -> object:
    low = (key or "").lower()
    if not stripped:
        kept = scrub(value) if low in FREE_KEYS else value
        return kept if len(kept) <= most else kept[:most] + TRUNCATED
    if low in FREE_KEYS:
        return summary_of_string(value)
    if low and is_path(low):
        return summary_of_string(value) | {"ext": os.path.splitext(value)[1] or None}
    return summary_of_string(value) if len(value) > FREEFORM_CHARS or re.search(r"\s", value) else value


def sanitise(value: object, stripped: bool = False, key: str | None = None, depth: int = 0, most: int = MAX_CHARS) -> object:
    """A value without contents of files.

    Values under content keys become digests; other strings are cut, those of
    queries scrubbed; ``stripped`` keeps short identifiers only. Lists keep
    MAX_ITEMS items, objects MAX_KEYS keys, both MAX_DEPTH levels.
    """
    if value is None or isinstance(value, bool):
        return value
    if is_content(key):
        return summary_of_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str))
    if isinstance(value, str):
        return _string(value, key, stripped, most)
    if isinstance(value, (int, float)):
        return value if math.isfinite(value) else None
    if isinstance(value, (list, tuple)):
        kept = [sanitise(v, stripped, key, depth + 1, most) for v in value[:MAX_ITEMS]]
        return kept if len(value) <= MAX_ITEMS else {"items": kept, "truncated": True, "original_length": len(value), "key": key}
    if isinstance(value, dict):
        if depth >= MAX_DEPTH:
            return {"sha256": _sha(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)), "truncated": True, "max_depth": MAX_DEPTH}
        out = {str(k): sanitise(v, stripped, str(k), depth + 1, most) for k, v in list(value.items())[:MAX_KEYS]}
        if len(value) > MAX_KEYS:
            out["__truncated_keys"] = {"truncated": True, "original_length": len(value), "kept": MAX_KEYS}
        return out
    return str(value)


def sanitised(rows: DataFrame, stripped: bool = False) -> DataFrame:
    """The same for the string columns of a table, by built-in functions: the policy of a column follows from its name."""

    def column(name: str) -> Column:
        value, low = F.col(name), name.lower()
        if is_content(name):
            return F.when(value.isNotNull(), text.text_summary(value))
        if stripped:
            told = F.struct(F.sha2(value, 256).alias("sha256"), F.length(value).cast("long").alias("length"), F.lit(None).cast("string").alias("value"))
            if low in FREE_KEYS or is_path(low):
                return F.when(value.isNotNull(), told)
            short = F.struct(F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("length"), value.alias("value"))
            return F.when((F.length(value) > FREEFORM_CHARS) | value.rlike(text.WS), told).when(value.isNotNull(), short)
        return text.truncate(text.scrub(value) if low in FREE_KEYS else value, MAX_CHARS)

    return rows.select(*(column(n).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes))
