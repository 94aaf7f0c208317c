"""Identities of rows: SHA-256 of their parts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS


def digest(*parts: Column) -> Column:
    """SHA-256 (hex) of the parts between bars; a null part counts as empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "|"), 256)


def file_id(repo: Column, revision: Column, path: Column) -> Column:
    return digest(repo, revision, path)


def symbol_id(repo: Column, path: Column, kind: Column, qualname: Column, signature: Column, name: Column, start: Column) -> Column:
    """By the signature with white space collapsed or, without one, name and start."""
    told = F.trim(F.regexp_replace(signature, rf"{WS}+", " "))
    own = F.when(F.coalesce(told, F.lit("")) != "", told).otherwise(F.concat(name, F.lit("|"), start.cast("string")))
    return digest(repo, path, kind, qualname, own)


def content_hash(header: Column, code: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(header, F.lit("")), F.lit("\n"), code), 256)


def chunk_id(owner: Column, path: Column, start: Column, end: Column, content: Column) -> Column:
    return digest(owner, path, start, end, content)


def ref_id(repo: Column, revision: Column, path: Column, kind: Column, start: Column, end: Column, module: Column, imported: Column) -> Column:
    return digest(repo, revision, path, kind, start, end, module, imported)


def project_id(root: Column, app: str = "querrick") -> Column:
    """The first 20 hex digits of the SHA-256 of the application's name and the path."""
    return F.substring(F.sha2(F.concat(F.lit(f"{app}:"), root), 256), 1, 20)
