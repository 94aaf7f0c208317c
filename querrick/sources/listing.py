"""Listings of source trees and texts of their files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import BINARY_EXTENSIONS, BINARY_PROBE_BYTES, IGNORE_FILES
from ..functions.text import extension
from ..operators.snapshots import reuse_hashes
from .ignore import IgnoreRules

LISTING = "file_path string, size bigint, mtime double"


def rules_of(root: str) -> IgnoreRules:
    """The rules of the ignore files at the root; missing files have none."""
    lines: list[str] = []
    for name in IGNORE_FILES:
        file = Path(root, name)
        lines += file.read_text(errors="replace").split("\n") if file.is_file() else []
    return IgnoreRules(lines)


def walk(root: str, rules: IgnoreRules | None = None) -> Iterator[tuple[str, int, float]]:
    """``(path, size, mtime)`` of the files below a folder, hidden ones too; links are not followed, ignored folders not entered."""
    rules = rules or rules_of(root)

    def below(folder: str, prefix: str) -> Iterator[tuple[str, int, float]]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = prefix + e.name
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if not rules.ignores(path + "/x"):
                    yield from below(e.path, path + "/")
            elif e.is_file(follow_symlinks=False) and not rules.ignores(path):
                s = e.stat(follow_symlinks=False)
                yield path, s.st_size, s.st_mtime

    yield from below(root, "")


def is_binary(path: Column, content: Column | None = None) -> Column:
    """Whether a file is binary: by its extension, else by a NUL byte among its first bytes."""
    by_name = F.lower(extension(path)).isin(*BINARY_EXTENSIONS)
    return by_name if content is None else by_name | (F.instr(F.substring(content, 1, BINARY_PROBE_BYTES).cast("binary").cast("string"), "\0") > 0)


def of_extensions(listing: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files of those extensions (case counts); all if there are none."""
    return listing.where(extension(F.col("file_path")).isin(*extensions)) if extensions else listing


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The listing of a tree as a table; names are few next to texts, so the driver makes it."""
    rows = list(walk(root))
    frame = spark.createDataFrame(rows, LISTING) if rows else spark.createDataFrame([], LISTING)
    return of_extensions(frame, extensions).where(~is_binary(F.col("file_path")))


def with_texts(listing: DataFrame, root: str) -> DataFrame:
    """``listing`` with ``content`` and ``hash`` (SHA-256 of the text), read by the executors from a folder that all of them see; unreadable and binary files go."""
    columns = listing.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts: list[str | None] = []
            for path in rows["file_path"]:
                try:
                    data = Path(root, path).read_bytes()
                    texts.append(None if b"\0" in data[:BINARY_PROBE_BYTES] else data.decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield rows[columns].assign(content=texts)

    from pyspark.sql.types import StringType, StructType

    schema = StructType(list(listing.schema.fields)).add("content", StringType())
    return listing.mapInPandas(read, schema).where("content is not null").drop("hash").withColumn("hash", F.sha2("content", 256))


def snapshot(listing: DataFrame, previous: DataFrame | None, root: str) -> DataFrame:
    """``(file_path, hash, size, mtime)``: hashes are reused where size and time are as before; only other files are read."""
    if previous is None:
        return with_texts(listing, root).select("file_path", "hash", "size", "mtime")
    known = reuse_hashes(listing, previous)
    fresh = with_texts(known.where("not reused").select("file_path", "size", "mtime"), root).select("file_path", "hash", "size", "mtime")
    return known.where("reused").select("file_path", "hash", "size", "mtime").unionByName(fresh)
