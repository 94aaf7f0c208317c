"""Changes between two listings of files, and hashes of their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """``(file_path, change)`` of files ``(file_path, hash)`` that are ``new``, ``modified`` or ``deleted``; equal ones have no row.

    No old side: all are new; no new side: all are deleted. One full outer join by
    path; a path that turns from file to folder is a deleted file and new ones below.
    """
    if old is None and new is None:
        raise ValueError("a difference needs a side")
    if old is None or new is None:
        return (new if old is None else old).select("file_path", F.lit("new" if old is None else "deleted").alias("change"))
    both = old.select("file_path", F.col("hash").alias("__old"), F.lit(1).alias("__in_old")).join(new.select("file_path", F.col("hash").alias("__new"), F.lit(1).alias("__in_new")), "file_path", "full_outer")
    change = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return both.select("file_path", change.alias("change")).where("change is not null")


def forced(new: DataFrame) -> DataFrame:
    """All files as new."""
    return new.select("file_path", F.lit("new").alias("change"))


def reuse_hashes(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """``listing`` with ``hash`` (null where content must be read) and ``reused``: the previous hash where size and time are the same."""
    before = previous.select("file_path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("hash").alias("__hash"))
    same = (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime"))
    rows = listing.drop("hash").join(before, "file_path", "left")
    return rows.withColumn("hash", F.when(same, F.col("__hash"))).withColumn("reused", F.coalesce(same & F.col("__hash").isNotNull(), F.lit(False))).drop("__size", "__mtime", "__hash")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def folder_hashes(files: DataFrame, depth: int | None = None) -> DataFrame:
    """``(folder, depth, hash, files)`` of every folder of ``(file_path, hash)``; the root is the empty path.

    A folder's hash is the SHA-256 of the lines ``name:hash`` of its files and
    folders, sorted by name. Levels go from the deepest up, one aggregation each;
    ``depth`` (of the deepest file) is looked up if it is not given.
    """
    rows = files.select(F.col("file_path").alias("path"), "hash", F.lit(1).cast("long").alias("files"), (F.size(F.split("file_path", "/")) - 1).alias("level"))
    if depth is None:
        depth = rows.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    below, out = None, None
    for level in range(depth, -1, -1):
        here = rows.where(F.col("level") == level).select("path", "hash", "files")
        here = here if below is None else here.unionByName(below.where(F.col("depth") == level + 1).select(F.col("folder").alias("path"), "hash", "files"))
        lines = F.array_sort(F.collect_list(F.struct(_name(F.col("path")).alias("name"), F.col("hash"))))
        text = F.array_join(F.transform(lines, lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "\n")
        below = here.groupBy(_parent(F.col("path")).alias("folder")).agg(F.sha2(text, 256).alias("hash"), F.sum("files").alias("files")).select("folder", F.lit(level).alias("depth"), "hash", "files")
        out = below if out is None else out.unionByName(below)
    return out


def unchanged_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Folders of equal hash in both ``folder_hashes``: nothing below them needs a look."""
    return new.select("folder", "hash").join(old.select("folder", "hash"), ["folder", "hash"], "left_semi")


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path has a segment or start of that name, or the extension of a ``*.ext`` pattern."""
    out = F.lit(False)
    for p in patterns:
        hit = path.endswith(p[1:]) if p.startswith("*.") else F.array_contains(F.split(path, "/"), p) | path.startswith(p + "/") | (path == p)
        out = out | hit
    return out
