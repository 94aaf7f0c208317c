"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Bits of hash that a directory may use.
BITS = 60
#: Levels of the directory that are summed from one table of buckets.
STRIDE = 10
#: Rows of a directory that are sent to every executor; a larger one is joined by its key.
SMALL_DIRECTORY = 100_000


def hash60(value):  # noqa: ANN001, ANN201
    """The leading 60 bits of the MD5 of a string column."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _prefix(key, depth):  # noqa: ANN001, ANN202
    """The leading ``depth`` (a column or number) of 60 bits."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def level_sums(fine: DataFrame, low: int, high: int) -> DataFrame:
    """``(depth, prefix, shard_bytes, shard_rows)`` of all prefixes of ``low`` to ``high`` bits, from those of ``high`` bits, ``fine`` ``(p, bytes, rows)``.

    Summed STRIDE levels at a time, each stride from the shortest prefixes of the
    one before, of which there are 2 ** STRIDE times fewer.
    """
    out = None
    while True:
        to = max(low, high - STRIDE)
        level = fine.select(F.explode(F.sequence(F.lit(to), F.lit(high))).alias("depth"), "p", "bytes", "rows")
        level = level.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(high) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        level = checkpoint(level)
        out = level if out is None else out.unionByName(level.where(F.col("depth") < high))
        if to == low:
            return out
        fine, high = level.where(F.col("depth") == to).select(F.col("prefix").alias("p"), F.col("shard_bytes").alias("bytes"), F.col("shard_rows").alias("rows")), to


def directory(keys: DataFrame, max_bytes: int, slack: int = 3) -> DataFrame:
    """The leaves ``(depth, prefix, shard_bytes, shard_rows)`` of the extendible hash of ``(key, bytes)``.

    A leaf is the shortest prefix whose rows fit ``max_bytes``: starting from
    one bucket, only buckets over the limit are split, on one more bit. Sizes of
    all prefixes down to some depth come from one aggregation; rows below
    prefixes that are still too large (and those only) are looked at again with
    more bits. A prefix of BITS bits that does not fit is returned as a leaf
    too: its rows share the whole hash.
    """
    total, rows = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    found, low = None, 0
    high = min(BITS, max(0, -(-int(total) // max_bytes) - 1).bit_length() + slack)
    left = keys
    while rows:
        fine = left.groupBy(_prefix(F.col("key"), high).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        level = level_sums(fine, low, high)
        over = level.where(F.col("shard_bytes") > max_bytes).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = level.where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS)).withColumn("parent", F.shiftright("prefix", 1))
        leaves = fits.join(over, ["depth", "parent"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_rows")
        if low == 0:
            leaves = leaves.unionByName(fits.where("depth = 0").select("depth", "prefix", "shard_bytes", "shard_rows"))
        found = leaves if found is None else found.unionByName(leaves)
        deeper = level.where((F.col("depth") == high) & (F.col("shard_bytes") > max_bytes))
        if high == BITS or not deeper.limit(1).count():
            break
        left = left.join(deeper.select("prefix"), _prefix(F.col("key"), high) == F.col("prefix"), "left_semi")
        low, high = high, min(BITS, high + slack + 3)
    if found is None:
        return keys.select(F.lit(0).alias("depth"), F.col("key").alias("prefix"), F.col("bytes").alias("shard_bytes"), F.col("bytes").alias("shard_rows"))
    return checkpoint(found)


def _placed(rows: DataFrame, leaves: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``shard_id`` and ``shard_bytes``.

    As extendible hashing has it, the directory holds a pointer for each prefix
    of its greatest depth, so that a row is looked up once. Where a few deep
    leaves would make that directory much larger than the shards are many, a row
    is looked up at each depth that has leaves instead.
    """
    count, deepest = leaves.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    label = F.concat(F.lit(name), F.format_string("%02d-%015x", F.col("depth"), F.col("prefix")))
    slots = leaves.select("depth", "prefix", label.alias("shard_id"), "shard_bytes")
    if 2**deepest <= max(1024, 64 * count):
        shift = (F.lit(deepest) - F.col("depth")).cast("int")
        first, after = F.call_function("shiftleft", F.col("prefix"), shift), F.call_function("shiftleft", F.col("prefix") + 1, shift)
        slots, size = slots.select(F.explode(F.sequence(first, after - 1)).alias("__slot"), "shard_id", "shard_bytes"), 2**deepest
        rows = rows.withColumn("__slot", _prefix(F.col(key), deepest))
    else:
        depths = [r[0] for r in leaves.select("depth").distinct().collect()]
        tries = F.array(*(F.struct(F.lit(d).alias("d"), _prefix(F.col(key), d).alias("p")) for d in sorted(depths)))
        slots, size = slots.select(F.struct(F.col("depth").alias("d"), F.col("prefix").alias("p")).alias("__slot"), "shard_id", "shard_bytes"), count
        rows = rows.withColumn("__slot", F.explode(tries))
    return rows.join(F.broadcast(slots) if size <= SMALL_DIRECTORY else slots, "__slot").drop("__slot")


def shard(docs: DataFrame, max_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``doc_bytes`` (UTF-8 bytes of the text), ``shard_id`` and ``shard_bytes``.

    No shard holds more than ``max_bytes``, but for one that consists of a
    single larger document. Ids are hashed by MD5; see ``directory``.

    Rows larger than the limit, and rows whose ids share all 60 bits and
    together exceed it (repeated ids), go by a second directory whose hash is
    that of all their columns and of a number that tells equal rows apart; that
    number comes from counting equal rows, not from numbering them in one task.

    Null texts have no bytes; null ids count as the empty string; repeated rows,
    and rows of one id with different texts, are rows like others that go to one
    shard as long as they fit it; an empty table gives no rows. Columns of the three
    names above are replaced.
    """
    rest = [c for c in docs.columns if c not in ("doc_bytes", "shard_id", "shard_bytes")]
    rows = docs.select(*rest, F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("doc_bytes"), hash60(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__key"))
    keys = checkpoint(rows.select(F.col("__key").alias("key"), F.col("doc_bytes").alias("bytes")))
    leaves = directory(keys.where(F.col("bytes") <= max_bytes), max_bytes)
    clash = leaves.where(F.col("shard_bytes") > max_bytes).select("prefix")
    usual = rows.where(F.col("doc_bytes") <= max_bytes)
    out = ["doc_bytes", "shard_id", "shard_bytes"]
    placed = _placed(usual, leaves.where(F.col("shard_bytes") <= max_bytes), "__key", "h").select(*rest, *out)
    crowded = clash.limit(1).count() > 0
    if not crowded and not keys.where(F.col("bytes") > max_bytes).limit(1).count():
        return placed
    odd = rows.where(F.col("doc_bytes") > max_bytes)
    if crowded:
        odd = odd.unionByName(usual.join(clash, F.col("__key") == F.col("prefix"), "left_semi"))
    odd = odd.groupBy(*rest, "doc_bytes").agg(F.count(F.lit(1)).alias("__n")).withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    odd = odd.withColumn("__key", hash60(F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(*rest).cast("string"), F.col("__nth").cast("string"))))
    large = odd.where(F.col("doc_bytes") > max_bytes).withColumn("shard_id", F.concat(F.lit("large-"), F.format_string("%015x", F.col("__key")))).withColumn("shard_bytes", F.col("doc_bytes"))
    placed = placed.unionByName(large.select(*rest, *out))
    if crowded:
        small = odd.where(F.col("doc_bytes") <= max_bytes)
        more = directory(checkpoint(small.select(F.col("__key").alias("key"), F.col("doc_bytes").alias("bytes"))), max_bytes)
        placed = placed.unionByName(_placed(small, more, "__key", "r").select(*rest, *out))
    return placed


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS doc_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
sums AS (SELECT d.depth, (key >> (60 - d.depth)) AS prefix, sum(doc_bytes)::BIGINT AS shard_bytes FROM docs, generate_series(0, 40) AS d(depth) GROUP BY 1, 2),
leaf AS (SELECT doc_id, doc_bytes, key, min(s.depth) AS depth FROM docs, sums s WHERE s.prefix = (key >> (60 - s.depth)) AND s.shard_bytes <= 1048576 GROUP BY 1, 2, 3)
SELECT doc_id, doc_bytes, 'h' || lpad(leaf.depth::VARCHAR, 2, '0') || '-' || lpad(lower(hex(s.prefix)), 15, '0') AS shard_id, s.shard_bytes
FROM leaf JOIN sums s ON s.depth = leaf.depth AND s.prefix = (leaf.key >> (60 - leaf.depth::BIGINT))
"""
