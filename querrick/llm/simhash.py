"""SimHash near-dedup: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint, components

by_value(__name__)

#: Shingles whose bits are summed at once.
BLOCK = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned.

    A-Z are lower-cased; shingles are ``words`` consecutive words, repeats
    included, joined by a space (fewer words: the whole sequence); each is
    hashed by XXH64 with seed 42; a bit is 1 if more than half the hashes have
    it. No words (or null): 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), 42)]
    else:
        hashes = [digest(b" ".join(s), 42) for s in zip(*(parts[i:] for i in range(words)), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.array(hashes[at : at + BLOCK], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def id_type(df: DataFrame, id_col: str) -> str:
    """The type of a table's ids, in which results carry them."""
    return df.select(id_col).schema[0].dataType.simpleString()


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, node, fp)`` a row of ``docs``; ``fp`` holds the unsigned fingerprint's bits in a long, ``node`` a hash of the text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "node", "fp"])

    return slim.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, node long, fp long")


def text_hash(text):  # noqa: ANN001, ANN201
    """64 bits of a text column; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def cover(positions: int, shared: int, width: int) -> list[tuple[int, ...]]:
    """``width``-subsets of the byte positions such that every ``shared``-subset holds one (few by greed, exact by check)."""
    want = set(combinations(range(positions), shared))
    pool, out = list(combinations(range(positions), width)), []
    while want:
        best = max(pool, key=lambda c: sum(set(c) <= set(w) for w in want))
        out.append(best)
        want = {w for w in want if not set(best) <= set(w)}
    return out


def byte_of(fp, position):  # noqa: ANN001, ANN201
    """The byte of a fingerprint column at one of its 8 positions."""
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255))


def tallied_pairs(fps: DataFrame, shared: int = 5, key_bytes: int = 4) -> DataFrame:
    """``(a, b, tally)``, a < b: the pairs of different fingerprints (column ``fp``, distinct) that meet in the index, each once, with their count of equal positional bytes.

    Lists of single bytes grow with the corpus (a 256th of it each); the index
    therefore holds ``key_bytes`` positional bytes a posting, at a set of position
    groups of which every ``shared`` positions include one: each pair that shares
    ``shared`` positional bytes meets. A pair that meets in several groups is
    emitted at the first of them.
    """
    groups = cover(8, shared, min(key_bytes, shared))

    def key(col, group):  # noqa: ANN001, ANN202
        out = F.lit(0).cast("long")
        for i in group:
            out = F.shiftleft(out, 8).bitwiseOR(byte_of(col, i))
        return out

    postings = fps.select("fp", F.posexplode(F.array(*(key(F.col("fp"), g) for g in groups))).alias("grp", "post"))
    left, right = postings.withColumnRenamed("fp", "a"), postings.withColumnRenamed("fp", "b")
    odd = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(groups))
    for n in range(len(groups) - 1, -1, -1):
        first = F.when(key(odd, groups[n]) == 0, n).otherwise(first)
    met = left.join(right, (left["grp"] == right["grp"]) & (left["post"] == right["post"]) & (F.col("a") < F.col("b")) & (left["grp"] == first))
    return met.select("a", "b", sum((F.when(byte_of(odd, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0)).alias("tally"))


def counted_pairs(fps: DataFrame, max_bits: int = 3, key_bytes: int = 4) -> DataFrame:
    """``(a, b)``: the pairs that the count filter retains: ``max_bits`` changed bits touch at most that many of the 8 bytes, so links share ``8 - max_bits`` positional bytes or more."""
    shared = 8 - max_bits
    if not 0 < shared <= 8:
        raise ValueError("max_bits must be 0 to 7")
    return tallied_pairs(fps, shared, key_bytes).where(F.col("tally") >= shared).select("a", "b")


def similar_fingerprints(fps: DataFrame, max_bits: int = 3, key_bytes: int = 4) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of different fingerprints (column ``fp``, distinct) that differ in at most ``max_bits`` bits.

    The pairs that the index and its count filter retain, verified by Hamming
    distance; no pair is lost. The planner draws count and distance into the
    join, so that only links leave it.
    """
    return counted_pairs(fps, max_bits, key_bytes).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, node, fp, label, component_id)`` a row of ``docs``: the near-duplicate group (``label``) of each document; ``node`` is the hash of its text.

    Documents with equal fingerprints are one node of the graph, so copies are
    never expanded to pairs. ``component_id`` is the least doc_id of the group, in
    the type that ids have. Null texts and texts without words have fingerprint 0
    and are linked like any other; a null doc_id is never the least unless the
    group has no other; repeated rows stay, each with its group; an empty table
    gives no rows; further columns of ``docs`` are ignored.
    """
    rows = checkpoint(fingerprints(docs, words, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(similar_fingerprints(nodes.select("fp"), max_bits))
    member = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(member.join(group, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "node", "fp", F.col("root").alias("label"), "component_id")


def simhash_dedup(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least doc_id.

    Rows are told apart by id and text: texts of one id that are in different
    groups stay, one a group. Of rows with the group's least id, that whose text
    hashes least stays; of rows that repeat its id and text, one stays (which,
    where other columns differ, is not said). A null doc_id stands for a group
    only if no other row of it has one.
    """
    return one_of_each(docs, simhash_groups(docs, words, max_bits, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each ``label`` of ``groups`` ``(doc_id, node, label)``, as ``simhash_dedup`` says."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = groups.groupBy("label").agg(F.min(order).alias("x")).select("x.doc_id", "x.node").distinct()
    rows = groups.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("__n")).withColumnsRenamed({"doc_id": "__kept_id", "node": "__kept_node"})
    first = first.withColumnsRenamed({"doc_id": "i", "node": "x"})
    kept = checkpoint(rows.join(first, F.col("__kept_id").eqNullSafe(F.col("i")) & (F.col("__kept_node") == F.col("x")), "left_semi"))
    own = docs.withColumn("__node", text_hash(F.col(text_col)))
    same = own[id_col].eqNullSafe(kept["__kept_id"]) & (own["__node"] == kept["__kept_node"])
    # always by sort and merge: ids grow with the documents, so that small inputs would be planned as large ones can't be
    out = own.join(kept.hint("merge"), same, "left_semi")
    if kept.where(F.col("__n") > 1).limit(1).count():
        out = out.dropDuplicates([id_col, "__node"])
    return out.select(*docs.columns)


def as_hex(fp):  # noqa: ANN001, ANN201
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
