"""Near-duplicates by shingle Jaccard on top of SimHash: prefix filtering, which loses no pair, and exact verification."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint, components
from .simhash import fingerprint, id_type, one_of_each, similar_fingerprints, text_hash

by_value(__name__)

#: Shingles are counted by so many leading bits of their hashes; the counts only order shingles, so that sharing a place costs time, not pairs.
BITS = 20
#: Counts that are added up in one place.
BLOCK = 65_536
#: Bits of a text's bitmap.
MAP_BITS = 1024


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles of ``words`` words, A-Z lower-cased (fewer words: the whole sequence; none: none), in order."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    if not len(h):
        return h
    n, out = min(words, len(h)), np.uint64(0)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def described(docs: DataFrame, words: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, node, fp, n, map)`` a row of ``docs`` (hash of the text, fingerprint, distinct shingles and their bitmap), and ``(block, counts)``: about how many rows hold the shingles of each bucket, by task. Each text is read once; kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names = np.zeros(1 << BITS, dtype=np.uint32), ["doc_id", "node", "fp", "n", "map", "block", "counts"]
        ids = None
        for batch in batches:
            ids, fps, sizes, maps = batch.column(0), [], [], []
            for text in batch.column(2):
                value = text.as_py()
                h = shingles(value, shingle)
                fps.append(fingerprint(value, words))
                sizes.append(len(h))
                maps.append(parity(h))
                np.add.at(sums, (h >> np.uint64(64 - BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if ids is not None:
            starts = range(0, len(sums), BLOCK)
            none = pa.nulls(len(starts))
            packed = [zlib.compress(sums[i : i + BLOCK].tobytes(), 1) for i in starts]
            yield pa.RecordBatch.from_arrays([none.cast(ids.type), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(starts, pa.int32()), pa.array(packed, pa.binary())], names=names)

    slim = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    both = checkpoint(slim.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, node long, fp long, n int, map binary, block int, counts binary"))
    return both.where("block is null").select("doc_id", "node", "fp", "n", "map"), both.where("block is not null").select("block", "counts")


def bucket_counts(blocks: DataFrame) -> np.ndarray:
    """The counts of all tasks, added up by block on the executors."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32).astype(np.int64)
                sums[block] = sums[block] + more if block in sums else more
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(1 << BITS, dtype=np.int64)
    for block, packed in blocks.repartition((1 << BITS) // BLOCK, "block").mapInArrow(added, "block int, counts binary").collect():
        out[block : block + BLOCK] = np.frombuffer(packed, dtype=np.int64)
    return out


def parity(shingle: np.ndarray) -> bytes:
    """A bitmap of ``MAP_BITS`` bits: whether an odd number of the shingles falls on each."""
    return np.packbits(np.bincount((shingle & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1).tobytes()


def prefixes(slim: DataFrame, counts: np.ndarray, words: int, least: float) -> DataFrame:
    """``(shingle, salt, node, n, pos)``: of each text (once a task) the first ``n - ceil(least n) + 1`` of its n shingles, rare ones first.

    Texts that share ``least`` of their union share a shingle among these, under
    any order that is the same for all texts. ``salt`` deals the places of frequent
    shingles (their bucket has over 1000 and over four times the mean count) over
    parts by node; it is -1 for others.
    """
    sent = slim.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = sent.value, set()
        most = max(1000, 4 * int(often.mean()))
        for batch in batches:
            held: list[tuple[int, int, np.ndarray]] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                h = shingles(text.as_py(), words)
                if len(h):
                    order = np.argsort(often[(h >> np.uint64(64 - BITS)).astype(np.int64)], kind="stable")
                    held.append((node, len(h), h[order[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]]))
            sizes = [len(h) for _, _, h in held]
            if held:
                shingle, node = np.concatenate([h for _, _, h in held]), np.repeat(np.array([x for x, _, _ in held], dtype=np.int64), sizes)
                count = often[(shingle >> np.uint64(64 - BITS)).astype(np.int64)]
                salt = np.where(count > most, node % (-(-count // most)), -1).astype(np.int32)
                n, pos = np.repeat(np.array([n for _, n, _ in held], dtype=np.int32), sizes), np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(salt), pa.array(node), pa.array(n), pa.array(pos)], names=["shingle", "salt", "node", "n", "pos"])

    return slim.select("node", "text").mapInArrow(run, "shingle long, salt int, node long, n int, pos int")


def shared_lists(slim: DataFrame, counts: np.ndarray, words: int, least: float) -> DataFrame:
    """The ``prefixes`` of shingles that more than one text has, each place once; kept. Places with a salt are all taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by shingle and node; the first place of a shingle waits until another text has it too
        waits, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if waits is None else [waits, batch])
            shingle, node, salt = (rows.column(c).to_numpy() for c in ("shingle", "node", "salt"))
            new = np.r_[last != (shingle[0], node[0]), (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]
            begins = np.r_[last is None or last[0] != shingle[0], shingle[1:] != shingle[:-1]]
            run_of = np.cumsum(begins)
            texts = np.bincount(run_of, new)
            if not begins[0]:
                texts[0] += 1
            keep = new & ((texts[run_of] > 1) | (salt >= 0))
            end = run_of == run_of[-1]
            waits = None
            if texts[run_of[-1]] == 1 and salt[-1] < 0:
                # not decided yet
                waits, last = rows.slice(int(np.flatnonzero(end & new)[0]), 1).combine_chunks().to_batches()[0], None
            else:
                last = int(shingle[-1]), int(node[-1])
            yield from rows.filter(pa.array(keep)).select(["shingle", "node", "n", "pos"]).to_batches()

    dealt = prefixes(slim, counts, words, least).repartition("shingle", "salt").sortWithinPartitions("shingle", "node")
    return checkpoint(dealt.mapInArrow(run, "shingle long, node long, n int, pos int"))


def bounded(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` ``(a, b)`` of nodes that may have that Jaccard similarity by their bitmaps: bits that differ are each due to a shingle that only one text has, which bounds what they share; kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            both = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            most = (both - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) / 2
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(most >= least / (1 + least) * both - 1e-9))

    pairs = checkpoint(pairs.distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = rows.select("node", "n", "map").join(asked, "node", "left_semi").dropDuplicates(["node"])
    near = pairs.join(known.select(F.col("node").alias("a"), "n", F.col("map").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("map").alias("y")), "b")
    return checkpoint(near.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"))


def verified(slim: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The ``pairs`` ``(a, b)`` of nodes whose texts have that Jaccard similarity; of equal texts one stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                if known is None or known[0] != a.as_py():
                    known = a.as_py(), shingles(x.as_py(), words)
                other = shingles(y.as_py(), words)
                common = len(np.intersect1d(known[1], other, assume_unique=True))
                if common >= least * (len(known[1]) + len(other) - common) - 1e-9:
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = slim.select("node", "doc_id").join(asked, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("i"))
    own = checkpoint(one.withColumnRenamed("node", "o"))
    # by sort and merge at every size, as in one_of_each; only the texts of pairs are kept
    held = slim.select("node", "doc_id", "text").join(own.hint("merge"), (F.col("node") == F.col("o")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi").select("node", "text")
    held = checkpoint(held)
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return checkpoint(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())


def may_match(n: Column, pos: Column, m: Column, at: Column, least: float) -> Column:
    """Whether texts of n and m shingles that meet at these places can have the similarity: by their sizes, and by what is left behind the place."""
    return F.least(n - pos, m - at) >= F.lit(least / (1 + least)) * (n + m) - 1e-9


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)`` with the labels of linked nodes made one; kept."""
    a = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    root = components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return checkpoint(label.join(root.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def met(near: DataFrame, few: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: the places ``few`` against all places ``near`` of their shingles, where labels differ and the texts may match."""
    other = few.select("shingle", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "pos", "label")))
    pair = near.join(other, "shingle").where((F.col("label") != F.col("o_label")) & may_match(F.col("n"), F.col("pos"), F.col("o_n"), F.col("o_pos"), least))
    return pair.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def pivots(near: DataFrame) -> DataFrame:
    """One place of each shingle: of a text with the fewest rarer shingles before it, which is the least changed of a group of copies."""
    x = F.struct("pos", F.xxhash64("node").alias("h"), "node", "n", "label")
    return near.groupBy("shingle").agg(F.min(x).alias("x")).select("shingle", "x.node", "x.n", "x.pos", "x.label")


def minority(near: DataFrame) -> DataFrame:
    """The places of each shingle that do not have its most frequent label."""
    most = near.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("x"))
    return near.join(most.select("shingle", F.col("x.label").alias("most")), "shingle").where("label <> most").drop("most")


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 3, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, node, label, component_id)`` a row of ``docs``: groups linked by SimHash or by shingle Jaccard.

    Texts are linked if their fingerprints of ``words`` words differ in at most
    ``max_bits`` bits, or if their sets of ``shingle``-word shingles have a Jaccard
    similarity of ``least`` or more. Pairs of the second kind come from prefix
    filtering, which loses none, and are verified exactly. Texts that meet at a
    shingle are first held against the least changed of them, which makes a large
    group of near copies one label, or few, with pairs in proportion to its members; then those that do not have the shingle's most frequent label
    against the others, so that all pairs that still may matter are compared. No
    list of a shingle is gathered: pivots and labels are aggregated, and places
    meet in joins. Equal texts are one node; nodes and shingles go by 64-bit
    hashes.

    Null texts and texts without words are linked with each other (fingerprint
    zero); null ids and repeated rows as in ``simhash_groups``; an empty table
    gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("node", text_hash(F.col("text")))
    rows, counts = described(docs, words, shingle, id_col, text_col)
    nodes = rows.select("node", "fp").distinct()
    root = components(similar_fingerprints(rows.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    label = checkpoint(nodes.join(root, "fp", "left").select("node", F.coalesce("root", "fp").alias("label")))

    lists = shared_lists(slim, bucket_counts(counts), shingle, least)
    for some in (pivots, minority):
        near = checkpoint(lists.join(label, "node"))
        label = merged(label, verified(slim, bounded(met(near, some(near), least), rows, least), shingle, least))

    held = rows.select("doc_id", "node").join(label, "node")
    group = held.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return held.join(group, "label").select("doc_id", "node", "label", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """``docs`` with one row of each group of ``near_groups``: that of the least doc_id, as ``simhash_dedup`` says."""
    return one_of_each(docs, near_groups(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)
