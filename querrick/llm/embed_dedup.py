"""Embedding near-dedup: p-stable Euclidean hashing in several tables, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint, components, one_thread

by_value(__name__)

#: Members of a bucket beyond which it is cut into blocks; each two blocks are one unit of work.
BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """The chance that two points at this distance fall in one cell of a Gaussian projection of cell width ``width``."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def tables_for(rows: int, cosine: float, miss: float, width: float) -> tuple[int, int]:
    """Projections a table and tables: far pairs meet about once a vector and table at any size of the input; a pair at the very threshold is missed with at most the chance ``miss``."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(6, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def usable(embedding):  # noqa: ANN001, ANN201
    """Whether a vector (array of double) has only finite components and is not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-5, width: float = 2.0, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` a row of ``vectors``.

    Two vectors of equal, non-null label and equal length are linked if their
    cosine (double precision) is at least ``cosine``. Equal vectors of a label
    are one node with a weight and never expanded to pairs. Nodes are
    normalised and hashed in several tables by quantised Gaussian projections
    (cells of ``width``); numbers of projections and tables follow from the
    count of nodes, the threshold and ``miss``, the bound on the chance to miss
    a link. Buckets over BLOCK members are cut into blocks and each two blocks
    compared apart. Pairs count in the first table where they meet. What leaves
    a comparison is each node's weight of links and one row a node that ties it
    to its part of the graph, not the pairs. Comparisons are handed vectors in
    the type they are stored in and 32 bits a table of their signatures.

    Null, zero or non-finite vectors and null labels link with nothing. A null
    vec_id is a row of its own without links. Rows that repeat a vec_id are
    vectors of their own, linked if their values say so, and share the id's
    component. An empty table gives no rows; other columns are ignored.
    """
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    base = base.withColumn("ok", usable(F.col("v").cast("array<double>")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = base.where("ok")
    nodes = checkpoint(good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w")).withColumn("node", F.monotonically_increasing_id()))
    count = nodes.count()
    k, tables = tables_for(count, cosine, miss, width)
    near = _links(nodes, cosine, k, tables, width, seed) if count else None
    if near is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    near = checkpoint(near)
    degree = near.where("other is null").groupBy("node").agg(F.sum("w").alias("deg"))
    forest = near.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    ids = good.join(nodes.select("label", "v", "node", "w"), ["label", "v"]).select("vec_id", "node", "w")
    twice = ids.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    root = components(forest.unionByName(twice))
    member = nodes.select("node", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = member.groupBy("root").agg(F.min("least").alias("component_id"))
    about = member.join(group, "root").join(degree, "node", "left").select("node", "component_id", F.coalesce("deg", F.lit(0)).alias("deg"))
    linked = ids.join(about, "node").select("vec_id", (F.col("deg") + F.col("w") - 1).cast("long").alias("n_links"), "component_id")
    alone = base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, cosine: float, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """``(node, other, w)``: with ``other`` null a part of the node's weight of links, else two nodes that links tie together."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            flat, at = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(lengths)]
            keys = np.zeros((batch.num_rows, tables), dtype=np.int32)
            for dim in np.unique(lengths):
                if dim not in planes:
                    rng = np.random.default_rng(seed)
                    planes[dim] = rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 2**62, k, dtype=np.int64) * 2 + 1
                a, b, mix = planes[dim]
                rows = np.flatnonzero(lengths == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(rows), tables, k)
                with np.errstate(over="ignore"):
                    mixed = (cells * mix).sum(axis=2)
                    keys[rows] = ((mixed ^ (mixed >> 29)) * np.int64(-4658895280553007687) + np.int64(dim)) >> 32
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "tag", "w", "v")), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())], names=["node", "tag", "w", "v", "sig"])

    kind = nodes.schema["v"].dataType.simpleString()
    signed = checkpoint(nodes.select("node", F.xxhash64("label").alias("tag"), "w", "v").mapInArrow(sign, f"node long, tag long, w long, v {kind}, sig array<int>"))
    spots = checkpoint(signed.select("node", F.posexplode("sig").alias("t", "h"), "tag").select("node", "t", F.xxhash64("tag", "t", "h").alias("bucket")))
    full = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = spots.join(full, "bucket").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("node", "t", "mine", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), (F.col("mine") != F.col("other")).alias("two"))
    rows = units.join(signed, "node")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.select("unit", "t", "mine", "two", "node", "tag", "w", "sig", "v").repartition(parts, "unit").sortWithinPartitions("unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node: list, other: list, w: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(w, pa.int64())], names=["node", "other", "w"])

        def unit(t: int, mine: np.ndarray, two: bool, node: np.ndarray, part: np.ndarray, w: np.ndarray, sig: np.ndarray, x: np.ndarray, got: tuple) -> None:
            if two:
                sides = [np.flatnonzero(mine == m) for m in np.unique(mine)]
                if len(sides) < 2:
                    return
                left, right = sides
            else:
                left = right = np.arange(len(node))
            near = (x[left] @ x[right].T >= cosine) & (part[left][:, None] == part[right])
            if not two:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            if t:
                new = ~(sig[left[i], :t] == sig[right[j], :t]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                return
            a, b = left[i], right[j]
            weight = np.bincount(a, w[b], len(node)) + (np.bincount(b, w[a], len(node)) if two else 0)
            some = np.flatnonzero(weight)
            got[0].extend(node[some].tolist())
            got[1].extend([None] * len(some))
            got[2].extend(weight[some].astype(np.int64).tolist())
            up = parts_of(a, b, len(node))
            tied = np.flatnonzero(up != np.arange(len(node)))
            got[0].extend(node[up[tied]].tolist())
            got[1].extend(node[tied].tolist())
            got[2].extend([0] * len(tied))

        one_thread()
        rest = None
        for last, batch in _with_last(batches):
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = whole.column("unit").to_numpy()
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            rest, whole = whole.slice(cut), whole.slice(0, cut).combine_chunks()
            if not cut:
                continue
            keys = keys[:cut]
            col = {c: whole.column(c).to_numpy() for c in ("t", "mine", "node", "tag", "w")}
            two = whole.column("two").to_numpy(zero_copy_only=False)
            sig = _one(whole.column("sig")).flatten().to_numpy().reshape(cut, -1)
            vectors = _one(whole.column("v"))
            lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
            at = np.r_[0, np.cumsum(lengths)]
            got: tuple[list, list, list] = [], [], []
            with np.errstate(over="ignore"):
                # units go by a hash: where two had the same, labels and tables tell them apart
                part = col["tag"] * np.int64(tables) + col["t"]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for s, e in zip(starts.tolist(), np.r_[starts[1:], cut].tolist(), strict=True):
                if e - s < 2:
                    continue
                for dim in np.unique(lengths[s:e]).tolist():
                    rows = s + np.flatnonzero(lengths[s:e] == dim)
                    x = flat[at[rows][:, None] + np.arange(dim)].astype(np.float64)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    unit(int(col["t"][s]), col["mine"][rows], bool(two[s]), col["node"][rows], part[rows], col["w"][rows], sig[rows], x, got)
                if len(got[0]) > 50_000:
                    yield out(*got)
                    got = [], [], []
            if got[0]:
                yield out(*got)

    return rows.mapInArrow(compare, "node long, other long, w long")


def parts_of(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The least member of each member's part of the graph of the links a-b."""
    up = np.arange(count)
    while True:
        before = up.copy()
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        up = up[up]
        if (up == before).all():
            return up


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield False, before
            before = batch
    if before is not None:
        yield True, before


def _one(column: pa.ChunkedArray) -> pa.ListArray:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


#: Cosines of all pairs of a label; components by recursion. Exact where no vector holds nulls or non-finite components.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_sum([x * x FOR x IN embedding::DOUBLE[]]) AS q FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.q > 0 AND b.q > 0 AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN least l ON l.a = vec_id LEFT JOIN degree d ON d.a = vec_id
"""
