"""Compression classifier: dictionaries of good and bad texts, and how much better one compresses a text than the other."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

by_value(__name__)

#: Texts are compressed in pieces of so many bytes, so that a dictionary helps throughout a long text.
PIECE = 512
DICT_BYTES = 32_768
LEVEL = 1
#: The score from which a document is taken as good.
KEEP = 0.7
#: Labels a class that are sent to the executors at most; more are joined by id.
SENT_LABELS = 100_000


class Model(NamedTuple):
    """Two dictionaries and the calibration of the difference of compressed sizes."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary that zstandard trains on the pieces of the texts; of too few pieces to train on, the pieces themselves."""
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = None
    if len(content) >= 8:
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """``(bad - good) / (bad + good)`` of the compressed sizes of the whole text; 0 if it is empty."""
    g = b = 0
    for part in pieces(text):
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if b + g else 0.0


def calibrate(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the labelled differences (Newton steps, a weak prior on the slope, softened targets)."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.c_[values, np.ones(len(values))]
    w = np.array([0.0, math.log((ones + 1) / (len(labels) - ones + 1))])
    keep = np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (target - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_texts(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """A model of labelled texts: two thirds of each class make the dictionaries, the rest (of a class with one text: the same) the calibration."""
    by = {v: [t for t, y in zip(texts, labels, strict=True) if y == v] for v in (0, 1)}
    if not by[0] or not by[1]:
        ones = len(by[1])
        return Model(b"", b"", 0.0, math.log((ones + 1) / (len(by[0]) + 1)))
    half = {v: max(1, len(t) * 2 // 3) for v, t in by.items()}
    good, bad = _dictionary(by[1][: half[1]]), _dictionary(by[0][: half[0]])
    g, b = compressor(good), compressor(bad)
    rest = [(t, v) for v in (0, 1) for t in (by[v][half[v] :] or by[v])]
    slope, offset = calibrate(np.array([difference(t, g, b) for t, _ in rest]), np.array([v for _, v in rest]))
    return Model(good, bad, max(slope, 0.0), offset)


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """Rows that no label is learnt from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_text_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learnt from at most ``per_class`` labelled documents of each class that are not held out, those whose ids hash least.

    Documents over ``max_text_bytes`` are not taken as examples, which bounds
    what reaches the driver at ``2 * per_class * max_text_bytes``. Labels are
    asked for in the order of their ids' hashes, more of them until there are
    enough documents of each class or all labels are asked. Labels other than 0
    and 1, null ids and null texts are not used; rows that repeat an id, in
    labels or documents, count as examples of their own; without examples of both
    classes, or with an empty table, scores are the share of the one class.
    """
    able = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__y"), F.md5(F.col(id_col).cast("string")).alias("__order"))
    there, ask = dict(able.groupBy("__y").count().collect()), 2 * per_class
    while True:
        some = None
        for value in (0, 1):
            # a threshold on the hash comes first, so that no task sends many labels
            part = able.where(F.col("__y") == value)
            if (share := 2 * ask / max(1, there.get(value, 0))) < 1:
                part = part.where(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") < int(share * 2**32))
            part = part.orderBy("__order", "__id").limit(ask)
            some = part if some is None else some.unionByName(part)
        if ask <= SENT_LABELS:
            some = F.broadcast(some)
        found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(some, F.col("__doc") == F.col("__id"))
        found = found.where(F.octet_length("__text") <= max_text_bytes)
        rows = [found.where(F.col("__y") == value).orderBy("__order", "__id", "__text").limit(per_class).select("__y", "__text", "__order") for value in (0, 1)]
        got = rows[0].unionByName(rows[1]).collect()
        if all(sum(r["__y"] == value for r in got) >= per_class or ask >= there.get(value, 0) for value in (0, 1)):
            break
        ask *= 4
    got.sort(key=lambda r: (r["__order"], r["__y"], r["__text"]))
    return fit_texts([r["__text"] for r in got], [r["__y"] for r in got])


def scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text.

    Null and empty texts score as the offset of the calibration says; equal
    texts score alike; repeated rows and rows without an id are rows like others;
    an empty table gives no rows. A column of that name is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    def run(batches: Iterator) -> Iterator:
        good, bad = compressor(model.good), compressor(model.bad)
        for texts in batches:
            d = texts.map(lambda t: difference(t, good, bad)).astype("float64")
            yield 1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -30, 30)))

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, pandas_udf(run, "double")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
