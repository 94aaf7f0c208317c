"""Vectors of texts: providers, distinct inputs, the cache, and rows with their vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import FIRST_DELAY_S, MOST_DELAY_S, RATE_LIMIT_SIGNS, RETRIES, TOO_LONG_SIGNS, TRANSIENT_SIGNS

T = TypeVar("T")


class Embedder(Protocol):
    """A provider of vectors. It is pickled to the executors; heavy state belongs in ``start``, which runs once a worker."""

    dimensions: int
    batch: int

    def start(self) -> None: ...

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """Unit vectors from a 32-bit hash of the text: the same everywhere, without a model.

    Arithmetic is that of double-precision numbers, so products round as they do there.
    """

    batch = 256

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def start(self) -> None:
        pass

    @staticmethod
    def seed(text: str) -> int:
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").tolist()
        h = 5381
        for unit in units:
            h = (h * 33 ^ unit) & 0xFFFFFFFF
        return h

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        seeds = np.array([self.seed(t) for t in texts], dtype=np.float64)
        steps = np.arange(1, self.dimensions + 1, dtype=np.float64)
        mixed = np.fmod(seeds[:, None] * steps * 1103515245.0 + 12345.0, 2.0**32)
        unit = np.fmod(np.floor(mixed), 0x7FFFFFFF) / 0x7FFFFFFF * 2 - 1
        size = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        return (unit / np.where(size > 0, size, 1)).tolist()


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors from token states: the mean over the tokens that the mask has."""
    weights = mask[..., None].astype(np.float64)
    mean = (states * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


class OnnxEmbedder:
    """A local transformer from two files that every worker can read: mean pooling, unit length. The session starts once a worker."""

    batch = 8

    def __init__(self, model: str, tokenizer: str, dimensions: int, longest: int = 512) -> None:
        self.model, self.tokenizer, self.dimensions, self.longest = model, tokenizer, dimensions, longest
        self._session = self._tokens = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None, "_tokens": None}

    def start(self) -> None:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
            self._tokens = Tokenizer.from_file(self.tokenizer)
            self._tokens.enable_truncation(self.longest)
            self._tokens.enable_padding()

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        self.start()
        coded = self._tokens.encode_batch(list(texts))
        fields = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
        wanted = {i.name for i in self._session.get_inputs()}
        inputs = {n: np.array(v, dtype=np.int64) for n, v in fields.items() if n in wanted}
        return mean_pooled(self._session.run(None, inputs)[0], np.array(fields["attention_mask"])).tolist()


def _says(error: BaseException, signs: tuple[tuple[str, ...], ...]) -> bool:
    said = str(error).lower()
    return any(all(word in said for word in group) for group in signs)


def is_rate_limit(error: BaseException) -> bool:
    return _says(error, RATE_LIMIT_SIGNS)


def is_too_long(error: BaseException) -> bool:
    return _says(error, TOO_LONG_SIGNS)


def is_transient(error: BaseException) -> bool:
    """Whether another try may help."""
    return not is_too_long(error) and (is_rate_limit(error) or _says(error, TRANSIENT_SIGNS))


def with_retry(call: Callable[[], T], attempts: int = RETRIES, first: float = FIRST_DELAY_S, most: float = MOST_DELAY_S, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of ``call``; transient errors are tried again after delays that double. Inputs that are too long are not."""
    delay = first
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n + 1 == attempts or not is_transient(error):
                raise
            sleep(delay)
            delay = min(delay * 2, most)
    raise AssertionError("unreachable")


def unique_inputs(inputs: DataFrame, key: str = "input_hash", value: str = "input") -> DataFrame:
    """One row a hash; the least of its texts (equal hashes have equal texts, unless they collide)."""
    return inputs.groupBy(key).agg(F.min(value).alias(value))


def split_by_cache(inputs: DataFrame, cache: DataFrame, key: str = "input_hash") -> tuple[DataFrame, DataFrame]:
    """Inputs that the cache holds, and those that it lacks."""
    return inputs.join(cache.select(key), key, "left_semi"), inputs.join(cache.select(key), key, "left_anti")


def embed(inputs: DataFrame, embedder: Embedder, key: str = "input_hash", value: str = "input") -> DataFrame:
    """``(key, vector)`` of the inputs; a batch that fails after retries gives null vectors. Runs on executors, one provider a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder.start()
        for rows in batches:
            out: list[list[float] | None] = []
            texts = rows[value].tolist()
            for at in range(0, len(texts), embedder.batch):
                part = texts[at : at + embedder.batch]
                try:
                    out += with_retry(lambda part=part: embedder.embed(part))
                except Exception:  # noqa: BLE001  a provider's failure costs its batch only
                    out += [None] * len(part)
            yield pd.DataFrame({key: rows[key], "vector": out})

    return inputs.select(key, value).mapInPandas(run, f"{key} string, vector array<float>")


def refreshed(inputs: DataFrame, cache: DataFrame, embedder: Embedder, now: str | None = None) -> DataFrame:
    """New rows for the cache: vectors of the distinct inputs that it lacks."""
    _, missing = split_by_cache(unique_inputs(inputs), cache)
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return embed(missing, embedder).where("vector is not null").select("input_hash", "vector", stamp.alias("created_at"))


def attach(rows: DataFrame, vectors: DataFrame, name: str, key: str = "embed_hash", files: DataFrame | None = None) -> DataFrame:
    """Rows with their vectors; rows without one go, and so do rows of files that are not in ``files`` (those with vectors)."""
    held = vectors.where("vector is not null").select(F.col("input_hash").alias(key), F.col("vector").alias(name))
    out = rows.drop(name).join(held, key)
    return out if files is None else out.join(files.select("file_path").distinct(), "file_path", "left_semi")
