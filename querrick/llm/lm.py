"""Language-model scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint, one_thread

by_value(__name__)

#: Token at the end of every text; no word holds a space.
END = b" "
#: Tokens whose counts are sent to the executors (more where more tokens have vectors); the counts of others are joined.
SENT_TOKENS = 65_536
#: Tokens that a task counts before it hands them on.
FLUSH = 400_000
#: Context positions, the nearest first; components of a vector; noise samples a token.
CONTEXT, SIZE, NOISE = 2, 16, 16
#: Tokens of a step of training, and of a product of matrices when texts are scored.
STEP = 16_384
#: Rows of a product that is worked on at once, so that it stays in a core's memory.
SLICE = 2_048
#: Training goes over small corpora several times, until about so many tokens were seen.
SEEN = 4_000_000
#: Squared slopes that adaptive rates start from: rows that are seldom met move little.
START = 30.0
#: Rows of the parameters that are added up in one place.
ROWS = 2_048


def named_tokens(tokens: int) -> int:
    """How many tokens have vectors of their own in a corpus of so many tokens: grows without end, but more slowly than distinct tokens do."""
    return max(32, int(2 * tokens**0.4))


class Vocabulary(NamedTuple):
    """What the training texts hold: all tokens, distinct tokens, and the most frequent tokens, the end among them, with their counts."""

    tokens: int
    distinct: int
    frequent: list[tuple[bytes, int]]


class Units(NamedTuple):
    """The words of the neural model, most frequent first: tokens by themselves, and buckets of all other tokens by their last bytes.

    ``names``: tokens with a vector of their own; ``of_name``, ``of_bucket``: units
    of names and buckets; ``counts``: occurrences of the units in training;
    ``inside``: occurrences plus distinct tokens plus one of each bucket; ``width``:
    units of a class.
    """

    names: list[bytes]
    of_name: np.ndarray
    of_bucket: np.ndarray
    counts: np.ndarray
    inside: np.ndarray
    width: int

    @property
    def classes(self) -> int:
        return -(-len(self.counts) // self.width)


def words(text: str | None) -> list[bytes]:
    """Tokens of a text: A-Z lower-cased words, then one end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """Rows that nothing is learnt from: CRC-32 of the id as text is 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """``(token, c)`` over all rows of column ``text``: counted by task, then added up by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["token", "c"])
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > FLUSH:
                    yield pack(seen)
                    seen = Counter()
        yield pack(seen)

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, sent: int = SENT_TOKENS) -> Vocabulary:
    """Totals, and the tokens over a count that at most ``sent`` tokens (or twice those with vectors) exceed.

    That count comes from a histogram in 32 steps a doubling, so that no task
    sends its own ``sent`` tokens to the driver. Where more tokens than ``sent``
    share the highest step, the first of them by token are taken.
    """
    step = F.floor(F.log2("c") * 32).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, distinct = sum(r["c"] for r in steps), sum(r["n"] for r in steps)
    sent = max(sent, 2 * named_tokens(total))
    least, held = None, 0
    for row in steps:
        if held + row["n"] > sent and held:
            break
        least, held = row["s"], held + row["n"]
    some = counts.where(step >= least) if least is not None else counts.limit(0)
    top = (some if held <= sent else some.orderBy("token").limit(sent)).collect()
    frequent = sorted(((bytes(r["token"]), r["c"]) for r in top), key=lambda x: (-x[1], x[0]))
    if total and END not in dict(frequent):
        frequent[-1] = END, counts.where(F.col("token") == F.lit(END)).first()["c"]
    return Vocabulary(total, distinct, frequent)


def bucket_of(token: bytes, buckets: int) -> int:
    """Tokens without a vector of their own go by their last three bytes, which say something of language and kind."""
    return zlib.crc32(token[-3:]) % buckets


def units(counts: DataFrame, known: Vocabulary) -> Units:
    """The model's units; counts of buckets cover all training tokens."""
    names = [w for w, _ in known.frequent[: named_tokens(known.tokens)]]
    if known.tokens and END not in names:
        names[-1] = END
    tally = dict(known.frequent)
    buckets = max(16, len(names) // 4)
    c, v = np.zeros(buckets), np.zeros(buckets)
    place = F.crc32(F.substring("token", -3, 3)) % buckets
    for row in counts.groupBy(place.cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        c[row["b"]], v[row["b"]] = row["c"], row["v"]
    for w in names:
        b = bucket_of(w, buckets)
        c[b] -= tally[w]
        v[b] -= 1
    every = np.r_[[float(tally[w]) for w in names], c]
    order = np.argsort(-every, kind="stable")
    rank = np.empty(len(every), dtype=np.int64)
    rank[order] = np.arange(len(every))
    return Units(names, rank[: len(names)], rank[len(names) :], every[order], c + v + 1, math.ceil(math.sqrt(len(every))))


class Model:
    """A log-bilinear model of units, in two levels: the class of a unit, then the unit within its class (classes by frequency).

    The vector predicted from a context is ``sum_i R[h_i] @ C_i`` over its
    positions; a class or unit has the energy of its product with its own vector,
    plus a bias. All parameters are rows of one table: context vectors (one more
    for the start of a text), position matrices, class vectors, unit vectors; the
    last column is the bias.
    """

    def __init__(self, u: Units, table: np.ndarray | None = None, seed: int = 5) -> None:
        k, s, n = u.classes, u.width, len(u.counts)
        share = np.zeros(k * s)
        share[:n] = (u.counts + 0.5) / (u.counts + 0.5).sum()
        share = share.reshape(k, s)
        self.of_class = share.sum(axis=1).astype(np.float32)
        self.within = (share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        self.start, self.width, self.real = n, s, self.within > 0
        self.draw_class, self.draw_within = self.of_class.astype(float) / self.of_class.astype(float).sum(), np.cumsum(self.within, axis=1)
        ends = np.cumsum([n + 1, CONTEXT * SIZE, k, k * s])
        if table is None:
            rng = np.random.default_rng(seed)
            table = np.zeros((ends[-1], SIZE + 1), dtype=np.float32)
            table[:, :SIZE] = rng.normal(0, 0.1, (ends[-1], SIZE))
            for i in range(CONTEXT):
                table[ends[0] + i * SIZE : ends[0] + (i + 1) * SIZE, :SIZE] += np.eye(SIZE) / (i + 1)
            table[ends[1] : ends[2], SIZE] = np.log(self.of_class)
            table[ends[2] :, SIZE] = np.log(np.maximum(self.within, 1e-12)).ravel()
        self.table, self.ends = table, ends
        self.context, self.by_class = table[: ends[0], :SIZE], table[ends[1] : ends[2]]
        self.turn = table[ends[0] : ends[1], :SIZE].reshape(CONTEXT, SIZE, SIZE)
        self.by_unit = table[ends[2] :].reshape(k, s, SIZE + 1)

    def predicted(self, ahead: list[np.ndarray]) -> np.ndarray:
        """The vectors predicted from contexts; each unit is turned once for a position, however often it stands there."""
        out = (self.context @ self.turn[0])[ahead[0]]
        for i, h in enumerate(ahead[1:], 1):
            out += (self.context @ self.turn[i])[h]
        return out

    def log_probabilities(self, ahead: list[np.ndarray], unit: np.ndarray) -> np.ndarray:
        """Natural log-probabilities, normalised over all units, of the units after their contexts."""
        order = _sorted(unit)
        own = unit[order]
        p = np.ascontiguousarray(self.predicted([h[order] for h in ahead]).T)
        cls, slot = own // self.width, own % self.width
        got = np.empty(len(own), dtype=np.float32)
        vectors, bias = self.by_class[:, :SIZE], self.by_class[:, SIZE:]
        for at in range(0, len(own), SLICE):
            got[at : at + SLICE] = _picked(vectors @ p[:, at : at + SLICE] + bias, cls[at : at + SLICE])
        for c, rows in _segments(cls):
            some = self.by_unit[c, self.real[c]]
            got[rows] += _picked(some[:, :SIZE] @ p[:, rows] + some[:, SIZE:], slot[rows])
        out = np.empty_like(got)
        out[order] = got
        return out

    def slopes(self, ahead: list[np.ndarray], unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The ascent of the noise-contrastive objective, for all parameters.

        Noise comes from the units' frequencies: NOISE classes drawn for each SLICE
        of tokens, and NOISE units of its class for the tokens of a class.
        """
        out = np.zeros_like(self.table)
        order = _sorted(unit)
        ahead, own = [h[order] for h in ahead], unit[order]
        p, cls, slot = self.predicted(ahead), own // self.width, own % self.width
        a, b = self.ends[1], self.ends[2]
        # the data: each token's own class and unit
        back = np.zeros_like(p)
        for at, vectors, noise in ((a, self.by_class[cls], self.of_class[cls]), (b, self.by_unit[cls, slot], self.within[cls, slot])):
            energy = np.einsum("ij,ij->i", p, vectors[:, :SIZE]) + vectors[:, SIZE]
            more = 1 - _data(energy, noise)
            back += more[:, None] * vectors[:, :SIZE]
            _add_by(out[at:], own if at == b else cls, more, p)
        # the noise
        for at in range(0, len(own), SLICE):
            drawn = rng.choice(len(self.of_class), NOISE, p=self.draw_class)
            self._less(out[a:b], self.by_class, drawn, self.of_class, p, back, slice(at, at + SLICE))
        for c, rows in _segments(cls):
            drawn = np.minimum(np.searchsorted(self.draw_within[c], rng.random(NOISE)), self.width - 1)
            self._less(out[b + c * self.width : b + (c + 1) * self.width], self.by_unit[c], drawn, self.within[c], p, back, rows)
        # what goes back is added up by unit and position before it is turned
        for i, h in enumerate(ahead if len(own) else ()):
            at, order = self.ends[0] + i * SIZE, _sorted(h)
            key = h[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            met, sums = key[first], np.add.reduceat(back[order], first, axis=0)
            out[at : at + SIZE, :SIZE] = self.context[met].T @ sums
            out[met, :SIZE] += sums @ self.turn[i].T
        return out

    def _less(self, out: np.ndarray, vectors: np.ndarray, drawn: np.ndarray, noise: np.ndarray, p: np.ndarray, back: np.ndarray, rows: slice) -> None:
        """What the drawn noise takes from the slopes of ``vectors`` (in ``out``) and of the predictions ``rows`` (in ``back``)."""
        some, near = vectors[drawn], p[rows]
        g = _data(near @ some[:, :SIZE].T + some[:, SIZE], noise[drawn])
        back[rows] -= g @ some[:, :SIZE]
        less = np.empty((len(drawn), SIZE + 1), dtype=np.float32)
        less[:, :SIZE], less[:, SIZE] = g.T @ near, g.sum(axis=0)
        np.subtract.at(out, drawn, less)


def _data(energy: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The chance that units of these energies are data, against NOISE draws of chance ``noise``; ``energy`` is used up."""
    np.subtract(np.log(np.maximum(NOISE * noise, np.float32(1e-9))), energy, out=energy)
    # goes to 0 where the exponential overflows
    with np.errstate(over="ignore"):
        np.exp(energy, out=energy)
    energy += 1
    return np.divide(1, energy, out=energy)


def _add_by(out: np.ndarray, key: np.ndarray, more: np.ndarray, p: np.ndarray) -> None:
    """Adds ``more * (p, 1)`` to the rows ``key`` (in order) of ``out``."""
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    out[key[first], :SIZE] += np.add.reduceat(more[:, None] * p, first, axis=0)
    out[key[first], SIZE] += np.add.reduceat(more, first)


def _picked(energy: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log-softmax of the columns at one row each; ``energy`` is used up."""
    energy -= energy.max(axis=0)
    out = energy[row, np.arange(energy.shape[1])]
    np.exp(energy, out=energy)
    return out - np.log(energy.sum(axis=0))


def _sorted(unit: np.ndarray) -> np.ndarray:
    """The stable order of units; small numbers are sorted by their digits."""
    return np.argsort(unit.astype(np.int16) if len(unit) and unit.max() < 1 << 15 else unit, kind="stable")


def _segments(cls: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The classes of tokens in order, and where they are."""
    ends = np.flatnonzero(np.diff(cls)) + 1
    for at, end in zip([0, *ends.tolist()], [*ends.tolist(), len(cls)], strict=True):
        if end > at:
            yield int(cls[at]), slice(at, end)


class Reader:
    """Texts as units with their contexts."""

    def __init__(self, u: Units) -> None:
        of_bucket, buckets = u.of_bucket.tolist(), len(u.of_bucket)

        class Ids(dict):
            def __missing__(self, token: bytes) -> int:
                return of_bucket[zlib.crc32(token[-3:]) % buckets]

        self.ids, self.start = Ids(zip(u.names, u.of_name.tolist(), strict=True)), len(u.counts)

    def contexts(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The units before each, nearest first, and the units, of texts that are rows of units."""
        lead = np.full(CONTEXT, self.start)
        flat = np.concatenate([x for r in rows for x in (lead, r)]) if rows else np.empty(0, dtype=np.int64)
        at = np.flatnonzero(flat != self.start)
        return [flat[at - 1 - i] for i in range(CONTEXT)], flat[at]


def train(texts: DataFrame, u: Units, tokens: int, rate: float = 0.15) -> np.ndarray:
    """The parameters, learnt from every token of the rows of ``text``.

    Each task goes through its own rows in steps of STEP tokens (adaptive rates),
    from the same start; the tasks' parameters are then averaged, each row by how
    often the tasks used it. What is handed on grows with the input: one table a
    task, added up by block of rows on the executors. Small corpora are gone
    through several times, each from the average before. No task waits for
    another and a lost one is run again from its rows.
    """
    spark = texts.sparkSession
    table = Model(u).table
    blocks, size = -(-len(table) // ROWS), min(STEP, max(1024, tokens // 200))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        model, reader = Model(u, sent.value.copy()), Reader(u)
        seen, room = np.full(model.table.shape, START, dtype=np.float32), np.empty_like(model.table)
        used = np.zeros(len(model.table), dtype=np.float64)
        ids, waiting, total = reader.ids, [], 0
        rng = np.random.default_rng(TaskContext.get().partitionId())

        def step(rows: list[np.ndarray]) -> None:
            ahead, unit = reader.contexts(rows)
            for at in range(0, len(unit), size):
                near, own = [h[at : at + size] for h in ahead], unit[at : at + size]
                g = model.slopes(near, own, rng)
                np.multiply(g, g, out=room)
                np.add(seen, room, out=seen)
                np.sqrt(seen, out=room)
                np.divide(g, room, out=room)
                np.multiply(room, rate, out=room)
                model.table += room
                used[: model.ends[0]] += sum(np.bincount(h, minlength=model.ends[0]) for h in near)
                used[model.ends[0] : model.ends[1]] += len(own)
                used[model.ends[1] : model.ends[2]] += np.bincount(own // u.width, minlength=u.classes)
                used[model.ends[2] :] += np.bincount(own, minlength=u.classes * u.width)

        for batch in batches:
            for text in batch.column(0):
                waiting.append(np.array([ids[w] for w in words(text.as_py())], dtype=np.int64))
                total += len(waiting[-1])
                if total >= 2 * STEP:
                    step(waiting)
                    waiting, total = [], 0
        step(waiting)
        weight = (used + 1e-6 * used.sum()).astype(np.float32)
        starts = range(0, len(weight), ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([weight[i : i + ROWS].tobytes() for i in starts], pa.binary()), pa.array([model.table[i : i + ROWS].tobytes() for i in starts], pa.binary())], names=["block", "weight", "rows"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, weight, rows in zip(*(batch.column(i) for i in range(3)), strict=True):
                w = np.frombuffer(weight.as_buffer(), dtype=np.float32).astype(np.float64)
                x = np.frombuffer(rows.as_buffer(), dtype=np.float32).reshape(len(w), -1) * w[:, None]
                if block.as_py() in sums:
                    held = sums[block.as_py()]
                    held[0] += w
                    held[1] += x
                else:
                    sums[block.as_py()] = [w, x]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([w.tobytes() for w, _ in sums.values()], pa.binary()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["block", "weight", "rows"])

    shape = "block int, weight binary, rows binary"
    for _ in range(min(20, max(1, -(-SEEN // max(tokens, 1))))) if tokens else ():
        sent = spark.sparkContext.broadcast(table)
        table = table.copy()
        for block, weight, rows in texts.mapInArrow(run, shape).repartition(blocks, "block").mapInArrow(added, shape).collect():
            w = np.frombuffer(weight, dtype=np.float64)
            some = w > 0
            table[block : block + len(w)][some] = (np.frombuffer(rows, dtype=np.float64).reshape(len(w), -1)[some] / w[some, None]).astype(np.float32)
    return table


def fit(texts: DataFrame, counts: DataFrame) -> tuple[Vocabulary, Units, np.ndarray]:
    """Vocabulary, units and parameters of the rows of ``text``, of which ``counts`` are the token counts."""
    known = vocabulary(counts)
    u = units(counts, known)
    return known, u, train(texts, u, known.tokens)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is the log10 probability of the whole text (and its end) under the
    model: each token's unit after the units of the CONTEXT tokens before it, and
    for tokens that share a bucket ``(c + 1) / (N + V + 1)`` within it, with c the
    token's count and N, V the bucket's tokens and distinct tokens in training, so
    that unseen tokens have a share. ``base_score`` is the add-one unigram.

    Counts cover all training rows. Those of the most frequent tokens are sent to
    the executors; the other tokens of each row are joined with their counts by
    hash, which spreads them. How rows are dealt over tasks decides what a task
    trains on, so that scores may differ in their last digits, or a little more,
    with other splits of the input; counts and base scores do not.

    A row stands for itself, however often its id is repeated. Null texts are
    empty and score their end alone; a null doc_id is a training row; an empty
    table gives no rows; without training rows all tokens are unknown; other
    columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learn = slim.where("not held_out").select("text")
    counts = checkpoint(count_tokens(learn))
    known, u, table = fit(learn, counts)
    rows = checkpoint(_parts(slim, known, u, table))
    rare = counts.select(F.xxhash64("token").alias("h"), "c") if known.distinct > len(known.frequent) else counts.limit(0).select(F.xxhash64("token").alias("h"), "c")
    tails = rows.select("rid", F.explode("tail").alias("h"))
    more = tails.join(rare, "h").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("lg"), F.count(F.lit(1)).alias("k"))
    lg, k = F.coalesce("lg", F.lit(0.0)), F.coalesce("k", F.lit(0))
    base = F.col("base") + lg - F.col("n_tokens") * math.log10(known.tokens + known.distinct + 1)
    return rows.drop("tail").join(more, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + k).cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + lg).alias("score"))


def _parts(slim: DataFrame, known: Vocabulary, u: Units, table: np.ndarray) -> DataFrame:
    """What a row's text gives by itself: ``base`` and ``part`` lack the logarithms of counts of the tokens hashed in ``tail``."""
    sent = slim.sparkSession.sparkContext.broadcast((known.frequent, table))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        frequent, parameters = sent.value
        model, reader = Model(u, parameters), Reader(u)
        place = {w: i for i, (w, _) in enumerate(frequent)}
        log_c = np.array([math.log10(c + 1) for _, c in frequent] + [0.0])
        get, unknown = place.get, len(place)
        unit_of = np.array([reader.ids[w] for w, _ in frequent] + [0], dtype=np.int64)
        # the share of a token within its unit, but for its own count
        inside = np.zeros(model.start + 1)
        inside[u.of_bucket] = -np.log10(u.inside)
        shared = np.zeros(model.start + 1)
        shared[u.of_bucket] = 1
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_tokens, n_known, base, tails, rows, added = [], [], [], [], [], []
            for text in batch.column(2):
                tokens = words(text.as_py())
                a = np.fromiter((get(w, unknown) for w in tokens), dtype=np.int64, count=len(tokens))
                lg = log_c[a]
                hard = np.flatnonzero(a == unknown)
                rows.append(unit_of[a])
                rows[-1][hard] = [reader.ids[tokens[i]] for i in hard.tolist()]
                n_tokens.append(len(tokens))
                n_known.append(len(tokens) - len(hard))
                base.append(float(lg.sum()))
                added.append(float((lg * shared[rows[-1]] + inside[rows[-1]]).sum()))
                tails.append(np.array([xxhash.xxh64_intdigest(tokens[i], 42) for i in hard], dtype=np.uint64).view(np.int64))
            part = np.array(added) + _scored(model, reader, rows)
            ends = np.cumsum([0, *map(len, tails)]).astype(np.int32)
            flat = np.concatenate(tails) if tails else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rid, rid + batch.num_rows), pa.int64()), batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(part, pa.float64()), pa.ListArray.from_arrays(ends, flat)],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "part", "tail"],
            )
            rid += batch.num_rows

    return slim.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, part double, tail array<long>")


def _scored(model: Model, reader: Reader, rows: list[np.ndarray]) -> np.ndarray:
    """The log10 probabilities of texts that are rows of units, by products over STEP tokens at once."""
    ahead, unit = reader.contexts(rows)
    logp = np.empty(len(unit))
    for at in range(0, len(unit), STEP):
        logp[at : at + STEP] = model.log_probabilities([h[at : at + STEP] for h in ahead], unit[at : at + STEP])
    return np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), logp, len(rows)) / math.log(10)
