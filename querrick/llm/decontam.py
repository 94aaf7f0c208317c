"""Benchmark decontamination: pigeonhole pieces found by an automaton, verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import by_value, checkpoint

by_value(__name__)

#: Characters of benchmark items that are searched at once; a larger benchmark takes several blocks.
BLOCK_CHARS = 4 << 20
#: Characters below which an item is found only as a whole text.
LEAST_CHARS = 12


def normal(text: str | None) -> str:
    """Lower case, white space collapsed."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """The edits that an item of this length may have."""
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into ``errors + 1`` pieces ``(offset, piece)``: that many edits leave one untouched."""
    n, parts = len(item), errors + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], length: int, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any substring of ``text`` and the first end where it is reached, if at most ``limit``."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best, end = full, 0, length, limit + 1, -1
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= limit else None


class Finder:
    """Items of a benchmark, ready to be found in texts; those of under ``least`` characters only where they are the whole text."""

    def __init__(self, items: list[tuple[Any, str]], rate: float, least: int = LEAST_CHARS) -> None:
        self.rate = rate
        known = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.items = [(i, t) for i, t in known if len(t) >= least]
        self.short: dict[str, list[Any]] = {}
        for i, t in known:
            if len(t) < least:
                self.short.setdefault(t, []).append(i)
        self.peq = [masks(t) for _, t in self.items]
        self.errors = [budget(len(t), rate) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.errors[n]):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[Any, int, int]]:
        """``(item_id, edits, end)`` of the items in the text, with the least edits and where that match ends in the normalised text."""
        text = normal(text)
        out = [(i, 0, len(text)) for i in self.short.get(text, [])]
        if not self.items:
            return sorted(out, key=order)
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, spots) in self.automaton.iter(text):
            for n, offset in spots:
                k = self.errors[n]
                start = last + 1 - size - offset
                spans.setdefault(n, []).append((max(0, start - k), start + len(self.items[n][1]) + k))
        for n, found in spans.items():
            best: tuple[int, int] | None = None
            length = len(self.items[n][1])
            # windows that overlap are searched as one; hits come in order of their ends, so windows of an item may step back by an item's length
            found.sort()
            spots: list[tuple[int, int]] = []
            for a, b in found:
                if spots and a <= spots[-1][1] and b - spots[-1][0] <= 4 * length:
                    spots[-1] = spots[-1][0], max(spots[-1][1], b)
                else:
                    spots.append((a, b))
            for low, high in spots:
                got = myers(self.peq[n], length, text[low:high], self.errors[n])
                if got and (best is None or got[0] < best[0]):
                    best = got[0], low + got[1]
            if best:
                out.append((self.items[n][0], *best))
        return sorted(out, key=order)


def order(match: tuple[Any, int, int]) -> tuple:
    """Results go by id, those without one first."""
    return (False,) + match[1:] if match[0] is None else (True, *match)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[Any, str]]]:
    """The benchmark in blocks of at most BLOCK_CHARS characters, or one item."""
    block, size = [], 0
    texts = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct().orderBy("i", "t")
    for row in texts.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``found``: an array of ``(item_id, edits, end)``, the items that the whole text holds within their budgets of edits.

    An item of n characters (lower case, white space collapsed, in text and item
    alike) may have ``int(rate * n)`` edits. It is cut into one piece more than
    that; a text that holds it so holds a piece exactly, which an automaton of
    all pieces finds in one pass; around each piece Myers' algorithm gives the
    least distance. No match is missed.

    The driver holds one block of BLOCK_CHARS characters of the benchmark at a
    time. A benchmark of one block is one pass over the rows, with no shuffle. A
    larger one takes a pass a block, each of which keeps the hashes of texts that
    hold an item (hits are few, and one a distinct text); rows then meet all hits
    of their text.

    Null and empty texts and items match nothing. Items of under ``least``
    characters are found only where they are the whole text: within other texts
    they would match nearly all. Items of one id are looked for each, with a
    result each, and so are items without an id, with a null ``item_id`` in the
    result; equal items of one id are one; repeated rows are documents of their
    own; an empty table gives no rows. A column named ``found`` is replaced.
    """
    rest = [c for c in docs.columns if c != "found"]
    kind = benchmark.select(item_col).schema[0].dataType
    text, out, passes = F.col(text_col).cast("string"), docs.select(*rest), blocks(benchmark, item_col, item_text)
    first, second = next(passes, None), next(passes, None)
    none = F.array().cast(f"array<struct<item_id:{kind.simpleString()},edits:int,end:long>>")
    if second is None:
        return out.select(*rest, (none if first is None else _search(first, rate, least, kind)(text)).alias("found"))
    hits = None
    for items in chain((first, second), passes):
        seen = docs.select(F.xxhash64(text).alias("__text"), F.hash(text).alias("__more"), _search(items, rate, least, kind)(text).alias("hits")).where(F.size("hits") > 0)
        part = checkpoint(seen.dropDuplicates(["__text", "__more"]))
        hits = part if hits is None else hits.unionByName(part)
    hits = checkpoint(hits.groupBy("__text", "__more").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("__hits")))
    own = out.withColumn("__text", F.xxhash64(text)).withColumn("__more", F.hash(text)).join(hits, ["__text", "__more"], "left")
    return own.select(*rest, F.coalesce("__hits", none).alias("found"))


def _search(items: list[tuple[Any, str]], rate: float, least: int, id_type: DataType):  # noqa: ANN202
    from pyspark.sql.functions import arrow_udf

    shape = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("edits", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(items, rate, least)
        for texts in batches:
            yield pa.array([[dict(zip(("item_id", "edits", "end"), m, strict=True)) for m in finder.find(t.as_py())] for t in texts], shape)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # else a filter on the result would be run as a second search
    return arrow_udf(run, f"array<struct<item_id:{id_type.simpleString()},edits:int,end:long>>").asNondeterministic()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` that hold no item of the benchmark, with the columns of ``docs``."""
    own = docs.withColumnRenamed("found", "__own_found") if "found" in docs.columns else docs
    return matches(own, benchmark, **options).where(F.size("found") == 0).drop("found").withColumnRenamed("__own_found", "found").select(*docs.columns)
