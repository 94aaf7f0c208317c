"""Information-theoretic sanitisation of personal data.

Base patterns find protected entities. Corpus counts then estimate how strongly
the terms around them reveal them: for an entity e and a term t of its context,
``PMI(e; t) / IC(e)``, the share of the entity's information that the term
discloses. Terms over a threshold are generalised or removed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint

by_value(__name__)

KINDS = ("email", "ip", "card", "phone", "term")
#: Up to so many candidate terms are sent to the executors; beyond, all terms are counted and joined.
SENT_TERMS = 500_000
#: Terms that a task counts before it hands them on.
FLUSH = 200_000
#: Terms whose counts are added up in one place.
BLOCK = 16_384
STRIP = ".,;:!?()[]{}<>\"'|*#$%&/\\"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost, in linear time: from each @ to the left as far as it goes."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start: leftmost non-overlapping matches a kind, those that fail their test dropped without retry."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.sub("", m[0])) <= 15]
    return out


def terms(words: set[str]) -> set[str]:
    """Terms of lower-cased words: outer punctuation goes, and so do terms of one or two characters."""
    return {t for w in words if len(t := w.strip(STRIP)) > 2}


def context(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """``(entity, term, start, end)``: the ``window`` words before and after each span, but for words that touch a span."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    starts, out = [s for s, _ in words], []
    taken = [(s, e) for _, s, e in spans]
    for kind, start, end in spans:
        low, high = bisect_left(starts, start), bisect_left(starts, end)
        for s, e in words[max(0, low - window - 1) : high + window]:
            piece = text[s:e]
            term = piece.lower().strip(STRIP)
            if len(term) > 2 and not any(s < b and a < e for a, b in taken):
                lead = len(piece) - len(piece.lstrip(STRIP))
                out.append((f"{KINDS[kind]}:{text[start:end].lower()}", term, s + lead, s + len(piece.rstrip(STRIP))))
    return out


def spread(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of all words of the text, but for words that touch a span."""
    taken, out, at = sorted((s, e) for _, s, e in spans), [], 0
    for m in re.finditer(r"\S+", text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        piece = m[0]
        term = piece.lower().strip(STRIP)
        if len(term) > 2 and not any(a < e and s < b for a, b in taken[at : at + 1]):
            out.append((term, s + len(piece) - len(piece.lstrip(STRIP)), s + len(piece.rstrip(STRIP))))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, window: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``docs``: ``rid`` (its place in the input), ``doc_id``, counts by kind, ``base`` (spans), ``near`` (context terms), ``entities`` and, where there are any, ``spread`` (all words)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    place = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, base, near, held, all_words = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                tally = Counter(k for k, _, _ in spans)
                counts.append([tally[k] for k in range(4)])
                base.append(joined(spans))
                near.append([dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in context(text, spans, window)] if spans else [])
                held.append(sorted({f"{KINDS[k]}:{text[s:e].lower()}" for k, s, e in spans}))
                all_words.append([dict(zip(("term", "start", "end"), x, strict=True)) for x in spread(text, spans)] if spans else [])
            by = list(zip(*counts, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rid, rid + batch.num_rows), pa.int64()), batch.column(0), *(pa.array(c, pa.int64()) for c in by), pa.array(base, pa.string()), pa.array(near, kind), pa.array(held, pa.list_(pa.string())), pa.array(all_words, place)],
                names=["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "entities", "spread"],
            )
            rid += batch.num_rows

    return slim.mapInArrow(run, "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity:string,term:string,start:long,end:long>>, entities array<string>, spread array<struct<term:string,start:long,end:long>>")


def term_frequencies(docs: DataFrame, wanted: list[str] | None, text_col: str = "text") -> DataFrame:
    """``(term, df)``: in how many documents each term is; of the ``wanted`` terms only, if they are given.

    Most wanted terms are in most tasks, so each task counts them in an array and
    hands it on in blocks, packed, and blocks are added up as arrays.
    """
    slim = docs.select(F.col(text_col).cast("string").alias("text"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(wanted)}
        known, counts = place.keys(), np.zeros(len(place), dtype=np.uint32)
        for batch in batches:
            for value in batch.column(0):
                found = terms(set((value.as_py() or "").lower().split())) & known
                if found:
                    counts[[place[t] for t in found]] += 1
        starts = range(0, len(counts), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([zlib.compress(counts[i : i + BLOCK].tobytes(), 1) for i in starts], pa.binary())], names=["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32).astype(np.int64)
                sums[block] = sums[block] + more if block in sums else more
        for block, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([wanted[block + i] for i in some], pa.string()), pa.array(total[some])], names=["term", "df"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["term", "df"])
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(terms(set((value.as_py() or "").lower().split())))
                if len(seen) > FLUSH:
                    yield pack(seen)
                    seen = Counter()
        yield pack(seen)

    if wanted is None:
        return slim.mapInArrow(sparse, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    blocks = -(-len(wanted) // BLOCK)
    return slim.mapInArrow(dense, "block long, counts binary").repartition(blocks, "block").mapInArrow(added, "term string, df long")


def sanitise(docs: DataFrame, window: int = 5, generalise: float = 0.8, remove: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``docs``: ``doc_id``, counts by kind, ``base`` (base spans as a string) and ``found``: all spans with kind, start, end and action.

    Of the terms of an entity's documents, those that disclose at least
    ``generalise`` of its information are generalised, and from ``remove`` on
    removed, wherever they stand in a document that holds the entity; entities
    themselves are removed. Terms that share one document only with the entity
    (most rare words do, by chance) must stand within ``window`` words of it. Documents without an entity are
    left alone. Document frequencies cover all documents: candidates (terms
    of such pairs) are few and sent to the executors up to SENT_TERMS, beyond
    which all terms are counted and joined.

    Null texts are empty; repeated rows count as documents of their own; a null
    doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    rows = checkpoint(find(docs, window, id_col, text_col))
    total = rows.count()
    holds = rows.select("rid", F.explode("entities").alias("entity"))
    entity = checkpoint(holds.groupBy("entity").agg(F.count(F.lit(1)).alias("de")))
    near = rows.select("rid", F.explode("near").alias("x")).select("rid", "x.entity", "x.term", F.lit(1).alias("close"))
    # an entity of one document has no pair of two
    often = holds.join(entity.where("de > 1").select("entity"), "entity", "left_semi")
    bags = rows.where(F.size("entities") > 0).select("rid", F.explode(F.array_distinct(F.transform("spread", lambda x: x["term"]))).alias("term"))
    seen = near.unionByName(often.join(bags, "rid").select("rid", "entity", "term", F.lit(0).alias("close")))
    pair = seen.groupBy("entity", "term", "rid").agg(F.max("close").alias("close")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.max("close").alias("close"))
    pair = checkpoint(pair.where("both > 1 or close = 1"))
    names = pair.select("term").distinct()
    wanted = [r[0] for r in names.limit(SENT_TERMS + 1).collect()]
    df = checkpoint(term_frequencies(docs, sorted(wanted) if len(wanted) <= SENT_TERMS else None, text_col)) if wanted else names.withColumn("df", F.lit(1).cast("long"))
    n = F.lit(float(max(total, 2)))
    share = F.log2(F.col("both") * n / (F.col("de") * F.col("df"))) / F.greatest(F.log2(n / F.col("de")), F.lit(1e-9))
    told = pair.join(df, "term").join(entity, "entity").select("entity", "term", share.alias("disclosed")).where(F.col("disclosed") >= generalise)
    places = rows.where(F.size("entities") > 0).select("rid", F.explode("spread").alias("x")).select("rid", "x.*")
    spans = places.join(holds.join(told, "entity").groupBy("rid", "term").agg(F.max("disclosed").alias("d")), ["rid", "term"])
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.when(F.col("d") >= remove, "remove").otherwise("generalise").alias("action")))).alias("found_terms"))
    return rows.join(spans, "rid", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce("found_terms", F.array().cast("array<struct<start:long,end:long,action:string>>")).alias("found_terms"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``sanitise``."""
    more = F.array_join(F.transform("found_terms", lambda x: F.concat(F.lit("term:"), x["start"], F.lit(":"), x["end"])), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(more, F.lit(""))).alias("spans"))


def shape(term: str) -> str:
    """What a generalised term becomes."""
    return "[number]" if any(c.isdigit() for c in term) else "[name]" if term[:1].isupper() else "[word]"


def apply_spans(text: str | None, base: str, terms_found: list) -> str:
    """The sanitised text: entities become their kind, removed terms ``[removed]``, generalised ones their shape."""
    text, cuts = text or "", []
    for part in filter(None, base.split(",")):
        kind, s, e = part.split(":")
        cuts.append((int(s), int(e), f"[{kind}]"))
    cuts += [(x["start"], x["end"], "[removed]" if x["action"] == "remove" else shape(text[x["start"] : x["end"]])) for x in terms_found]
    out, at = [], 0
    for s, e, new in sorted(cuts):
        if s >= at:
            out += [text[at:s], new]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sha256_of_base(text: str) -> str:
    """The digest of a text's base spans; for tests."""
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
