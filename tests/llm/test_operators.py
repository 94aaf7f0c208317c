"""Operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from querrick.llm import decontam, embed_dedup, line_dedup, lm, mixing, pii, quality, queries, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "some words here and there", "en", None, 1), (5, "same text of six words here", "en", "b", 1), (5, "same text of six words here", "en", "b", 1), (6, "same text of six words here", "en", "b", 1), (7, "x" * 300_000 + " é\U0001f600 y", None, "b", 9), (8, "word " * 60_000, "fr", "c", 2)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(spark, edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.copies <= 2 for r in rows)
    assert mixing.mix(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken, size, target = Counter(), Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
    largest = max(len(words_of(r.text)) for r in docs.collect())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= 2 * largest for s in size)
    own = edge.withColumn("size", F.lit("mine")).withColumn("target", F.lit("too"))
    assert mixing.mixture(own).columns == own.columns
    assert {r["size"] for r in mixing.mixture(own).collect()} <= {"mine"}


def brute_fingerprint(text, words=3):
    parts = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(text)]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {n: top(n) for n in nodes}


def test_simhash(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_simhash(spark, SF).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    groups = brute_groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == groups
    kept = sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect())
    assert kept == sorted(set(groups.values()))
    rows = simhash.simhash_groups(edge).collect()
    assert len(rows) == len(EDGE)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    stay = [r.doc_id for r in simhash.simhash_dedup(edge).collect()]
    assert sorted(stay, key=str) == sorted([1, 5, 7, 8, None], key=str)
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_similar_fingerprints(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 8))) & (2**64 - 1))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = [tuple(r) for r in simhash.similar_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert set(got) == want and len(got) == len(want)


def test_embeddings_edges_and_blocks(spark, monkeypatch):
    kind = "vec_id long, embedding array<float>, label int, kept string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, ""), (2, [0.0, 0.0], 1, ""), (3, [nan, 1.0], 1, ""), (4, [inf, 1.0], 1, ""), (5, [1.0, None], 1, ""), (6, [1.0, 0.0], None, ""), (7, [1.0, 0.0], 1, ""), (8, [2.0, 0.0], 1, ""), (9, [1.0, 0.0], 1, ""), (10, [1.0, 0.0], 2, ""), (None, [1.0, 0.0], 1, ""), (12, [1.0, 0.01, 0.0], 1, ""), (13, [], 1, "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == len(rows)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False)
    assert all(got[i][0] == 0 for i in (1, 2, 3, 4, 5, 6, 10, 12, 13, None))
    assert embed_dedup.near_vectors(spark.createDataFrame([], kind)).count() == 0
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 16))
    vec = np.r_[base[[0] * 60 + [1] * 20 + [2] * 3] + rng.normal(scale=0.03, size=(83, 16)), rng.normal(size=(40, 16))].astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int")
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    groups = brute_groups(range(len(vec)), lambda a, b: near[a, b])
    for block in (1024, 16):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(table).collect()}
        assert got == {i: (int(near[i].sum()), groups[i]) for i in range(len(vec))}


def test_line_dedup(spark):
    page = lambda *lines: "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"
    rows = [(i, "http://A.example/x", page("menu", f"own {i}", "menu", "rare" if i < 2 else f"other {i}"), "h") for i in range(8)]
    rows += [(100, None, page("menu"), "h"), (101, "http://b.example/", page("menu"), "h"), (102, "http://a.example:80/", None, "h"), (102, "http://a.example:80/", None, "h")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in line_dedup.dedup_lines(table).collect()}
    assert got[0].kept_text == "own 0\nrare" and got[0].n_lines == 4 and got[0].n_dropped == 2 and got[0].host == "a.example"
    assert got[100].kept_text == "menu" and got[101].kept_text == "menu" and got[102].kept_text == ""
    assert line_dedup.dedup_lines(table).count() == len(rows) and line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (None, "n", long), (2, "again", long), (9, "big", "z" * 3_000_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(table, str(tmp_path / "out"), roll_bytes=300)
    assert archives.count() > 3
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(want.encode()) and r.payload_digest == hashlib.sha1(want.encode()).hexdigest()
        assert (r.record_type == "revisit") == (r.page_id in (1, None)) and (r.refers_to == 2) == (r.record_type == "revisit")
        assert r.payload == (None if r.record_type == "revisit" else want.encode())
    assert warc.round_trip(table.limit(0)).count() == 0
    good = warc.encode_record(1, "u", b"payload" * 300, None, "1970-01-01T00:00:00Z")
    assert len(list(warc.read_records(io.BytesIO(good + good)))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-4])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad.compress(zlib.decompress(good, 31).replace(b"payloadpayload", b"payloadpayl0ad", 1)) + bad.flush())))


def brute_spans(text):
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, rule in rules:
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, edge, empty):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab@@..-+% 0123456789()é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a@b.cd@e.fg", "4111 1111 1111 1111", "x@y.z.", "1.2.3.4.5.6.7.8", "0255.1.1.1", "256.1.1.1", "+1 (555) 010-9999", "1" * 50_000, "a" * 50_000 + "@", "+" * 9000]
    for t in texts:
        assert pii.joined(pii.base_spans(t)) == brute_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pii.digest(pii.sanitise(docs)).collect()}
    for r in docs.collect():
        base = brute_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[r.doc_id].spans.startswith(base) and (base or not got[r.doc_id].spans)
    assert pii.sanitise(edge).count() == len(EDGE) and pii.sanitise(empty).count() == 0
    rows = [(i, "filler words are in this one", "en", "a", 1) for i in range(60)] + [(90, "filler words Zaphodine mail to z@example.org or words", "en", "a", 1)]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[-1][1]
    assert [text[x.start : x.end] for x in found[90].found_terms] == ["Zaphodine", "mail"]
    assert pii.apply_spans(text, found[90].base, found[90].found_terms) == "filler words [removed] [removed] to [email] or words"
    frequencies = {r.term: r.df for r in pii.term_frequencies(docs, None).collect()}
    some = sorted(frequencies)[::7]
    assert {r.term: r.df for r in pii.term_frequencies(docs, some).collect()} == {t: frequencies[t] for t in some}


def test_quality(spark, edge, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    out = [(rows[i].score, y) for i, y in truth.items() if rows[i].held_out]
    good, bad = [s for s, y in out if y], [s for s, y in out if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= quality.KEEP for s in good]) > 0.93
    model = quality.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.scores(edge, model).collect()) and quality.scores(empty, model).count() == 0
    assert quality.fit(empty, labels) == quality.fit_texts([], [])
    assert quality.fit_texts(["one"], [1]).slope == 0


def test_sharding(spark, edge, empty):
    for table, limit in ((spark.read.parquet(f"{SF}/documents.parquet"), 20_000), (edge, 1000), (edge.unionByName(edge.where("doc_id = 5")).withColumn("shard_id", F.lit("mine")), 40)):
        rows = sharding.shard(table, max_bytes=limit).collect()
        assert len(rows) == table.count()
        held, count = defaultdict(int), Counter()
        for r in rows:
            assert r.doc_bytes == len((r.text or "").encode())
            held[r.shard_id] += r.doc_bytes
            count[r.shard_id] += 1
        assert all(b <= limit or count[s] == 1 for s, b in held.items())
        assert all(r.shard_bytes == held[r.shard_id] for r in rows)
    assert sharding.shard(empty).count() == 0


def edit_in(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, p in enumerate(item):
            row.append(min(row[-1] + 1, last[i + 1] + 1, last[i] + (p != c)))
        best = min(best, row[-1])
    return best


def test_decontamination(spark, edge, empty):
    rng = random.Random(2)
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    bench = [(1, item), (2, "another passage of some length that is here to be found by the search"), (3, None), (4, "")]
    finder = decontam.Finder([(i, t or "") for i, t in bench], 0.08)
    for _ in range(300):
        part = list(item)
        for _ in range(rng.randrange(0, 10)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice(["", "z", "q" + part[at]])
        text = "some words before " * rng.randrange(3) + "".join(part) + " after it" * rng.randrange(3)
        least = edit_in(item, decontam.normal(text))
        got = [(i, e) for i, e, _ in finder.find(text)]
        assert got == ([(1, least)] if least <= decontam.budget(len(item), 0.08) else [])
    table = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y", "en", "a", 1), (2, "clean", "en", "a", 1)], DOCS).withColumn("found", F.lit(1))
    assert [r.doc_id for r in decontam.decontaminate(docs, table).collect()] == [2]
    assert decontam.decontaminate(docs, table).columns == docs.columns
    assert decontam.decontaminate(edge, table).count() == len(EDGE) and decontam.decontaminate(empty, table).count() == 0
    assert decontam.decontaminate(docs, table.limit(0)).count() == 2


def test_lm(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    texts = {r.doc_id: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words_of(r.text)] + [None] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(t for i, ts in texts.items() if not out[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
    held = [i for i in texts if out[i]]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    few = {r.doc_id: r for r in lm_with_few_sent(docs)}
    assert all(math.isclose(few[i].score, got[i].score, rel_tol=1e-4) and few[i].n_known == got[i].n_known for i in texts)
    rows = lm.scores(edge).collect()
    assert len(rows) == len(EDGE) and all(r.score < 0 for r in rows)
    assert lm.scores(empty).count() == 0


def lm_with_few_sent(docs, monkey=200):
    keep = lm.vocabulary
    lm.vocabulary = lambda counts: keep(counts, monkey)
    try:
        return lm.scores(docs).collect()
    finally:
        lm.vocabulary = keep


def made_units(rng, names=40, buckets=16):
    counts = np.sort(rng.integers(1, 500, names + buckets).astype(float))[::-1]
    order = rng.permutation(names + buckets)
    return lm.Units([b"n%d" % i for i in range(names)], order[:names], order[names:], counts, rng.integers(2, 90, buckets).astype(float), 8)


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    u = made_units(rng)
    model = lm.Model(u)
    model.table += rng.normal(0, 0.3, model.table.shape).astype(np.float32)
    model = lm.Model(u, model.table)
    n = len(u.counts)
    for h in ([3, n], [n, n], [0, 7]):
        ahead = [np.full(n, x) for x in h]
        logp = model.log_probabilities(ahead, np.arange(n))
        assert math.isclose(np.exp(logp.astype(float)).sum(), 1, abs_tol=1e-4)
        # from the definition: the sum of turned context vectors, and two softmaxes
        p = sum(model.context[x] @ model.turn[i] for i, x in enumerate(h))
        e = model.by_class[:, :-1] @ p + model.by_class[:, -1]
        for w in (0, 9, n - 1):
            c, slot = divmod(w, u.width)
            real = model.real[c]
            f = model.by_unit[c, real, :-1] @ p + model.by_unit[c, real, -1]
            want = e[c] - np.log(np.exp(e).sum()) + f[slot] - np.log(np.exp(f).sum())
            assert math.isclose(logp[w], want, abs_tol=1e-3)


def test_lm_slopes_are_those_of_the_contrastive_objective():
    """Averaged over many draws of noise, the slopes are those of the objective with the expectation over the noise."""
    rng = np.random.default_rng(1)
    u = made_units(rng, 20, 16)
    model = lm.Model(u)
    ahead, unit = [rng.integers(0, 37, 30) for _ in range(lm.CONTEXT)], rng.integers(0, 36, 30)

    def objective(table):
        m = lm.Model(u, table)
        total, s = 0.0, lambda x: 1 / (1 + np.exp(-x))
        for i, w in enumerate(unit):
            p = sum(table[h[i], :-1].astype(float) @ m.turn[j].astype(float) for j, h in enumerate(ahead))
            c, slot = divmod(int(w), u.width)
            for vectors, noise, true in ((m.by_class, m.of_class, c), (m.by_unit[c], m.within[c], slot)):
                kn = np.maximum(lm.NOISE * noise.astype(float), 1e-9)
                d = vectors[:, :-1].astype(float) @ p + vectors[:, -1] - np.log(kn)
                total += np.log(s(d[true])) + (kn * np.log(1 - s(d))).sum()
        return total

    draws = np.array([model.slopes(ahead, unit, rng) for _ in range(3000)], dtype=np.float64)
    slopes, error = draws.mean(axis=0), draws.std(axis=0) / math.sqrt(len(draws))
    for row, col in ((ahead[0][0], 2), (model.ends[0] + 3, 5), (model.ends[1] + 1, lm.SIZE), (model.ends[2] + int(unit[0]), 1), (model.ends[0] + lm.SIZE + 2, 7)):
        up, down = model.table.astype(np.float64), model.table.astype(np.float64)
        up[row, col] += 1e-4
        down[row, col] -= 1e-4
        assert math.isclose((objective(up) - objective(down)) / 2e-4, slopes[row, col], rel_tol=1e-2, abs_tol=5 * error[row, col] + 1e-2)


def test_lm_against_brute_force(spark):
    """Every score again from the fitted parameters, token by token; the shares of all tokens after a context add up to 1."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    learn = docs.where(~lm.held_out()).select("text")
    counts = lm.count_tokens(learn)
    known, u, table = lm.fit(learn, counts)
    keep, lm.fit = lm.fit, lambda *_: (known, u, table)
    try:
        got = {r.doc_id: r.score for r in lm.scores(docs).collect()}
    finally:
        lm.fit = keep
    tally = {bytes(r.token): r.c for r in counts.collect()}
    model, names, n = lm.Model(u, table), {w: u.of_name[i] for i, w in enumerate(u.names)}, len(u.counts)

    def unit(t):
        return names.get(t, u.of_bucket[lm.bucket_of(t, len(u.of_bucket))])

    inside = lambda t: 1.0 if t in names else (tally.get(t, 0) + 1) / u.inside[lm.bucket_of(t, len(u.of_bucket))]
    ahead = [np.full(n, 4), np.full(n, n)]
    share = np.exp(model.log_probabilities(ahead, np.arange(n)).astype(float))
    total = sum(share[unit(t)] * inside(t) for t in tally) + sum(share[b] / u.inside[i] for i, b in enumerate(u.of_bucket))
    assert math.isclose(total, 1, abs_tol=1e-3)
    for r in docs.limit(40).collect():
        line = [unit(t) for t in lm.words(r.text)]
        want = sum(math.log10(inside(t)) for t in lm.words(r.text))
        for i, w in enumerate(line):
            h = [np.array([line[i - 1 - j] if i - 1 - j >= 0 else n]) for j in range(lm.CONTEXT)]
            want += float(model.log_probabilities(h, np.array([w]))[0]) / math.log(10)
        assert math.isclose(got[r.doc_id], want, rel_tol=1e-4, abs_tol=1e-2)
