import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from canopy.llm import lm_scoring as M
from tests.llm.cases import nothing, odd


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), " end"]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def base(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = words(t)
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, score))
    return sorted(out)


def same(got, want):
    got = sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-9)


@pytest.mark.parametrize("lbl", [M.Lbl(), M.Lbl(known=3000, longest=10, words=500)])
def test_base_and_gain(spark, lbl):
    """Rare and long words take the way over the join; the model beats counts on texts it has not seen."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.score_documents(df, lbl).collect()
    same(got, base([(x.doc_id, x.text) for x in df.collect()]))
    assert sum(x.score for x in got if x.held_out) > sum(x.base_score for x in got if x.held_out)


def test_odd_rows(spark):
    df = odd(spark)
    got = M.score_documents(df).collect()
    same(got, base([(x.doc_id, x.text) for x in df.collect()]))
    assert all(np.isfinite(x.score) and x.score < 0 for x in got)
    assert M.score_documents(nothing(spark)).count() == 0


def test_nothing_to_train_on(spark):
    ids = [i for i in range(60) if held(i)][:3]
    df = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    got = M.score_documents(df).collect()
    assert all((x.held_out, x.n_known, x.train_tokens, x.base_score) == (True, 0, 0, 0.0) for x in got)


def model(rounds):
    r = np.random.default_rng(3)
    lbl = M.Lbl(dim=8, noise=16, batch=128)
    counts = np.array([50, 400, 300, 200, 100, 50])
    own = M.start_model(counts, lbl)
    table = r.dirichlet(np.full(6, 0.3), (6, 6))  # P(w | u, v)
    w = [0, 0]
    for _ in range(20000):
        w.append(r.choice(6, p=table[w[-1], w[-2]]))
    w = np.array(w[2:])
    trainer = M.Trainer(own, lbl, 1)
    lists = [w[:15000]]
    start = own.log_probabilities(*M.before([w[15000:]])).mean()
    for _ in range(rounds):
        trainer.steps(*M.before(lists))
    own.__dict__.pop("tables", None)
    return own, start, own.log_probabilities(*M.before([w[15000:]])).mean()


def test_normalised():
    own, _, _ = model(1)
    n = len(own.b)
    u, v = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    total = sum(np.exp(own.log_probabilities(np.full(n * n, w), u, v)) for w in range(n))
    assert total == pytest.approx(np.ones(n * n), abs=1e-5)


def test_contrast_learns():
    _, start, end = model(4)
    assert end > start + 0.1


def test_before():
    w, u, v = M.before([np.array([3, 4, 5]), np.array([6]), np.array([7, 8])])
    assert (w.tolist(), u.tolist(), v.tolist()) == ([3, 4, 5, 6, 7, 8], [0, 3, 4, 0, 0, 7], [0, 0, 3, 0, 0, 0])


def test_normalised_in_two_levels():
    """Three classes of several words: probabilities over all words still sum to one."""
    r = np.random.default_rng(5)
    lbl = M.Lbl(dim=4, noise=8, batch=64, classes=3)
    own = M.start_model(r.integers(1, 90, 40), lbl)
    assert 1 < len(own.bc) <= 3 and sorted(own.order.tolist()) == list(range(40))
    M.Trainer(own, lbl, 1).steps(*M.before([r.integers(0, 40, 3000)]))
    u, v = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    total = sum(np.exp(own.log_probabilities(np.full(1600, w), u, v)) for w in range(40))
    assert total == pytest.approx(np.ones(1600), abs=1e-4)


def test_wide_scores_stay_finite():
    own = M.start_model(np.arange(1, 30), M.Lbl(classes=3))
    own.q[3], own.r[:] = 500.0, 1.0
    at = np.arange(29)
    assert np.isfinite(own.log_probabilities(at, at, at)).all()


@pytest.mark.parametrize("lbl", [M.Lbl(), M.Lbl(known=3000, longest=10, words=500)])
def test_score_is_the_fitted_model(spark, lbl):
    """Scores over Spark equal a dense softmax of the fitted vectors, word by word; the vocabulary follows the counts."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = M._split(df, lbl, "doc_id", "text")
    train = docs.where("not held_out")
    counts = M.written(M.count_words(train), "lm-test")
    fitted = M.fit(train, counts, lbl)
    rows = [(x.doc_id, x.text) for x in df.collect()]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    c = Counter({w.encode(): n for w, n in c.items()})
    m, groups = fitted.model, lbl.shared
    own = {w: fitted.entry[i] for w, i in fitted.numbers.items() if fitted.entry[i] < len(m.b) - groups}
    if lbl == M.Lbl():
        assert set(own) - {M.END} == {w for w, n in c.items() if n >= lbl.least and w != M.END}
    room, entry = Counter(), lambda w: own.get(w, len(m.b) - groups + zlib.crc32(w) % groups)
    for w, n in c.items():
        if w not in own:
            room[entry(w)] += n + 0.5

    def log10_p(w, u, v):
        h = m.r[u] * m.c[0] + m.r[v] * m.c[1]
        soft = lambda s: s - s.max() - np.log(np.exp(s - s.max()).sum())
        k = m.class_of[entry(w)]
        inside = np.flatnonzero(m.class_of == k)
        p = soft(m.qc @ h + m.bc)[k] + soft(m.q[inside] @ h + m.b[inside])[inside.tolist().index(entry(w))]
        return p / math.log(10) + (0 if w in own else math.log10((c[w] + 0.5) / (room[entry(w)] + 0.5)))

    some = sorted(rows)[:40]
    known = M._known_scores(docs, fitted).where(M.F.col("doc_id").isin([i for i, _ in some])).collect()
    got = {x.doc_id: x.score + sum(math.log10(c[bytes(w)] + 0.5) for w in x.rare) for x in known}
    for i, t in some:
        e = [w.encode() for w in words(t)]
        before = [0, 0, *map(entry, e)]
        assert got[i] == pytest.approx(sum(log10_p(w, before[j + 1], before[j]) for j, w in enumerate(e)), rel=1e-4)


@pytest.mark.parametrize("n", [1, 2, 543, 1024])
def test_rows_are_ranked_stably(n):
    """Changes of one row are added up in the order in which they came."""
    rows = np.random.default_rng(n).integers(0, 131_200, n) // 900 * 900
    order, ranked = M._ranked(rows)
    assert order.tolist() == np.argsort(rows, kind="stable").tolist() and ranked.tolist() == rows[order].tolist()


ODD = ["", " \t\n\x0b\x0c\r", "One", " one  TWO\x0bÀé\xa0x\u2003y ", "\x00 \x1c\x85 end END", "a" * 70, "one\nTwo\rthree one"]


@pytest.mark.parametrize("texts", [[], [""], ODD, ODD[::-1]])
def test_words_are_numbered_as_if_one_by_one(texts):
    """Known words, groups of others, ends; the words that are not known in their order."""
    lbl, known = M.Lbl(), [M.END, b"one", b"two", b"end"]
    own = M.Scorer(lbl, {w: i for i, w in enumerate(known)}, np.arange(4), 0, 0, None, None, None)
    every, ends, rare = own.numbered([t.encode() for t in texts])
    plain = [[w.encode() for w in words(t)] for t in texts]
    want = [known.index(w) if w in known else 4 + zlib.crc32(w) % lbl.shared for t in plain for w in t]
    assert every.tolist() == want and ends.tolist() == np.cumsum([len(t) for t in plain]).tolist()
    assert rare.to_pylist() == M.as_bytes(rare) == [w for t in plain for w in t if w not in known]


def test_words_are_counted_as_if_one_by_one(spark):
    rows = [(t,) for t in [*ODD, None] * 3]
    got = M.count_words(spark.createDataFrame(rows, "text string")).collect()
    assert {bytes(x.word): x.c for x in got} == Counter(w.encode() for t, in rows for w in words(t))


def test_numbering_costs_less_than_a_look_up_for_each_token():
    """Training and scoring number every token, so this is a large part of their CPU time."""
    r = np.random.default_rng(4)
    known = [M.END, *(b"w%d" % i for i in range(20_000))]
    own = M.Scorer(M.Lbl(), {w: i for i, w in enumerate(known)}, np.arange(len(known)), 0, 0, None, None, None)
    texts = [b" ".join(known[i] for i in r.zipf(1.2, 500) % 20_000 + 1) for _ in range(600)]

    def took(f):
        best = []
        for _ in range(5):
            at = time.thread_time()
            f()
            best.append(time.thread_time() - at)
        return min(best)

    def plain():
        for t in texts:
            np.fromiter(map(own.numbers.get, [*t.translate(M.LOWER).split(), M.END]), dtype=np.int64)

    own.numbered(texts)
    assert took(lambda: own.numbered(texts)) < took(plain)
