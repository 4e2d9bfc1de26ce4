"""Importance resampling against a plain count of the same features, and its hash table."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from canopy.llm import importance as im
from tests.llm.cases import by_key, nothing, odd, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, n):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, p):
    """(doc_id, n_features, weight, score, rank), ranks of equal (score, id) in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in features(t, p.n)[1])
    s, t = count([x for _, x in docs]), count(target)
    ns, nt = s.total() + p.buckets, t.total() + p.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt)))
    rows = []
    for key, text in docs:
        words, found = features(text, p.n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha256(f"{p.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: p.percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("n", [1, 3])
def test_equals_plain(spark, n):
    docs = [(i, prose(random.Random(i).randint(0, 60), i % 97) + " ÉTÉ x9") for i in range(400)]
    target = [prose(40, 1000 + i) for i in range(10)] + [None, ""]
    p = im.Resampling(n=n, buckets=500, percent=23)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = im.resample(table(spark, docs).repartition(7), goal, p)
    assert by_key(got.collect()) == by_key(plain(docs, target, p))


def test_odd_rows(spark):
    df = odd(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    p = im.Resampling(percent=60)
    got = im.resample(df.repartition(5), df.limit(0), p)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(t == "bigint" for _, t in got.dtypes)
    assert by_key(got.collect()) == by_key(plain(docs, [], p))


def test_empty_tables(spark):
    assert im.resample(nothing(spark), nothing(spark)).collect() == []
    short = im.resample(table(spark, [(1, "too short"), (2, None)]), odd(spark))
    assert [r.rank for r in short.collect()] == [None, None]


def test_repeated_rows_rank_apart(spark):
    """One row a third of the table: equal scores and ids, each with a rank of its own."""
    docs = [(7, prose(30, 5))] * 300 + [(i, prose(30, i)) for i in range(100, 700)]
    got = im.resample(table(spark, docs).repartition(9), odd(spark), im.Resampling(percent=100)).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 901))
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    order = sorted(got, key=lambda r: r["rank"])
    assert all((-a.score, a.doc_id) <= (-b.score, b.doc_id) for a, b in zip(order, order[1:]))


def test_table_verifies_bytes():
    """Every key equal: n-grams are told apart by their bytes alone, short and long ones."""
    r = random.Random(3)
    words = [bytes(r.choice(b"ab") for _ in range(r.choice([1, 2, 7, 8, 9, 64, 65, 90]))) for _ in range(400)]
    words += words[:100]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for digest in (lambda w: 5, lambda w: len(w), im.xxhash.xxh64_intdigest):
        slot, owner = im.intern(b"".join(words), starts, ends, digest)
        names = {}
        for w, s in zip(words, slot.tolist()):
            assert names.setdefault(s, w) == w
            assert words[owner[s]] == w
        assert len(names) == len(set(words))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(im, "AT_ONCE", 64)
    texts = [prose(500, 1).encode(), b"", prose(3, 2).encode()]
    got = [(int(t), d[a:b].decode()) for d, s, e, x in im._occurrences(texts, 2) for a, b, t in zip(s.tolist(), e.tolist(), x)]
    want = [(i, f) for i, t in enumerate(texts) for f in features(t.decode(), 2)[1]]
    assert sorted(got) == sorted(want)
