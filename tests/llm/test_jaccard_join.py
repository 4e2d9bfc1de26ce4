"""The Jaccard join against all pairs, on sets that share few, many and almost all tokens."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from canopy.llm import jaccard_join as jj
from tests.llm.cases import by_key, nothing, odd, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def plain(docs, p):
    sets = [shingles(t, p.words) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= p.percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(docs):
        r = find(i)
        least[r] = key if least.get(r) is None else least[r] if key is None else min(key, least[r])
    return [(key, len(s), least[find(i)]) for i, ((key, _), s) in enumerate(zip(docs, sets))]


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return words


def corpus(seed=1):
    """Near copies around bases, a passage that many texts share, chains of links, short texts."""
    r = random.Random(seed)
    docs = []
    for base in range(6):
        words = prose(r.choice([12, 60, 150, 400]), base).split()
        for _ in range(r.choice([2, 5, 40, 90])):
            docs.append(" ".join(edited(words, r.randint(0, max(1, len(words) // 40)), r)))
    passage = prose(80, 77).split()
    for i in range(80):
        own = [f"o{i}w{j}" for j in range(r.randint(0, 30))]
        docs.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    chain = prose(90, 5).split()
    for i in range(25):
        docs.append(" ".join(chain))
        chain[(7 * i) % 90] = f"c{i}"
    for n in range(1, 14):
        docs += [" ".join(f"s{j}" for j in range(n)), " ".join(f"S{j}" for j in range(n + 1))]
    docs += [prose(r.randint(1, 50), 100 + i) for i in range(60)] + ["", None, " \n "]
    r.shuffle(docs)
    return [(1000 - i, t) for i, t in enumerate(docs)]


SETTINGS = [
    jj.Join(),
    jj.Join(levels=((3, 2), (12, 3)), crowd=4, bucket=1 << 10),
    jj.Join(levels=((2, 2),), crowd=2, table=40),
    jj.Join(percent=60, levels=((4, 2), (30, 4)), crowd=8, words=3),
    jj.Join(percent=95, levels=((1, 3),), crowd=3),
]


@pytest.mark.parametrize("p", SETTINGS, ids=str)
def test_equals_all_pairs(spark, p):
    docs = corpus()
    got = jj.jaccard_components(table(spark, docs).repartition(6), p)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and all(t == "bigint" for _, t in got.dtypes)
    assert by_key(got.collect()) == by_key(plain(docs, p))


def test_odd_rows(spark):
    df = odd(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert by_key(jj.jaccard_components(df.repartition(5)).collect()) == by_key(plain(docs, jj.Join()))


def test_empty_table(spark):
    assert jj.jaccard_components(nothing(spark)).collect() == []


def test_hot_copies(spark):
    """A third of all rows is one text, and as many share an id."""
    docs = [(i, prose(50, 1)) for i in range(300)] + [(7, prose(30, i)) for i in range(300)] + [(None, prose(40, 5))] * 3
    assert by_key(jj.jaccard_components(table(spark, docs).repartition(8)).collect()) == by_key(plain(docs, jj.Join()))


@pytest.mark.parametrize("seed", range(40))
def test_linked_sets_share_a_signature(seed):
    """For classes, sizes and bands drawn at random: every pair that links meets in some signature."""
    r = random.Random(seed)
    p = jj.Join(percent=r.choice([50, 70, 80, 90]), levels=((1, r.choice([2, 3])), (2, r.choice([3, 4]))))
    n = r.choice([4, 9, 17, 31, 64, 130, 260])
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
    size = dict(zip(pool.tolist(), rng.choice([1, p.levels[0][1], p.levels[1][1]], 3 * n, p=[0.2, 0.4, 0.4]).tolist()))
    a = np.unique(pool[:n])
    for _ in range(10):
        change = r.randint(0, max(1, n // 4))
        b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), change, replace=False)), pool[n : n + r.randint(0, change + 1)]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < p.percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
            continue
        of = lambda s: set(np.concatenate(jj.signatures(s, np.array([size[t] for t in s.tolist()]), p)).tolist())
        assert of(a) & of(b)


def test_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(jj, "WINDOW", 64)
    hasher = jj.Hasher()
    texts = [b"one two three four five six", b"x" * 200 + b" y z", b"", b"zero one two three four five six seven", b"Six"]
    apart = [jj.token_sets([t], 3, hasher)[0].tolist() for t in texts]
    assert [s.tolist() for s in jj.token_sets(texts, 3, hasher)] == apart
    assert len(set(apart[0]) & set(apart[3])) == 4 and [len(s) for s in apart] == [4, 1, 0, 6, 1]


def test_bitmaps_never_exclude_links():
    """Their differing bits, at any size, are at most the tokens in which sets differ."""
    rng = np.random.default_rng(2)
    p = jj.Join()
    for n in (10, 100, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for cut in (0, n // 20, n // 9, n // 2):
            b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, cut // 2, dtype=np.uint64)])
            x, y = jj.parity(a), jj.parity(b)
            for words in (16, min(len(x), len(y)) // 8):
                assert np.bitwise_count(jj._folded(x, words) ^ jj._folded(y, words)).sum(dtype=int) <= cut + cut // 2
            linked = 100 * (n - cut) >= p.percent * (len(a) + len(b) - n + cut)
            assert jj._fit(x, y, len(a), len(b), p) or not linked
            assert linked or cut < n // 2 or not jj._fit(x, y, len(a), len(b), p)


@pytest.mark.parametrize("n", [300, 500, 2000, 5000])
def test_combinations_stay_fewer_than_tokens(n):
    """Where all tokens are frequent, as those of a growing corpus become, a set sends no square of its prefix."""
    tokens = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    single, many = jj.signatures(tokens, np.full(len(tokens), 2), jj.Join())
    assert len(single) == 0 and len(many) < n


def test_copies_are_one_set(spark, monkeypatch):
    """Copies in many tasks make no token frequent, so no combination of any is sent."""
    sent, rows = [], jj.combination_rows
    monkeypatch.setattr(jj, "combination_rows", lambda *a: sent.append(rows(*a)) or sent[-1])
    text = " ".join(f"w{i}" for i in range(60))
    rest = [(100, text + " more"), (101, None), (None, "a text of no id " * 3)]
    df = spark.createDataFrame([(i, text) for i in range(64)] + rest, "doc_id long, text string").repartition(64)
    got = {r.doc_id: r for r in jj.jaccard_components(df).collect()}
    assert len(got) == 67 and {got[i].component_id for i in [*range(64), 100]} == {0} and got[101].component_id == 101
    assert sent[0].count() == 0
