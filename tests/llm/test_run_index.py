import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import run_index as X
from tests.llm.cases import by_key, nothing, odd


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, gone) if not m)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def report(df, length, block=X.BLOCK):
    got = X.remove_repeats(df, length, block)
    return by_key(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_suffix_ranks():
    r = random.Random(1)
    for n in (1, 5, 300):
        text = bytes(r.choice(b"ab") for _ in range(n))
        order = sorted(range(n), key=lambda i: text[i:])
        assert [order[k] for k in range(n)] == np.argsort(X.suffix_ranks(np.frombuffer(text, dtype=np.uint8))).tolist()


def test_matching_statistics():
    r = random.Random(2)
    for _ in range(30):
        text = bytes(r.choice(b"abc") for _ in range(60)) + b"\xff"
        index = X.RunIndex(np.frombuffer(text, dtype=np.uint8))
        want = []
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                k = 0
                while i != j and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert index.matches().tolist() == want
        assert index.runs[1].sum() == len(text) and len(index.heads) == len(index.runs[0])


def test_repeated_starts():
    r = random.Random(3)
    for _ in range(60):
        base = bytes(r.choice(b"ab") for _ in range(300))
        contexts = []
        for _ in range(r.randint(1, 12)):
            a = r.randint(0, 200)
            x = bytearray(base[a : a + r.randint(40, 100)])
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.choice(b"abc")
            contexts.append(bytes(x) if r.random() < 0.8 else b"a" * r.randint(30, 80))
        times = Counter(x[i : i + 40] for x in contexts for i in range(len(x) - 39))
        got = [{i for a, n in runs for i in range(a, a + n)} for runs in X.repeated_starts(contexts, 40)]
        assert got == [{i for i in range(len(x) - 39) if times[x[i : i + 40]] > 1} for x in contexts]


@pytest.mark.parametrize("n", [2, 100, 127, 128, 129, 130, 257])
@pytest.mark.parametrize("at", [1, -1, "middle"])
def test_first_context(n, at):
    """The first context has no byte before it, whichever byte the block ends with."""
    r = random.Random(n)
    make = lambda k: bytes(r.choice(b"abcdefgh") for _ in range(k))
    shared = make(60)
    contexts = [make(80) for _ in range(n)]
    for i in (0, n // 2 if at == "middle" else at):
        contexts[i] = shared + make(30)
    times = Counter(x[i : i + 40] for x in contexts for i in range(len(x) - 39))
    got = [{i for a, k in runs for i in range(a, a + k)} for runs in X.repeated_starts(contexts, 40)]
    assert got == [{i for i in range(len(x) - 39) if times[x[i : i + 40]] > 1} for x in contexts]


def test_equal_byte_before():
    """The block's last byte is also the one before another context with the first one's beginning."""
    r = random.Random(8)
    make = lambda k: bytes(r.choice(b"abcdefgh") for _ in range(k))
    for n, other in ((129, 1), (257, 1), (257, 129), (256, 128), (300, 44)):
        shared = make(60)
        contexts = [make(50) for _ in range(n)]
        contexts[0], contexts[other] = shared + b"X" + make(20), shared + b"Y" + make(25)
        got = X.repeated_starts(contexts, 40)
        assert got[0] == got[other] == [(0, 21)]


def test_begins_within_a_character(spark):
    """The last byte of a character and what follows, where another context begins with what follows."""
    r = random.Random(9)
    tail = bytes(r.choice(b"abcdefgh") for _ in range(39))
    contexts = [bytes([0x80 + i]) + tail for i in range(64)]
    contexts = [c for x in contexts for c in (x, tail + bytes([x[0] - 0x60]))]
    assert not any(X.repeated_starts(contexts, 40))
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows, same = [], [text(230) for _ in range(30)]
    for i, x in enumerate(same):
        rows += [(3 * i, x + text(50)), (3 * i + 1, text(40) + chr(0x4000 + i) + x + text(60)), (3 * i + 2, chr(0xC0 + i) + x)]
    assert report(spark.createDataFrame(rows, "doc_id long, text string"), 200) == by_key(brute(rows, 200))


def test_after_alike_ends():
    """Contexts that begin alike, after ends whose last bytes are alike."""
    r = random.Random(10)
    make = lambda k: bytes(r.choice(b"abcdefgh") for _ in range(k))
    contexts, shared = [make(60) for _ in range(1000)], make(50)
    for i in range(1, 1000, 3):
        contexts[i] = shared + bytes([i % 100]) + make(20)
    got = X.repeated_starts(contexts, 40)
    assert [x[:1] for x in got[1::3]] == [[(0, x[0][1])] for x in got[1::3]] and all(x[0][1] >= 11 for x in got[1::3])


@pytest.mark.parametrize("block", [X.BLOCK, 2000, 600])
def test_against_all_windows(spark, block):
    """Small blocks crowd nearly every anchor, so that windows are counted by hash."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    own = lambda: "".join(r.choice("xyzuvw ") for _ in range(r.randint(0, 300)))
    rows = [(i, own() + passage[r.randint(0, 300) : r.randint(350, 700)] + own()) for i in range(60)]
    rows += [(None, None), (70, ""), (71, "a" * 3000), (72, rows[0][1]), (72, rows[0][1]), (None, "é日" * 300), (73, "ab" * 900 + "c" + "ab" * 500)]
    assert report(spark.createDataFrame(rows, "doc_id long, text string"), 200, block) == by_key(brute(rows, 200))


def test_stretches(monkeypatch):
    """Records of a text taken in stretches cover the same windows once."""
    r = random.Random(6)
    text = bytes(r.choice(b"abcd") for _ in range(4000))
    monkeypatch.setattr(X, "STRETCH", 500)
    anchor, context, first, n = X.records(text, 200)
    assert [i for a, k in zip(first.tolist(), n.tolist()) for i in range(a, a + k)] == list(range(4000 - 199))


def test_odd_rows(spark):
    df = odd(spark)
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert report(df, 200) == by_key(brute(rows, 200))
    assert X.repeat_report(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        X.remove_repeats(df, 30)
