import base64
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from canopy.llm import quality_rules as Q
from tests.llm.cases import nothing, odd, prose

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered, seen, lines = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(WORD, line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


@given(st.text(alphabet="ab #é\n\t|", max_size=150))
@settings(max_examples=200, deadline=None)
def test_counts(text):
    assert Q.Judge(Q.Bands())(text)[:6] == brute(text)


def test_odd_rows(spark):
    df = odd(spark)
    got = Q.judge_quality(df)
    rows = got.collect()
    assert sorted(((x.doc_id, *x[1:7]) for x in rows), key=str) == sorted(((x.doc_id, *brute(x.text or "")) for x in df.collect()), key=str)
    assert not any(x.kept for x in rows if x.base_failed)
    assert Q.judge_quality(nothing(spark)).count() == 0


def test_bands():
    judge = Q.Judge(Q.Bands())
    r = random.Random(1)
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(200))
    sound = prose(1500, 2)
    lines = "\n".join(f"{i} all lines are alike but for their number {i}" for i in range(400))
    assert not judge(noise)[5] and not judge(noise)[6]
    assert judge(sound)[6]
    assert judge(lines)[7] < 0.2 and not judge(lines)[6]
    # half a text of noise: the chunks tell, as the whole may not
    assert judge(sound + "\n" + noise)[8] > 0.3 and not judge(sound + "\n" + noise)[6]


@pytest.mark.parametrize("n", [500, 700, 1000, 1200, 1600, 1700, 2000, 3000, 4090, 5000, 9000, 20000, 70000])
def test_noise_of_any_length(n):
    """Wrapped base64 from 500 bytes on, random words where clean text is well below them."""
    judge = Q.Judge(Q.Bands())
    r = random.Random(n)
    words = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(4, 9))) for _ in range(n))[:n]
    for _ in range(20):
        coded = base64.encodebytes(r.randbytes(n)).decode()[:n]
        assert Q._outside(n, judge(coded)[7], judge.bands) and not judge(coded)[6]
        assert n < 1536 or not judge(words("abcdefghijklmnopqrstuvwxyz0123456789"))[6]
        assert n < 4096 or not judge(words("abcdefghijklmnopqrstuvwxyz"))[6]


def test_clean_text_of_any_length(spark):
    """The beginnings of clean texts in every language are below the upper limits."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judge = Q.Judge(Q.Bands())
    limit = lambda n: next(b for least, _, b in reversed(Q.BANDS) if n >= least)
    rows = docs.join(labels.where("quality = 1"), "doc_id").select("lang", "text").collect()
    assert len({x.lang for x in rows}) > 1
    for n in sorted({least for least, _, _ in Q.BANDS[1:]} | {500, 1000, 1700, 2500, 4090, 5000}):
        assert all(judge.ratio(x.text.encode()[:n]) <= limit(n) for x in rows if len(x.text.encode()) >= n)


def test_clean_labels_are_kept(spark):
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.judge_quality(docs).join(labels, "doc_id").collect()
    assert all(x.kept for x in rows if x.quality == 1 and not x.base_failed)
    bad = [x for x in rows if x.quality == 0 and x.zstd_ratio < 0.2 and x.n_words > 200]
    assert not any(x.kept for x in bad)


def test_filter_keeps_columns(spark):
    df = odd(spark)
    kept = Q.keep_quality(df)
    assert kept.schema == df.schema
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in Q.judge_quality(df).where("kept").collect()}
