import random

import numpy as np

from canopy.llm import toxicity as T
from tests.llm.cases import nothing, odd, prose


def corpus(spark, n=900, seed=1):
    """Invented insults with changing endings; every fourth text holds some, long ones too."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(r.randint(20, 400), 1000 * seed + i).split()
        toxic = i % 4 == 0
        for _ in range(r.randint(1, 3) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["zorgling", "brakkel", "vexil"]) + r.choice(["", "en", "ora", "us"]))
        low = i % 7 == 0
        rows.append((i, " ".join(words).upper() + " !!" if low else " ".join(words)))
        if low:
            rows[-1] = (i, rows[-1][1] + " !! BUYNOW" * 3)
        labels.append((i, 0 if low else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    got = {x.doc_id: x for x in T.toxic_documents(docs, labels.where("doc_id % 2 = 0 or doc_id % 4 = 3")).collect()}
    unseen = [x for x in labels.collect() if x.doc_id % 4 == 1]
    assert not any(got[x.doc_id].toxic for x in unseen)  # clean texts are left alone
    fresh, truth = corpus(spark, 400, 2)
    fitted = T.train(docs, labels.selectExpr("doc_id", "1 - quality as low_quality", "toxic"))
    told = {x.doc_id: x for x in T.score(fresh, fitted).collect()}
    hits = [(told[x.doc_id].toxic, bool(x.toxic)) for x in truth.collect()]
    assert np.mean([a for a, b in hits if b]) >= 0.95 and np.mean([a for a, b in hits if not b]) <= 0.01


def test_given_tables(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxic_documents(docs, labels)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic"] and got.count() == docs.count()
    rows = got.join(labels.select("doc_id", "quality", T.F.col("toxic").alias("truth")), "doc_id").collect()
    assert np.mean([x.toxic for x in rows if x.truth]) >= 0.95
    assert not any(x.toxic for x in rows if not x.truth)


def test_chain_uses_earlier_categories():
    """The second category follows from the first alone, which only its column tells."""
    r = np.random.default_rng(1)
    n = 600
    first = r.integers(0, 2, n)
    columns, starts = np.flatnonzero(first) * 0, np.concatenate([[0], np.cumsum(first)])
    labels = np.column_stack([first, 1 - first])
    chain = T.Chain(categories=("a", "b"))
    weights, bias = T.fit_chain(columns, starts, labels, np.arange(n) % 3, 1, chain)
    assert weights.shape == (2, 3) and weights[1, 1] < 0  # more of a, less of b
    fitted = T.Fitted(chain, {b"x": 0}, weights, bias)
    assert fitted.probabilities("x")[1] < 0.5 < fitted.probabilities("")[1]


def test_odd_rows(spark):
    df = odd(spark)
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 1), (5, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, 1), (77, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int"
    )
    rows = T.toxic_documents(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= x.p_toxic <= 1 for x in rows)
    assert T.toxic_documents(nothing(spark), labels).count() == 0
    none = T.toxic_documents(df, labels.where("false")).collect()
    assert len(none) == df.count() and not any(x.toxic for x in none)
