"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each is a logistic model over words and word
beginnings, and over the log-odds of all categories before it in the chain. For training, the
earlier categories' probabilities come from models that have not seen the row (out of fold), so a
later model learns how far an earlier one can be trusted on new text.

The models are fitted on a bounded sample of labelled rows (about ``Chain.sample``, picked by a
hash of their ids); features are counted and chosen over that sample on Spark, and the
chosen columns of it, a few megabytes, are fitted in numpy. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import drawn, id_text, sliced, written

#: What parts words: everything in ASCII but letters and digits.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Chain:
    """``sample``: labelled rows used; ``features``: columns kept for each category; ``folds``: out-of-fold parts."""

    categories: tuple[str, ...] = ("low_quality", "toxic")
    sample: int = 20_000
    features: int = 2048
    least_rows: int = 3
    #: Chi-square below which a column tells no more than chance would, over so many columns.
    least_score: float = 8.0
    folds: int = 3
    rounds: int = 120
    ridge: float = 2e-4
    prefixes: tuple[int, ...] = (4, 5)


def tokens(text: str, prefixes: Sequence[int]) -> set[bytes]:
    """Distinct lower-case words, their first bytes (marked) where a word is longer, and shares in tenths."""
    raw = text.encode()
    every = text.lower().encode().translate(_PARTS).split()
    if not every:
        return set()
    words = set(every)
    out = words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in prefixes))
    tenths = lambda part, whole: b"%d" % (10 * part // whole)
    out.add(b"#capitals " + tenths(len(raw) - len(raw.translate(None, _CAPITALS)), len(raw)))
    out.add(b"#marks " + tenths(len(raw) - len(raw.translate(None, _MARKS)), len(raw)))
    out.add(b"#distinct " + tenths(len(words), len(every)))
    return out


@dataclass
class Fitted:
    chain: Chain
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # category x (features, earlier categories)
    bias: np.ndarray

    def probabilities(self, text: str) -> list[float]:
        get = self.vocabulary.get
        own = [i for i in map(get, tokens(text, self.chain.prefixes)) if i is not None]
        n, odds = len(self.vocabulary), []
        for k in range(len(self.bias)):
            z = self.bias[k] + self.weights[k, own].sum() + sum(w * o for w, o in zip(self.weights[k, n:], odds))
            odds.append(float(np.clip(z, -15, 15)))
        return [1 / (1 + np.exp(-z)) for z in odds]


def _logistic(columns: np.ndarray, starts: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, chain: Chain) -> np.ndarray:
    """Weights (features, extra columns, bias) by full-batch Adam; rows are runs of ``columns``."""
    n = len(y)
    owner = np.repeat(np.arange(n), np.diff(starts))
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(width + extra.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # rare positives weigh more
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, chain.rounds + 1):
        z = np.bincount(owner, weights=w[columns], minlength=n) + extra @ w[width:-1] + w[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(columns, weights=error[owner], minlength=width), extra.T @ error, [error.sum()]])
        g[:-1] += chain.ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _margin(columns: np.ndarray, starts: np.ndarray, extra: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    z = np.bincount(owner, weights=w[columns], minlength=n) + extra @ w[width:-1] + w[-1]
    return np.clip(z, -15, 15)


def _rows(columns: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)
    return columns[np.repeat(chosen, sizes)], np.concatenate([[0], np.cumsum(sizes[chosen])])


def fit_chain(columns: np.ndarray, starts: np.ndarray, labels: np.ndarray, fold: np.ndarray, width: int, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of each category; ``labels`` is rows x categories, ``fold`` a row's part."""
    n, k = labels.shape
    weights, bias = np.zeros((k, width + k)), np.zeros(k)
    odds = np.zeros((n, 0))
    for c in range(k):
        y = labels[:, c].astype(float)
        w = _logistic(columns, starts, odds, y, width, chain)
        weights[c, : width + c], bias[c] = w[:-1], w[-1]
        unseen = np.zeros(n)
        for f in range(chain.folds):
            out = fold == f
            if not out.any() or out.all():
                unseen[out] = _margin(*_rows(columns, starts, out), odds[out], w, width)
                continue
            part = _logistic(*_rows(columns, starts, ~out), odds[~out], y[~out], width, chain)
            unseen[out] = _margin(*_rows(columns, starts, out), odds[out], part, width)
        odds = np.column_stack([odds, unseen])
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, chain: Chain = Chain()) -> Fitted:
    """Fit on ``labels (doc_id, <categories> 0/1)``; rows without a label or text are left out.

    A doc_id labelled twice counts as positive if one label is. With no labelled rows, or rows of
    one kind only, a category's probability is their share (nearly 0 for none).
    """
    spark = docs.sparkSession
    names = chain.categories
    flags = [F.max(F.col(f"`{c}`").cast("int")).alias(c) for c in names]
    known = labels.select(F.col("doc_id").cast("long"), *names).dropna().groupBy("doc_id").agg(*flags)
    sample = drawn(known, F.col("doc_id"), known.count(), chain.sample)
    # Bounded: the sample's ids and labels.
    texts = id_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", *names)
    prefixes = chain.prefixes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            found = [list(tokens(x, prefixes)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary())), *batch.columns[2:]], ["doc_id", "words", *names]
            )

    kinds = ", ".join(f"{c} int" for c in names)
    rows = written(texts.mapInArrow(features, f"doc_id long, words array<binary>, {kinds}"), "toxic-sample")
    count = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    if not count.n:
        return Fitted(chain, {}, np.zeros((len(names), len(names))), np.full(len(names), -12.0))
    words = rows.select(F.explode("words").alias("word"), *names).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]
    ).where(F.col("n") >= chain.least_rows)
    words = written(words, "toxic-words")
    vocabulary: dict[bytes, int] = {}
    for c in names:
        # Signed chi-square against the share of positives, both signs.
        share = min(max(count[c] / count.n, 1e-6), 1 - 1e-6)
        score = F.pow(F.col(c) - F.lit(share) * F.col("n"), F.lit(2)) / (F.col("n") * F.lit(share * (1 - share)))
        top = words.select("word", score.alias("s")).where(F.col("s") >= chain.least_score)
        for r in top.orderBy(F.desc("s"), "word").limit(chain.features).collect():
            vocabulary.setdefault(bytes(r.word), len(vocabulary))
    sent = spark.sparkContext.broadcast(vocabulary)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in sliced(batches, 256):
            found = [sorted(i for i in map(get, x) if i is not None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "columns", *names]
            )

    table = rows.mapInArrow(chosen, f"doc_id long, columns array<int>, {kinds}").orderBy("doc_id").toArrow()
    lists = table.column("columns").combine_chunks()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists.to_pylist()])]).astype(np.int64)
    columns = np.array([i for x in lists.to_pylist() for i in x], dtype=np.int64)
    y = np.column_stack([table.column(c).to_numpy() for c in names])
    fold = (table.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(chain.folds)
    weights, bias = fit_chain(columns, starts, y, fold.astype(int), len(vocabulary), chain)
    return Fitted(chain, vocabulary, weights, bias)


def score(df: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_<category>..., <category>...``: probabilities, and whether they reach one half.

    One row for each row of ``df``, over whole texts. A null text is empty and gets the chain's
    base rates; a null id stays null; repeated rows score alike; an empty table gives an empty
    one; other columns are left out.
    """
    names = fitted.chain.categories
    sent = df.sparkSession.sparkContext.broadcast(fitted)  # bounded by features x categories

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches):
            p = [model.probabilities(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*p)) if p else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.float64()) for c in columns]], ["doc_id", *[f"p_{c}" for c in names]]
            )

    out = id_text(df, id_col, text_col).mapInArrow(scored, "doc_id long, " + ", ".join(f"p_{c} double" for c in names))
    return out.select("*", *[(F.col(f"p_{c}") >= 0.5).alias(c) for c in names])


def toxic_documents(docs: DataFrame, labels: DataFrame, chain: Chain = Chain()) -> DataFrame:
    """Chain fitted on ``labels (doc_id, quality, toxic)``, every document scored."""
    flags = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
    return score(docs, train(docs, flags, chain))
