"""Scores of a log-bilinear neural language model, trained with noise-contrastive estimation.

Every training word with ``least`` or more counts has vectors of its own, so the vocabulary grows
with the corpus; rarer words share the vectors of ``shared`` groups by a hash. From the vectors
``r`` of the two words before, the next word's score is

    s(w | u, v) = h . q_w + b_w,   h = c1 * r_u + c2 * r_v

Words lie in classes of about equal sums of root counts, and classes have vectors and biases too.
Training tells true words (and classes) from ones drawn from the unigram distribution, so it needs
no normaliser. Tasks train copies of the model on all their tokens; Spark averages the copies, each
word weighted by how often a copy met it, and a second round starts from the average.

Scoring is exactly normalised, in two levels of batched matrix products: over the classes, and over
the words of the true one. A word of a group shares its probability by smoothed counts, like the
base score; counts cover all training texts.

Tasks hold the counts and vectors of the ``known`` most frequent words. The rarer words of a
document are joined with their counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import LOWER, LOWER_SPACED, id_text, raw, sliced, written

#: An id cannot hold a space, so this cannot be a word.
END = b" end"


@dataclass(frozen=True)
class Lbl:
    """``known`` bounds the counts sent to every task, ``longest`` the bytes of a word among them.

    Of the known words, those with ``least`` counts have own vectors, ``words`` of them at most.
    """

    least: int = 3
    words: int = 1 << 17
    known: int = 1 << 17
    longest: int = 64
    shared: int = 64
    classes: int = 256
    #: Tokens that one copy of the model is trained on, if there are so many.
    stretch: int = 1 << 24
    dim: int = 16
    noise: int = 32
    batch: int = 512
    rate: float = 0.07
    past: float = 1e-6
    rounds: int = 2
    parts: int = 5
    held_part: int = 1
    seed: int = 1


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after another, and how many each text has; ends are left out."""
    joined = b" ".join(texts)
    word = np.frombuffer(b" %b " % joined.translate(LOWER_SPACED), dtype=np.uint8) != 32
    turn = np.flatnonzero(word[1:] != word[:-1])
    first, ends = turn[::2], np.cumsum(turn[1::2] - turn[::2])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    buffers = [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(joined.translate(LOWER, b" \t\n\v\f\r"))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), buffers), np.diff(np.searchsorted(first, begins))


def as_bytes(words: pa.Array) -> list[bytes]:
    """As ``to_pylist`` without a scalar for each word."""
    _, at, data = words.buffers()
    at = np.frombuffer(at, dtype=np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


def _split(df: DataFrame, lbl: Lbl, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, held_out``; a null id counts as an empty one."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % lbl.parts
    return id_text(df, id_col, text_col).withColumn("held_out", part == lbl.held_part)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c``: over all rows of ``docs (text)``; partial counts leave a task, not words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room, texts = [], 1 << 26, 0

        def told() -> Iterator[pa.RecordBatch]:
            found = pa.chunked_array(held, pa.large_binary()).value_counts()
            words, c = found.field(0).cast(pa.binary()), found.field(1)
            rows = [pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([c, pa.array([texts], c.type)])]
            return sliced([pa.RecordBatch.from_arrays(rows, ["word", "c"])], 1 << 17)

        for batch in sliced(batches, 1024):
            words, sizes = words_of(raw(batch.column(0)))
            held.append(words)
            room -= words.nbytes
            texts += len(sizes)
            if room < 0:
                yield from told()
                held, room, texts = [], 1 << 26, 0
        if texts:
            yield from told()

    parts = docs.select("text").mapInArrow(counted, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


# --- the model ------------------------------------------------------------------------------------


def _with_bias(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([q, b]))


def _log_softmax(h: np.ndarray, q: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Natural logs of the picked entries' shares, a few rows at a time; a one in ``h`` meets the biases in ``q``."""
    out = np.empty(len(h))
    step = max(1, (1 << 16) // len(q))
    room, columns = np.empty((min(step, len(h)), len(q)), dtype=np.float32), np.ascontiguousarray(q.T)
    for at in range(0, len(h), step):
        some = h[at : at + step]
        s = np.matmul(some, columns, out=room[: len(some)])
        own = s[np.arange(len(s)), pick[at : at + step]].astype(np.float64)
        with np.errstate(over="ignore"):
            total = np.exp(s, out=s).sum(1)
        wide = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # beyond single precision
        if len(wide):
            again = some[wide] @ columns
            top = again.max(1)
            own[wide] -= top
            total[wide] = np.exp(again - top[:, None]).sum(1)
        out[at : at + step] = own - np.log(total)
    return out


@dataclass
class Model:
    """Vectors and biases of words, entry 0 being the end of a text, and of their classes."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray  # two rows: weights of the word before, and of the one before that
    qc: np.ndarray
    bc: np.ndarray
    log_share: np.ndarray  # unigram log probabilities
    order: np.ndarray  # words class by class
    bounds: np.ndarray  # where classes begin in ``order``, and its length

    @cached_property
    def class_of(self) -> np.ndarray:
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return out

    @cached_property
    def class_log_share(self) -> np.ndarray:
        return np.log(np.add.reduceat(np.exp(self.log_share[self.order]), self.bounds[:-1]))

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """What scoring gathers from.

        Vectors and biases of words, class by class, and of classes; each word's place in its class;
        what a word adds to the next one's context, and to that of the one after it.
        """
        place = np.empty(len(self.order), dtype=np.int64)
        place[self.order] = np.arange(len(self.order)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        words = _with_bias(self.q[self.order], self.b[self.order])
        return words, _with_bias(self.qc, self.bc), place, self.r * self.c[0], self.r * self.c[1]

    def copy(self) -> Model:
        own = (x.copy() for x in (self.r, self.q, self.b, self.c, self.qc, self.bc))
        return Model(*own, self.log_share, self.order, self.bounds)

    def log_probabilities(self, w: np.ndarray, u: np.ndarray, v: np.ndarray, rows: int = 1 << 17) -> np.ndarray:
        """Natural logs of ``P(w | u, v)``; over all ``w`` they sum to one."""
        parts = [self._some(w[a : a + rows], u[a : a + rows], v[a : a + rows]) for a in range(0, len(w), rows)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _some(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        words, classes, place, one, two = self.tables
        own = self.class_of.take(w)
        by = np.argsort(own.astype(np.min_scalar_type(len(self.bc))), kind="stable")
        own, place = own.take(by), place.take(w.take(by))
        h = np.ones((len(w), words.shape[1]), dtype=np.float32)
        np.add(one.take(u.take(by), axis=0), two.take(v.take(by), axis=0), out=h[:, :-1])
        found = _log_softmax(h, classes, own)
        ends = np.cumsum(np.bincount(own, minlength=len(self.bc))).tolist()
        for lo, hi, a, b in zip(self.bounds, self.bounds[1:], [0, *ends], ends):
            if hi - lo > 1 and a < b:
                found[a:b] += _log_softmax(h[a:b], words[lo:hi], place[a:b])
        out = np.empty(len(w))
        out[by] = found
        return out


def start_model(counts: np.ndarray, lbl: Lbl) -> Model:
    """Unigram scores as biases; small random vectors, the same everywhere."""
    rng = np.random.default_rng(lbl.seed)
    counts = np.maximum(counts, 0.5).astype(np.float64)
    share = np.log(counts / counts.sum())
    order = np.argsort(-counts, kind="stable")
    root = np.sqrt(counts[order])
    into = ((np.cumsum(root) - root) / root.sum() * min(lbl.classes, math.isqrt(len(root)) + 1)).astype(np.int64)
    bounds = np.append(np.flatnonzero(np.diff(into, prepend=-1)), len(counts))
    small = lambda n: rng.normal(0, 0.1, (n, lbl.dim)).astype(np.float32)
    k = len(bounds) - 1
    own = Model(
        small(len(counts)), small(len(counts)), share.astype(np.float32), np.ones((2, lbl.dim), dtype=np.float32),
        small(k), np.zeros(k, dtype=np.float32), share, order, bounds,
    )
    own.bc = own.class_log_share.astype(np.float32)
    return own


def before(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, the ones before them, and the ones before those; texts begin after ends (0)."""
    w = np.concatenate(lists)
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    u = np.concatenate([[0], w[:-1]])
    u[starts] = 0
    v = np.concatenate([[0], u[:-1]])
    v[starts] = 0
    return w, u, v


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ``rows`` (numbers from 0) comes in a stable order, and the rows in it: a sort of packed numbers beats that of places."""
    bits = len(rows).bit_length()
    packed = np.sort((rows.astype(np.int64) << bits) | np.arange(len(rows)))
    return packed & ((1 << bits) - 1), packed >> bits


class Trainer:
    """Noise-contrastive steps in place, with Adagrad on rows.

    A batch shares its noise words, so their scores are one matrix product. With ``k`` of them
    drawn from ``p_n``, a word is true with probability ``sigmoid(s - log(k p_n))``; classes
    likewise, with noise classes.
    """

    def __init__(self, model: Model, lbl: Lbl, seed: int) -> None:
        self.model, self.lbl = model, lbl
        self.rng = np.random.default_rng(seed)
        self.past = {k: np.full(len(getattr(model, k)), lbl.past, dtype=np.float32) for k in ("r", "q", "b", "c", "qc", "bc")}
        kinds = (model.log_share, model.class_log_share)
        self.drawn_from = [np.cumsum(np.exp(x)) / np.exp(x).sum() for x in kinds]
        self.prior = [(x + np.log(lbl.noise)).astype(np.float32) for x in kinds]

    def _move(self, rows: np.ndarray, **changes: np.ndarray) -> None:
        """One Adagrad step for rows that may repeat; their changes are added up first."""
        order, ranked = _ranked(rows)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        own = ranked.take(first)
        for name, change in changes.items():
            table, past = getattr(self.model, name), self.past[name]
            total = np.add.reduceat(change.take(order, axis=0), first, axis=0)
            total /= np.float32(self.lbl.batch)
            square = np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1]) if total.ndim > 1 else total * total
            square += past.take(own)
            past[own] = square
            step = np.float32(self.lbl.rate) / np.sqrt(square)
            total *= step[:, None] if total.ndim > 1 else step
            table[own] = table.take(own, axis=0) - total

    def _told(self, level: int, q: str, b: str, true: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Moves the vectors of true and noise entries; the change of ``h``."""
        vectors, bias, prior = getattr(self.model, q), getattr(self.model, b), self.prior[level]
        noise = np.searchsorted(self.drawn_from[level], self.rng.random(self.lbl.noise))
        noise = np.minimum(noise, len(bias) - 1)
        qt, qn = vectors.take(true, axis=0), vectors[noise]
        # A sigmoid less one for true entries, a sigmoid for noise.
        up = -1 / (1 + np.exp(np.einsum("ij,ij->i", h, qt) + bias.take(true) - prior.take(true)))
        down = h @ qn.T
        down += bias[noise] - prior[noise]
        np.negative(down, out=down)
        with np.errstate(over="ignore"):  # infinite: no chance
            np.exp(down, out=down)
        down += 1
        np.reciprocal(down, out=down)
        change = np.empty((len(true) + len(noise), h.shape[1]), dtype=np.float32)
        np.multiply(up[:, None], h, out=change[: len(true)])
        np.matmul(down.T, h, out=change[len(true) :])
        self._move(np.concatenate([true, noise]), **{q: change, b: np.concatenate([up, np.einsum("ij->j", down)])})
        qt *= up[:, None]
        qt += down @ qn
        return qt

    def steps(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        """One pass over tokens ``w`` after ``u`` after ``v``."""
        m, lbl = self.model, self.lbl
        classes, past = m.class_of, self.past["c"]
        for at in range(0, len(w), lbl.batch):
            a, b, c = w[at : at + lbl.batch], u[at : at + lbl.batch], v[at : at + lbl.batch]
            ru, rv = m.r.take(b, axis=0), m.r.take(c, axis=0)
            weights = m.c.repeat(len(a), axis=0).reshape(2, *ru.shape)
            h = ru * weights[0]
            h += rv * weights[1]
            dh = self._told(0, "q", "b", a, h)
            dh += self._told(1, "qc", "bc", classes.take(a), h)
            dc = np.stack([np.einsum("ij->j", dh * ru), np.einsum("ij->j", dh * rv)])
            weights *= dh
            self._move(np.concatenate([b, c]), r=weights.reshape(-1, dh.shape[1]))
            dc /= np.float32(lbl.batch)
            past += (dc * dc).mean(1)
            m.c -= np.float32(lbl.rate) / np.sqrt(past)[:, None] * dc


# --- Spark ----------------------------------------------------------------------------------------


def _group(word: bytes, lbl: Lbl) -> int:
    return zlib.crc32(word) % lbl.shared


@dataclass
class Scorer:
    """Everything a task needs: bounded by ``known`` words and the model.

    A number below ``len(counts)`` is a known word, a later one a group of words that are not known.
    """

    lbl: Lbl
    numbers: dict[bytes, int]
    counts: np.ndarray  # of the known words
    total: int
    distinct: int
    entry: np.ndarray  # the model's entry of each number
    room: np.ndarray  # smoothed tokens of each group
    model: Model

    @property
    def base_room(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @cached_property
    def known(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.large_binary())

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of all tokens, where texts end among them, and the words that are not known, in order."""
        words, sizes = words_of(texts)
        found = pc.index_in(words, value_set=self.known)
        own, rare = found.fill_null(-1).to_numpy().astype(np.int64), words.filter(found.is_null())
        own[own < 0] = [len(self.counts) + _group(x, self.lbl) for x in as_bytes(rare)]
        ends = np.cumsum(sizes + 1)
        out = np.zeros(len(words) + len(sizes), dtype=np.int64)  # an end's number is 0
        is_word = np.ones(len(out), dtype=bool)
        is_word[ends - 1] = False
        out[is_word] = own
        return out, ends, rare

    def in_group(self) -> np.ndarray:
        """What a word adds to the log10 probability of its entry; its count is still to come if not known."""
        out = -np.log10(np.append(np.ones(len(self.entry) - len(self.room)), self.room))
        group = self.entry[: len(self.counts)] - (len(self.model.b) - len(self.room))
        shared = np.flatnonzero(group >= 0)
        out[shared] = np.log10((self.counts[shared] + 0.5) / self.room[group[shared]])
        return out


def _averaged(texts: DataFrame, scorer: Scorer, lbl: Lbl, number: int) -> Model:
    """The average of the models that tasks train on ``texts``, each row weighted by how often it was met.

    A task sends only the rows it met; rows that none has met stay. ``row`` counts words, then
    classes, and at last the weights of the two places.
    """
    sent = texts.sparkSession.sparkContext.broadcast(scorer)
    width = 2 * lbl.dim + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, held, size = sent.value, [], 0
        m = own.model.copy()
        met = np.zeros(len(m.b) + len(m.bc) + 1)
        trainer = Trainer(m, lbl, lbl.seed + 7919 * number + TaskContext.get().partitionId())

        def learn() -> None:
            w, u, v = before(held)
            trainer.steps(w, u, v)
            for x in (w, u, v):
                met[: len(m.b)] += np.bincount(x, minlength=len(m.b))
            met[len(m.b) : -1] += np.bincount(m.class_of[w], minlength=len(m.bc))
            met[-1] += len(w)

        for batch in sliced(batches, 1024):
            every, ends, _ = own.numbered(raw(batch.column(0)))
            for text in np.split(own.entry.take(every), ends[:-1]):
                held.append(text)
                size += len(text)
                if size >= 1 << 18:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        rows = np.zeros((len(met), width), dtype=np.float32)
        rows[: len(m.b)] = np.column_stack([m.r, m.q, m.b])
        rows[len(m.b) : -1, lbl.dim :] = np.column_stack([m.qc, m.bc])
        rows[-1, :-1] = m.c.ravel()
        own_rows = np.flatnonzero(met)
        for at in range(0, len(own_rows), 4096):
            part = own_rows[at : at + 4096]
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows[part].ravel()), width).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(met[part]), values], ["row", "n", "x"])

    copies = texts.mapInArrow(train, "row int, n double, x array<float>")
    sums = copies.groupBy("row").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("x")[i] * F.col("n")).alias(f"x{i}") for i in range(width)]
    )
    table = sums.toArrow()  # one row for each word and class of the model
    row = table.column("row").to_numpy()
    x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(width)]) / table.column("n").to_numpy()[:, None]
    out, d = scorer.model.copy(), lbl.dim
    n = len(out.b)
    word, kind, last = row < n, (row >= n) & (row < n + len(out.bc)), row == n + len(out.bc)
    at = row[word]
    out.r[at], out.q[at], out.b[at] = x[word, :d], x[word, d : 2 * d], x[word, -1]
    out.qc[row[kind] - n], out.bc[row[kind] - n] = x[kind, d : 2 * d], x[kind, -1]
    if last.any():
        out.c[:] = x[last, : 2 * d].reshape(2, d)
    return out


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` (word, c), the largest counts first; words of equal frequency class come all or none.

    Classes are steps of one percent, so their histogram is small and only words that stay travel.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    least, room = None, most
    for r in sizes:
        if r.n > room:
            break
        least, room = r.step, room - r.n
    if least is None:
        return []
    table = counts.where(step >= least).select("word", "c").toArrow()
    return sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, counts: DataFrame, lbl: Lbl) -> Scorer:
    """Counts of the known words and a model trained on all tokens of ``docs (text)``."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = _most_frequent(counts.where((F.length("word") <= lbl.longest) & (F.col("word") != F.lit(END))), lbl.known)
    ends = counts.where(F.col("word") == F.lit(END)).first()
    known = [(END, ends.c if ends else 0), *top]
    numbers = {w: i for i, (w, _) in enumerate(known)}
    own = np.array([c for _, c in known], dtype=np.int64)
    vectors = 1 + min(lbl.words, sum(c >= lbl.least for _, c in top))
    sums = counts.where(F.col("word") != F.lit(END)).groupBy((F.crc32("word") % lbl.shared).alias("group")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")
    )
    tokens_, words_ = np.zeros(lbl.shared), np.zeros(lbl.shared)
    for r in sums.collect():  # one row a group
        tokens_[r.group], words_[r.group] = r.c, r.n
    groups = np.array([_group(w, lbl) for w, _ in known], dtype=np.int64)
    np.subtract.at(tokens_, groups[1:vectors], own[1:vectors])
    np.subtract.at(words_, groups[1:vectors], 1)
    entry = np.concatenate([np.arange(vectors), vectors + groups[vectors:], vectors + np.arange(lbl.shared)])
    room = tokens_ + 0.5 * (words_ + 1)
    scorer = Scorer(lbl, numbers, own, total, distinct, entry, room, start_model(np.append(own[:vectors], tokens_), lbl))
    copies = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (lbl.rounds * lbl.stretch)))
    for number in range(lbl.rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(lbl.rounds)) == number).select("text")
        scorer.model = _averaged(part.coalesce(copies), scorer, lbl, number)
    return scorer


def _known_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Sums over the known words of each text, and its other words as ``rare``."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        rare, in_group = len(own.counts), own.in_group()
        later = np.zeros(len(own.room))  # counts of words that are not known are joined
        base_of = np.append(np.log10((own.counts + 0.5) / own.base_room), later)
        seen = np.append(own.counts > 0, later > 0)
        for part in sliced(batches, 1024):
            every, ends, left = own.numbered(raw(part.column(2)))
            starts = np.append(0, ends[:-1])  # a text has its end at least
            w, u, v = before(np.split(own.entry.take(every), starts[1:]))
            score = own.model.log_probabilities(w, u, v) / np.log(10) + in_group.take(every)
            lists = np.append(0, np.cumsum(np.add.reduceat((every >= rare).astype(np.int32), starts, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ends - starts),
                 pa.array(np.add.reduceat(seen.take(every).astype(np.int64), starts)),
                 pa.array(np.add.reduceat(base_of.take(every), starts)), pa.array(np.add.reduceat(score, starts)),
                 pa.ListArray.from_arrays(pa.array(lists, pa.int32()), left.cast(pa.binary()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(scored, schema)


def score_documents(df: DataFrame, lbl: Lbl = Lbl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each row of ``df``.

    ``score`` is the model's log10 probability of the whole text, its end included; ``base_score``
    that of smoothed counts. A null or empty text is its end alone; a null id counts as an empty
    one; repeated rows are rows like any others, in training too; if no row is left for training,
    all words are unknown; an empty table gives an empty one; other columns are left out.
    """
    docs = _split(df, lbl, id_col, text_col)
    train = docs.where(~F.col("held_out"))
    counts = written(count_words(train), "lm-counts")
    scorer = fit(train, counts, lbl)
    known = written(_known_scores(docs, scorer).withColumn("row", F.monotonically_increasing_id()), "lm-known")
    c = F.coalesce("c", F.lit(0)) + 0.5
    rare = known.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(
        F.count("c").alias("more_known"),
        F.sum(F.log10(c / F.lit(float(scorer.base_room)))).alias("more_base"),
        F.sum(F.log10(c)).alias("more_score"),
    )
    return known.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(scorer.total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
