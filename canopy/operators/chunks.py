"""Ordered folds over one long group on many tasks: speculative chunks, stitched where states agree.

A group is cut at fixed frames. Each chunk is folded from an empty book that first reads the rows of
a stretch before it, so that at the chunk's start it holds what a fold of the whole group would, if
the book forgets. Whether it does is checked, not assumed: a chunk counts when the book at its start
equals the book at the end of the chunk before. Chunks that disagree are folded again, all of them at
once, from the book at the end of the chunk before, until all agree; a group that does not within
``ROUNDS`` is folded in one pass. So results are those of the one pass.

Books are compared by what can match later, without numbers. Numbers only order books' entries, and
order only decides between entries at equal distance. So where some chunk of a group met such a tie,
order must agree too in the chunks up to it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from canopy.operators.folds import fold_sorted, in_order, plain, stretches
from canopy.session import cut_lineage


ROUNDS = 4


class Book(Protocol):
    """State of a fold. Numbers count up from 1; ``inherited`` is the first that the chunk gave itself."""

    next_number: int
    inherited: int
    tied: bool

    def step(self, *row) -> tuple:
        """The number of a row, and what else the fold tells of it."""

    def live(self, frame: int) -> list[tuple[int, list]]:
        """Number and content of the entries that can match at ``frame``, in order of creation."""

    def save(self, frame: int) -> str:
        """All of it that matters at ``frame``."""


BOOKS = "__start_key string, __start_no array<long>, __start_rank array<int>, __end_key string, __end_no array<long>, __end_rank array<int>, __state string, __tied boolean"


def _floats(v):
    """Numbers as floats: a column with nulls brings whole numbers so, one without them does not."""
    return [_floats(x) for x in v] if isinstance(v, (list, tuple)) else float(v) if isinstance(v, int) else v


def _told(book: Book, frame: int) -> tuple[str, list[int], list[int]]:
    """Name of the live entries, their numbers in order of content, and their places in order of creation.

    Entries of equal content follow each other as they were made, which is also how they match.
    """
    live = sorted((json.dumps(_floats(content)), i, number) for i, (number, content) in enumerate(book.live(frame)))
    name = hashlib.md5("\n".join(t for t, _, _ in live).encode()).hexdigest()
    return name, [n for _, _, n in live], [i for _, i, _ in live]


class _Group:
    """One chunk, from an empty book or a given one."""

    def __init__(self, key: tuple, book: Book, width: int, alone: bool):
        self.key, self.book, self.width = key, book, width
        self.start: tuple | None = None
        self.chunk = None
        self.alone = alone  # it shares no row with another chunk, so none asks for its books

    def begin(self, chunk: int) -> None:
        self.chunk = chunk
        if self.start is None:
            self.start = (None, [], []) if self.alone else _told(self.book, chunk * self.width)
            self.book.inherited, self.book.tied = self.book.next_number, False

    def record(self) -> list[tuple]:
        if self.chunk is None or self.alone:
            return []
        frame = (self.chunk + 1) * self.width
        return [(*self.key, *self.start, *_told(self.book, frame), self.book.save(frame), self.book.tied)]


def _whole(pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """All columns in order, those that are missing as nulls."""
    for c in names:
        if c not in pdf.columns:
            pdf[c] = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
    return pdf[names]


def _folded(
    rows: DataFrame, names: list[str], by: list[str], order: Sequence[Column], inputs: Sequence[str], fields: str,
    make: Callable[[str | None], Book], width: int,
) -> DataFrame:
    """Rows that are not warm with number and ``fields``; for each group of ``by`` one more row with its books."""
    added, books = T.StructType.fromDDL(f"__number long, {fields}" if fields else "__number long"), T.StructType.fromDDL(BOOKS)
    kept = [rows.schema[c] for c in dict.fromkeys([*names, *by, "__chunk"])]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + added.fields + books.fields)
    columns, told = [f.name for f in kept], [*by, *books.fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: _Group | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            values = list(zip(*[plain(pdf[c]) for c in inputs]))
            chunk, warm, late, init = pdf["__chunk"].tolist(), pdf["__warm"].tolist(), pdf["__late"].tolist(), plain(pdf["__init"])
            at, out, records = [], [], []
            for a, b, key in stretches(pdf, by):
                if group is None or key != group.key:
                    records += group.record() if group else []
                    group = _Group(key, make(init[a]), width, init[a] is None and not warm[a])
                step = group.book.step
                for i in range(a, b):
                    if warm[i]:
                        step(*values[i])
                    elif init[i] is None:
                        if chunk[i] != group.chunk:
                            group.begin(chunk[i])
                        if late[i]:
                            group.alone = False
                        at.append(i)
                        out.append(step(*values[i]))
            if at:
                own = pdf.iloc[at][columns].copy()
                for c, column in zip(added.names, zip(*out)):
                    own[c] = pd.Series(column, index=own.index, dtype=object)
                yield _whole(own, schema.names)
            if records:
                yield _whole(pd.DataFrame(records, columns=told, dtype=object), schema.names)
        if group and group.record():
            yield _whole(pd.DataFrame(group.record(), columns=told, dtype=object), schema.names)

    first = F.col("__init").isNull()
    return in_order(rows, by, [first, *order]).mapInPandas(run, schema)


def _roots(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, __chunk, __number -> __root_chunk, __root_no``: where an entry that a chunk took over was made."""
    schema = T.StructType([chunks.schema[k] for k in keys] + T.StructType.fromDDL("__chunk long, __number long, __root_chunk long, __root_no long").fields)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, before = None, []
        for pdf in batches:
            rows = []
            for a, b, key in stretches(pdf, keys) if len(pdf) else []:
                if key != current:
                    current, before = key, []
                for i in range(a, b):
                    chunk = int(pdf["__chunk"].iat[i])
                    taken = dict(zip((int(n) for n in pdf["__start_no"].iat[i]), before))
                    rows += [(*key, chunk, n, *root) for n, root in taken.items()]
                    before = [taken.get(int(n), (chunk, int(n))) for n in pdf["__end_no"].iat[i]]
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return in_order(chunks, keys, [F.col("__chunk")]).mapInPandas(follow, schema)


def _judged(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with ``__again``: whether the chunk must be folded from ``__given``, the book of the one before."""
    w = W.partitionBy(*keys).orderBy("__chunk")
    opens = F.row_number().over(w) == 1
    agrees = F.coalesce(F.col("__start_key") == F.lag("__end_key").over(w), F.lit(False))
    tie_ahead = F.max("__tied").over(w.rowsBetween(0, W.unboundedFollowing))
    in_order_too = F.col("__start_rank") == F.lag("__end_rank").over(w)
    return records.withColumn("__again", ~opens & ~(agrees & (in_order_too | ~tie_ahead))).withColumn("__given", F.lag("__state").over(w))


def fold_in_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], inputs: Sequence[str], fields: str,
    make: Callable[[str | None], Book], width: int, warm: int, frame: str = "frame",
) -> DataFrame:
    """``df`` with ``__run, __local`` (chunk and number; together the entry a row belongs to within its keys) and ``fields``.

    ``make`` gives an empty book or one that was saved; ``order`` starts with ``frame``. Chunks are
    ``width`` frames, of which the last ``warm`` are also read by the next chunk; no group pauses
    for ``warm`` frames. Rows without a frame come first. An empty frame gives an empty one.
    """
    keys, names = list(keys), df.columns
    field_names = T.StructType.fromDDL(fields).names if fields else []
    here = F.coalesce(F.floor(F.col(frame) / F.lit(width)).cast("long"), F.lit(-(1 << 40)))
    # A chunk whose group goes on has rows in its last frames, as the group has no pause that long.
    late = F.coalesce(F.pmod(F.col(frame), F.lit(width)) >= width - warm, F.lit(False))
    into = lambda c, w: F.struct(c.alias("c"), F.lit(w).alias("w"), late.alias("l"))
    places = F.when(late, F.array(into(here, False), into(here + 1, True))).otherwise(F.array(into(here, False)))
    dealt = df.withColumn("__at", F.explode(places)).select(
        *names, F.col("__at.c").alias("__chunk"), F.col("__at.w").alias("__warm"), F.col("__at.l").alias("__late"),
        F.lit(None).cast("string").alias("__init"),
    )
    by, books = [*keys, "__chunk"], T.StructType.fromDDL(BOOKS).names
    shown = [*names, "__key", "__chunk", "__number", *field_names]
    apart = lambda t: (
        t.where("__tied IS NULL").withColumn("__key", F.struct(*keys)).select(*shown),
        t.where("__tied IS NOT NULL").withColumn("__key", F.struct(*keys)).select(*by, "__key", *books),
    )
    rows, records = apart(cut_lineage(_folded(dealt, names, by, order, inputs, fields, make, width)))
    bad = None
    for i in range(ROUNDS + 1):
        judged = cut_lineage(_judged(records, keys))
        told = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("__again").alias("again")).first()
        if not told.n:  # every chunk is alone
            return rows.select(*names, F.col("__chunk").alias("__run"), F.col("__number").alias("__local"), *field_names)
        if not told.again:
            break
        again = judged.where("__again")
        if i == ROUNDS:
            bad = again.select("__key").distinct()
            break
        chosen = again.select("__key", "__chunk")
        redo = rows.drop("__number", *field_names).join(chosen, ["__key", "__chunk"], "left_semi").drop("__key")
        redo = redo.select("*", F.lit(False).alias("__warm"), F.lit(False).alias("__late"), F.lit(None).cast("string").alias("__init"))
        heads = again.select(*by, F.lit(False).alias("__warm"), F.lit(False).alias("__late"), F.col("__given").alias("__init"))
        new_rows, new_records = apart(cut_lineage(_folded(redo.unionByName(heads, True), names, by, order, inputs, fields, make, width)))
        rows = rows.join(chosen, ["__key", "__chunk"], "left_anti").unionByName(new_rows)
        records = judged.where("NOT __again").select(*records.columns).unionByName(new_records)

    if bad is not None:
        judged, rows = judged.join(bad, "__key", "left_anti"), rows.join(bad, "__key", "left_anti")
    roots = _roots(judged.select(*by, "__start_no", "__end_no"), keys)
    roots = roots.select(F.struct(*keys).alias("__key"), "__chunk", "__number", "__root_chunk", "__root_no")
    stitched = rows.join(roots, ["__key", "__chunk", "__number"], "left").select(
        *names, F.coalesce("__root_chunk", "__chunk").alias("__run"), F.coalesce("__root_no", "__number").alias("__local"), *field_names
    )
    if bad is None:
        return stitched
    whole = df.withColumn("__key", F.struct(*keys)).join(bad, "__key", "left_semi").drop("__key")
    whole = fold_sorted(whole, keys, order, inputs, f"__local long, {fields}" if fields else "__local long", lambda: make(None).step)
    return stitched.unionByName(whole.withColumn("__run", F.lit(0).cast("long")))
