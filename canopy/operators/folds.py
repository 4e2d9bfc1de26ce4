"""Ordered folds over groups, streamed batch by batch, and exact ways to cut groups apart first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def plain(values: pd.Series) -> list:
    """A batch column as Python values, missing ones as None."""
    return [None if v is None or v != v else v for v in values.tolist()]


def stretches(pdf: pd.DataFrame, keys: Sequence[str]) -> list[tuple[int, int, tuple]]:
    """Runs of equal keys in a sorted batch."""
    fresh = np.zeros(len(pdf), dtype=bool)
    fresh[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        fresh[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(fresh)
    at = [*first.tolist(), len(pdf)]
    names = zip(*[pdf[k].take(first).tolist() for k in keys]) if keys else [()] * len(first)
    return list(zip(at, at[1:], names))


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    inputs: Sequence[str],
    fields: str,
    start: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """Append columns ``fields`` computed by one ordered pass over each group.

    ``start()`` makes a group's state and returns the function that takes a row's
    ``inputs`` and gives its new values. Groups follow one another in sorted
    partitions and rows are let go batch by batch, so memory holds one state and
    one batch, never a group, and small groups cost no call of their own.
    """
    extra = T.StructType.fromDDL(fields)
    names, added = df.columns, extra.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            cols = [plain(pdf[c]) for c in inputs]
            rows: list[tuple] = []
            for a, b, key in stretches(pdf, keys):
                if key != current:
                    current, step = key, start()
                rows.extend(step(*r) for r in zip(*[c[a:b] for c in cols]))
            for c, values in zip(added, zip(*rows)):
                pdf[c] = pd.Series(values, index=pdf.index, dtype=object)
            yield pdf[[*names, *added]]

    return in_order(df, keys, order).mapInPandas(run, T.StructType(df.schema.fields + extra.fields))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Groups whole in one partition each, rows of a partition sorted by key and order."""
    return df.repartition(*keys).sortWithinPartitions(*[F.col(k) for k in keys], *order)


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    schema: T.StructType,
    fn: Callable[[tuple, pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """``fn(key, rows)`` per group; only for groups whose size the caller has bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            done = []
            for a, b, key in stretches(pdf, keys):
                if key != current and held:
                    done.append(fn(current, pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                current = key
                held.append(pdf.iloc[a:b])
            if done:
                yield pd.concat(done)
        if held:
            yield fn(current, pd.concat(held) if len(held) > 1 else held[0])

    return in_order(df, keys, order).mapInPandas(run, schema)


def independent_parts(
    df: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str, float, float]], out: str = "part"
) -> DataFrame:
    """Number groups of rows that cannot interact.

    An axis ``(low, high, gap, cell)`` says that rows whose intervals lie more than
    ``gap`` apart, and everything beyond, do not see each other. Rows reduce to
    ``cell``-wide cells first; cuts are looked for among cells, axis after axis, and
    carried back by one join. ``cell`` only sets how fine cuts can be found. An axis may
    come again: what others have cut apart may have gaps of its own.

    ``df`` is read twice, for cells and for rows; nothing runs before the result is used.
    """
    keys = list(keys)
    names = {axis: f"__c{i}" for i, axis in enumerate(dict.fromkeys(axes))}
    cells = list(names.values())
    tagged = df.withColumn("__key", F.struct(*keys))  # null keys meet in it
    for (low, _, _, width), c in names.items():
        cell = F.floor(F.col(low) / F.lit(float(width))).cast("long")
        # A missing position must not drop its row in the join below.
        tagged = tagged.withColumn(c, F.coalesce(cell, F.lit(-(1 << 62))))
    bounds = [
        f(F.col(col)).alias(f"{n}{c}")
        for (low, high, _, _), c in names.items()
        for f, col, n in ((F.min, low, "__lo"), (F.max, high, "__hi"))
    ]
    table = tagged.groupBy("__key", *cells).agg(*bounds)
    parts: list[str] = []
    for i, axis in enumerate(axes):
        c, gap = names[axis], axis[2]
        w = W.partitionBy("__key", *parts).orderBy(c)
        reach = F.max(f"__hi{c}").over(w.rangeBetween(W.unboundedPreceding, -1))
        start = F.min(f"__lo{c}").over(w.rangeBetween(0, 0))
        # Rows of one cell are cut as one: its first counts.
        fresh = F.coalesce(F.lag(c).over(w) != F.col(c), F.lit(True))
        table = table.withColumn("__cut", F.when(fresh & (start - reach > F.lit(float(gap))), 1).otherwise(0))
        table = table.withColumn(f"__p{i}", F.sum("__cut").over(w.rangeBetween(W.unboundedPreceding, 0)).cast("int"))
        parts.append(f"__p{i}")
    label = F.concat_ws(".", *[F.col(p).cast("string") for p in parts])
    labels = table.select("__key", *cells, label.alias(out))
    return tagged.join(labels, ["__key", *cells]).drop("__key", *cells)
