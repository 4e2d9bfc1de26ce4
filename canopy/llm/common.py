"""What the operators of this package share: columns, words, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canopy.session import scratch_path

#: Bytes that part words: space and 0x09 to 0x0D, which is what ``bytes.split()`` cuts at.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Lower case for A-Z only; other letters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower case as above, and every byte that parts words as a space.
LOWER_SPACED = bytes(32 if 9 <= c <= 13 else c for c in LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly ``doc_id long, text string``; a null text becomes empty. Other columns go, so none can clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, rows: int = 512) -> None:
    """From now on at most ``rows`` rows of a table are in one Arrow batch, as a session that asks for fewer has it.

    An executor holds each batch outside its heap, in both directions and for every task, and Python holds it again.
    """
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = int(spark.conf.get(most))
    if not 0 < asked <= rows:
        spark.conf.set(most, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python makes of a batch stays small beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; nulls are empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def drawn(df: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """About ``most`` of the ``n`` rows of ``df``, or all if there are no more; the same on every run.

    Rows stay whose key hashes into a share of the range, a tenth wider than ``most`` asks for, so
    tasks send only what is drawn. The limit above it is met by repeated rows alone.
    """
    if n <= most:
        return df
    space = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(space)) < int(space * 1.1 * most / n) + 1).limit(2 * most)


def text_groups(batches: Iterator[pa.RecordBatch], room_for: int = 1 << 22) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (columns 0 and 1), at most ``room_for`` bytes of text at a time; a longer text alone."""
    ids, texts, room = [], [], room_for
    for batch in sliced(batches):
        for key, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            if texts and len(text) > room:
                yield ids, texts
                ids, texts, room = [], [], room_for
            ids.append(key)
            texts.append(text)
            room -= len(text)
    if texts:
        yield ids, texts


def joined_words(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by one space, and for each its start, its end and the index of its text.

    ``table`` translates bytes first; what it makes a space parts words.
    """
    joined = (b" " + b" ".join(texts) + b" ").translate(table)
    byte = np.frombuffer(joined, dtype=np.uint8)
    word = byte != 32
    turn = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, after = turn[::2], turn[1::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(begins, first, side="right") - 1
    size = after - first
    ends = np.cumsum(size + 1) - 1
    word[first - 1] = True
    return byte[word].tobytes()[1:], ends - size, ends, text
