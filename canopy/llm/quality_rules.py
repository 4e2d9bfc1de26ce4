"""Quality rules: word and line counts, and compression bands over documents and fixed chunks.

The zstandard ratio (compressed bytes by bytes) is low for repetitive text and high for noise.
How low or high it may be depends on the length, as short texts carry the frame's own bytes and
long ones share more. Limits stand by length for the whole text and for chunks of ``CHUNK``
bytes alike; a text fails if its own ratio lies outside its band, or if chunks outside theirs
hold more than ``CHUNK_SHARE`` of its bytes (a block of noise or of copies in a sound text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from canopy.llm.common import id_text, sliced

CHUNK = 4096
CHUNK_SHARE = 0.3
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Fixed values: (least bytes, lowest ratio, highest ratio). Texts below 128 bytes are not judged:
#: there the frame outweighs the content. The highest ratios stand above those of clean English,
#: French, German and Spanish at each length and below base64's. From 1536 bytes on they are below
#: random words of letters and digits, from 3072 on of letters too; shorter ones, and hexadecimal
#: digits, compress like clean text, so a ratio does not tell them.
BANDS = (
    (0, 0.0, float("inf")),
    (128, 0.30, 1.04),
    (160, 0.30, 0.97),
    (192, 0.30, 0.94),
    (256, 0.25, 0.87),
    (384, 0.25, 0.82),
    (512, 0.22, 0.78),
    (768, 0.22, 0.72),
    (1024, 0.20, 0.70),
    (1536, 0.20, 0.65),
    (2048, 0.20, 0.62),
    (3072, 0.20, 0.587),
    (4096, 0.18, 0.575),
    (8192, 0.18, 0.56),
    (65536, 0.12, 0.55),
)


@dataclass(frozen=True)
class Bands:
    """Length-specific limits of the ratio and the chunk rule."""

    limits: tuple[tuple[int, float, float], ...] = BANDS
    chunk: int = CHUNK
    chunk_share: float = CHUNK_SHARE
    level: int = LEVEL


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found twice or more in the text."""
    n = len(words) - 4
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    one = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return 0
    pair = lambda a, b: np.unique(a * (len(words) + 1) + b, return_inverse=True)[1].ravel()
    two = pair(one[:-1], one[1:])
    four = pair(two[:-2], two[2:])
    _, inverse, counts = np.unique(four[:-1] * (len(words) + 1) + one[4:], return_inverse=True, return_counts=True)
    starts = (counts[inverse.ravel()] > 1).astype(np.int8)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    change[:n] += starts
    change[5 : n + 5] -= starts
    return int((np.cumsum(change)[:-1] > 0).sum())


def _repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return again


def _outside(n: int, ratio: float, bands: Bands) -> bool:
    low, high = next((a, b) for least, a, b in reversed(bands.limits) if n >= least)
    return not low <= ratio <= high


class Judge:
    """Measures of one text after another; a compressor is kept between texts."""

    def __init__(self, bands: Bands) -> None:
        self.bands = bands
        self.zstd = zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, data: bytes | memoryview) -> float:
        return len(self.zstd.compress(data)) / len(data) if len(data) else 0.0

    def __call__(self, text: str) -> tuple:
        data, bands = text.encode(), self.bands
        words = data.split()
        n = len(words)
        bare = len(data.translate(None, SPACES))
        chars = len(text) - (len(data) - bare)
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        repeated = _repeated_words(words)
        failed = n < 10 or 100 * repeated > 20 * n
        ratio = self.ratio(data)
        out = 0
        if len(data) > bands.chunk:
            view = memoryview(data)
            for at in range(0, len(data), bands.chunk):
                piece = view[at : at + bands.chunk]
                out += len(piece) * _outside(len(piece), self.ratio(piece), bands)
        share = out / len(data) if data else 0.0
        sound = not _outside(len(data), ratio, bands) and share <= bands.chunk_share
        return n, chars, symbols, _repeated_lines(data), repeated, failed, not failed and sound, ratio, share


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("zstd_ratio", pa.float64()),
    ("outside_share", pa.float64()),
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, outside_share double"
)


def judge_quality(df: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts, ``base_failed``, ``kept`` and the ratios behind it.

    A null text counts as empty and an empty one has no words, so both fail; a null id stays null;
    repeated rows are judged each for itself; an empty table gives an empty one; other columns are
    left out. Whole texts are measured, in memory that follows the longest text of a batch.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for batch in sliced(batches):
            rows = [judge(x) for x in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [()] * len(FIELDS)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *[n for n, _ in FIELDS]])

    return id_text(df, id_col, text_col).mapInArrow(measured, SCHEMA)


def keep_quality(df: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is kept, with their columns as they are."""
    index = df.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for batch in sliced(batches):
            yield batch.filter(pa.array([judge(x or "")[6] for x in batch.column(index).to_pylist()], pa.bool_()))

    return df.mapInArrow(kept, df.schema)
