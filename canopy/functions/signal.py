"""Filters over array columns, vectorised over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def padded_length(n: int) -> int:
    """Next power of two."""
    return 1 << max(n - 1, 0).bit_length()


def fft_frequencies(n: int, spacing: float = 1.0) -> np.ndarray:
    return np.fft.rfftfreq(padded_length(n), spacing)


def _by_length(series: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked 2-D values for each array length of a batch."""
    sizes = series.map(len, na_action="ignore").to_numpy(dtype=float)
    for n in np.unique(sizes[~np.isnan(sizes)]):
        at = np.flatnonzero(sizes == n)
        yield at, np.stack(series.iloc[at].to_numpy())


def fft_filter(col: Column | str, response: Sequence[float] | None) -> Column:
    """Padded to a power of two, multiplied in frequency space, back at padded length.

    Without a response the input is returned. The response needs ``N / 2 + 1`` values.
    """
    if response is None:
        return F.col(col) if isinstance(col, str) else col
    weights = np.asarray(response, dtype=float)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            for at, values in _by_length(s):
                n = padded_length(values.shape[1])
                if len(weights) != n // 2 + 1:
                    raise ValueError(f"response has {len(weights)} values, {n // 2 + 1} are needed")
                back = np.fft.irfft(np.fft.rfft(values, n, axis=1) * weights, axis=1)
                for i, row in zip(at, back):
                    out[i] = row
            yield pd.Series(out, index=s.index, dtype=object)

    return run(col)


def savgol_matrix(n: int, window: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    """Smoothing matrix (n x n): local least-squares polynomials, fitted at the ends."""
    if window % 2 == 0 or window > n or polyorder >= window:
        raise ValueError("window must be odd, at most the length and above the order")
    half = window // 2
    offsets = np.arange(window) - half
    basis = np.vander(offsets, polyorder + 1, increasing=True)
    fit = np.linalg.pinv(basis)  # coefficients from window values

    def row(at: float) -> np.ndarray:
        powers = np.zeros(polyorder + 1)
        for k in range(deriv, polyorder + 1):
            powers[k] = math.perm(k, deriv) * at ** (k - deriv)
        return powers @ fit / delta**deriv

    m = np.zeros((n, n))
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        m[i, start : start + window] = row(i - start - half)
    return m


def savgol(col: Column | str, n: int, window: int = 15, polyorder: int = 3, deriv: int = 0, delta: float = 1.0) -> Column:
    """Savitzky-Golay filter along arrays of length ``n``; one matrix product per batch.

    A NULL array stays NULL; one of another length fails.
    """
    m = savgol_matrix(n, window, polyorder, deriv, delta).T

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            for at, values in _by_length(s):
                if values.shape[1] != n:
                    raise ValueError(f"an array has {values.shape[1]} values, {n} are expected")
                for i, row in zip(at, values @ m):
                    out[i] = row
            yield pd.Series(out, index=s.index, dtype=object)

    return run(col)


def smooth_spectra(spectra: DataFrame, n: int, window: int = 15, polyorder: int = 3, deriv: int = 0) -> DataFrame:
    return spectra.withColumn("spectrum", savgol("spectrum", n, window, polyorder, deriv))
