"""Basis expansions of each key's series: a key, whose samples depend on one another, is the unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def haar(x: np.ndarray) -> np.ndarray:
    """Orthonormal Haar coefficients of a series, padded with zeros to a power of two: the mean's first, then details from coarse to fine."""
    n = 1 << max(len(x) - 1, 0).bit_length()
    a, details = np.pad(np.asarray(x, float), (0, n - len(x))), []
    while len(a) > 1:
        details.append((a[::2] - a[1::2]) / np.sqrt(2))
        a = (a[::2] + a[1::2]) / np.sqrt(2)
    return np.concatenate([a, *details[::-1]])


def unhaar(c: np.ndarray) -> np.ndarray:
    a, at = np.asarray(c[:1], float), 1
    while at < len(c):
        d = c[at : at + len(a)]
        a, at = np.stack(((a + d) / np.sqrt(2), (a - d) / np.sqrt(2)), 1).ravel(), at + len(a)
    return a


def _expanded(df: DataFrame, by: str, order: str, value: str, expand, columns: str) -> DataFrame:
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = expand(pdf.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame({by: key[0], "k": range(len(next(iter(found.values())))), **found})

    return df.select(by, order, value).groupBy(by).applyInPandas(step, f"`{by}` {df.schema[by].dataType.simpleString()}, k int, {columns}")


def spectrum(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, k, re, im): the discrete Fourier transform of a real series, its first half."""

    def expand(x: np.ndarray) -> dict:
        c = np.fft.rfft(x)
        return {"re": c.real, "im": c.imag}

    return _expanded(df, by, order, value, expand, "re double, im double")


def wavelets(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, k, coefficient): Haar coefficients."""
    return _expanded(df, by, order, value, lambda x: {"coefficient": haar(x)}, "coefficient double")
