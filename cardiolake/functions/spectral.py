"""Spectra over array columns, peak refinement and ratios, as SQL expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(n: int) -> Column:
    """Symmetric Hann weights."""
    return F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) if n > 1 else 1.0) for i in range(n)])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dft_bin(re: Column, im: Column | None, n: int, k: Column) -> Column:
    """Bin ``k`` of the transform of ``n`` samples, as ``struct(re, im)``: one bin costs n steps, not a whole transform."""
    angle = lambda i: -2 * math.pi / n * (k * i)
    if im is None:
        real = _sum(F.transform(re, lambda x, i: x * F.cos(angle(i))))
        imag = _sum(F.transform(re, lambda x, i: x * F.sin(angle(i))))
    else:
        real = _sum(F.zip_with(F.transform(re, lambda x, i: x * F.cos(angle(i))), F.transform(im, lambda y, i: y * F.sin(angle(i))), lambda a, b: a - b))
        imag = _sum(F.zip_with(F.transform(re, lambda x, i: x * F.sin(angle(i))), F.transform(im, lambda y, i: y * F.cos(angle(i))), lambda a, b: a + b))
    return F.struct(real.alias("re"), imag.alias("im"))


def amplitude_spectrum(x: Column, n: int, windowed: bool = True) -> Column:
    """Magnitudes of bins 0 to n // 2 of a real series of ``n`` samples, Hann-weighted unless told otherwise."""
    y = F.zip_with(x, hann(n), lambda a, b: a * b) if windowed else x
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: _magnitude(dft_bin(y, None, n, k)))


def _magnitude(z: Column) -> Column:
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def to_db(magnitude: Column) -> Column:
    return 20 * F.log10(magnitude + 1e-10)


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def refine_by_index(spectrum: Column, i: Column, resolution: Column) -> Column:
    """Parabolic peak ``(i + d) * resolution``; the bin itself at an edge, on a flat top or when ``abs(d) > 1``."""
    return _parabola(spectrum, i, lambda d: F.when(F.abs(d) <= 1, (i + d) * resolution), i * resolution)


def refine_by_frequency(spectrum: Column, freqs: Column, i: Column) -> Column:
    """Parabolic peak ``freqs[i] + d * bin``; the bin itself at an edge or on a flat top."""
    return _parabola(spectrum, i, lambda d: F.get(freqs, i) + d * (F.get(freqs, F.lit(1)) - F.get(freqs, F.lit(0))), F.get(freqs, i))


def _parabola(spectrum: Column, i: Column, moved, plain: Column) -> Column:
    a, b, c = (F.get(spectrum, i + k) for k in (-1, 0, 1))
    bend = a - 2 * b + c
    inner = (i > 0) & (i < F.size(spectrum) - 1) & (bend != 0)
    return F.when(inner, F.coalesce(moved(F.try_divide(0.5 * (a - c), bend)), plain)).otherwise(plain)


def peak_to_floor(peak: Column, floor: Column) -> tuple[Column, Column]:
    """Ratio and its decibels: a floor of 0 gives infinity, or NaN for a peak of 0; a ratio of 0 gives minus infinity."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = F.when(floor == 0, F.when(peak > 0, inf).otherwise(nan)).otherwise(F.try_divide(peak, floor))
    return ratio, F.when(F.isnan(ratio), nan).when(ratio == 0, -inf).otherwise(20 * F.log10(ratio))
