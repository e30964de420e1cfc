"""Gaussian clump models as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FWHM, FitParams, tile_keys

#: Fixed value: the share of a Gaussian within three sigma.
WITHIN_3 = math.erf(3 / math.sqrt(2))


def gaussian(x: Column, y: Column, v: Column | None, a: Column, x0: Column, y0: Column, s1: Column, s2: Column, theta: Column, v0: Column | None = None, s3: Column | None = None) -> Column:
    """A rotated anisotropic Gaussian; theta in radians."""
    c2, n2, sin2 = F.cos(theta) * F.cos(theta), F.sin(theta) * F.sin(theta), F.sin(2 * theta)
    dx, dy = x - x0, y - y0
    q = dx * dx * (c2 / (2 * s1 * s1) + n2 / (2 * s2 * s2)) + dy * dy * (n2 / (2 * s1 * s1) + c2 / (2 * s2 * s2)) + dx * dy * (sin2 / (2 * s2 * s2) - sin2 / (2 * s1 * s1))
    if v is not None:
        q = q + (v - v0) * (v - v0) / (2 * s3 * s3)
    return a * F.exp(-q)


def flux(a: Column, *sigmas: Column) -> Column:
    """The integral of a Gaussian within three sigma of each axis, in closed form."""
    out = a
    for s in sigmas:
        out = out * s * (math.sqrt(2 * math.pi) * WITHIN_3)
    return out


def initial_guess(catalog: DataFrame) -> DataFrame:
    """Start parameters of a fit from a pixel catalogue: sigmas from FWHM sizes, no rotation."""
    cube = "Cen3" in catalog.columns
    return catalog.select(
        *tile_keys(catalog), "ID", F.col("Peak").alias("A"), F.col("Cen1").alias("x0"), F.col("Cen2").alias("y0"), (F.col("Size1") / FWHM).alias("s1"), (F.col("Size2") / FWHM).alias("s2"), F.lit(0.0).alias("theta"),
        *([F.col("Cen3").alias("v0"), (F.col("Size3") / FWHM).alias("s3")] if cube else []),
    )


def bounds(guess: DataFrame, p: FitParams = FitParams()) -> DataFrame:
    """guess with <name>_lo and <name>_hi of every parameter."""
    cube = "v0" in guess.columns
    new = {"A_lo": F.greatest(F.col("A") - p.peak_range, F.lit(p.peak_low)), "A_hi": F.col("A") + p.peak_range}
    for place, sigma in (("x0", "s1"), ("y0", "s2"), *((("v0", "s3"),) if cube else ())):
        new |= {f"{place}_lo": F.col(place) - F.col(sigma) * p.sigma_time, f"{place}_hi": F.col(place) + F.col(sigma) * p.sigma_time}
        new |= {f"{sigma}_lo": F.least(F.col(sigma) * 0.5, F.lit(p.size_low)), f"{sigma}_hi": F.col(sigma) * p.size_time}
    new |= {"theta_lo": F.lit(-0.001 if cube else 0.0), "theta_hi": F.lit(2 * math.pi)}
    return guess.withColumns(new)


def in_bounds(bounded: DataFrame) -> Column:
    """Whether every parameter of bounds() lies within its closed bounds."""
    names = [c[:-3] for c in bounded.columns if c.endswith("_lo")]
    return reduce(lambda a, b: a & b, (F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")) for n in names), F.lit(True))


#: Points of unit grids that are held at a time, and fits whose grids a task goes through, about.
POINTS, FITS_A_TASK = 1_000_000, 20_000


def _volume(rms: float, cube: bool):
    """The points of each row's unit grid, from -3 sigma by steps of 1 below 3 sigma, at which its model is at least rms."""

    @F.pandas_udf("long")
    def volume(a: pd.Series, s1: pd.Series, s2: pd.Series, s3: pd.Series, theta: pd.Series) -> pd.Series:
        a, s1, s2, s3, theta = (c.to_numpy(dtype=float) for c in (a, s1, s2, s3, theta))
        out = np.zeros(len(a), dtype=np.int64)
        whole = np.flatnonzero(np.isfinite(a) & (np.minimum(s1, s2) > 0) & np.isfinite(s1 + s2 + theta) & (not cube or np.isfinite(s3) & (s3 > 0)))
        n = np.column_stack([np.ceil(6 * s)[whole] for s in (s1, s2, s3 if cube else np.full(len(s3), 1 / 6))]).astype(np.int64)
        kinds, which = np.unique(n, axis=0, return_inverse=True)
        for kind, (nx, ny, nv) in enumerate(kinds.tolist()):
            same = whole[which.ravel() == kind]
            lines = max(1, min(ny, POINTS // nx))
            for at in np.array_split(same, 1 + len(same) * nx * lines // POINTS):
                c2, n2, sin2 = np.cos(theta[at]) ** 2, np.sin(theta[at]) ** 2, np.sin(2 * theta[at])
                one, two = 2 * s1[at] ** 2, 2 * s2[at] ** 2
                xx, yy, xy = ((q[:, None, None]) for q in (c2 / one + n2 / two, n2 / one + c2 / two, sin2 / two - sin2 / one))
                dx = (np.arange(nx)[None, :] - 3 * s1[at, None])[:, None, :]
                for y in range(0, ny, lines):
                    dy = (np.arange(y, min(y + lines, ny))[None, :] - 3 * s2[at, None])[:, :, None]
                    plane = dx * dx * xx + dy * dy * yy + dx * dy * xy
                    for v in range(nv):
                        q = plane if not cube else plane + ((v - 3 * s3[at]) ** 2 / (2 * s3[at] ** 2))[:, None, None]
                        out[at] += (a[at, None, None] * np.exp(-q) >= rms).sum(axis=(1, 2))
        return pd.Series(out)

    return volume


def with_volume(fits: DataFrame, rms: float) -> DataFrame:
    """fits with Volume: the points of each model's unit grid over three sigma at which it is at least rms; 0 where a
    parameter is missing. Rows are dealt first, since a small table has much work in few rows."""
    c = lambda n: F.col(n).cast("double")
    cube = "v0" in fits.columns
    cut = fits.repartition(1 + fits.count() // FITS_A_TASK)
    return cut.withColumn("Volume", _volume(rms, cube)(c("A"), c("s1"), c("s2"), c("s3") if cube else F.lit(None).cast("double"), c("theta")))


def model_volume(fits: DataFrame, rms: float) -> DataFrame:
    """(ID, Volume), after tile if fits have one: see with_volume()."""
    return with_volume(fits, rms).select(*tile_keys(fits), "ID", "Volume")


def fit_catalog(fits: DataFrame, rms: float) -> DataFrame:
    """Fitted parameters as a catalogue: flux, signal-to-noise ratios, and sizes with the major axis first."""
    cube = "v0" in fits.columns
    c = F.col
    total = flux(c("A"), c("s1"), c("s2"), *([c("s3")] if cube else []))
    snr = F.when(c("Volume") > 0, c("_flux") / (rms * F.sqrt("Volume"))).otherwise(c("_flux") / rms)
    angle, swap = F.pmod(F.degrees("theta"), F.lit(180.0)), c("s1") < c("s2")
    keys = tile_keys(fits)
    made = with_volume(fits, rms).withColumn("_flux", total)
    return made.select(
        *keys, "ID", c("x0").alias("Cen1"), c("y0").alias("Cen2"), *([c("v0").alias("Cen3")] if cube else []),
        (FWHM * F.greatest("s1", "s2")).alias("Size1"), (FWHM * F.least("s1", "s2")).alias("Size2"), *([(FWHM * c("s3")).alias("Size3")] if cube else []),
        F.when(swap, F.pmod(angle + 90, F.lit(180.0))).otherwise(angle).alias("Theta"), c("A").alias("Peak"), c("_flux").alias("Sum"), snr.alias("Flux_SNR"), (c("A") / rms).alias("Peak_SNR"),
        *(k for k in ("Success", "Cost") if k in fits.columns),
    )
