"""World coordinates as column expressions: plate carree sky axes and a linear velocity axis."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolution_of(header: dict) -> tuple[float, ...]:
    """Arc seconds, arc seconds and km/s a voxel, from the steps of a header; the usual ones where it has none."""
    sky = [abs(float(header[f"CDELT{k}"])) * 3600 if f"CDELT{k}" in header else 30.0 for k in (1, 2)]
    step = abs(float(header["CDELT3"])) if "CDELT3" in header else 166.0
    return (*sky, step / 1000 if step > 10 or str(header.get("CUNIT3", "")).strip() == "m/s" else step)


@dataclass(frozen=True)
class Wcs:
    """Reference values, steps (degrees, metres a second) and reference pixels of longitude, latitude and velocity.

    The native longitude of the celestial pole is the default one: 0 for a reference latitude of 0 or more, else 180.
    """

    # The header template of survey cubes.
    crval: tuple[float, ...] = (16.75, 0.75, 15939.88032)
    cdelt: tuple[float, ...] = (-0.00833333333333, 0.00833333333333, 166.04042)
    crpix: tuple[float, ...] = (181.0, 91.0, 1.0)
    resolution: tuple[float, ...] = (30.0, 30.0, 0.166)

    @classmethod
    def from_header(cls, header: dict) -> Wcs:
        """From the cards of a FITS header; a velocity axis that is missing is the template's."""
        axes = range(1, 1 + min(3, int(header.get("NAXIS", 3))))
        base = cls()
        pick = lambda key, k, default: float(header.get(f"{key}{k}", default))
        return cls(
            *(tuple(pick(key, k, d) if k in axes else d for k, d in enumerate(default, 1)) for key, default in (("CRVAL", base.crval), ("CDELT", base.cdelt), ("CRPIX", base.crpix))),
            resolution_of(header),
        )

    @property
    def pole(self) -> tuple[float, float]:
        """Declination and right ascension of the native pole, in radians."""
        if self.crval[1] < 0:
            return math.radians(90.0 + self.crval[1]), math.radians(self.crval[0])
        return math.radians(90.0 - self.crval[1]), math.radians(self.crval[0] - 180.0)

    @property
    def turn(self) -> float:
        """-1 where native longitudes count from the other side of the pole, that is by 180 degrees; else 1."""
        return -1.0 if self.crval[1] < 0 else 1.0

    @property
    def velocity_unit(self) -> float:
        return 1000.0 if abs(self.cdelt[2]) > 10 else 1.0


def sky(p1: Column, p2: Column, w: Wcs) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, of 1-based pixel places."""
    d, a = w.pole
    x = F.radians((p1 - w.crpix[0]) * w.cdelt[0])
    y = F.radians((p2 - w.crpix[1]) * w.cdelt[1])
    sin_x, cos_x = (F.sin(x), F.cos(x)) if w.turn > 0 else (-F.sin(x), -F.cos(x))
    lat = F.asin(F.sin(y) * math.sin(d) + F.cos(y) * math.cos(d) * cos_x)
    lon = F.lit(a) + F.atan2(-F.cos(y) * sin_x, F.sin(y) * math.cos(d) - F.cos(y) * math.sin(d) * cos_x)
    return F.pmod(F.degrees(lon), F.lit(360.0)), F.degrees(lat)


def pixel(lon: Column, lat: Column, w: Wcs) -> tuple[Column, Column]:
    """1-based pixel places of longitude and latitude in degrees."""
    d, a = w.pole
    l, b = F.radians(lon) - a, F.radians(lat)
    x = F.atan2(-F.cos(b) * F.sin(l) * w.turn, (F.sin(b) * math.cos(d) - F.cos(b) * math.sin(d) * F.cos(l)) * w.turn)
    y = F.asin(F.sin(b) * math.sin(d) + F.cos(b) * math.cos(d) * F.cos(l))
    return F.degrees(x) / w.cdelt[0] + w.crpix[0], F.degrees(y) / w.cdelt[1] + w.crpix[1]


def velocity(p3: Column, w: Wcs) -> Column:
    return (F.lit(w.crval[2]) + (p3 - w.crpix[2]) * w.cdelt[2]) / w.velocity_unit


def channel(v: Column, w: Wcs) -> Column:
    return (v * w.velocity_unit - w.crval[2]) / w.cdelt[2] + w.crpix[2]


def _signed(value: Column, decimals: int, width: int) -> Column:
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.format_string(f"%.{decimals}f", F.abs(value)), width, "0"))


def clump_name(lon: Column, lat: Column, vel: Column | None = None, prefix: str = "MWISP", decimals: tuple[int, int, int] = (3, 3, 3)) -> Column:
    """prefix, longitude, signed latitude and, in three dimensions, signed velocity, each padded with zeros."""
    out = [F.lit(prefix), F.lpad(F.format_string(f"%.{decimals[0]}f", lon), decimals[0] + 4, "0"), _signed(lat, decimals[1], decimals[1] + 3)]
    return F.concat(*out, *([] if vel is None else [_signed(vel, decimals[2], decimals[2] + 3)]))


def to_world(catalog: DataFrame, w: Wcs, prefix: str = "MWISP", keep_id: bool = False) -> DataFrame:
    """A pixel catalogue in world coordinates: places in degrees and km/s, sizes times the resolution, ID the name.

    With keep_id the pixel catalogue's ID stays as PixelID, which joins the two catalogues.
    """
    if keep_id:
        catalog = catalog.withColumn("PixelID", F.col("ID"))
    cube = "Cen3" in catalog.columns
    new: dict[str, Column] = {}
    for kind in ("Peak", "Cen"):
        new[f"{kind}1"], new[f"{kind}2"] = sky(F.col(f"{kind}1"), F.col(f"{kind}2"), w)
        if cube:
            new[f"{kind}3"] = velocity(F.col(f"{kind}3"), w)
    for k in range(1, 4 if cube else 3):
        new[f"Size{k}"] = F.col(f"Size{k}") * w.resolution[k - 1]
    new["ID"] = clump_name(new["Cen1"], new["Cen2"], new.get("Cen3"), prefix)
    return catalog.withColumns(new)


def to_pixel(catalog: DataFrame, w: Wcs) -> DataFrame:
    """The inverse of to_world; ID stays."""
    cube = "Cen3" in catalog.columns
    new: dict[str, Column] = {}
    for kind in ("Peak", "Cen"):
        new[f"{kind}1"], new[f"{kind}2"] = pixel(F.col(f"{kind}1"), F.col(f"{kind}2"), w)
        if cube:
            new[f"{kind}3"] = channel(F.col(f"{kind}3"), w)
    for k in range(1, 4 if cube else 3):
        new[f"Size{k}"] = F.col(f"Size{k}") / w.resolution[k - 1]
    return catalog.withColumns(new)


def to_world_fixed(catalog: DataFrame, w: Wcs) -> DataFrame:
    """As to_world, with the usual resolution whatever the header says, velocities always in m/s before, no Angle, and
    another prefix in two dimensions."""
    cube = "Cen3" in catalog.columns
    plain = catalog.drop("Angle")
    if not cube:
        return to_world(plain, replace(w, resolution=Wcs().resolution), "MWSIP")
    speed = {f"{kind}3": (F.lit(w.crval[2]) + (F.col(f"{kind}3") - w.crpix[2]) * w.cdelt[2]) / 1000.0 for kind in ("Peak", "Cen")}
    out = to_world(plain.withColumns({f"_{k}": e for k, e in speed.items()}), replace(w, resolution=Wcs().resolution))
    return out.withColumns({**{k: F.col(f"_{k}") for k in speed}, "ID": clump_name(F.col("Cen1"), F.col("Cen2"), F.col("_Cen3"))}).drop(*(f"_{k}" for k in speed))


def fit_to_pixel(catalog: DataFrame, w: Wcs) -> DataFrame:
    """A fitted catalogue in world coordinates as pixels: the inverse of fit_to_world, but that ID and Flux stay as they
    are, the latter as Sum."""
    cube = "Velocity" in catalog.columns
    x, y = pixel(F.col("Galactic_Longitude"), F.col("Galactic_Latitude"), w)
    return catalog.select(
        "ID",
        x.alias("Cen1"),
        y.alias("Cen2"),
        *([((F.col("Velocity") * 1000.0 - w.crval[2]) / w.cdelt[2] + w.crpix[2]).alias("Cen3")] if cube else []),
        (F.col("Size_major") / w.resolution[0]).alias("Size1"),
        (F.col("Size_minor") / w.resolution[1]).alias("Size2"),
        *([(F.col("Size_velocity") / w.resolution[2]).alias("Size3")] if cube else []),
        "Theta",
        "Peak",
        F.col("Flux").alias("Sum"),
        *(c for c in ("Flux_SNR", "Peak_SNR", "Success", "Cost") if c in catalog.columns),
    )


def fit_to_world(catalog: DataFrame, w: Wcs, prefix: str = "MWISP") -> DataFrame:
    """A fitted pixel catalogue in world coordinates; Flux is Sum times the last resolution."""
    cube = "Cen3" in catalog.columns
    lon, lat = sky(F.col("Cen1"), F.col("Cen2"), w)
    vel = (F.lit(w.crval[2]) + (F.col("Cen3") - w.crpix[2]) * w.cdelt[2]) / 1000.0 if cube else None
    return catalog.select(
        clump_name(lon, lat, vel, prefix, (3, 2, 1)).alias("ID"),
        lon.alias("Galactic_Longitude"),
        lat.alias("Galactic_Latitude"),
        *([vel.alias("Velocity")] if cube else []),
        (F.col("Size1") * w.resolution[0]).alias("Size_major"),
        (F.col("Size2") * w.resolution[1]).alias("Size_minor"),
        *([(F.col("Size3") * w.resolution[2]).alias("Size_velocity")] if cube else []),
        "Theta",
        "Peak",
        (F.col("Sum") * w.resolution[2 if cube else 1]).alias("Flux"),
        *(c for c in ("Flux_SNR", "Peak_SNR", "Success", "Cost") if c in catalog.columns),
    )
