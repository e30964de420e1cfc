"""Parameters of detection, fitting and matching, with their usual defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DetectParams:
    """Thresholds are in units of the background noise `rms`, distances in voxels."""

    rms: float = 1.0
    delta_min: int = 4
    gradmin: float = 0.01
    min_area: int = 25
    min_span: int = 5
    noise_times: float = 2.0
    rms_times: float = 5.0
    sigma: float | None = None  # None: adaptive density
    remove_edge: bool = True
    anywhere: bool = False  # look for denser voxels beyond delta_min, through the whole tile
    id_prefix: str = "MWISP"

    @property
    def noise(self) -> float:
        return self.rms * self.noise_times

    @property
    def rho_min(self) -> float:
        return self.rms * self.rms_times


@dataclass(frozen=True)
class FitParams:
    overlap: float = 0.8
    peak_range: float = 3.0
    peak_low: float = 0.69
    sigma_time: float = 1.0
    size_time: float = 1.5
    size_low: float = 1.0
    weight_power: float = 4.0
    soft_scale: float = 0.1
    max_steps: int = 100
    task_mb: float = 256.0  # slopes that one task may hold; larger groups of clumps are fitted by blocks


@dataclass(frozen=True)
class MatchParams:
    """tolerance caps the allowed offset per axis; sizes are FWHM unless size_is_sigma."""

    tolerance: float = 2.0
    size_is_sigma: bool = False
    stop_on_first_reject: bool = True


#: Fixed value: full width at half maximum of a Gaussian of unit sigma.
FWHM = 2.3548


def tile_keys(df: DataFrame) -> list[str]:
    """The key of a catalogue's tile, if it has one: IDs are numbers within it."""
    return ["tile"] if "tile" in df.columns else []


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """The entries of a flat YAML file (key: value), without comments; a missing file is an error."""
    out = {}
    for (line,) in spark.read.text(path).collect():  # a configuration of some lines
        key, sign, value = line.split(" #")[0].partition(":")
        if sign and not key.lstrip().startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


def from_config(kind: type, config: dict[str, str]):
    """Parameters of a kind (DetectParams and the like) from entries of the same names; others are left as they are."""
    said = {f.name: config[f.name] for f in fields(kind) if f.name in config}
    value = lambda old, text: None if text in ("", "null", "None") else text.lower() in ("true", "yes", "1") if isinstance(old, bool) else type(old)(text) if old is not None else float(text)
    return kind(**{k: value(getattr(kind(), k), v) for k, v in said.items()})
