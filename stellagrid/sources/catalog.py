"""Catalogues as delimited text: reading with the delimiter found in the header line, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Shape
from ..operators.match import MatchResult
from ..operators.measure import FIT_WORLD_DECIMALS, PIXEL_DECIMALS, in_core, rounded


def sniff_delimiter(line: str) -> str:
    """Tab, comma, or space: the first that divides the header line."""
    return next((d for d in ("\t", ",", " ") if d in line.strip()), "\t")


def read_catalog(spark: SparkSession, path: str, schema: str | None = None, names: str | None = None) -> DataFrame:
    """A catalogue file, or a folder of such (those whose names match a pattern), with typed columns (doubles, and strings where a value is no number).

    The header line decides the delimiter; a column without a name is a row number and is left out. Runs of spaces are
    one delimiter.
    """
    files = {"pathGlobFilter": names} if names else {}
    head = spark.read.options(**files).text(path).limit(1).collect()
    line = head[0][0] if head else ""
    delimiter = sniff_delimiter(line)
    if delimiter != " ":
        df = spark.read.options(**files).csv(path, sep=delimiter, header=True, schema=schema, inferSchema=schema is None, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        return df.drop(*(c for c in df.columns if c.startswith("_c") or c.startswith("Unnamed")))
    names = line.split()
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.options(**files).text(path).where((F.trim("value") != "") & (F.trim("value") != line.strip()))
    return rows.select(*(F.coalesce(F.get(fields, F.lit(k)).try_cast("double")).alias(n) for k, n in enumerate(names)))


def normalise_names(catalog: DataFrame, with_id: bool = True) -> DataFrame:
    """Column names as the engine has them (cen1 -> Cen1); ID from PIDENT, or the row number where there is none."""
    known = {n.lower(): n for n in ("ID", "Peak", "Sum", "Volume", "Angle", *(f"{k}{i}" for k in ("Peak", "Cen", "Size") for i in (1, 2, 3)))}
    out = catalog.toDF(*(known.get(c.lower(), c) for c in catalog.columns))
    if "ID" not in out.columns and "PIDENT" in out.columns:
        out = out.withColumnRenamed("PIDENT", "ID")
    return out


def write_catalog(catalog: DataFrame, path: str, round_columns: bool = True) -> None:
    """Tab-separated text with a header; pixel catalogues are rounded, world catalogues are written as they are."""
    out = rounded(catalog, PIXEL_DECIMALS) if round_columns else catalog
    out.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_local_catalog(catalog: DataFrame, path: str, shape: Shape, edges: tuple[tuple[float, float], ...]) -> None:
    """The clumps of the core alone, as write_catalog writes them."""
    write_catalog(catalog.where(in_core(shape, edges)), path)


def write_fit_world(catalog: DataFrame, path: str) -> None:
    """A fitted catalogue in world coordinates, rounded column by column."""
    rounded(catalog, FIT_WORLD_DECIMALS).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_matches(result: MatchResult, folder: str, suffix: str) -> None:
    """Match, Miss and False as three tables of the folder, named after the suffix of what was matched."""
    for name, table in (("Match", result.match), ("Miss", result.miss), ("False", result.false)):
        table.write.mode("overwrite").csv(f"{folder}/{name}_{suffix}", sep="\t", header=True)


def write_fit_groups(fits: DataFrame, path: str) -> None:
    """Fits as one table with a folder for each group of overlapping clumps (component)."""
    fits.write.mode("overwrite").partitionBy("component").csv(path, header=True)


def collect_fit_groups(spark: SparkSession, path: str) -> DataFrame:
    """All groups that write_fit_groups wrote, or a folder of such files, as one table in the order of ID."""
    return spark.read.csv(path, header=True, inferSchema=True).orderBy("ID")


def write_spaced(catalog: DataFrame, path: str) -> None:
    """Space-separated text with a header."""
    catalog.write.mode("overwrite").csv(path, sep=" ", header=True)


def write_fixed_width(catalog: DataFrame, path: str, width: int = 14) -> None:
    out = catalog.select(F.concat(*(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c in catalog.columns)).alias("value"))
    out.write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str) -> None:
    """The voxels of all clumps as one table partitioned by clump."""
    points.write.mode("overwrite").partitionBy("clump_id").parquet(path)


def log_value(spark: SparkSession, path: str, word: str = "fits") -> str | None:
    """What stands after the last ": " of the first line of a log that has the word."""
    found = spark.read.text(path).where(F.contains("value", F.lit(word))).select(F.element_at(F.split("value", ": "), -1)).limit(1).collect()
    return found[0][0] if found else None
