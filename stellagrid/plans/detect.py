"""Whole plans: detection, detection with fits, tiled and multi-scale detection."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wcs
from ..functions.model import fit_catalog
from ..operators import density, grid, labels, measure, mosaic, overlap, smooth, spread_fit
from ..operators.grid import Shape
from ..params import DetectParams, FitParams
from ..tables import cut_lineage, kept


@dataclass
class Detection:
    """mask: the voxels kept of each clump; catalog: one row a clump; density: the smoothed cube."""

    mask: DataFrame
    catalog: DataFrame
    density: DataFrame


def smoothed(cube: DataFrame, shape: Shape, p: DetectParams) -> DataFrame:
    if p.sigma is None:
        return smooth.adaptive_density(cube, shape)
    kernel = smooth.gaussian_kernel(p.sigma)
    return smooth.smooth(cube.withColumn("intensity", F.col("intensity").cast("double")), shape, {a: kernel for a in shape})


def fingerprint(cube: DataFrame, shape: Shape, p: DetectParams, header: dict | None = None) -> str:
    """A name for the density of a cube: of all its voxels, its header and the kernels, whatever order the rows are in.

    Voxels go into two sums of 64-bit hashes and a count: one pass over the cube, without a shuffle of it.
    """
    columns = ["tile", *shape, "intensity"]
    whole = "decimal(38,0)"
    sums = cube.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), *(F.col(c).cast("double") if c == "intensity" else F.col(c) for c in columns)).cast(whole)) for seed in (1, 2))).first()
    kernels = [smooth.gaussian_kernel(p.sigma)] if p.sigma is not None else [smooth.gaussian_kernel(s) for s in smooth.SCALES]
    said = [list(shape.items()), [str(x) for x in sums], kernels, sorted((str(k), str(v)) for k, v in (header or {}).items())]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


def kept_density(cube: DataFrame, shape: Shape, p: DetectParams, folder: str, header: dict | None = None) -> tuple[DataFrame, bool]:
    """The smoothed cube from a folder of densities, made and put there if it is not known yet; and whether it was."""
    return kept(cube.sparkSession, folder, f"density-{fingerprint(cube, shape, p, header)}", lambda: smoothed(cube, shape, p))


def detect(cube: DataFrame, shape: Shape, p: DetectParams, densities: str | None = None, header: dict | None = None) -> Detection:
    """Clumps of a dense cube (tile, axes, idx, intensity), every tile by itself.

    densities is a folder in which densities are kept: a cube that was smoothed with the same kernels before, by this or
    another session, is not smoothed again. Changed voxels, headers or kernels have another density.

    Smoothing, then the density peak clustering of the voxels above the noise: nearest denser neighbours, centres,
    labels down the parent forest, boundaries by gradient, measures of whole labels, and tests of size and edge. Moments
    come from the whole label, the mask and the test of size from its largest connected part.
    """
    rho = kept_density(cube, shape, p, densities, header)[0] if densities else cut_lineage(smoothed(cube, shape, p), "density")
    link = density.nearest_higher_anywhere if p.anywhere else density.nearest_higher
    linked = cut_lineage(link(rho.where(F.col("rho") > p.noise), shape, p.delta_min, ("intensity",)), "linked")
    centre = density.centres(linked, p.rho_min, p.delta_min)
    named = cut_lineage(labels.propagate(linked, centre), "labels")
    clusters = cut_lineage(labels.cut_boundaries(named, p.gradmin), "clusters")
    part = cut_lineage(labels.largest_part(clusters, shape), "parts")
    sizes = labels.area_and_span(part, shape)
    enough = F.col("area") >= p.min_area
    if "v" in shape:
        enough &= F.col("span") >= p.min_span
    large = sizes.where(enough).select("tile", F.col("clump_id").alias("ID"))
    angles = measure.orientation(clusters).withColumnRenamed("clump_id", "ID")
    catalog = measure.regions(clusters, shape).join(large, ["tile", "ID"]).join(angles, ["tile", "ID"], "left")
    if p.remove_edge:
        catalog = catalog.where(~measure.touches_edge(shape))
    catalog = cut_lineage(catalog, "catalog")
    mask = part.join(catalog.select("tile", F.col("ID").alias("clump_id")), ["tile", "clump_id"], "left_semi")
    return Detection(mask.select("tile", "clump_id", *shape, "idx", "intensity"), catalog, rho)


def detect_and_fit(cube: DataFrame, shape: Shape, p: DetectParams, o: FitParams = FitParams()) -> tuple[Detection, DataFrame]:
    """A detection, and the fitted catalogue of its clumps, every tile by itself."""
    found = detect(cube, shape, p)
    groups = cut_lineage(overlap.overlap_groups(found.catalog, o.overlap), "groups")
    fits = spread_fit.fit_any(grid.clump_points(cube, found.mask, shape), found.catalog, groups, o)
    return found, fit_catalog(cut_lineage(fits, "fits"), p.rms)


def detect_fit_tiled(cube: DataFrame, shape: Shape, p: DetectParams, step: int, halo: int, o: FitParams = FitParams(), world: wcs.Wcs | None = None) -> tuple[DataFrame, DataFrame]:
    """The catalogue of one field and the fits of its clumps, found and fitted tile by tile, with (tile, ID) as the key.

    A clump belongs to the tile that owns its centre as it was found: a fit may move the centre over a seam, and would
    then be in both tiles or in neither. A tile fits the groups of overlapping clumps that have one of its own, with the
    members in its halo, which are left out of the result. So the field is fitted once, a tile's fits are as large as a
    tile, and results are those of the whole field where a halo holds the groups that lie across a seam.
    """
    parts = cut_lineage(mosaic.split(cube.drop("tile"), shape, step, halo), "tiles")
    found = detect(parts, shape, replace(p, remove_edge=False))
    tiles = mosaic.tile_table(cube.sparkSession, mosaic.tiling(shape, step, halo))
    own = mosaic.owned(found.catalog, tiles)
    if p.remove_edge:
        own = own.where(~measure.touches_edge(shape))
    own = cut_lineage(own, "owned")
    groups = cut_lineage(overlap.overlap_groups(found.catalog, o.overlap), "groups")
    needed = groups.join(own.select("tile", "ID"), ["tile", "ID"], "left_semi").select("tile", "component").distinct()
    groups = cut_lineage(groups.join(needed, ["tile", "component"], "left_semi"), "groups")
    fits = cut_lineage(spread_fit.fit_any(grid.clump_points(parts, found.mask, shape), found.catalog, groups, o), "fits")
    fitted = fit_catalog(fits.join(own.select("tile", F.col("ID").cast("long").alias("ID")), ["tile", "ID"], "left_semi"), p.rms)
    if world:
        return wcs.to_world(own, world, p.id_prefix), wcs.fit_to_world(fitted, world, p.id_prefix)
    return own, fitted


def detect_tiled(cube: DataFrame, shape: Shape, p: DetectParams, step: int, halo: int, world: wcs.Wcs | None = None) -> DataFrame:
    """The catalogue of one field found tile by tile, each clump by the tile that owns its centre.

    Tiles keep field coordinates, so no result is moved; a halo of the smoothing radius and the reach of the denser
    neighbour around a clump makes a tile's result that of the whole field.
    """
    parts = mosaic.split(cube.drop("tile"), shape, step, halo)
    found = detect(parts, shape, replace(p, remove_edge=False))
    tiles = mosaic.tile_table(cube.sparkSession, mosaic.tiling(shape, step, halo))
    catalog = mosaic.owned(found.catalog, tiles)
    if p.remove_edge:
        catalog = catalog.where(~measure.touches_edge(shape))
    return wcs.to_world(catalog, world, p.id_prefix) if world else catalog


def detect_multiscale(cube: DataFrame, shape: Shape, p: DetectParams, fine: DetectParams, o: FitParams = FitParams()) -> tuple[Detection, Detection, DataFrame | None]:
    """A detection on the cube; another on what a blur takes from it, with its own noise outside the first one's clumps;
    and joint fits of the overlapping clumps of detail to the cube. No fit if there is no detail."""
    coarse = detect(cube, shape, p)
    detail = cut_lineage(smooth.detail(cube, shape).select("tile", *shape, "idx", F.col("detail").alias("intensity")), "detail")
    rms = measure.off_mask_rms(detail, coarse.mask).agg(F.max("rms")).first()[0] or fine.rms
    small = detect(detail, shape, replace(fine, rms=rms))
    if small.catalog.isEmpty():
        return coarse, small, None
    again = cut_lineage(measure.regions(small.mask.drop("intensity").join(cube.select("tile", "idx", "intensity"), ["tile", "idx"]), shape).where(F.col("Cen1").isNotNull()), "again")
    groups = cut_lineage(overlap.overlap_groups(again, o.overlap), "groups")
    return coarse, small, spread_fit.fit_any(grid.clump_points(cube, small.mask, shape), again, groups, o)


def detect_log(p: DetectParams, shape: Shape, found: Detection) -> DataFrame:
    """One row: the parameters, the cube's shape, and the number of clumps."""
    lits = {k: F.lit(v if v is not None else "adaptive").cast("string") for k, v in vars(p).items()}
    return found.catalog.agg(F.count("*").alias("clumps")).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit(str(shape)).alias("shape"), *(c.alias(k) for k, c in lits.items()), "clumps")
