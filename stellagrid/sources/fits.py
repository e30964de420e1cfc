"""FITS images and binary tables as a Spark data source, and their export.

scan_fits(spark, path) gives one row a voxel, read_table(spark, path) the rows of a binary table. A partition is a block
of planes of the slowest axis, or of table rows, read by byte ranges, so that a file of any size is spread over tasks and
none holds it whole. Filters on x, y and v become ranges of planes and rows before anything is read. Files lie where
pyarrow's file systems reach them: a local or mounted path, or a URI. read_fits() reads images through Spark's own file
systems, for paths that only those know, as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.wcs import Wcs
from ..operators.grid import subcube, voxel_index, world_subcube
from ..operators.rank import ranked

BLOCK, CARD = 2880, 80
#: The sample types of the format.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_card(card: str) -> tuple[str, object] | None:
    key, sign, rest = card[:8].strip(), card[8:10], card[10:]
    if sign != "= ":
        return (key, card[8:].strip()) if key else None
    rest = rest.strip()
    if rest.startswith("'"):
        end = 1
        while (end := rest.find("'", end)) >= 0 and rest[end : end + 2] == "''":
            end += 2
        return key, rest[1 : end if end >= 0 else None].replace("''", "'").rstrip()
    value = rest.split("/")[0].strip()
    if value in ("T", "F"):
        return key, value == "T"
    try:
        return key, int(value)
    except ValueError:
        try:
            return key, float(value.replace("D", "E"))
        except ValueError:
            return key, value


def _file(path: str):
    """The file, for reading at any place."""
    system, name = files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)
    return system.open_input_file(name)


def _cards(f, at: int, path: str) -> tuple[dict[str, object], int]:
    """The header that begins at a place of a file, and where its data begin."""
    header: dict[str, object] = {}
    while block := f.read_at(BLOCK, at):
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            if card.startswith("END") and not card[3:].strip():
                return header, at
            if (parsed := parse_card(card)) and parsed[0] not in ("HISTORY", "COMMENT"):
                header.setdefault(*parsed)
    raise ValueError(f"no END card: {path}")


def _named(path: str) -> str:
    if not path.endswith((".fits", ".fit", ".FIT")):
        raise TypeError(f"not a FITS file by its name: {path}")
    return path


def read_header(path: str) -> tuple[dict[str, object], int]:
    """The primary header, and where its data begin."""
    with _file(_named(path)) as f:
        return _cards(f, 0, path)


def _data_bytes(header: dict[str, object]) -> int:
    """The bytes of the data after a header, whole blocks, with what a table has after its rows."""
    sides = [int(header[f"NAXIS{k}"]) for k in range(1, int(header.get("NAXIS", 0)) + 1)]
    size = abs(int(header["BITPIX"])) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + math.prod(sides)) if sides else 0
    return -(-size // BLOCK) * BLOCK


def decoded(raw: np.ndarray, header: dict[str, object]) -> np.ndarray:
    """Samples as doubles: scaled, blank integers and NaN as 0."""
    values = raw.astype(np.float64) * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
    if (blank := header.get("BLANK")) is not None and raw.dtype.kind in "iu":
        values[raw == int(blank)] = np.nan
    return np.nan_to_num(values, nan=0.0)


def image_shape(header: dict[str, object], path: str) -> list[int]:
    """The lengths of the axes x, y and perhaps v; axes of length 1 do not count."""
    shape = [n for n in (int(header[f"NAXIS{k}"]) for k in range(1, int(header["NAXIS"]) + 1)) if n > 1] or [1]
    if len(shape) not in (2, 3):
        raise ValueError(f"a cube has 2 or 3 axes, not {len(shape)}: {path}")
    return shape


class _Planes(InputPartition):
    def __init__(self, first: int, last: int, bytes_read: int = 0):
        self.first, self.last, self.bytes_read = first, last, bytes_read


class FitsReader(DataSourceReader):
    """An image's voxels, or its header's cards."""

    def __init__(self, options: dict, schema):
        self.path, self.what = options["path"], options.get("what", "data")
        self.tile = options.get("tile", self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        self.planes = int(options.get("planes", 16))
        self.header, self.at = read_header(self.path)
        self.shape = image_shape(self.header, self.path)
        # v_range and the like, e.g. "10:20": closed 1-based pixel ranges.
        self.axes = ["x", "y", "v"][: len(self.shape)]
        self.ranges = {}
        for a, n in zip(self.axes, self.shape, strict=True):
            low, _, high = options.get(f"{a}_range", f"1:{n}").partition(":")
            self.ranges[a] = max(1, int(low)), min(n, int(high))

    @property
    def kind(self) -> np.dtype:
        return np.dtype(TYPES[int(self.header["BITPIX"])])

    def span(self, first: int, last: int) -> list[tuple[int, int]]:
        """(sample, number of samples) of each run that must be read of the planes first to last: whole rows of x."""
        x, plane = self.shape[0], math.prod(self.shape[:-1])
        if len(self.shape) == 2:
            return [((first - 1) * x, (last - first + 1) * x)]
        low, high = self.ranges["y"]
        if (low, high) == (1, self.shape[1]):
            return [((first - 1) * plane, (last - first + 1) * plane)]
        return [((k - 1) * plane + (low - 1) * x, (high - low + 1) * x) for k in range(first, last + 1)]

    def partitions(self) -> list[InputPartition]:
        if self.what == "header":
            return [_Planes(0, 0)]
        if any(low > high for low, high in self.ranges.values()):
            return [_Planes(1, 0)]  # nothing
        low, high = self.ranges[self.axes[-1]]
        cuts = [(k, min(high, k + self.planes - 1)) for k in range(low, high + 1, self.planes)]
        return [_Planes(a, b, sum(n for _, n in self.span(a, b)) * self.kind.itemsize) for a, b in cuts]

    def read(self, partition: _Planes) -> Iterator:
        if self.what == "header":
            yield from ((k, str(v)) for k, v in self.header.items())
            return
        x = self.shape[0]
        rows = max(1, (1 << 20) // x)  # about a million samples at once
        with _file(self.path) as f:
            for start, n in self.span(partition.first, partition.last) if partition.first <= partition.last else ():
                for at in range(start, start + n, rows * x):
                    raw = np.frombuffer(f.read_at(min(rows * x, start + n - at) * self.kind.itemsize, self.at + at * self.kind.itemsize), dtype=self.kind)
                    idx = at + np.arange(len(raw), dtype=np.int64)
                    place = {"x": idx % x + 1, "y": idx // x % self.shape[1] + 1} | ({"v": idx // math.prod(self.shape[:2]) + 1} if len(self.shape) == 3 else {})
                    keep = np.logical_and.reduce([(place[a] >= low) & (place[a] <= high) for a, (low, high) in self.ranges.items()])
                    n_kept = int(keep.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([self.tile] * n_kept, pa.string()),
                            *(pa.array(place[a][keep].astype(np.int32)) if a in place else pa.nulls(n_kept, pa.int32()) for a in "xyv"),
                            pa.array(idx[keep]),
                            pa.array(decoded(raw, self.header)[keep]),
                        ],
                        names=["tile", "x", "y", "v", "idx", "intensity"],
                    )


class PushingFitsReader(FitsReader):
    """Takes comparisons of x, y and v with whole numbers over from Spark: planes and rows outside are not read."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        if self.what == "header":
            yield from filters
            return
        for f in filters:
            axis = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if axis not in self.ranges:
                yield f
                continue
            low, high = self.ranges[axis]
            value = getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            match f:
                case IsNotNull():
                    pass
                case EqualTo() if whole:
                    low, high = max(low, value), min(high, value)
                case GreaterThan() if whole:
                    low = max(low, value + 1)
                case GreaterThanOrEqual() if whole:
                    low = max(low, value)
                case LessThan() if whole:
                    high = min(high, value - 1)
                case LessThanOrEqual() if whole:
                    high = min(high, value)
                case In() if f.value and all(isinstance(v, int) for v in f.value):
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                    yield f  # the range holds the values, and others between them
                case _:
                    yield f
            self.ranges[axis] = low, high


# ---- binary tables

#: The column types of the format.
FORMS = {"B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string"), "L": ("S1", "boolean")}


def _columns(header: dict[str, object]) -> list[tuple[str, int, str, int, object]]:
    """(name, repeat, form, offset in a row, null value) of each column of a table."""
    out, at = [], 0
    for k in range(1, int(header["TFIELDS"]) + 1):
        form = str(header[f"TFORM{k}"]).strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        repeat, code = int(form[:digits] or 1), form[digits : digits + 1]
        if code not in FORMS:
            raise ValueError(f"columns of form {form} are not read: column {header.get(f'TTYPE{k}', k)}")
        out.append((str(header.get(f"TTYPE{k}", f"COL{k}")).strip(), repeat, code, at, header.get(f"TNULL{k}")))
        at += repeat * (1 if code in "AL" else np.dtype(FORMS[code][0]).itemsize)
    if at != int(header["NAXIS1"]):
        raise ValueError(f"columns take {at} bytes, a row has {header['NAXIS1']}")
    return out


def table_header(path: str, table: int = 1) -> tuple[dict[str, object], int]:
    """The header of a file's binary table (of several, the number), and where its rows begin."""
    with _file(_named(path)) as f:
        header, at = _cards(f, 0, path)
        while True:
            at += _data_bytes(header)
            if at >= f.size():
                raise ValueError(f"no binary table {table}: {path}")
            header, at = _cards(f, at, path)
            if str(header.get("XTENSION", "")).strip() == "BINTABLE":
                table -= 1
                if not table:
                    return header, at


class FitsTableReader(DataSourceReader):
    """The rows of a binary table; only the bytes of the columns asked for are decoded."""

    def __init__(self, options: dict, schema):
        self.path, self.rows = options["path"], int(options.get("rows", 1 << 18))
        self.header, self.at = table_header(self.path, int(options.get("table", 1)))
        self.wanted = _wanted(self.header, options)

    def partitions(self) -> list[InputPartition]:
        n = int(self.header["NAXIS2"])
        return [_Planes(k, min(n, k + self.rows), (min(n, k + self.rows) - k) * int(self.header["NAXIS1"])) for k in range(0, n, self.rows)] or [_Planes(0, 0)]

    def read(self, partition: _Planes) -> Iterator:
        width = int(self.header["NAXIS1"])
        step = max(1, (1 << 22) // width)
        with _file(self.path) as f:
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                raw = np.frombuffer(f.read_at(n * width, self.at + first * width), dtype=np.uint8).reshape(n, width)
                yield pa.RecordBatch.from_arrays([_column(raw, c) for c in self.wanted], names=[c[0] for c in self.wanted])


def _wanted(header: dict[str, object], options: dict) -> list:
    names = [c.strip() for c in options["columns"].split(",")] if "columns" in options else None
    known = _columns(header)
    return known if names is None else [next(c for c in known if c[0] == n) for n in names]


def _column(raw: np.ndarray, column: tuple) -> pa.Array:
    """The values of a column from rows of bytes. Strings end at the first zero byte and lose blanks at the end."""
    _, repeat, code, at, null = column
    if code == "A":
        cells = np.ascontiguousarray(raw[:, at : at + repeat]).view(f"S{max(1, repeat)}").ravel() if repeat else np.full(len(raw), b"")
        return pa.array([c.split(b"\0")[0].decode("utf-8", "replace").rstrip(" ") for c in cells], pa.string())
    if code == "L":
        cells = raw[:, at : at + repeat]
        values, gone = (cells == ord("T")).ravel(), ((cells != ord("T")) & (cells != ord("F"))).ravel()
        kind = pa.bool_()
    else:
        size = np.dtype(FORMS[code][0]).itemsize
        values = np.ascontiguousarray(raw[:, at : at + repeat * size]).view(FORMS[code][0]).ravel()
        gone = values == int(null) if null is not None and values.dtype.kind in "iu" else None
        values = values.astype("i2" if code == "B" else values.dtype.newbyteorder("="))
        kind = pa.from_numpy_dtype(values.dtype)
    flat = pa.array(values, kind, mask=gone)
    return flat if repeat == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(raw) * repeat + 1, repeat) if repeat else np.zeros(len(raw) + 1), pa.int32()), flat)


class FitsSource(DataSource):
    """Options: path, what (data, header or table), tile (a name), planes (per partition), x_range, y_range, v_range, and
    pushdown (true where spark.sql.python.filterPushdown.enabled is); of tables: table (its number), columns, rows."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        what = self.options.get("what", "data")
        if what == "header":
            return "key string, value string"
        if what == "table":
            header, _ = table_header(self.options["path"], int(self.options.get("table", 1)))
            kind = lambda repeat, code: FORMS[code][1] if repeat == 1 or code == "A" else f"array<{FORMS[code][1]}>"
            return ", ".join(f"`{name}` {kind(repeat, code)}" for name, repeat, code, _, _ in _wanted(header, self.options))
        return "tile string, x int, y int, v int, idx bigint, intensity double"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("what", "data") == "table":
            return FitsTableReader(self.options, schema)
        return (PushingFitsReader if self.options.get("pushdown", "false") == "true" else FitsReader)(self.options, schema)


def scan_fits(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The voxels of an image (tile, x, y, v, idx, intensity); filters on x, y and v reach the file. It turns the session's
    setting for such filters on."""
    spark.dataSource.register(FitsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("fits").options(pushdown="true", **options).load(path)


def scan_world(spark: SparkSession, path: str, w: Wcs | None = None, **ranges: tuple[float, float]) -> DataFrame:
    """The voxels of an image within closed ranges of lon, lat and vel; only planes of the velocities are read.

    w is the header's if not given. A range of velocities is one of planes, as that axis is linear; a plane more at either
    end is read, and what lies outside left out, as are places outside the ranges of longitude and latitude.
    """
    w = w or Wcs.from_header(read_header(path)[0])
    cube = scan_fits(spark, path)
    if "vel" in ranges:
        ends = [(v * 1000.0 - w.crval[2] * (1000.0 / w.velocity_unit)) / (w.cdelt[2] * (1000.0 / w.velocity_unit)) + w.crpix[2] for v in ranges["vel"]]
        low, high = max(-(2**31), math.floor(min(ends)) - 1), min(2**31 - 1, math.ceil(max(ends)) + 1)
        cube = cube.where((F.col("v") >= low) & (F.col("v") <= high))
    return world_subcube(cube, w, **ranges)


def read_table(spark: SparkSession, path: str, table: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The rows of a binary table, or some of its columns. Columns of variable length (heaps) and complex ones are an error
    that names the column; unsigned and scaled integers come as they are stored."""
    spark.dataSource.register(FitsSource)
    more = {"columns": ",".join(columns)} if columns else {}
    return spark.read.format("fits").options(what="table", table=str(table), **more).load(path)


def card(key: str, value) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int | float):
        text = f"{value!r:>20}".upper()
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}"[:CARD].ljust(CARD)


#: Samples, and bytes of table rows, that a task packs at once.
CHUNK, CHUNK_BYTES = 1 << 20, 1 << 23


def _begin(path: str, text: bytes, data: int) -> int:
    """A file of a header and so many bytes of zeros to the end of a block; where the data begin."""
    with open(path, "wb") as f:
        f.write(text)
        f.truncate(len(text) + -(-data // BLOCK) * BLOCK)
    return len(text)


def _header_text(cards: list[tuple]) -> bytes:
    text = "".join(card(*c) for c in cards) + "END".ljust(CARD)
    return text.encode("ascii").ljust(-(-len(text) // BLOCK) * BLOCK)


def write_fits(voxels: DataFrame, shape: dict[str, int], path: str, header: dict | None = None, integer: bool = False) -> None:
    """One tile's voxels (idx, intensity) as a FITS image; missing and null voxels are 0.

    The driver writes the header and sets the file's length. Voxels are dealt by runs of CHUNK samples, and every task
    writes its runs at their place in the file; a task that runs again writes the same bytes. So path must be in a folder
    that driver and executors share as a file system, as the machine's own is for a local session.
    """
    cards = [("SIMPLE", True), ("BITPIX", 32 if integer else -64), ("NAXIS", len(shape))]
    cards += [(f"NAXIS{k}", n) for k, n in enumerate(shape.values(), 1)] + list((header or {}).items())
    kind, size = np.dtype(">i4" if integer else ">f8"), math.prod(shape.values())
    at = _begin(path, _header_text(cards), size * kind.itemsize)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        chunk = int(group["chunk"].iloc[0])
        out = np.zeros(min(CHUNK, size - chunk * CHUNK), dtype=kind)
        out[group["idx"].to_numpy() - chunk * CHUNK] = group["intensity"].to_numpy()
        with open(path, "r+b") as f:
            f.seek(at + chunk * CHUNK * kind.itemsize)
            f.write(out.tobytes())
        return pd.DataFrame({"n": [len(group)]})

    inside = voxels.where(F.col("idx").between(0, size - 1) & F.col("intensity").isNotNull())
    inside.select("idx", "intensity", F.floor(F.col("idx") / CHUNK).alias("chunk")).groupBy("chunk").applyInPandas(pack, "n long").agg(F.sum("n")).collect()


def write_table(df: DataFrame, path: str, order: list[str], name: str = "TABLE") -> None:
    """df as the binary table of a FITS file, in the order of the columns `order`, which tell rows apart.

    Strings take as many bytes as the longest one has; arrays must all be of one length and without nulls. Null whole
    numbers are the least number of their type (TNULL), null doubles NaN, null strings empty. Every task writes its rows
    at their place, as write_fits() does, so path must be in a folder that driver and executors share.
    """
    kinds = {"smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A", "boolean": "L"}
    plain = {c: t.removeprefix("array<").removesuffix(">") for c, t in df.dtypes}
    lists = [c for c, t in df.dtypes if t.startswith("array<")]
    texts = [c for c, t in plain.items() if t == "string" and c not in lists]
    odd = [c for c, t in plain.items() if t not in kinds or (c in lists and t in ("string", "boolean"))]
    if odd:
        raise TypeError(f"no column form for {', '.join(odd)}")
    placed = ranked(df, [], [F.col(c) for c in order], "_rank")
    ends = placed.agg(F.count("*").alias("n"), *(F.max(F.octet_length(c)).alias(c) for c in texts), *(f(F.size(c)).alias(f"{c} {f.__name__}") for c in lists for f in (F.min, F.max))).first()
    if ragged := [c for c in lists if ends[f"{c} min"] != ends[f"{c} max"]]:
        raise ValueError(f"arrays of different lengths: {', '.join(ragged)}")
    repeat = {c: max(1, ends[c] or 0) if c in texts else (ends[f"{c} max"] or 0) if c in lists else 1 for c in plain}
    form = {c: kinds[t] for c, t in plain.items()}
    dtype = {c: f"S{repeat[c]}" if form[c] == "A" else ("S1", (repeat[c],)) if form[c] == "L" else (FORMS[form[c]][0], (repeat[c],)) for c in plain}
    record = np.dtype([(c, *(d if isinstance(d, tuple) else (d,))) for c, d in dtype.items()])
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", record.itemsize), ("NAXIS2", ends["n"]), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(plain)), ("EXTNAME", name)]
    least = {c: np.iinfo(FORMS[form[c]][0]).min for c in plain if form[c] in "IJK" and c not in lists}
    for k, c in enumerate(plain, 1):
        cards += [(f"TTYPE{k}", c), (f"TFORM{k}", f"{repeat[c]}{form[c]}")] + ([(f"TNULL{k}", int(least[c]))] if c in least else [])
    text = _header_text([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + _header_text(cards)
    at, rows = _begin(path, text, ends["n"] * record.itemsize), max(1, CHUNK_BYTES // record.itemsize)

    def cells(values: list, c: str) -> list:
        if form[c] == "A":
            return [(v or "").encode() for v in values]
        if form[c] == "L":
            return [[b"\0" if v is None else b"T" if v else b"F"] for v in values]
        if c in lists:
            return values
        return [[(least.get(c, math.nan)) if v is None else v] for v in values]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rank")
        first = group.column("_rank")[0].as_py() - 1
        out = np.zeros(group.num_rows, dtype=record)
        for c in plain:
            out[c] = np.array(cells(group.column(c).to_pylist(), c), dtype=record[c].base).reshape(out[c].shape)
        with open(path, "r+b") as f:
            f.seek(at + first * record.itemsize)
            f.write(out.tobytes())
        return pa.table({"n": [group.num_rows]})

    placed.groupBy(F.floor((F.col("_rank") - 1) / rows).alias("_chunk")).applyInArrow(pack, "n long").agg(F.sum("n")).collect()


def write_subcube(voxels: DataFrame, shape: dict[str, int], path: str, header: dict | None = None, **ranges: tuple[int, int]) -> dict[str, int]:
    """The voxels within closed pixel ranges as a FITS image of their own, its reference pixels moved; gives its shape."""
    ends = {a: (max(1, ranges.get(a, (1, n))[0]), min(n, ranges.get(a, (1, n))[1])) for a, n in shape.items()}
    small = {a: high - low + 1 for a, (low, high) in ends.items()}
    moved = subcube(voxels, shape, **ends).withColumns({a: F.col(a) - low + 1 for a, (low, _) in ends.items()})
    cards = dict(header or {})
    for k, (low, _) in enumerate(ends.values(), 1):
        if f"CRPIX{k}" in cards:
            cards[f"CRPIX{k}"] = float(cards[f"CRPIX{k}"]) - low + 1
    write_fits(moved.withColumn("idx", voxel_index(small)), small, path, cards)
    return small


def write_mask(mask: DataFrame, shape: dict[str, int], path: str, header: dict | None = None) -> None:
    """A mask (idx, clump_id) as an integer FITS image, 0 off all clumps."""
    write_fits(mask.select("idx", F.col("clump_id").alias("intensity")), shape, path, header, integer=True)


def read_fits(spark: SparkSession, path: str, tile: str = "t0") -> tuple[dict[str, object], DataFrame]:
    """(header, voxels) of a FITS image at any path that Spark's file systems can open.

    The file is read as numbered blocks of 2880 bytes, split among tasks as any large file is; each block gives the
    voxels whose samples it holds. The driver reads the first blocks, up to the END card.
    """
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(BLOCK)}
    blocks = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf
    )
    header: dict[str, object] = {}
    count = 0
    while not header:
        count += 8
        first = blocks.filter(lambda b, n=count: b[0] < n).sortByKey().values().map(bytes).collect()
        data = b"".join(first)
        end = next((k for k in range(0, len(data), CARD) if data[k : k + CARD].rstrip() == b"END"), None)
        if end is not None:
            for k in range(0, end, CARD):
                if (parsed := parse_card(data[k : k + CARD].decode("ascii", "replace"))) and parsed[0] not in ("HISTORY", "COMMENT"):
                    header.setdefault(*parsed)
            break
        if len(first) < count:
            raise ValueError(f"no END card: {path}")
    begin = end // BLOCK + 1
    kind = np.dtype(TYPES[int(header["BITPIX"])])
    shape = image_shape(header, path)
    size, each = math.prod(shape), BLOCK // kind.itemsize

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column("number").to_pylist(), batch.column("data").to_pylist(), strict=True):
                at = (number - begin) * each
                raw = np.frombuffer(block, dtype=kind)[: max(0, size - at)]
                idx = at + np.arange(len(raw))
                x, y, v = idx % shape[0] + 1, idx // shape[0] % shape[1] + 1, idx // (shape[0] * shape[1]) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tile] * len(idx), pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)),
                        pa.array(v.astype(np.int32)) if len(shape) == 3 else pa.nulls(len(idx), pa.int32()), pa.array(idx), pa.array(decoded(raw, header)),
                    ],
                    names=["tile", "x", "y", "v", "idx", "intensity"],
                )

    rows = spark.createDataFrame(blocks.filter(lambda b: b[0] >= begin), "number long, data binary")
    return header, rows.mapInArrow(samples, "tile string, x int, y int, v int, idx long, intensity double")
