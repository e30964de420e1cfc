"""Detection on tiles as they arrive, whole or in pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.grid import Shape, dense_grid
from ..params import DetectParams
from ..plans.detect import detect
from ..tables import cut_lineage


def detect_arriving(voxels: DataFrame, shape: Shape, p: DetectParams, catalog_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the clumps of every micro-batch of whole tiles to catalog_path.

    A batch's clumps are written under the batch's number, so a repeated batch replaces its own.
    """

    def found(batch: DataFrame, number: int) -> None:
        detect(dense_grid(batch, shape), shape, p).catalog.write.mode("overwrite").parquet(f"{catalog_path}/batch={number}")

    return voxels.writeStream.foreachBatch(found).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a piece of a tile is in the state: the places and intensities of its voxels.
PIECE = np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "<i4"), ("intensity", "<f8")])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pieces(StatefulProcessor):
    """A tile's state: its pieces, how many voxels they have, and a timer from the first piece on.

    A tile goes on when all its places are there, or, as it is, when the time is up; what arrives for it afterwards is
    dropped. A place that arrives twice counts once, and its last intensity stays.
    """

    def __init__(self, axes: list[str], expected: int, patience_ms: int):
        self.axes, self.expected, self.patience_ms = axes, expected, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "piece binary")
        self.held = handle.getValueState("held", "voxels long")
        self.gone = handle.getValueState("gone", "done boolean")

    def _emit(self, key: tuple, complete: bool, voxels: np.ndarray) -> Iterator[pd.DataFrame]:
        self.pieces.clear()
        self.held.clear()
        self.gone.update((True,))
        yield pd.DataFrame({"tile": key[0], **{a: voxels[a] for a in self.axes}, "intensity": voxels["intensity"], "complete": complete})

    def _voxels(self) -> np.ndarray:
        """All pieces in the order of their arrival, without places that come again later."""
        whole = np.concatenate([np.frombuffer(p, dtype=PIECE) for (p,) in self.pieces.get()])[::-1]
        _, first = np.unique(whole[["x", "y", "v"]], return_index=True)
        return whole[np.sort(first)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.gone.exists():
            for _ in rows:
                pass
            return
        n = self.held.get()[0] if self.held.exists() else None
        if n is None:
            n = 0
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        for batch in rows:
            piece = np.zeros(len(batch), dtype=PIECE)
            for c in (*self.axes, "intensity"):
                piece[c] = batch[c].to_numpy()
            self.pieces.appendValue((piece.tobytes(),))
            n += len(piece)
        self.held.update((n,))
        if n >= self.expected and len(voxels := self._voxels()) >= self.expected:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            yield from self._emit(key, True, voxels)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists() and not self.gone.exists():
            yield from self._emit(key, False, self._voxels())

    def close(self) -> None:
        pass


def whole_tiles(voxels: DataFrame, shape: Shape, patience: float) -> DataFrame:
    """The voxels of a stream's tiles (tile, axes, intensity) once all of a tile have arrived, or `patience` seconds after
    its first piece; complete says which. A tile's voxels lie in the state until then, so the state is as large as the
    tiles that are under way. It needs the state store that keeps its state on disk, and sets the session to it."""
    voxels.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    axes = list(shape)
    rows = voxels.where(F.col("tile").isNotNull()).select("tile", *(F.col(a).cast("int").alias(a) for a in axes), F.coalesce(F.nanvl(F.col("intensity").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("intensity"))
    inside = reduce(lambda a, b: a & b, (F.col(a).between(1, n) for a, n in shape.items()))
    schema = "tile string, " + ", ".join(f"{a} int" for a in axes) + ", intensity double, complete boolean"
    pieces = Pieces(axes, math.prod(shape.values()), int(patience * 1000))
    return rows.where(inside).groupBy("tile").transformWithStateInPandas(pieces, schema, "Append", "ProcessingTime")


def detect_pieces(voxels: DataFrame, shape: Shape, p: DetectParams, catalog_path: str, checkpoint: str, patience: float = 3600.0, every: str = "10 seconds") -> StreamingQuery:
    """Starts a query that appends the clumps of every tile to catalog_path when the tile is whole (see whole_tiles).

    Tiles may arrive in pieces over any number of micro-batches. A batch's clumps are written under the batch's number,
    with `complete`, so a repeated batch replaces its own.
    """

    def found(batch: DataFrame, number: int) -> None:
        batch = cut_lineage(batch, "tiles")
        if batch.isEmpty():
            return
        state = batch.select("tile", "complete").distinct()
        clumps = detect(dense_grid(batch.drop("complete"), shape), shape, p).catalog
        clumps.join(state, "tile").write.mode("overwrite").parquet(f"{catalog_path}/batch={number}")

    stream = whole_tiles(voxels, shape, patience).writeStream.outputMode("append").foreachBatch(found)
    return stream.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
