"""Helpers that the text operators share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut_lineage as cut
from ..tables import drop

__all__ = ["LOWER", "UPPER", "WHITE", "ascii_lower", "cut", "drop", "filter_texts", "hash128", "pieces", "run_hashes", "small_batches", "small_side", "table", "text_or_empty", "word_hashes"]

#: The white space that the operators strip or split at, and the two ASCII alphabets.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that go to a Python worker at once. Spark's default of 64 MB stands several times over in a worker, beside the heap
#: of its executor.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bytes a batch to BATCH_BYTES; a lower setting stays. It holds when the result is computed.

    It bounds what a worker holds, whatever the length of texts, and leaves batches of short rows as they are.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = _bytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that for pure ASCII, and quickly."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hash128(c: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds: equal pairs are taken for equal strings."""
    return [F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)]


def small_side(df: DataFrame, row_bytes: Column, at_most_mb: float = 32) -> DataFrame:
    """df, marked for broadcast if its measured size is at most at_most_mb; else as it is, for a shuffled join.

    df should be cheap to read, as cut() leaves it.
    """
    size = df.agg(F.sum(row_bytes.cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if size <= at_most_mb * 1_000_000 else df


def filter_texts(docs: DataFrame, passing: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs whose text passes, with all columns as they are. passing() says so of a list of texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1 << 14), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(flat: bytes, k: int) -> np.ndarray:
    """Hashes of all runs of k words of flat, whose words stand one space apart; of the whole if it has fewer."""
    b = np.frombuffer(flat, dtype=np.uint8)
    n = len(b)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * _power("up", _P, n), out=sums[1:])
    gaps = np.flatnonzero(b == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [n]))
    m = max(1, len(starts) - k + 1)
    first, last = starts[:m], ends[len(ends) - m :]
    return _mix((sums[last] - sums[first]) * _power("down", _P_INVERSE, n + 1)[first] + (last - first).astype(np.uint64))


#: A text is taken in pieces of about so many bytes, so that what a task holds does not grow with the longest text.
PIECE = 1 << 19
#: Longer words are hashed on their own.
LONG_WORD = 1 << 16
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def pieces(text: bytes) -> Iterator[bytes]:
    """text, cut at white space into pieces of PIECE bytes and what is left of the word there."""
    at = 0
    while len(text) - at > PIECE:
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; words have no white space and are not empty."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if max(map(len, words)) <= LONG_WORD:
        return run_hashes(b" ".join(words), 1)
    long = {k: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for k, w in enumerate(words) if len(w) > LONG_WORD}
    out = run_hashes(b" ".join([b"-" if k in long else w for k, w in enumerate(words)]), 1)
    out[list(long)] = np.array(list(long.values()), dtype=np.uint64)
    return out
