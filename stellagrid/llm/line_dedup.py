"""Line dedup: drop lines that many documents share, keep them in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, hash128, small_side, text_or_empty

MIN_CHARS = 40
MIN_DOCS = 5


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of every line whose normalised form has min_chars code points at least."""
    line = F.btrim("line", F.lit(WHITE))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(text_or_empty()).alias("row_hash"), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", line.alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", ascii_lower(F.col("line")).alias("line"))
        .select("doc_id", "row_hash", "pos", *(h.alias(f"h{i}") for i, h in enumerate(hash128(F.col("line")), 1)))
    )


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row, lines, dropped, kept): each row of docs as a struct, its lines, dropped positions, and lines kept."""
    lines = keyed_lines(docs, min_chars)
    common = cut(
        lines.groupBy("h1", "h2")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper"),
        "common_lines",
    )
    # Broadcast if measured to be small; else a plain join of two tables, whose hot keys adaptive execution splits.
    dropped = cut(
        lines.join(small_side(common, F.lit(0)), ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("dropped")),
        "dropped_lines",
    )
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("row_hash"), F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.col("lines")[i]))
    side = small_side(dropped, 16 + 4 * F.size("dropped"))
    return rows.join(side, ["doc_id", "row_hash"], "left").select("row", "lines", "dropped", F.array_join(kept, "\n").alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of each row of docs (doc_id, text; other columns are ignored).

    Lines are cut at "\\n", stripped, A-Z lower-cased and hashed to 128 bits; the documents of each hash are counted
    with partial aggregation on (hash, doc_id), so a line that a third of all documents hold is spread over all tasks.
    The hashes of common lines, which are few, then meet the lines again, in a broadcast where their measured size allows
    it; so do the positions to drop and their documents. Beyond that size both are shuffled, and the text moves once.

    A line found in min_docs distinct documents loses all its places but those in the largest doc_id that holds it.
    Null text counts as one empty line. Rows without doc_id count nowhere and lose nothing. Repeated rows of a doc_id
    are one document: each of them loses the same lines. An empty table gives no rows. A long text is split where it is
    read; a document's positions to drop are bounded by its own lines. There are no ties: doc_ids order the documents.
    """
    return _kept(docs.select("doc_id", "text"), min_chars, min_docs).select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("kept").alias("kept_text"),
    )


def rewrite(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the kept text for the text, and its length in n_chars if there is such a column; null texts become empty."""
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return _kept(docs, min_chars, min_docs).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
