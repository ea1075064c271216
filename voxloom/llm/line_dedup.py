"""Line dedup: drop every line whose normalised form occurs in many documents.

A line's key is the line without the white space (0x20, 0x09 to 0x0D) at its ends, A-Z in lower case.
Keys are hashed to 128 bits.  Each document names each of its keys once; Spark counts documents per
hash, adding up on the map side, so one line in a third of all documents is no hot key.  Hashes at or
over the threshold are joined back to the (document, position) rows, and documents are reassembled by
position without the dropped lines.

Scale.  The hashes of a document's lines are computed once and checkpointed; texts are read again and
shuffled at most once, to meet the list of dropped positions.  The table of hot hashes is broadcast
only behind a count of its rows.

Edge cases.  Null and empty texts are one empty line.  Empty keys are never dropped.  Each row is a
document of its own when lines are counted; rows that agree in doc_id and text (null ids included)
share one result.  An empty table gives an empty result.  Extra columns, whatever their names, are
carried along by ``without_common_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LOWER, SPACES, UPPER
from voxloom.session import checked_broadcast, durable

LEAST_DOCUMENTS, LEAST_LENGTH = 10, 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(text: Column, least_length: int = LEAST_LENGTH) -> Column:
    """Per line a struct (a, b) of two 64-bit hashes of its key, or null where the key is shorter than ``least_length``."""
    keys = F.transform(lines(text), lambda line: F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_length, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))


def dropped_positions(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(__id, __text, positions) of the rows (doc_id, text) that lose lines; __text is a hash of the text."""
    hashed = durable(docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), line_hashes(F.col("text"), least_length).alias("h")))
    named = hashed.select(F.explode(F.array_distinct("h")).alias("h")).where("h is not null").select("h.a", "h.b")
    hot = durable(named.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents).select("a", "b"))
    places = hashed.select("__id", "__text", F.posexplode("h").alias("at", "h")).where("h is not null").select("__id", "__text", "at", "h.a", "h.b")
    return places.join(checked_broadcast(hot), ["a", "b"]).groupBy("__id", "__text").agg(F.collect_set("at").alias("positions"))


def _joined(docs: DataFrame, least_documents: int, least_length: int) -> DataFrame:
    """(row, lines, kept) of each row of ``docs``: all its columns, its lines, the positions that stay (null: all)."""
    gone = dropped_positions(docs.select("doc_id", "text"), least_documents, least_length)
    rows = docs.select(F.struct("*").alias("row"))
    out = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("row.text") == F.col("__text")), "left")
    out = out.select("row", lines(F.col("row.text")).alias("lines"), "positions")
    return out.select("row", "lines", F.when(F.col("positions").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "positions")).alias("kept"))


def _text() -> Column:
    return F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")


def digest(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row (doc_id, text)."""
    out = _joined(docs.select("doc_id", "text"), least_documents, least_length)
    n = F.size("lines").cast("long")
    text = F.coalesce(_text(), F.col("row.text"), F.lit(""))
    return out.select("row.doc_id", n.alias("n_lines"), F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def without_common_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The rows of ``docs`` with all its columns, the text without its dropped lines; texts that lose none stay as they are."""
    out = _joined(docs, least_documents, least_length)
    text = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(_text())
    return out.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
