"""Line dedup: lines found in several documents stay in the first of them only.

Lines are exploded, normalised and hashed (two 64-bit hashes); a map-side-combined aggregate finds
the hashes held by several documents; the hits go back to their documents as lists of positions.
Only hashes, positions and ids are shuffled for that; texts move once, to meet their positions.

Defined cases. A missing or empty text is one empty line. Repeated rows with one id are one document:
each keeps or loses the same lines. Documents without an id count together as one that comes last.
Further columns are carried whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import ordered_id, packed, unpacked
from millrace.llm.text import WHITE

MIN_CHARS = 10
MIN_DOCS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row, n_lines, n_dropped, kept (the text that stays) for every document."""
    rows = packed(docs, id=ordered_id(), text=F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("print", F.xxhash64("text"))
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    lines = (
        rows.select("id", "print", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "print", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2"))
    )
    if min_docs == 2:
        held = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        held = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count_distinct("id").alias("docs")).where(F.col("docs") >= min_docs)
    drops = (
        lines.join(held.select("h1", "h2", "first"), ["h1", "h2"])
        .where("id <> first")
        .groupBy("id", "print")
        .agg(F.collect_set("pos").alias("drops"))
    )
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("parts"), i + 1)), "\n")
    return (
        rows.join(drops, ["id", "print"], "left")
        .withColumn("parts", parts)
        .select(
            "row",
            F.size("parts").cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        )
    )


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines before dropping, n_dropped, text that stays), a row for each document."""
    return _marked(docs, min_chars, min_docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("text"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; a text without a repeated line is unchanged."""
    marked = _marked(docs, min_chars, min_docs)
    return unpacked(marked, docs, text=F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")))
