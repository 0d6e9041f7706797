"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

The mean repetition of a source is its share of the target size over its own size. Each document's
count inverts the Poisson distribution with that mean at a uniform number hashed from seed, id and
text, so a rerun, or an executor lost half-way, gives the same copies. Copies are exploded and dealt
out by a hash of their own: any range of the output mixes all sources.

The cumulative distribution is an array per source, long enough that what lies beyond it is less
than the resolution of the uniform number; looking up a document's count scans that array only. A source with a
rate above PART_RATE splits it into equal parts: a document's count is then the sum of independent
Poisson numbers, each drawn at a uniform number of its own, which is Poisson again with the whole rate. So arrays stay
short, and the parts of one document are dealt out before their copies are made.

Defined cases. Copies are numbered from 1 in each part, parts STRIDE apart. A missing source is a source of its own. A missing text has size one, as an empty one.
A source without a weight gets none of the output. Equal rows are drawn alike. A very long text is a row like
any other; each of its copies is one. Further columns are carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import packed, unpacked
from millrace.plans.lineage import cut_lineage

#: Sources up to which the table of rates, one small row each, is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 2_000
#: Rate up to which a document's count is one draw.
PART_RATE = 1_000.0
#: Above the number of copies of any part.
STRIDE = 1 << 12
SEED = 17


def _uniform(digest: Column) -> Column:
    """52 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): mean copies of a source's documents and the distribution of their count in each of equal parts.

    ``weights`` are shares of the output's characters (one is added for each document) among the sources that are
    there, equal for all when not given; ``size`` is the output's size over the input's.
    """
    per = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)) + 1).alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    per = cut_lineage(per.select("source", "chars", weight.cast("double").alias("weight")))
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.coalesce(F.col("weight") / F.nullif("all_weight", F.lit(0.0)) * F.col("all_chars") * F.lit(float(size)) / F.col("chars"), F.lit(0.0))
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("int"))
    first = F.struct((-mean).alias("log_p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(so_far: Column, k: Column) -> Column:
        log_p = so_far["log_p"] + F.log(mean / k)
        return F.struct(log_p.alias("log_p"), F.concat(so_far["cdf"], F.array(F.element_at(so_far["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(steps, first, step)["cdf"]).otherwise(F.array(F.lit(2.0)))
    rates = per.join(F.broadcast(total)).select("source", rate.alias("rate"))
    return rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1))).select("source", "rate", "parts", cdf.alias("cdf"))


def _mixed(docs: DataFrame, weights: Mapping[str, float] | None, size: float, seed: int) -> DataFrame:
    rates = cut_lineage(repetition_rates(docs, weights, size))
    n, most = rates.agg(F.count(F.lit(1)), F.max("parts")).first()
    rates = rates.select(F.col("source").alias("rated"), "parts", "cdf")
    named = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    rows = packed(docs, source=F.col("source"), draw=named)
    rows = rows.join(F.broadcast(rates) if n <= BROADCAST_SOURCES else rates, F.col("source").eqNullSafe(F.col("rated")))
    if (most or 1) > 1:
        # The first part keeps the document's own draw.
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        rows = rows.withColumn("own", F.when(F.col("part") == 0, F.col("draw")).otherwise(F.md5(F.concat_ws("|", "draw", F.lit("part"), F.col("part").cast("string")))))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("bigint")).withColumn("own", F.col("draw"))
    count = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    copies = rows.withColumn("u", _uniform(F.col("own"))).withColumn("n", F.when(F.col("cdf")[0] > 1, 0).otherwise(count)).where("n > 0").select("row", "draw", "part", "n")
    if (most or 1) > 1:
        # Counts are drawn, tables left behind: parts of a document go to many tasks before any copy is made.
        copies = copies.repartition(F.xxhash64("draw", "part"))
    copies = copies.select("row", "draw", "part", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    copies = copies.select("row", "draw", (F.col("part") * STRIDE + F.col("copy")).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", "draw", F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    keyed = copies.select("row", "copy", key.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_report(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """Copies with their columns (doc_id, source, text), number and the key that deals them out."""
    mixed = _mixed(docs, weights, size, seed)
    return mixed.select(*[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")], "copy", "shuffle_key")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled globally, columns unchanged."""
    return unpacked(_mixed(docs, weights, size, seed), docs)
