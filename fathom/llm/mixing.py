"""Operator 6: choose documents so that the sources' tokens meet target weights.

Every document has a fixed place in [0, 2**60) from a hash of its doc_id. A source's sample is all
documents up to a threshold, so a larger budget's sample contains a smaller one's. Thresholds come from
histograms: tokens summed by source and by the hash's leading bits show the bucket in which the budget is
reached; only that bucket is summed again by the next bits, until single hash values are told apart.
Then one filter against the thresholds makes the sample. Nothing is sorted and no document is shuffled:
what moves is at most 2**BITS sums a source and round, and then one threshold a source.

A token here is a run of characters other than blank, tab, carriage return and line feed.

Defined results: a null source is a source of its own; a null doc_id is hashed as ''; documents with the
same doc_id share a place and go or stay together; a null text has no tokens and follows its place.
Sources without a weight get none of the budget and no rows. Without a total, the total is the largest at
which every weighted source that is present can meet its share; a source without tokens doesn't bind.
An empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.llm.scratch import cut

BITS, LEVELS = 12, 5  # 60 bits in all
WEIGHTS = {f"src{i}": (6.0 if i == 0 else 1.0) for i in range(20)}


def place(doc_id: Column) -> Column:
    """60 leading bits of the md5 of the doc_id's decimal form."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def thresholds(docs: DataFrame, weights: dict[str, float], total: int | None = None) -> DataFrame:
    """(source, budget, last): the place up to which each weighted source is taken, -1 for none of it."""
    spark = docs.sparkSession
    sums = cut(docs.select(F.col("source").cast("string").alias("source"), place(F.col("doc_id")).alias("place"), words(F.col("text")).alias("tokens")), "places")
    share = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
    # One row a source of the mixture, here and below.
    have = {r[0]: r[1] for r in sums.join(F.broadcast(share.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left_semi").groupBy("source").agg(F.sum("tokens")).collect()}
    if not have:
        return spark.createDataFrame([], "source string, budget double, last long")
    whole = sum(weights[s] for s in have)
    if total is None:
        total = min((have[s] * whole / weights[s] for s in have if have[s] and weights[s] > 0), default=0)
    # Of each source: its budget, the tokens taken so far, the first place still open, and whether all of it fits.
    state = {s: (math.floor(total * weights[s] / whole + 1e-6), 0, 0, False) for s in have}
    shape = "s string, budget double, taken long, low long, fits boolean"
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        now = spark.createDataFrame([(s, float(b), t, low, fits) for s, (b, t, low, fits) in state.items()], shape)
        opened = F.col("source").eqNullSafe(F.col("s")) & ~F.col("fits") & (F.col("place") >= F.col("low")) & (F.col("place") - F.col("low") < F.lit(width << BITS))
        bucket = F.expr(f"(place - low) div {width}")
        buckets = sums.join(F.broadcast(now), opened).groupBy("s", "budget", "taken", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))
        reached = F.col("taken") + F.sum("n").over(W.partitionBy("s").orderBy("bucket"))
        met = buckets.withColumn("reached", reached).groupBy("s").agg(F.min(F.expr("if(reached > budget, bucket, null)")).alias("at"), F.max(F.expr("if(reached <= budget, reached, null)")).alias("taken"))
        found = {r["s"]: (r["at"], r["taken"]) for r in met.collect()}
        for s, (budget, taken, low, fits) in state.items():
            if not fits:
                at, got = found.get(s, (None, None))
                state[s] = (budget, taken if got is None else got, low + (width << BITS if at is None else at * width), at is None)
    return spark.createDataFrame([(s, float(b), low - 1) for s, (b, _, low, _) in state.items()], "source string, budget double, last long")


def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, total: int | None = None) -> DataFrame:
    """The rows of docs whose place is within their source's threshold."""
    last = thresholds(docs, weights, total).select(F.col("source").alias("__fathom_source"), F.col("last").alias("__fathom_last"))
    inside = docs["source"].cast("string").eqNullSafe(F.col("__fathom_source")) & (place(docs["doc_id"]) <= F.col("__fathom_last"))
    return docs.join(F.broadcast(last), inside, "left_semi")
