"""Sessions: turns whose query may lean on the last answered one.

A turn's context depends on the results of the turn before it, so all conversations advance together, a turn
a round: each round is one batch search. Rounds are as many as the longest conversation has turns, whatever
the number of conversations, and a round touches only the conversations that still go on. A search over
stored postings (rank.postings) tokenises the knowledge table once for all rounds.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.functions.chunking import passage
from fathom.functions.text import is_follow_up
from fathom.operators.answer import REFUSAL, answers, first_acceptable
from fathom.plans.shared import materialise, remove

MEMORY = "conv_id long, context string"
CLEAR = ("clear", ":clear")


def searched(context: Column, text: Column) -> Column:
    """What is searched for: a follow-up with the context before it."""
    return F.when(context.isNotNull() & is_follow_up(text), F.concat_ws(" ", context, text)).otherwise(text)


def remembered(text: Column) -> Column:
    """The context that an answered turn leaves: its text and the result's title, tags and matched terms."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" ", part(text), part(F.col("title")), part(F.array_join("tags", " ")), part(F.array_join("matched_terms", " ")))


def session_turns(turns: DataFrame, search: Callable[[DataFrame], DataFrame], memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, searched, accepted, path, passage) of each turn (conv_id, turn, text), and the memory after them.

    search takes (qid, query) and returns ranked results, with passages or without: then only the accepted ones get theirs. Turns with a null conv_id or text are left out.
    """
    spark = turns.sparkSession
    order, whole = W.partitionBy("conv_id").orderBy("turn", "text"), W.partitionBy("conv_id")
    numbered = turns.filter("conv_id is not null and text is not null").select("conv_id", "turn", "text", F.row_number().over(order).alias("round"), F.count("*").over(whole).alias("last"))
    numbered = materialise(numbered, "turns")
    before = memory if memory is not None else spark.createDataFrame([], MEMORY)
    rounds = numbered.agg(F.max("round")).first()[0] or 0
    done, finished = [], [before.join(numbered.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "context")]
    now_known = before
    for k in range(1, rounds + 1):
        now = numbered.filter(F.col("round") == k).join(now_known, "conv_id", "left")
        asked = materialise(now.select("conv_id", "turn", "text", "last", "context", searched(F.col("context"), F.col("text")).alias("searched")), "asked")
        best = first_acceptable(search(asked.select(F.col("conv_id").alias("qid"), F.col("searched").alias("query")))).withColumnRenamed("qid", "conv_id")
        if "passage" not in best.columns:
            best = best.withColumn("passage", passage(F.coalesce("body", F.lit("")), F.col("query")))
        after = asked.join(best.select("conv_id", "path", "passage", "title", "tags", "matched_terms"), "conv_id", "left")
        after = materialise(after.select("conv_id", "turn", "last", "searched", "path", "passage", F.when(F.col("path").isNotNull(), remembered(F.col("text"))).otherwise(F.col("context")).alias("context")), "after")
        done.append(after.select("conv_id", "turn", "searched", F.col("path").isNotNull().alias("accepted"), "path", F.coalesce("passage", F.lit(REFUSAL)).alias("passage")))
        known = after.filter("context is not null")
        finished.append(known.filter(F.col("last") == k).select("conv_id", "context"))
        now_known = known.filter(F.col("last") > k).select("conv_id", "context")
    if not done:
        return spark.createDataFrame([], "conv_id long, turn long, searched string, accepted boolean, path string, passage string"), before
    out, kept = done[0], finished[0]
    for more in done[1:]:
        out = out.unionByName(more)
    for more in finished[1:]:
        kept = kept.unionByName(more)
    return out, kept


def run_sessions(stream: DataFrame, search: Callable[[DataFrame], DataFrame], output: str, checkpoint: str):
    """A streaming query (conv_id, turn, text) -> output; memory is kept as a table a batch, so a batch that is run again gives the same rows.

    output and checkpoint are folders that all executors share. Two batches' memories are kept.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = f"{checkpoint}/memory"
        before = spark.read.schema(MEMORY).parquet(f"{kept}/{number - 1}") if number else None
        rows, memory = session_turns(batch, search, before)
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")
        memory.write.mode("overwrite").parquet(f"{kept}/{number}")
        if number > 1:
            with contextlib.suppress(Exception):  # what is left is only space
                remove(spark, f"{kept}/{number - 2}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


class Session:
    """One conversation at a console or page: its memory is a string on the driver."""

    def __init__(self, engine, top_k: int = 3):
        self.engine, self.top_k, self.context = engine, top_k, None

    def clear(self) -> None:
        self.context = None

    def search(self, query: str) -> tuple[DataFrame, DataFrame]:
        """The turn as a query table, and its results; an acceptable one is remembered."""
        spark = self.engine.kb.sparkSession
        turn = spark.createDataFrame([(0, query, self.context)], "qid long, said string, context string")
        asked = turn.select("qid", searched(F.col("context"), F.col("said")).alias("query"))
        results = materialise(self.engine.search(asked, self.top_k), "results")
        found = first_acceptable(results).select(remembered(F.lit(query))).first()
        self.context = found[0] if found else self.context
        return asked, results

    def answer(self, query: str) -> str:
        return answers(*self.search(query)).first()["answer"]

    def passage(self, query: str) -> str:
        """The passage alone, or the refusal."""
        found = first_acceptable(self.search(query)[1]).select("passage").first()
        return found[0] if found else REFUSAL
