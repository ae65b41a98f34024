"""Transcripts to features of turns and summaries of conversations, as new transcript files arrive.

    python jobs/transcripts.py SOURCE OUT [--config jobs/transcripts.json]

SOURCE is a folder of Parquet files of turns (conv_id, turn, role, text), or one file or a pattern; new files join it, and files once
there don't change. A run takes the files that Spark's file stream hasn't taken yet, by its checkpoint in OUT/checkpoint, and ends when there are none left. It writes

    OUT/turns/part=P/batch=B             each turn with its features
    OUT/conversations/part=P             a row for each conversation

P is conv_id divided by `conversations_per_part`, B the number of the stream's batch. A batch writes its turns, then makes anew
the conversations of the parts that it touched, from all their turns; other parts are neither read nor written. Conversations
whose ids rise with time thus cost what is new. A batch that is run again after a failure writes the same partitions again, so
each turn counts once. Turns sent again (same conv_id and turn) replace the earlier ones; turns without conv_id are left out.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadspark.operators import text

SETTINGS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "transcripts.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LABELS = ("entailment", "contradiction", "neutral")
log = logging.getLogger("jobs.transcripts")


def turn_features(turns: DataFrame) -> DataFrame:
    """Each turn with its numbers of letters, words and sentences and whether it asks; null texts count as empty."""
    own = F.coalesce(F.col("text"), F.lit(""))
    return turns.select("*", *text.text_counts(own), F.contains(own, F.lit("?")).alias("asks"))


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: its statistics, its letters and questions, and how each turn follows from the one before."""
    latest = turns.groupBy("conv_id", "turn").agg(F.max(F.struct("batch", "role", "text", "n_chars", "asks")).alias("t"))
    own = latest.select("conv_id", "turn", "t.role", F.coalesce("t.text", F.lit("")).alias("text"), "t.n_chars", "t.asks")
    stats = text.conversation_stats(own, "conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    label = F.when(before.isNotNull(), text.inference_label(before, F.col("text")))
    counts = [F.count_if(F.col("label") == k).alias(f"n_{k}") for k in LABELS]
    follow = own.withColumn("label", label).groupBy("conv_id").agg(F.sum("n_chars").alias("n_chars"), F.count_if("asks").alias("n_questions"), *counts)
    return stats.join(follow, "conv_id")


def _write(df: DataFrame, path: str, *parts: str) -> None:
    """Only the partitions that df has change. Spark evens out the files: small partitions share tasks, large ones are split."""
    df.hint("rebalance", parts[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def run(spark: SparkSession, source: str, out: str, settings: dict) -> dict[str, int]:
    """Takes what is new in source into out. Gives the numbers of batches, turns read and conversations written."""
    turns_path, conversations_path = f"{out}/turns", f"{out}/conversations"
    size = int(settings["conversations_per_part"])
    done = {"batches": 0, "turns": 0, "conversations": 0}

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        rows = rows.where("conv_id IS NOT NULL").withColumn("part", F.floor(F.col("conv_id") / size)).withColumn("batch", F.lit(number))
        _write(turn_features(rows), turns_path, "part", "batch")
        turns = own.read.parquet(turns_path)
        fresh = turns.where(F.col("batch") == number).groupBy("part").count().collect()  # a row a partition
        if not fresh:
            return
        touched = turns.where(F.col("part").isin([r["part"] for r in fresh]))
        _write(conversations(touched).withColumn("part", F.floor(F.col("conv_id") / size)), conversations_path, "part")
        written = own.read.parquet(conversations_path).where(F.col("part").isin([r["part"] for r in fresh])).count()
        done.update(batches=done["batches"] + 1, turns=done["turns"] + sum(r["count"] for r in fresh), conversations=done["conversations"] + written)
        log.info("batch %d: %d turns of %s in %d parts to %s; %d conversations to %s", number, sum(r["count"] for r in fresh), source, len(fresh), turns_path, written, conversations_path)

    # as a pattern, for a file stream takes a plain path for a folder, and SOURCE may be one file
    pattern = source if set(source) & set("*?[{") else f"{source[:-1]}[{source[-1]}]"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(pattern)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d new turns in %d batches", source, done["turns"], done["batches"])
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    """All conversations as they stand."""
    return spark.read.parquet(f"{out}/conversations").drop("part")


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--config", default=SETTINGS)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.config) as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName("transcripts").getOrCreate()
    try:
        run(spark, given.source.rstrip("/"), given.out.rstrip("/"), settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
