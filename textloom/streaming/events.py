"""Event streams: the same transformations serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling window and type; `late` sets the watermark of a stream."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("window_start"), "event_type", "n", "v")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def annotate_stream(lines: DataFrame, annotators, column: str = "value") -> DataFrame:
    """A line-at-a-time annotation service: applies a resolved chain of annotators to a stream of lines."""
    out = lines.withColumnRenamed(column, "text")
    for a in annotators:
        out = a.transform(out)
    return out


def incremental_vocabulary(batch: DataFrame, batch_id: int, state: str) -> None:
    """For foreachBatch: adds the batch's word counts to a table; replaying a batch changes nothing."""
    from textloom.operators.statistics import counts
    from textloom.operators.tokens import tokens

    batch = batch.withColumn("doc_id", F.monotonically_increasing_id()) if "doc_id" not in batch.columns else batch
    counts(tokens(batch)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")


def vocabulary_so_far(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(state).groupBy("term").agg(F.sum("n").alias("n"))


def stream_entities(mentions: DataFrame, doc: str = "doc_id", name: str = "string") -> DataFrame:
    """(name, doc_id, entity, seen): cross-document coreference over a stream of mentions. State is kept for each lower-cased name: the
    first document that had it, whose id is the entity, and how many mentions there were so far. Within a micro-batch documents go by id."""
    import pandas as pd

    kind = mentions.schema[doc].dataType.simpleString()

    def update(key, batches, state):
        first, seen = state.get if state.exists else (None, 0)
        rows = sorted(d for pdf in batches for d in pdf[doc])
        out = []
        for d in rows:
            first = int(d) if first is None else first
            seen += 1
            out.append((key[0], d, first, seen))
        state.update((first, seen))
        yield pd.DataFrame(out, columns=["name", doc, "entity", "seen"])

    keyed = mentions.select(F.lower(name).alias("name"), doc).where("name is not null")
    return keyed.groupBy("name").applyInPandasWithState(update, f"name string, {doc} {kind}, entity long, seen long", "entity long, seen long", "append", "NoTimeout")
