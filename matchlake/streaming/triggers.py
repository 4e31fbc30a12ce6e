"""Reactions to arriving data: uploads, live documents, status changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchlake import scratch
from matchlake.operators import docs

UPLOADS = "path string, content_type string, size bigint"


def accepted_uploads(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Uploads(path, content_type, size), of a stream or a table, that pass the gate and whose match waits for one.

    A match that is past uploading is left alone, so that a file reported twice starts nothing twice.
    """
    gated = docs.upload_gate(files).filter("accepted")
    waiting = matches.filter("status = 'uploading'").select(F.col("id").cast("string").alias("match_part"), F.col("user_id").cast("string").alias("user_part"))
    return gated.join(waiting, ["match_part", "user_part"]).select(F.col("match_part").alias("id"), F.col("user_part").alias("user_id"), F.col("path").alias("video_url"), F.lit("processing").alias("status"))


def refused_uploads(files: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, status, error_message) of matches, whatever their status, whose video is larger than an upload may be."""
    large = docs.upload_gate(files).filter("in_place AND is_video AND NOT trigger_size").select(F.col("match_part").alias("large_id")).distinct()
    told = F.lit("Video file exceeds the 500MB limit.")
    return matches.join(large, F.col("id").cast("string") == F.col("large_id"), "left_semi").select(F.col("id").cast("string").alias("id"), F.lit("error").alias("status"), told.alias("error_message"))


def on_upload(spark: SparkSession, folder: str, matches: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of accepted uploads from the manifests (JSON) in a folder to handle."""
    files = spark.readStream.schema(UPLOADS).json(folder)
    return accepted_uploads(files, matches).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_processing(updates: str, audit: str) -> Callable[[DataFrame, int], None]:
    """A handler of accepted uploads that writes the new state of each match and a row for the audit log.

    Each batch has a folder of its own, so that one that is run again after a failure replaces what it wrote.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")
        batch.select("id", "user_id", F.lit("processing_started").alias("action"), F.col("video_url").alias("detail")).write.mode("overwrite").parquet(f"{audit}/batch={number}")
        batch.unpersist()

    return handle


def live_documents(changes: DataFrame) -> DataFrame:
    """The last state of each document of a stream of changes(id, at, status); for update mode."""
    return changes.groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def transitions(changes: DataFrame, to: str) -> DataFrame:
    """Changes(id, at, status) of a stream by which a document comes to a status, with the one before: id, at, was.

    The last status of each document is kept as state, so that a change is told whatever batch it comes in. Changes of
    a batch are taken by their time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at")
        was = rows["status"].shift()
        was.iloc[0] = state.get[0] if state.exists else None
        state.update((rows["status"].iloc[-1],))
        came = (rows["status"] == to) & was.notna() & (was != to)
        yield rows.assign(was=was, id=key[0])[came][["id", "at", "was"]]

    return changes.groupBy("id").applyInPandasWithState(step, "id long, at long, was string", "status string", "append", GroupStateTimeout.NoTimeout)


def frame_states(frames: DataFrame, gap: int) -> DataFrame:
    """A stream of ball frames(match_id, frame_seq, owner, x, y, near) with what came before: prev_owner, step, corner.

    Owner and ball of a match's last frame and the frame of its last corner are the state, so that a match may come in
    any number of batches, its frames in their order. A corner is an owned near frame more than gap frames after the
    last corner. The first frame of a match has no step.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame_seq")
        owner, x, y, corner = state.get if state.exists else (None, None, None, None)
        before = rows[["owner", "x", "y"]].shift()
        before.iloc[0] = [owner, x, y]
        moved = ((rows["x"] - before["x"].astype("float64")) ** 2 + (rows["y"] - before["y"].astype("float64")) ** 2) ** 0.5
        taken = []
        for seq in rows["frame_seq"][rows["near"] & rows["owner"].notna()]:
            if corner is None or seq - corner > gap:
                corner = int(seq)
                taken.append(corner)
        last = rows.iloc[-1]
        state.update((last["owner"], float(last["x"]), float(last["y"]), corner))
        yield pd.DataFrame({"match_id": key[0], "frame_seq": rows["frame_seq"], "prev_owner": before["owner"], "step": moved, "corner": rows["frame_seq"].isin(taken)})

    return frames.groupBy("match_id").applyInPandasWithState(
        step, "match_id long, frame_seq long, prev_owner string, step double, corner boolean", "owner string, x double, y double, corner long", "append", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that has arrived and read the rows that it gave."""
    spark = stream.sparkSession
    out, marks = scratch.folder(spark, "stream-out"), scratch.folder(spark, "stream-marks")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drained_updates(stream: DataFrame, key: str) -> DataFrame:
    """Run an aggregation over all that has arrived, in update mode, and read the newest row of each key.

    Batches write what changed in them, each into a folder of its own; the newest batch of a key counts.
    """
    spark, columns = stream.sparkSession, stream.columns
    out, marks = scratch.folder(spark, "stream-out"), scratch.folder(spark, "stream-marks")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in columns if c != key])
