"""Streams of results: each finished one once, tallies, and a ledger of requests; runs resume where the last one ended."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tallywright.sources.files import shared_folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what its sink has."""
    spark = stream.sparkSession
    out, log = shared_folder(spark, name), shared_folder(spark, f"{name}-log")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch:06d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.withColumn("epoch", F.lit(0)).schema).parquet(out)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB: only the keys of a batch are read and written, and the checkpoint gets what changed."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def commit(batch: DataFrame, folder: str, epoch: int) -> None:
    """One epoch is one folder, so a batch that is repeated after a failure takes its own place again."""
    batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def committed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(StructType(list(schema)).add("epoch", "long")).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType(list(schema)).add("epoch", "long"))


def resume(stream: DataFrame, home: str, mode: str) -> DataFrame:
    """Runs a stream from where the last run with this home ended, to the end of what is there; gives all rows and their epochs.

    home holds the checkpoint (log: offsets, state) and the rows. A run that is killed in a batch repeats only that batch,
    with the state before it. Files that were read in a committed batch are not read again.
    """
    spark = stream.sparkSession
    with keyed_state(spark):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").foreachBatch(lambda batch, epoch: commit(batch, f"{home}/rows", epoch)).trigger(availableNow=True).start()
        q.awaitTermination()
    return committed(spark, f"{home}/rows", stream.schema)


def append_once(stream: DataFrame, key: str, home: str) -> DataFrame:
    """Runs a stream over all that is there; each key gets in once, however late its repeats come and however often a run is killed.

    The keys seen are the state: a row of state for each, looked up for the keys of a batch only. So neither the rows that are
    written nor the source are read again, and no watermark drops a late key. A null key is a key.
    """
    return resume(stream.dropDuplicates([key]), home, "append")


class Requests(StatefulProcessor):
    """The first fingerprint of a request stays; entries with another are refused. One row of state for each request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "print string, value double, ts long, place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        seen: dict[str, list] = {}  # by fingerprint: first and last place, value at the last, rows
        for batch in rows:
            for x, value, ts, place in zip(batch["print"], batch["value"], batch["ts"], batch["place"], strict=True):
                at = (int(ts), int(place))
                old = seen.setdefault(x, [at, at, value, 0])
                old[0] = min(old[0], at)
                if at >= old[1]:
                    old[1:3] = [at, value]
                old[3] += 1
        held = self.entry.get() if self.entry.exists() else None
        first = held[0] if held else min(seen, key=lambda x: seen[x][0])
        out = []
        if first in seen:
            _, at, value, n = seen[first]
            if held and (held[2], held[3]) > at:
                value, at = held[1], (held[2], held[3])
            self.entry.update((first, None if pd.isna(value) else float(value), *at))
            out.append(("entry", first, value, *at, n))
        out += [("refused", x, value, *at, n) for x, (_, at, value, n) in sorted(seen.items()) if x != first]
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["request", "kind", "print", "value", "ts", "place", "n"])

    def close(self) -> None:
        pass


def stream_ledger(stream: DataFrame, request: str, ts: str, fingerprint: str, order: str, home: str) -> DataFrame:
    """Runs a ledger of requests over all that is there, from where the last run with this home ended; gives its rows.

    A row for each request and batch that has it: kind "entry" with the fingerprint that the request began with, its latest value by
    (ts, order), and how many entries the batch had; and a row of kind "refused" for each other fingerprint of the batch, which changes nothing. The
    first fingerprint is that of the least (ts, order) in the first batch. Null time comes first, a null fingerprint is "".
    """
    kind = dict(stream.dtypes)[request]
    rows = stream.select(F.col(request).alias("request"), F.coalesce(F.col(fingerprint).cast("string"), F.lit("")).alias("print"), F.col("value").cast("double").alias("value"), F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(1 << 62))).alias("ts"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("place"))
    return resume(rows.groupBy("request").transformWithStateInPandas(Requests(), f"request {kind}, kind string, print string, value double, ts long, place long, n long", "Update", "None"), home, "update")


def entries(ledger: DataFrame) -> DataFrame:
    """(request, print, value, accepted, refused): what a ledger says of each request now."""
    mine = F.col("kind") == "entry"
    return ledger.groupBy("request").agg(F.max_by(F.when(mine, F.col("print")), F.when(mine, F.col("epoch"))).alias("print"), F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("epoch"))).alias("value"), F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.when(~mine, F.col("n"))), F.lit(0)).alias("refused"))


def tallies(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums for each window and outcome."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def ledger(rows: DataFrame, request: str, ts: str, fingerprint: str) -> DataFrame:
    """One row per request: its latest value, and whether its fingerprint ever changed."""
    return rows.groupBy(request).agg(F.max_by("value", F.struct(ts, "event_id")).alias("value"), (F.count_distinct(fingerprint) > 1).alias("changed"))
