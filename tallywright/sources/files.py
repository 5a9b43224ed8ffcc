"""Readers and writers of packages: JSON lines, CSV, partitioned exports, manifests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on one machine (tests) a local one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again, so that what follows doesn't repeat it and knows its size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with blank lines skipped; no file gives no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_torn(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines whose last line may be cut off: it is dropped; any other bad line fails."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")).where(F.trim("value") != "")
    last = rows.groupBy("file").agg(F.max("pos").alias("last"))
    parsed = rows.join(last, "file").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("whole", F.trim("value").endswith("}"))
    bad = ~F.col("whole") & (F.col("pos") < F.col("last"))
    return parsed.withColumn("row", F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))).otherwise(F.col("row"))).where("whole").select("row.*")


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; not-a-number is an error. by: folders to deal rows into."""
    for c, t in df.dtypes:
        if t in ("double", "float"):
            df = df.withColumn(c, F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}"))).otherwise(F.col(c)))
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of all data files below a folder; the name is the path from there, as files of different folders may be named alike."""
    root = re.sub("^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", re.escape(root), 2), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest."""
    now = manifest(spark, path).withColumnRenamed("sha256", "now")
    return now.join(expected, "name", "full_outer").where(~F.col("now").eqNullSafe(F.col("sha256")))


def publish(df: DataFrame, path: str, faults: DataFrame) -> bool:
    """Writes to a staging folder and renames it, if there is no fault and nothing at path; never overwrites."""
    spark = df.sparkSession
    if not faults.isEmpty():
        return False
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(at) and fs.rename(jvm.org.apache.hadoop.fs.Path(staging), at)
