"""What the text operators share: the scratch folder, words, and the hot-key safe look-up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D. A fixed value of the query contracts.
SPACES = "[ \\x09-\\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. On one machine (tests) a new local one where it is unset.

    Tables stay there until whoever set the folder clears it, as lost executors may need them while the result is read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df to the scratch folder and reads it back: the lineage ends there, and Spark knows its real size."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column of distinct numbers, one for each row; written out, so that a row keeps its number."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank text."""
    text = F.coalesce(text, F.lit(""))
    # a literal space splits without a regular expression
    return F.filter(F.when(text.rlike("[\\x09-\\x0D]"), F.split(text, SPACES)).otherwise(F.split(text, " ")), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, however often the lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
