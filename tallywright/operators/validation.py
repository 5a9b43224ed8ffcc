"""Rules that rows must keep before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(asks: DataFrame, column: str, cards: DataFrame) -> DataFrame:
    """asks with the card of the id in a column, and an error where the catalogue has none; ids are matched exactly.

    cards is a catalogue: it is broadcast.
    """
    known = F.broadcast(cards.withColumnRenamed("id", column))
    return asks.join(known, column, "left").withColumn("error", F.when(F.col("label").isNull(), "UnknownVariable").otherwise(""))


def sample_faults(rows: DataFrame, sample: str, values: list[str], least: int) -> DataFrame:
    """(sample, error, n): whether each sample has only finite values, as many of each column, and least rows or more."""
    odd = None
    for v in values:
        bad = F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        odd = bad if odd is None else odd | bad
    each = rows.groupBy(sample).agg(F.count_if(odd).alias("odd"), F.count(F.lit(1)).alias("n"))
    return each.select(sample, F.when(F.col("odd") > 0, "NotFinite").when(F.col("n") < least, "TooFew").otherwise("").alias("error"), "n")
