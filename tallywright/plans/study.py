"""A study over the order tables: respondents are orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.filters import Study

from .registry import table

ORDERS = Study(
    blocks={"returns": ["ret_a", "ret_n", "ret_r"]},
    scales={"priority": ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]},
    values={
        "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "status": ["F", "O", "P"],
        "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "balance": ["low", "middle", "high", "Prefer not to say"],
    },
)

#: The same view for DuckDB.
SQL = """
WITH r AS (
  SELECT o_orderkey AS respondent_id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, r_name AS region,
         CASE WHEN c_acctbal < 0 THEN 'Prefer not to say' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'middle' WHEN c_acctbal >= 7000 THEN 'high' END AS balance,
         ret_a, ret_n, ret_r
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN true END AS ret_a, CASE WHEN bool_or(l_returnflag = 'N') THEN true END AS ret_n,
                    CASE WHEN bool_or(l_returnflag = 'R') THEN true END AS ret_r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; the lines give a checkbox block (true or null), and a negative balance is a refusal."""
    t = lambda n: table(spark, sf_dir, n)
    flag = lambda x: F.when(F.bool_or(F.col("l_returnflag") == x), True).alias(f"ret_{x.lower()}")
    lines = t("lineitem").groupBy("l_orderkey").agg(*map(flag, "ANR"))
    balance = F.when(F.col("c_acctbal") < 0, "Prefer not to say").when(F.col("c_acctbal") < 3000, "low").when(F.col("c_acctbal") < 7000, "middle").when(F.col("c_acctbal") >= 7000, "high")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    who = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("respondent_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), balance.alias("balance"), "ret_a", "ret_n", "ret_r")
