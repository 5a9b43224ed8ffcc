"""A study on disk: a wide table of answers and a JSON catalogue of its variables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.filters import Study

#: What a card of the catalogue must have, and the kinds of answers there are.
REQUIRED = ("id", "label", "block_id", "answer_type", "values", "ordered_values", "flags", "denominator_rule")
KINDS = ("select_all", "single", "ordered_scale", "rank")
CARD = "study_id string, ordinal int, id string, label string, block_id string, answer_type string, values array<string>, ordered_values array<string>, unranked_values array<string>, flags array<string>, denominator_rule string"


def card_faults(card: dict, columns: list[str]) -> list[str]:
    """Why a card can't be used, if it can't."""
    if missing := [k for k in REQUIRED if k not in card]:
        return [f"InvalidMetadata: no {k}" for k in missing]
    out = [f"InvalidMetadata: empty {k}" for k in ("id", "label", "block_id", "denominator_rule") if not card[k]]
    if card["id"] not in columns:
        out.append(f"MissingColumn: {card['id']}")
    if card["answer_type"] not in KINDS:
        out.append(f"InvalidMetadata: answers of {card['id']}")
    ordered = card["ordered_values"] or []
    if card["answer_type"] == "ordered_scale" and not ordered or len(set(ordered)) != len(ordered) or not set(ordered) <= set(card["values"]):
        out.append(f"InvalidMetadata: order of {card['id']}")
    unranked = card.get("unranked_values") or []
    if not set(unranked) <= set(card["values"]) or set(unranked) & set(ordered) or len(set(unranked)) != len(unranked):
        out.append(f"InvalidMetadata: unranked answers of {card['id']}")
    return out


def catalogue(spark: SparkSession, metadata: dict) -> DataFrame:
    """One row for each card of the metadata."""
    rows = [(metadata["study"].get("id"), i, *[c.get(k) for k in ("id", "label", "block_id", "answer_type", "values", "ordered_values", "unranked_values", "flags", "denominator_rule")]) for i, c in enumerate(metadata["variables"])]
    return spark.createDataFrame(rows, CARD)


def study_of(metadata: dict) -> Study:
    """The blocks, scales and values that the cards describe."""
    blocks: dict[str, list[str]] = {}
    for c in metadata["variables"]:
        if c["answer_type"] == "select_all":
            blocks.setdefault(c["block_id"], []).append(c["id"])
    scales = {c["id"]: c["ordered_values"] for c in metadata["variables"] if c["ordered_values"]}
    return Study(blocks, scales, {c["id"]: c["values"] for c in metadata["variables"] if c["answer_type"] != "select_all"})


def load_study(spark: SparkSession, answers: str, metadata: str, key: str = "respondent_id") -> tuple[DataFrame, DataFrame, Study]:
    """(answers, catalogue, study) from a Parquet folder and a JSON file; ValueError names the first fault.

    Only the columns of cards and the key are read; text answers lose white space around them. The key must be unique.
    """
    # a catalogue is one small file
    found = json.loads("\n".join(r.value for r in spark.read.text(metadata).collect()))
    if not isinstance(found.get("hash"), str) or not isinstance(found.get("study"), dict) or not isinstance(found.get("variables"), list):
        raise ValueError("InvalidMetadata: hash, study and variables are needed")
    df = spark.read.parquet(answers)
    ids = [c.get("id") for c in found["variables"]]
    faults = [x for c in found["variables"] for x in card_faults(c, df.columns)] + [f"InvalidMetadata: repeated {i}" for i in ids if ids.count(i) > 1]
    if faults:
        raise ValueError(faults[0])
    boxes = {c["id"] for c in found["variables"] if c["answer_type"] == "select_all"}
    if odd := [c for c, t in df.dtypes if c in boxes and t != "boolean"]:
        raise ValueError(f"InvalidData: {odd[0]} has other answers than ticks")
    kept = df.select(key, *[F.trim(c).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in ids])
    if not kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("InvalidData: the key isn't unique")
    return kept, catalogue(spark, found), study_of(found)
