"""Filters: a mask and the universe it was observed in, as columns of one respondents table."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.stats import REFUSAL


class Filter:
    """A mask within an observed universe. Both are never null; combining narrows the universe to what both observed."""

    def __init__(self, mask: Column, universe: Column):
        self.universe = F.coalesce(universe, F.lit(False))
        self.mask = F.coalesce(mask, F.lit(False)) & self.universe

    def __invert__(self) -> Filter:
        return Filter(~self.mask, self.universe)

    def __and__(self, other: Filter) -> Filter:
        return Filter(self.mask & other.mask, self.universe & other.universe)

    def __or__(self, other: Filter) -> Filter:
        """In either mask, among those of whom both sides are known."""
        return Filter(self.mask | other.mask, self.universe & other.universe)


class Study:
    """Which columns answer what: blocks of checkbox columns, ordered scales, and single-choice columns."""

    def __init__(self, blocks: dict[str, list[str]], scales: dict[str, list[str]], values: dict[str, list[str]]):
        self.blocks, self.scales, self.values = blocks, scales, values
        self.block_of = {c: b for b, cs in blocks.items() for c in cs}

    def base(self, v: str) -> Column:
        """The observed base: any sibling of the block answered, or an answer that isn't a refusal."""
        if v in self.block_of:
            return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in self.blocks[self.block_of[v]]])
        return F.col(v).isNotNull() & (F.col(v) != REFUSAL)

    def eligible(self, v: str) -> Filter:
        return Filter(self.base(v), F.lit(True))

    def where(self, v: str, values: list) -> Filter:
        known = [True, False] if v in self.block_of else self.values[v]
        if bad := [x for x in values if x not in known or x == REFUSAL]:
            raise ValueError(f"UnknownValue: {v} has no {bad}")
        match = (F.coalesce(F.col(v), F.lit(False)) == values[0]) if v in self.block_of else F.col(v).isin(values)
        return Filter(match, self.base(v))

    def ordered_base(self, v: str) -> Column:
        """The base of an ordered statistic: a ranked answer."""
        return self.base(v) & F.col(v).isin(self.scales[v])

    def tree(self, spec: str | dict) -> Filter:
        """A filter from a JSON tree of eq, eligible, not, and, or."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        (op, arg), *more = spec.items()
        if more:
            raise ValueError("FilterShape: one operation for each node")
        if op == "eq":
            return self.where(arg["variable"], [arg["value"]])
        if op == "eligible":
            return self.eligible(arg)
        if op == "not":
            return ~self.tree(arg)
        if op in ("and", "or"):
            return reduce(Filter.__and__ if op == "and" else Filter.__or__, [self.tree(x) for x in arg])
        raise ValueError(f"FilterShape: {op}")

    def groups(self, v: str, mapping: dict[str, list] | None = None) -> dict[str, Filter]:
        """Labelled groups of one variable; by default every answer but the refusal."""
        mapping = mapping or {x: [x] for x in self.values[v] if x != REFUSAL}
        taken = [x for xs in mapping.values() for x in xs]
        if len(taken) != len(set(taken)) or len(mapping) < 2:
            raise ValueError("GroupsOverlap: groups need two labels or more and different values")
        return {label: self.where(v, xs) for label, xs in mapping.items()}

    def subset(self, df: DataFrame, key: str, variables: list[str]) -> DataFrame:
        """The chosen variables and every sibling of a chosen checkbox, so that no base changes."""
        blocks = {self.block_of[v] for v in variables if v in self.block_of}
        return df.select(key, *[c for c in df.columns if c != key and (c in variables or self.block_of.get(c) in blocks)])
