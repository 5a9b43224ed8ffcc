"""All registered queries, by the table they are about."""

from . import cases, catalogues, claims, curriculum, details, estimation, inference, meaning, outcomes, packages, reviews, written  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
