"""Importing this package registers every query."""

from quercus.plans import (  # noqa: F401
    answers,
    columns,
    corpus,
    executions,
    experiments,
    files,
    text,
)
from quercus.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
