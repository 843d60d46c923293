"""All registered queries."""

from checks import classes, convert, detection, episodes, geometry, metrics, mixing, prompts, sources  # noqa: F401
from checks.base import OPERATORS, ORACLES, QUERIES

__all__ = ["OPERATORS", "ORACLES", "QUERIES"]
