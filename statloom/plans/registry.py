"""Every registered query of the statistics operators, with its SQL twin where SQL can express it."""

from __future__ import annotations

from statloom.plans import descriptive, later, models, shapes
from statloom.plans.define import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "descriptive", "later", "models", "shapes"]
