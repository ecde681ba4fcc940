"""Registered queries by subject; importing this package registers them all."""

from tallybrook.plans import features, files, models, paired, panel, reports, rules, simulated, tables  # noqa: F401
from tallybrook.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
