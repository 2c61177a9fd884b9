"""Registered queries: each applies operators to the test tables, with its SQL where SQL can express it."""

from quillon.plans import generators, relational, simulation, studies
from quillon.plans.base import ORACLE_SQL as SQL
from quillon.plans.base import QUERIES

__all__ = ["QUERIES", "SQL", "generators", "relational", "simulation", "studies"]
