"""Operators bound to the test tables, their SQL oracles, plan helpers."""

from ledgerflow.plans.explain import plan_text
from ledgerflow.plans.oracle import ORACLE_SQL
from ledgerflow.plans.standins import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "plan_text"]
