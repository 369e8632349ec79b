"""Operators: totals, rankings, monthly revenue, sync primitives and their log, keyed targets, bound statements, status."""

from ledgerflow.operators.keyed_table import KeyedTable
from ledgerflow.operators.rankings import top_customers, top_items
from ledgerflow.operators.revenue import (
    month_digests,
    monthly_revenue,
    monthly_revenue_partitioned,
    read_month_partitioned,
    refresh_month_partitioned,
    write_month_partitioned,
)
from ledgerflow.operators.statements import batch_statement, statement
from ledgerflow.operators.status import count_side, ha_status, nest_status, sync_status, with_availability
from ledgerflow.operators.sync import (
    InsertResult,
    batch_edges,
    first_per_key,
    high_watermark,
    high_watermark_value,
    incremental_batch,
    insert_if_absent,
    logged_insert,
    run_sync,
    sync_cycle,
)
from ledgerflow.operators.sync_log import CycleResult, compact_log, read_failures, read_log
from ledgerflow.operators.topk import top_k
from ledgerflow.operators.totals import count_of, money_total_of, overview_totals

__all__ = [
    "top_customers",
    "top_items",
    "monthly_revenue",
    "monthly_revenue_partitioned",
    "month_digests",
    "read_month_partitioned",
    "refresh_month_partitioned",
    "write_month_partitioned",
    "batch_statement",
    "statement",
    "count_side",
    "ha_status",
    "nest_status",
    "sync_status",
    "with_availability",
    "CycleResult",
    "KeyedTable",
    "batch_edges",
    "compact_log",
    "read_failures",
    "InsertResult",
    "first_per_key",
    "high_watermark",
    "high_watermark_value",
    "incremental_batch",
    "insert_if_absent",
    "logged_insert",
    "read_log",
    "run_sync",
    "sync_cycle",
    "top_k",
    "count_of",
    "money_total_of",
    "overview_totals",
]
