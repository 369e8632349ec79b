"""ledgerflow: Spark-native analytics and table sync for transactional data.

Every operator takes and returns DataFrames and is built from built-in
DataFrame / Structured Streaming functions, so Catalyst plans it and the
work runs on executors.

Layout:
    functions/  column helpers (money totals, month keys, status labels)
    sources/    table loading, fallback reads, JSON row sink
    operators/  totals, top-k rankings, monthly revenue, sync primitives, status
    streaming/  Structured Streaming sync with a per-batch log
    plans/      the operators bound to the test tables, their SQL oracles,
                and plan-inspection helpers
"""

__version__ = "0.1.0"
