"""Declared schemas of the tables the operators read.

``TABLES`` holds the test tables (TPC-H-like star schema plus an event
feed); the README says which of them plays which role of the transactional
model the operators were written for.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


TABLES: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", _I), ("r_name", _S)),
    "nation": _struct(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _struct(
        ("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)
    ),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _struct(
        ("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I), ("p_retailprice", _D)
    ),
    "orders": _struct(
        ("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
        ("o_orderdate", _TS), ("o_orderpriority", _S),
    ),
    "lineitem": _struct(
        ("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I), ("l_quantity", _D),
        ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
        ("l_linestatus", _S), ("l_shipdate", _TS),
    ),
    "events": _struct(
        ("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S)
    ),
}

# Tables compared between the source and replica sides by sync_status.
STATUS_TABLES: dict[str, str] = {
    "customers": "customer",
    "rentals": "events",
    "payments": "orders",
    "films": "part",
}

# Unique key of each synced / compared table.
KEYS: dict[str, str] = {
    "customer": "c_custkey",
    "events": "event_id",
    "orders": "o_orderkey",
    "part": "p_partkey",
    "supplier": "s_suppkey",
}
