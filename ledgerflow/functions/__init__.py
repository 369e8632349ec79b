"""Column helpers built only from ``pyspark.sql.functions``."""

from ledgerflow.functions.money import TOTAL, WIDE, money_sum, money_value, month_key, utc_stamp
from ledgerflow.functions.labels import (
    AVAILABILITY,
    OVERALL,
    availability_label,
    overall_label,
)

__all__ = [
    "WIDE",
    "TOTAL",
    "money_sum",
    "money_value",
    "month_key",
    "utc_stamp",
    "AVAILABILITY",
    "OVERALL",
    "availability_label",
    "overall_label",
]
