"""Status labels for source-versus-replica comparison and availability.

The classification is a ``when`` chain over the two sides' online flags
and the per-table count differences, so it runs inside whole-stage codegen
on whatever rows hold the status.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Side states and labels.
ONLINE = "online"
OFFLINE = "offline"

# overall sync label, by (source, replica) state
IN_SYNC = "IN_SYNC"                                       # both online, every count difference 0
LAG_DETECTED = "LAG_DETECTED"                             # both online, some difference not 0
SOURCE_DOWN_REPLICA_RUNNING = "SOURCE_DOWN_REPLICA_RUNNING"  # source offline, replica online
REPLICA_DOWN = "REPLICA_DOWN"                             # source online, replica offline
BOTH_DOWN = "BOTH_DOWN"                                   # both offline

# availability label, by (source, replica) state
NORMAL = "NORMAL"                                         # both online
FAILOVER_ACTIVE = "FAILOVER_ACTIVE"                       # source offline, replica online
# REPLICA_DOWN and BOTH_DOWN as above

OVERALL = (IN_SYNC, LAG_DETECTED, SOURCE_DOWN_REPLICA_RUNNING, REPLICA_DOWN, BOTH_DOWN)
AVAILABILITY = (NORMAL, FAILOVER_ACTIVE, REPLICA_DOWN, BOTH_DOWN)


def _online(state: Column) -> Column:
    return F.coalesce(state == F.lit(ONLINE), F.lit(False))


def overall_label(source_state: Column, replica_state: Column, lags: list[Column]) -> Column:
    """Overall sync label; ``lags`` are the per-table count differences."""
    src, rep = _online(source_state), _online(replica_state)
    all_zero = F.lit(True)
    for lag in lags:
        all_zero = all_zero & F.coalesce(lag == 0, F.lit(False))
    return (
        F.when(src & rep & all_zero, F.lit(IN_SYNC))
        .when(src & rep, F.lit(LAG_DETECTED))
        .when(~src & rep, F.lit(SOURCE_DOWN_REPLICA_RUNNING))
        .when(src & ~rep, F.lit(REPLICA_DOWN))
        .otherwise(F.lit(BOTH_DOWN))
    )


def availability_label(source_state: Column, replica_state: Column) -> Column:
    """Availability label from the two sides' states."""
    src, rep = _online(source_state), _online(replica_state)
    return (
        F.when(src & rep, F.lit(NORMAL))
        .when(~src & rep, F.lit(FAILOVER_ACTIVE))
        .when(src & ~rep, F.lit(REPLICA_DOWN))
        .otherwise(F.lit(BOTH_DOWN))
    )
