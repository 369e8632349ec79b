"""Structured Streaming sync."""

from ledgerflow.streaming.supervisor import Outcome, StopGate, run_supervised
from ledgerflow.streaming.sync_stream import DEFAULT_INTERVAL, start_sync, stream_location, sync_until_caught_up

__all__ = [
    "DEFAULT_INTERVAL",
    "Outcome",
    "StopGate",
    "run_supervised",
    "start_sync",
    "stream_location",
    "sync_until_caught_up",
]
