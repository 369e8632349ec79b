"""Run the continuous sync of one keyed table.

    python -m ledgerflow.streaming --source /landing/rental --target /replica/rental.parquet \\
        --key rental_id --schema-from /replica/rental.parquet [--interval "30 seconds"] [--available-now]

The schema is taken from an existing copy of the table (``--schema-from``,
default: the target). The checkpoint defaults to a folder under
``spark.checkpoint.dir`` derived from the target, so a restart resumes.

A failed query is started again, after a delay that grows from ``--first-delay``
to ``--longest-delay`` seconds; failures go into the log. SIGTERM or Ctrl+C
lets the running micro-batch commit and then ends the process.
"""

from __future__ import annotations

import argparse
import signal

from ledgerflow.session import build_session, stable_path
from ledgerflow.streaming.supervisor import FIRST_DELAY, LONGEST_DELAY, StopGate, run_supervised
from ledgerflow.streaming.sync_stream import DEFAULT_INTERVAL, start_sync


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m ledgerflow.streaming")
    parser.add_argument("--source", required=True, help="folder (or glob) where new files of the table land")
    parser.add_argument("--target", required=True, help="Parquet table to keep in sync")
    parser.add_argument("--key", required=True, help="unique key column")
    parser.add_argument("--schema-from", help="existing copy of the table to take the schema from")
    parser.add_argument("--checkpoint", help="streaming checkpoint folder")
    parser.add_argument("--log", help="Parquet table receiving one row of metrics per batch")
    parser.add_argument("--interval", default=DEFAULT_INTERVAL)
    parser.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    parser.add_argument("--max-files-per-trigger", type=int)
    parser.add_argument("--counts", action="store_true", help="whole-table counts of both sides in the log, at every batch")
    parser.add_argument("--keyed-state", action="store_true", help="keep the keys brought in a state store, not compared with the target")
    parser.add_argument("--first-delay", type=float, default=FIRST_DELAY, help="seconds before the first restart")
    parser.add_argument("--longest-delay", type=float, default=LONGEST_DELAY, help="most seconds before a restart")
    parser.add_argument("--max-failures", type=int, help="give up after so many failures in a row")
    args = parser.parse_args(argv)

    spark = build_session(app_name="ledgerflow-sync")
    gate = StopGate()
    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, lambda *_: gate.request())
    schema = spark.read.parquet(args.schema_from or args.target).schema
    checkpoint = args.checkpoint or stable_path(spark, "sync-checkpoint", args.target)

    def start(gate: StopGate):
        return start_sync(
            spark, args.source, schema, args.target, args.key,
            checkpoint=checkpoint,
            log_path=args.log,
            interval=args.interval,
            available_now=args.available_now,
            max_files_per_trigger=args.max_files_per_trigger,
            with_counts=args.counts,
            query_name="ledgerflow_sync",
            keyed_state=args.keyed_state,
            gate=gate,
        )

    try:
        outcome = run_supervised(
            spark, start, gate,
            (args.log, checkpoint, schema[args.key].dataType) if args.log else None,
            args.first_delay, args.longest_delay, args.max_failures,
        )
        print(f"{'stopped' if outcome.stopped else 'ended'} after {outcome.starts} starts, {outcome.failures} failures")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
