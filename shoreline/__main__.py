"""Command line: build the published reports, or look up published records.

    python -m shoreline reports ACTIONS PROFILE SUMMARY OUT_DIR
    python -m shoreline lookup PUBLISHED_JSON STATE [TERM]

Uses the configured session (``spark-submit`` master and settings, cluster
defaults); ``--local`` runs on a local session instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session(local: bool) -> SparkSession:
    """The configured session (spark-submit master, cluster defaults); with
    ``--local`` the local test session instead."""
    if local:
        from shoreline.session import local_session

        return local_session()
    return SparkSession.builder.appName("shoreline").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m shoreline")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("reports", help="read the three reports, write the published files")
    r.add_argument("actions")
    r.add_argument("profile")
    r.add_argument("summary")
    r.add_argument("out_dir")
    r.add_argument("--multiline", action="store_true",
                   help="quoted fields may hold line breaks")
    r.add_argument("--single-files", action="store_true",
                   help="publish one file each (CSV, JSON arrays), rows in order, instead of folders of parts")
    lk = sub.add_parser("lookup", help="records of a state matching a search term")
    lk.add_argument("records")
    lk.add_argument("state")
    lk.add_argument("term", nargs="?", default="")
    lk.add_argument("--short-keys", action="store_true",
                    help="records use the short keys (bn, bi, s, ...) instead of the published labels")
    lk.add_argument("--array", action="store_true",
                    help="records are one JSON array document instead of JSON lines")
    lk.add_argument("--out", help="write the matches here (JSON lines, missing as \"NA\") "
                                  "instead of printing them")
    for cmd in (r, lk):
        cmd.add_argument("--local", action="store_true", help="run on a local session")
    args = p.parse_args(argv)

    spark = _session(args.local)
    if args.cmd == "reports":
        from shoreline.plans.beaches import run_reports

        run_reports(spark, args.actions, args.profile, args.summary, args.out_dir,
                    multiline=args.multiline, single_files=args.single_files)
        return 0
    from pyspark.sql import types as T

    from shoreline.plans.lookup import RECORD_KEYS, display, find, short_records
    from shoreline.sources import RECORD_SCHEMA, read_records

    if args.short_keys:
        records = read_records(spark, args.records, RECORD_SCHEMA, multiline=args.array)
    else:  # what `reports` publishes: labelled records, JSON lines
        labelled = T.StructType([T.StructField(k, T.StringType(), True) for k in RECORD_KEYS])
        records = short_records(read_records(spark, args.records, labelled, multiline=args.array))
    found = find(records, args.state, args.term)
    if args.out:  # distributed write, nothing passes through the driver
        from shoreline.sinks import write_json_na

        write_json_na(found, args.out)
        return 0
    # interactive display: rows stream to the console one partition at a time
    for row in display(found).toLocalIterator():
        print({k: v for k, v in row.asDict().items() if v is not None})
    return 0


if __name__ == "__main__":
    sys.exit(main())
