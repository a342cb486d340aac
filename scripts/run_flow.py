"""Run one of the study's flows as a batch job (spark-submit or local).

    spark-submit scripts/run_flow.py training-set --input PATH --key row_id --output PATH
    spark-submit scripts/run_flow.py agreement --rater1 PATH --rater2 PATH --key row_id --output PATH

Inputs and outputs are Parquet directories. The session's own settings win
(checkpoint dir, shuffle partitions); nothing is collected to the driver
beyond counts and small metric tables.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    sub = ap.add_subparsers(dest="flow", required=True)
    ts = sub.add_parser("training-set")
    ts.add_argument("--input", required=True)
    ts.add_argument("--key", default="row_id")
    ts.add_argument("--output", required=True)
    ts.add_argument("--n-calibrate", type=int, default=200)
    ts.add_argument("--seed", type=int, default=56)
    ag = sub.add_parser("agreement")
    ag.add_argument("--rater1", required=True)
    ag.add_argument("--rater2", required=True)
    ag.add_argument("--key", default="row_id")
    ag.add_argument("--output", required=True)
    ap.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    ap.add_argument("--input-bytes", type=int, default=None, help="sizes the shuffles, with --cores")
    ap.add_argument("--cores", type=int, default=None)
    args = ap.parse_args()

    from tessera.plans import workflows
    from tessera.session import cluster_conf, get_spark
    from tessera.sources.io import write_table

    sized = cluster_conf(args.input_bytes, args.cores) if args.input_bytes and args.cores else None
    spark = get_spark(args.master, app=f"tessera-{args.flow}", extra=sized)
    if args.flow == "training-set":
        df = spark.read.parquet(args.input)
        out = workflows.training_set(df, args.key, n_calibrate=args.n_calibrate, seed=args.seed)
        write_table(out, args.output, partition_by=["split"])
    else:
        a = spark.read.parquet(args.rater1)
        b = spark.read.parquet(args.rater2)
        for name, table in workflows.agreement_report(a, b, args.key).items():
            write_table(table, os.path.join(args.output, name))
    spark.stop()


if __name__ == "__main__":
    main()
