"""Command line: python -m gridwright.cli COMMAND CONFIG. A failed system or audit check exits 1, warnings exit 0."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridwright")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("freeze", "single", "adaptive", "calibrate", "experiment", "analyse"):
        p = sub.add_parser(name)
        p.add_argument("config")
        if name == "experiment":
            p.add_argument("--families", nargs="*")
            p.add_argument("--allow-stub-8b", action="store_true")
    p = sub.add_parser("random")
    p.add_argument("config")
    p.add_argument("--seed", type=int, required=True)
    p.add_argument("--probability", type=float, default=0.5)
    p = sub.add_parser("score")
    p.add_argument("run_dir")
    p.add_argument("gold")
    p.add_argument("out")
    p = sub.add_parser("select")
    p.add_argument("annotations")
    p.add_argument("out")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--min-non-empty-cells", type=int, default=0)
    p = sub.add_parser("describe")
    p.add_argument("annotations")
    a = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators import dataset
    from .plans import calibration, drivers
    from .sources import json_tables

    spark = SparkSession.builder.appName("gridwright").getOrCreate()
    if a.command == "experiment":
        entries = drivers.run_experiment(spark, a.config, a.families, a.allow_stub_8b)
        print(json.dumps({e["system_id"]: e["status"] for e in entries}, indent=2))
        return int(any(e["status"] == "failed" for e in entries))
    if a.command == "analyse":
        out = drivers.analyse(spark, a.config)
        print(json.dumps(out, indent=2))
        return int(out["any_failed"])
    if a.command == "score":
        print(json.dumps(drivers.score_run(spark, drivers.run_outputs(spark, a.run_dir), json_tables.gold(spark, a.gold), a.out), indent=2))
    elif a.command == "random":
        print(drivers.run_adaptive(spark, a.config, a.seed, a.probability))
    elif a.command == "calibrate":
        print(calibration.told(drivers.run_calibration(spark, a.config)))
    elif a.command == "select":
        print(drivers.select_fixture(spark, a.annotations, a.out, a.limit, a.min_non_empty_cells))
    elif a.command == "describe":
        for r in dataset.described(json_tables.annotations(spark, a.annotations)).orderBy("path", "kind").collect():  # as many as shapes
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        run = {"freeze": drivers.run_freeze, "single": drivers.run_single, "adaptive": drivers.run_adaptive}[a.command]
        print(json.dumps(run(spark, a.config), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
