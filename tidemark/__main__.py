"""python -m tidemark point|panel: what was known at a time, of a declared dataset, as rows on screen, Parquet or a snapshot."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.declaration import PlanError
from .plans.declared import load
from .session import session
from .sources import registry

MOST_PREVIEWED = 20


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", allow_abbrev=False)
    parser.add_argument("mode", choices=["point", "panel"])
    parser.add_argument("--declaration", required=True, help="a YAML file")
    parser.add_argument("--root", required=True, help="the folder that the declaration's locator starts from")
    parser.add_argument("--as-of", required=True, help="an ISO instant with a zone, or a date (its midnight, UTC)")
    parser.add_argument("--columns", help="names, with commas between")
    parser.add_argument("--output", choices=["preview", "parquet", "snapshot"], default="preview")
    parser.add_argument("--to", help="folder for parquet, or store of snapshots")
    parser.add_argument("--rows", type=int, default=MOST_PREVIEWED, help=f"of a preview, {MOST_PREVIEWED} at most")
    a = parser.parse_args(arguments)
    if (a.output != "preview") != bool(a.to) or not 0 <= a.rows <= MOST_PREVIEWED:
        parser.error("--to goes with parquet and snapshot; a preview has 0 to 20 rows")
    spark = spark or session()
    try:
        read = registry.point if a.mode == "point" else registry.panel
        rows = read(registry.Registry(a.root), spark, load(a.declaration), a.as_of, a.columns.split(",") if a.columns else None)
        if a.output == "preview":
            print("\n".join(r.json for r in rows.limit(a.rows).selectExpr("to_json(struct(*)) as json").collect()))
        elif a.output == "parquet":
            rows.write.parquet(a.to)
        else:
            print(registry.save_snapshot(rows, a.to))
    except PlanError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
