"""``python -m cellwise list`` names the registered queries; ``python -m cellwise run NAME DATA_DIR [OUT_DIR]`` runs one, ``python -m cellwise describe NAME [DATA_DIR]``
tells what it does and, with tables, shows its plan."""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import SparkSession

from cellwise.queries import QUERIES


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(f"cellwise {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(QUERIES))
        return 0
    if len(args) in (2, 3) and args[0] == "describe" and args[1] in QUERIES:
        print(args[1], inspect.getdoc(QUERIES[args[1]]) or "", sep="\n")
        if len(args) == 3:
            QUERIES[args[1]](_session(args[1]), args[2]).explain("formatted")
        return 0
    if len(args) in (3, 4) and args[0] == "run" and args[1] in QUERIES:
        spark = _session(args[1])
        df = QUERIES[args[1]](spark, args[2])
        if len(args) == 4:
            df.write.mode("overwrite").parquet(args[3])
        else:
            df.show(50, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
