"""python -m keepsake.checkup ROOT [--agent A] [--fix]: health of a memory store; exit code 0 healthy, 1 degraded, 2 critical."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import health
from .store import MemoryStore


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root")
    parser.add_argument("--agent", default="")
    parser.add_argument("--fix", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = MemoryStore(spark, given.root).check_health(given.agent, given.fix).cache()  # a row a check
    for r in found.where("n > 0").orderBy(F.desc("severity"), "check").collect():
        print(f"{r.severity:9}{r.check:32}{r.n:10}" + ("" if r.repairable is None else f"  {r.repairable} repairable"))
    status = health.status(found)
    print(status)
    return ("healthy", "degraded", "critical").index(status)


if __name__ == "__main__":
    sys.exit(main())
