"""A shell: ``python -m tandemql --dialect mysql --data folder``, one statement a line, with timings."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tandemql.session import Session
from tandemql.sharding.shard_map import ShardedTable, parse_shard_spec
from tandemql.sql.dialect import SqlError

MOST_ROWS = 1000


def shown(result) -> str:
    if isinstance(result, DataFrame):
        rows = result.limit(MOST_ROWS + 1).collect()
        table = [result.columns] + [["NULL" if v is None else str(v) for v in r] for r in rows[:MOST_ROWS]]
        widths = [max(len(r[i]) for r in table) for i in range(len(result.columns))]
        lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in table]
        more = f", the first {MOST_ROWS}" if len(rows) > MOST_ROWS else ""
        return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:], f"({min(len(rows), MOST_ROWS)} rows{more})"])
    if result.returning is not None:
        return shown(result.returning)
    return f"OK, {result.affected_rows} rows"


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tandemql", description=__doc__)
    args.add_argument("--dialect", default="mysql")
    args.add_argument("--data", help="a folder of Parquet tables")
    args.add_argument("--shard", action="append", default=[], help="table:key:[hash|range|list:]shards")
    args.add_argument("-e", "--execute", action="append", help="a statement to run instead of reading lines")
    told = args.parse_args(argv)
    spark = SparkSession.builder.appName("tandemql").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(spark, told.dialect)
    if told.data:
        for path in sorted(Path(told.data).glob("*.parquet")):
            session.register(path.stem, spark.read.parquet(str(path)))
    for spec in told.shard:
        shard_map = parse_shard_spec(spec)
        session.register_sharded(ShardedTable.deal(session.tables.pop(shard_map.table.lower()).df, shard_map))
    failed = 0
    for line in told.execute or sys.stdin:
        if not line.strip():
            continue
        began = time.time()
        try:
            print(shown(session.execute(line)))
        except SqlError as error:
            failed += 1
            print(f"error: {error}", file=sys.stderr)
        print(f"{time.time() - began:.3f} s")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
