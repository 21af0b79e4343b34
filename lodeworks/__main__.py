"""python -m lodeworks QUERY FOLDER [--out PATH] [--format csv|json|parquet] [--order COLUMN ...]: run a registered query over a folder of tables.

Without a path, the rows are printed; without a query, the names of all are.
"""

from __future__ import annotations

import argparse
import time

from . import session
from .plans import registry
from .sources import writers


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodeworks")
    parser.add_argument("query", nargs="?", choices=sorted(registry.queries()))
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--out")
    parser.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
    parser.add_argument("--order", nargs="*", default=[])
    found = parser.parse_args(args)
    if found.query is None or found.folder is None:
        print("\n".join(sorted(registry.queries())))
        return
    began = time.time()
    df = writers.in_order(registry.queries()[found.query](session.build("lodeworks"), found.folder), tuple(found.order))
    if found.out is None:
        df.show(50, truncate=False)
    elif found.format == "parquet":
        df.write.mode("overwrite").parquet(found.out)
    else:
        (writers.csv_rows if found.format == "csv" else writers.json_rows)(df, found.out)
    print(f"Duration: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()
