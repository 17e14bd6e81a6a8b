"""Command line: list the registered queries, run one over a folder of tables, or look at a checkout.

    python -m evidentia queries
    python -m evidentia run graph_hubs /data/sf1 [--limit 20]
    python -m evidentia revision /path/to/checkout
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import catalog
from .sources import observations


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidentia")
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("queries")
    run = parts.add_parser("run")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--limit", type=int, default=20)
    parts.add_parser("revision").add_argument("path")
    asked = parser.parse_args(words)
    if asked.command == "queries":
        print("\n".join(sorted(catalog.queries())))
    elif asked.command == "revision":
        print(json.dumps(observations.revision(asked.path), sort_keys=True))
    else:
        queries = catalog.queries()
        if asked.name not in queries or asked.limit < 1:
            print("unknown query or limit", file=sys.stderr)
            return 2
        spark = SparkSession.builder.appName(f"evidentia {asked.name}").getOrCreate()
        for row in queries[asked.name](spark, asked.folder).limit(asked.limit).toJSON().collect():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
