"""Command line: ``python -m spanloom COMMAND``.

run NAME DIR [--out DIR]: one query over a folder of tables, shown or written as Parquet.
report DIR FILE: the corpus audit, the dataset summaries and the scores as Markdown.
check DIR: all errors and warnings of a folder of annotated documents and how it was reviewed; exit code 1 if there are errors.
datasets DIR OUT: the span and sentence tables by split; an existing OUT is left alone.
list: the names of all queries.
audit DIR OUT: sizes, roles and nesting of a folder of annotated documents, as JSON.
dedup DIR OUT: near-duplicate groups of a folder of annotated documents, as JSON.
freeze-grid DIR OUT [--force]: the grid's manifest of a folder of annotated documents.
split DIR DEDUP OUT --sizes train=..,val=..,test=.. [--grid GRID] [--force]: a split's manifest, which names the grid's.
build DIR GRID SPLIT OUT [--vocabulary FILE]: the span and sentence tables of annotated documents, if the manifests fit them.
verify DIR GRID SPLIT: exit code 1, and what differs, if the manifests do not fit the documents.
mock OUT: a small made-up corpus.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import catalogue, corpus
from .plans.report import report
from .sources import annotations

AUDIT = ["audit_sizes", "audit_roles", "audit_multi", "audit_combos", "audit_nesting", "audit_length", "projection_stats", "s1_summary", "s2_summary", "multilabel_summary", "per_role_f1"]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, given in (("run", ["name", "dir"]), ("report", ["dir", "out"]), ("datasets", ["dir", "out"]), ("list", [])):
        own = sub.add_parser(name)
        for x in given:
            own.add_argument(x)
        if name == "run":
            own.add_argument("--out")
    for name, given in (("audit", ["dir", "out"]), ("dedup", ["dir", "out"]), ("freeze-grid", ["dir", "out"]), ("split", ["dir", "dedup", "out"]), ("verify", ["dir", "grid", "split"]), ("check", ["dir"]), ("build", ["dir", "grid", "split", "out"]), ("mock", ["out"])):
        own = sub.add_parser(name)
        for x in given:
            own.add_argument(x)
        if name in ("freeze-grid", "split"):
            own.add_argument("--force", action="store_true")
        if name == "split":
            own.add_argument("--sizes", required=True)
            own.add_argument("--seed", type=int, default=13)
            own.add_argument("--grid")
        if name == "build":
            own.add_argument("--vocabulary")
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(catalogue.QUERIES))
        return 0
    if a.command == "mock":
        annotations.mock_corpus(a.out)
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        made = catalogue.QUERIES[a.name](spark, a.dir)
        made.write.parquet(a.out) if a.out else made.show(50, truncate=False)
    elif a.command == "report":
        with open(a.out, "w") as file:
            file.write(report("Corpus", {n: catalogue.QUERIES[n](spark, a.dir) for n in AUDIT}))
    elif a.command == "datasets":
        for name in ("s1_rows", "s2_rows"):
            annotations.write_split(catalogue.QUERIES[name](spark, a.dir), f"{a.out}/{name}")
    elif a.command in corpus.COMMANDS:
        return corpus.COMMANDS[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
