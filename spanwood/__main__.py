"""``python -m spanwood show [-p PATH] [--to text|hex|debug|xml|binary] [-o OUT] FILE...`` prints files' trees or what a
path finds in them; ``python -m spanwood build IN OUT`` writes a text document as binary (``-``: standard in or out)."""

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .api import Forest
from .sources.binary import write_binary
from .sources.files import READERS, parse_bytes


def show(a: argparse.Namespace) -> int:
    spark = SparkSession.builder.appName("spanwood").getOrCreate()
    if a.files == ["-"]:
        df = spark.createDataFrame([("stdin", sys.stdin.buffer.read())], "doc_id string, content binary")
        forest = Forest.parse(df, "doc_id", "content", a.form)
    else:
        forest = Forest.read(spark, [os.path.abspath(f) for f in a.files], a.form)
    if a.path:
        forest = forest.subtrees(forest.path(a.path))
    rows = getattr(forest, f"to_{a.to}")().orderBy("doc_id", "root_ord").toLocalIterator()
    out = open(a.out, "xb") if a.out else sys.stdout.buffer  # noqa: SIM115  an existing file is an error
    with out:
        for r in rows:
            out.write(bytes(r.body) if a.to == "binary" else (r.body if r.body.endswith("\n") else r.body + "\n").encode())
    return 0


def build(a: argparse.Namespace) -> int:
    data = sys.stdin.buffer.read() if a.source == "-" else open(a.source, "rb").read()  # noqa: SIM115
    roots = parse_bytes(data, "text")
    if len(roots) != 1:
        print(f"{len(roots)} top-level nodes where one is wanted", file=sys.stderr)
        return 1
    out = sys.stdout.buffer if a.target == "-" else open(a.target, "wb")  # noqa: SIM115
    with out:
        out.write(write_binary(roots[0]))
    return 0


def main() -> int:
    p = argparse.ArgumentParser("spanwood", description=__doc__)
    commands = p.add_subparsers(required=True)
    s = commands.add_parser("show")
    s.add_argument("files", nargs="+")
    s.add_argument("-p", "--path")
    s.add_argument("-o", "--out")
    s.add_argument("--to", choices=["text", "hex", "debug", "xml", "binary"], default="text")
    s.add_argument("--form", choices=READERS, default="auto")
    s.set_defaults(run=show)
    b = commands.add_parser("build")
    b.add_argument("source")
    b.add_argument("target")
    b.set_defaults(run=build)
    a = p.parse_args()
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
