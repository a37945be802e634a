"""Archives that are folders of a manifest.json and raw tensor files.

    python -m tensorloom parse FOLDER                            the manifest's components, a JSON document a line
    python -m tensorloom separate FOLDER OUT [-t TYPE] [-p PATH]...  numeric components (of one type; of these paths) as files of OUT
    python -m tensorloom combine FOLDER OUT [--override KEY FILE]...  a new archive with replaced files; KEY is a path or a file name
    python -m tensorloom compare A B [-q | -v]                   differences by path; exit status 1 if there are any; -q prints
                                                                 nothing, -v also what each side declares

Files are read and written by Spark's tasks; OUT is a folder that all workers mount.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources import manifest, tensor_files


def _files(spark: SparkSession, folder: str):
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("bin"), "content")


def _described(spark: SparkSession, folder: str):
    """Rows for manifest.difference(): a component's declaration and the hash of its file."""
    rows = manifest.read(spark, f"{folder}/manifest.json").join(_files(spark, folder), "bin", "left")
    return rows.select("path", F.lit("array").alias("kind"), F.col("samples").alias("nsamples"), F.lit(False).alias("constant"), "type", F.concat_ws("x", F.col("size").cast("string"), F.col("extent").cast("string")).alias("dims"), F.sha2("content", 256).alias("hash"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tensorloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("parse").add_argument("folder")
    s = sub.add_parser("separate")
    s.add_argument("folder"), s.add_argument("out"), s.add_argument("-t", "--type"), s.add_argument("-p", "--path", action="append", default=[])
    c = sub.add_parser("combine")
    c.add_argument("folder"), c.add_argument("out"), c.add_argument("--override", nargs=2, action="append", default=[], metavar=("KEY", "FILE"))
    d = sub.add_parser("compare")
    d.add_argument("a"), d.add_argument("b")
    loud = d.add_mutually_exclusive_group()
    loud.add_argument("-q", "--quiet", action="store_true"), loud.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tensorloom").getOrCreate()
    if a.command == "compare":
        left, right = _described(spark, a.a), _described(spark, a.b)
        found = manifest.difference(left, right)
        if a.quiet:
            return int(not found.isEmpty())
        side = lambda rows, name: rows.select("path", F.concat_ws(" ", "kind", F.col("nsamples").cast("string"), "type", "dims", F.substring("hash", 1, 12)).alias(name))
        shown = found.join(side(left, "left"), "path", "left").join(side(right, "right"), "path", "left") if a.verbose else found
        some = False
        for r in shown.orderBy("path").toLocalIterator():
            some = True
            print(r["change"], r["path"], *([f"[{r['left'] or ''}] [{r['right'] or ''}]"] if a.verbose else []))
        return int(some)
    components = manifest.read(spark, f"{a.folder}/manifest.json")
    if a.command == "parse":
        for r in components.orderBy("ordinal").toJSON().toLocalIterator():
            print(r)
        return 0
    own, out = _files(spark, a.folder), os.path.abspath(a.out)
    os.makedirs(out, exist_ok=True)
    if a.command == "separate":
        wanted = manifest.numeric(components, a.type)
        wanted = wanted.where(F.col("path").isin(a.path)) if a.path else wanted
        wrong = manifest.misshapen(wanted, own.select("bin", F.length("content").alias("length"))).select("path")
        tensor_files.write(wanted.join(wrong, "path", "left_anti").join(own, "bin").select("bin", "content"), out)
        failed = 0
        for r in wrong.orderBy("path").toLocalIterator():
            failed = 1
            print(f"missing or not of its declared size: {r['path']}", file=sys.stderr)
        for path in sorted({*a.path} - {r["path"] for r in wanted.select("path").collect()}) if a.path else []:  # those asked for
            failed = 1
            print(f"no such component: {path}", file=sys.stderr)
        return failed
    given = [f for _, f in a.override if os.path.exists(f)]
    files = own.select(F.col("bin").alias("file"), "content")
    if given:  # overrides come from the command line
        place = spark.createDataFrame([(f, os.path.abspath(f)) for f in given], "file string, place string")
        there = spark.read.format("binaryFile").load([f"file://{os.path.abspath(f)}" for f in given]).select(F.regexp_replace("path", "^file:/+", "/").alias("place"), "content")
        files = place.join(there, "place").select("file", "content").unionByName(files.join(place, "file", "left_anti"))
    over = spark.createDataFrame(a.override, "key string, file string") if a.override else spark.createDataFrame([], "key string, file string")
    plan = manifest.replacement_plan(components, over, files.select("file"))
    sources = components.select("path", "bin").join(plan, "path", "left").select("bin", F.coalesce("source", "bin").alias("file"))  # a component without a file to replace it keeps its own
    tensor_files.write(sources.join(files, "file").select("bin", "content"), out)
    tensor_files.write(own.where("bin = 'manifest.json'"), out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
