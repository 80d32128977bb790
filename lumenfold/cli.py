"""Command line: scan, build, regroup, check, use, search, stats, groups, export and archive listings."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lumenfold.operators.groups import GroupParams
from lumenfold.plans import lookups, pipeline
from lumenfold.plans import search as Q
from lumenfold.sources import archive, csvfile, scan, snapshots


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"build": ["data", "root", "name"], "regroup": ["root", "old", "new"], "check": ["root", "name"], "use": ["root", "name"], "search": ["root"], "list": ["path"], "scan": ["path", "shards", "cfg"], "build-scanned": ["shards", "root", "name"], "stats": ["root"], "groups": ["root"], "export": ["root", "path"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "build-scanned":
            s.add_argument("--home-tz", default="UTC")
        if name == "groups":
            s.add_argument("--limit", type=int, default=50)
            s.add_argument("--offset", type=int, default=0)
        if name in ("build", "build-scanned", "regroup"):
            s.add_argument("--distance", type=int, default=3)
            s.add_argument("--bucket-cap", type=int, help="skip hash buckets of more items, as the reference does at 500; exact without")
        if name == "search":
            for a in ("category", "date_from", "date_to", "filename_contains", "group"):
                s.add_argument(f"--{a.replace('_', '-')}", dest=a)
            s.add_argument("--year", type=int)
            s.add_argument("--limit", type=int, default=50)
            s.add_argument("--offset", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenfold").getOrCreate()
    if a.command == "build":
        print(pipeline.build(spark, a.data, a.root, a.name, GroupParams(distance=a.distance, bucket_cap=a.bucket_cap))["tables"])
    elif a.command == "scan":
        scan.scan(spark, a.path, a.shards, a.cfg).show(truncate=False)
    elif a.command == "build-scanned":
        print(pipeline.build(spark, scan.deliveries(spark, a.shards, a.home_tz), a.root, a.name, GroupParams(distance=a.distance, bucket_cap=a.bucket_cap))["tables"])
    elif a.command in ("stats", "groups", "export"):
        name = snapshots.current(spark, a.root)
        read = lambda t: snapshots.read_table(spark, a.root, name, t)
        if a.command == "stats":
            read("stats").orderBy("key").show(10_000, truncate=False)
        elif a.command == "groups":
            lookups.group_page(read("dup_groups"), read("dup_members"), read("items").select("item_id", "filename"), a.offset, a.limit).show(1000, truncate=False)
        else:
            csvfile.write_csv(read("items").withColumnRenamed("file_size", "size_bytes"), a.path)
    elif a.command == "regroup":
        print(pipeline.regroup(spark, a.root, a.old, a.new, GroupParams(distance=a.distance, bucket_cap=a.bucket_cap))["tables"])
    elif a.command == "check":
        problems = snapshots.check_snapshot(spark, a.root, a.name)
        problems.show(truncate=False)
        return int(not problems.isEmpty())
    elif a.command == "use":
        snapshots.set_current(spark, a.root, a.name)
    elif a.command == "search":
        name = snapshots.current(spark, a.root)
        read = lambda t: snapshots.read_table(spark, a.root, name, t)
        p = Q.SearchParams(category=a.category, date_from=a.date_from, date_to=a.date_to, filename_contains=a.filename_contains, group=a.group, year=a.year, limit=a.limit, offset=a.offset)
        page, total = Q.search(read("items"), p, read("scores"), dup_members=read("dup_members"))
        page.select("item_id", "local_date", "local_time", "filename").show(a.limit, truncate=False)
        total.show()
    elif a.command == "list":
        archive.read_archives(spark, a.path, "").groupBy("zip_name").count().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
