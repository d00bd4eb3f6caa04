"""Masks files: python -m spanlake PATH --out DIR [--types inn,email] [--custom types.json] [--rules-only] [--dry-run] [--quiet]."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="spanlake", description="Masks personal and contract data in office and text files.")
    ask.add_argument("path", help="a folder of .docx, .xlsx and .txt files")
    ask.add_argument("--out", help="where masked segments, files and reports are written")
    ask.add_argument("--types", help="types to mask, with commas between; all but visible terms by default")
    ask.add_argument("--custom", help="a JSON file with a list of own types: id, pattern or literals, context")
    ask.add_argument("--rules-only", action="store_true", help="without organisations and free amounts")
    ask.add_argument("--dry-run", action="store_true", help="find and plan, but write nothing")
    ask.add_argument("--quiet", action="store_true", help="print nothing but errors")
    own = ask.parse_args(argv)
    if not own.out and not own.dry_run:
        ask.error("--out is needed, or --dry-run")
    from pyspark.sql import SparkSession

    from spanlake import engine
    from spanlake.operators.rules import CustomType

    custom = ()
    if own.custom:
        with open(own.custom, encoding="utf-8") as f:
            custom = tuple(CustomType(t["id"], t.get("pattern", ""), tuple(t.get("context", ())), literals=tuple(t.get("literals", ()))) for t in json.load(f))
    spark = SparkSession.builder.appName("spanlake").getOrCreate()
    result, files = engine.mask_files(spark, own.path, types=tuple(own.types.split(",")) if own.types else None, custom=custom, rules_only=own.rules_only)
    n_leaks = result.leaks.count()
    if not own.dry_run:
        result.masked.write.mode("overwrite").parquet(f"{own.out}/segments")
        result.report.write.mode("overwrite").json(f"{own.out}/reports")
        files.write.mode("overwrite").parquet(f"{own.out}/files")
    if not own.quiet:
        for r in result.groups.groupBy("type").agg({"n_refs": "sum", "group_id": "count"}).orderBy("type").collect():
            print(f"{r['type']}: {r['sum(n_refs)']} places, {r['count(group_id)']} values")
        print(f"values left: {n_leaks}")
    return 1 if n_leaks else 0


if __name__ == "__main__":
    raise SystemExit(main())
