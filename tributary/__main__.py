"""``python -m tributary transform --csv rows.csv --ats record.json --output profile.json``: one entity's profile."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.functions.dims import HIGH, LOW
from tributary.operators.project import pretty
from tributary.plans.engine import available_sources, fuse_files
from tributary.serve import server


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: no input could be used; 2: --strict and the profile has errors."""
    parser = argparse.ArgumentParser(prog="tributary", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("transform", help="fuse the sources of one entity")
    for source in available_sources():
        one.add_argument(f"--{source}")
    one.add_argument("--config")
    one.add_argument("--output", "-o")
    one.add_argument("--verbose", "-v", action="store_true")
    one.add_argument("--strict", action="store_true")
    sub.add_parser("sources", help="list the sources")
    web = sub.add_parser("serve", help="answer HTTP requests")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(args, "verbose", False) else logging.WARNING, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if args.command == "sources":
        print("\n".join(available_sources()))
        return 0
    spark = SparkSession.builder.appName("tributary").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "serve":
        server(spark, args.host, args.port).serve_forever()
        return 0
    try:
        fused = fuse_files(spark, {s: getattr(args, s) for s in available_sources()}, args.config)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    data = pretty(fused.json.first()["json"])
    if args.output:
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        Path(args.output).write_bytes(data)
    else:
        sys.stdout.buffer.write(data + b"\n")
    record = fused.validated.select("full_name", "first_name", "last_name", *COUNTED, "confidence.overall_score", "sources", "findings").first()
    print("\n".join(report(record)), file=sys.stderr)
    return 2 if args.strict and any(f["severity"] == "error" for f in record["findings"]) else 0


#: Lists whose lengths are reported.
COUNTED = ("emails", "phones", "skills", "experience", "education", "projects")


def report(record) -> list[str]:
    """A profile in a few lines: its name, sources, lengths, confidence and findings."""
    name = record["full_name"] or " ".join(x for x in (record["first_name"], record["last_name"]) if x) or "Unknown"
    score = record["overall_score"]
    band = "high" if score >= HIGH else "medium" if score >= LOW else "low"
    lines = [("name", name), ("sources", ", ".join(record["sources"])), *((n, len(record[n])) for n in COUNTED), ("confidence", f"{score:.3f} ({band})")]
    return [f"{k:<12}{v}" for k, v in lines] + [f"{f['severity']}: [{f['field']}] {f['message']}" for f in record["findings"]]


if __name__ == "__main__":
    sys.exit(main())
