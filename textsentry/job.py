"""Command line: ``python -m textsentry.job scan|redact|policies ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from textsentry.api import Engine, scan_json
from textsentry.plans.model import PolicyLoadError, load_file, problems
from textsentry.sources import text as io


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textsentry")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a text, standard input or files")
    scan.add_argument("text", nargs="?")
    scan.add_argument("--files", nargs="+")
    scan.add_argument("--policy")
    scan.add_argument("--json", action="store_true")
    redact = commands.add_parser("redact", help="redact files or standard input")
    redact.add_argument("files", nargs="*")
    redact.add_argument("--strategy", default="replace")
    redact.add_argument("--output")
    validate = commands.add_parser("policies", help="check a policy file")
    validate.add_argument("path")
    a = parser.parse_args(args)
    if a.command == "policies":
        try:
            found = list(map(str, problems(load_file(a.path))))
        except PolicyLoadError as e:
            found = [str(e)]
        print("\n".join(found) or "valid")
        return int(bool(found))
    spark = SparkSession.builder.appName("textsentry").getOrCreate()
    engine = Engine()
    if a.command == "scan":
        engine.load_policy(a.policy) if a.policy else engine.load_policies()
        df = io.from_files(spark, a.files) if a.files else io.from_strings(spark, [a.text if a.text is not None else sys.stdin.read().strip()])
        out = engine.scan(df)
        if a.json:
            for r in out.select(scan_json().alias("j")).toLocalIterator():
                print(r["j"])
        else:
            io.to_console(out)
        return 0
    df = io.from_files(spark, a.files) if a.files else io.from_strings(spark, [sys.stdin.read()])
    out = engine.redact(df, a.strategy)
    if a.output:
        io.to_text(out, a.output)
    else:
        for r in out.select("redaction.redacted_text").toLocalIterator():
            print(r[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
