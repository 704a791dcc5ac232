"""Command line: screen one file into a JSON and an HTML report."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from .model import CIRCA_MARGIN
from .operators.explain import Generator, HttpTransport, Settings
from .plans.html import render
from .plans.parts import write_parts
from .plans.screening import report, screen_file, write
from .sources.lido import listed_notes
from .sources.lists import DATA, ListError, load_config
from .sources.records import InputError


#: Ingest notes that a report in parts lists; --parquet has all of them.
MOST_NOTES = 1_000


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens", description=__doc__)
    p.add_argument("input")
    p.add_argument("--format", choices=("csv", "lido"))
    p.add_argument("--out", help="JSON report")
    p.add_argument("--html", help="HTML report")
    p.add_argument("--parquet", help="folder for flags, objects, citations and coverage as tables; without --out or --html nothing is collected")
    p.add_argument("--parts", help="folder for the report in parts (JSON lines and HTML pages), written by the tasks; nothing is collected for it")
    p.add_argument("--onset-table", default=DATA / "onset_table.json")
    p.add_argument("--circa-margin-years", type=int, default=CIRCA_MARGIN)
    p.add_argument("--anonymous-patterns", default=DATA / "anonymous_patterns.json")
    p.add_argument("--aliu-list", default=DATA / "name_list.json")
    p.add_argument("--actor-list", default=DATA / "actor_list.json")
    p.add_argument("--institution-commitment-date")
    p.add_argument("--llm-endpoint")
    p.add_argument("--llm-model")
    p.add_argument("--env-file", default=".env")
    p.add_argument("--llm-api-key-env", default="LLM_API_KEY")
    p.add_argument("--llm-language", default="en")
    p.add_argument("--llm-max-retries", type=int, default=1)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 2: rejected input, date or explanation settings."""
    args = arguments().parse_args(argv)
    if Path("config.yaml").exists():
        print("config.yaml is not read; settings are given on the command line", file=sys.stderr)
    try:
        commitment = date.fromisoformat(args.institution_commitment_date) if args.institution_commitment_date else None
        generator = None
        if args.llm_endpoint:
            generator = Generator(HttpTransport(Settings.from_env(args.llm_endpoint, args.llm_model, args.llm_api_key_env, args.env_file)), args.llm_language, max_retries=args.llm_max_retries)
        cfg = load_config(args.onset_table, args.anonymous_patterns, args.aliu_list, args.actor_list, commitment)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("ledgerlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        screening, notes, fmt = screen_file(spark, args.input, cfg, args.format, args.circa_margin_years)
        if args.parquet:
            write(screening, args.parquet, notes)
        if args.parts:
            write_parts(screening, cfg, args.parts, args.input, fmt, listed_notes(notes, MOST_NOTES), args.circa_margin_years)
        if (args.parquet or args.parts) and not args.out and not args.html:
            return 0
        result = report(screening, cfg, args.input, fmt, listed_notes(notes), args.circa_margin_years, generator)
    except (InputError, ListError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    text = json.dumps(result, indent=2, ensure_ascii=False) + "\n"
    if args.out:
        Path(args.out).write_text(text, encoding="utf-8")
    if args.html:
        Path(args.html).write_text(render(result), encoding="utf-8")
    if not args.out and not args.html:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
