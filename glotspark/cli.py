"""Command line: extract and translate."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from glotspark.config import load_config
from glotspark.functions.display import format_duration
from glotspark.operators.aikeys import Generator
from glotspark.operators.translate import Translator
from glotspark.plans import application
from glotspark.session import local_session


def languages(option: str | None) -> list[str] | None:
    named = [x.strip() for x in (option or "").split(",") if x.strip()]
    return named or None


def main(args: list[str] | None = None, translator: Translator | None = None, generator: Generator | None = None) -> int:
    parser = argparse.ArgumentParser("glotspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "translate"):
        sub = commands.add_parser(name)
        sub.add_argument("-c", "--config")
        sub.add_argument("--root", default=".")
        if name == "translate":
            sub.add_argument("-l", "--lang", help="codes, separated by commas")
            sub.add_argument("-f", "--force", action="store_true", help="translate what is translated already")
    said = parser.parse_args(args)
    config = load_config(Path(said.root), said.config, said.command)
    spark, began = SparkSession.getActiveSession() or local_session(), time.time()
    provider = config["ai_provider"]["api_key"]
    if said.command == "extract":
        out = application.extract(spark, config, generator=generator)
        changed = out.summary["changed_files"] if out.summary else 0
        print(f"{out.files_processed} files, {changed} changed, {out.key_report['total'] if out.key_report else 0} keys, {out.collisions.count() if out.collisions is not None else 0} collisions, {len(out.errors)} errors")
        return 0
    if translator is None and not provider:
        print("translate needs ai_provider.api_key in the configuration, or a translator passed to glotspark.cli.main", file=sys.stderr)
        return 2
    wanted = languages(said.lang)
    done = application.translate_missing(spark, config, translator, wanted, said.force)
    targets = wanted or [t for t in config["languages"]["targets"] if t != config["languages"]["source"]]
    print(f"{'all' if said.force else 'missing'} entries of {', '.join(targets)}: {done.reconciled.count()} translated in {format_duration((time.time() - began) * 1000)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
