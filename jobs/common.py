"""What the jobs share: configuration files, logging, and settings that are put back."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config_of(file: Path, path: str | None) -> dict:
    """The defaults beside a job, with what the given JSON file changes; names that the defaults lack are an error."""
    found = json.loads(file.with_suffix(".json").read_text())
    if path:
        changes = json.loads(Path(path).read_text())
        unknown = sorted(set(changes) - set(found))
        if unknown:
            raise ValueError(f"{path}: unknown settings {', '.join(unknown)}; known are {', '.join(sorted(found))}")
        found |= changes
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold within the block; dots are written as two underscores."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def command_line(title: str, inputs: dict[str, str], run: Callable[..., None], arguments: list[str] | None, spark: SparkSession | None) -> int:
    """Parse paths, start a session unless one is given, run, and stop only a session that was started here."""
    p = argparse.ArgumentParser(description=title)
    for name, text in inputs.items():
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--config", help="JSON file of settings to change")
    a = vars(p.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s", stream=sys.stderr)
    session = spark or SparkSession.builder.appName(title.split(":")[0]).getOrCreate()
    try:
        run(session, *(a[n] for n in inputs), a["config"])
    finally:
        if spark is None:
            session.stop()
    return 0
