"""The jobs as registered queries: each runs twice into one new folder and returns the whole output after the second run."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import digest_audit, id_monitor
from jobs.common import config_of
from spacelab.sources.storage import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_digest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, config = _folder(spark, "job1"), config_of(Path(digest_audit.__file__), None)
    digest_audit.audit(spark, f"{sf_dir}/documents.parquet", place, config)
    return digest_audit.audit(spark, f"{sf_dir}/documents.parquet", place, config)


def job2_id_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, config = _folder(spark, "job2"), config_of(Path(id_monitor.__file__), None)
    for _ in range(2):
        found = id_monitor.monitor(spark, f"{sf_dir}/events.parquet", f"{place}/output", f"{place}/checkpoint", config)
    return found


QUERIES = {"job1_digest_audit": job1_digest_audit, "job2_id_monitor": job2_id_monitor}
ORACLE = {
    "job1_digest_audit": digest_audit.sql(config_of(Path(digest_audit.__file__), None)),
    "job2_id_monitor": id_monitor.sql(config_of(Path(id_monitor.__file__), None)),
}
