"""Spark session defaults and the shared scratch folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared folder; the library
only reads it. Local runs (tests, bench) get a fresh folder under the system temp dir when none is set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins from runtime sizes (broadcast only when the
# measured side is small, sort-merge otherwise), coalesces small shuffle partitions and splits
# skewed ones; UTC keeps any date maths independent of the host.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "marquee", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` when set. Only a local-mode session (tests, local
    benchmarks) gets a new temporary folder when the setting is absent; on a cluster a machine-local
    folder would be invisible to the executors, so the setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints and intermediate tables are written there)")
        configured = tempfile.mkdtemp(prefix="marquee-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder (never reused between runs)."""
    base = scratch_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:16]}"


def run_concurrently(*jobs: Callable[[], object]) -> list[object]:
    """Run independent Spark actions from separate threads so that their stages share the cluster
    instead of queueing one job after another; returns their results in order, re-raising the
    first failure. Threads inherit the caller's local properties (job group, scheduler pool)."""
    if len(jobs) == 1:
        return [jobs[0]()]
    results: list[object] = [None] * len(jobs)
    errors: list[BaseException | None] = [None] * len(jobs)

    def run(i: int, job: Callable[[], object]) -> None:
        try:
            results[i] = job()
        except BaseException as exc:  # re-raised in the caller's thread below
            errors[i] = exc

    threads = [InheritableThread(target=run, args=(i, job)) for i, job in enumerate(jobs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for exc in errors:
        if exc is not None:
            raise exc
    return results
