"""Session construction and the shared work area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan in this package assumes.

    On a cluster pass neither argument: the master comes from spark-submit and
    AQE sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName("recollect")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()
#: Spark's own bound on an Arrow batch, and ours: a Python worker holds a batch and what it makes of it.
_ARROW_DEFAULT, _ARROW_BYTES = 64 << 20, 8 << 20
#: Spark's own bound on the tasks that list many files or folders, and ours: with a task for each file, starting tasks is most of the work.
_LIST_DEFAULT, _LIST_TASKS = 10_000, 256


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application.

    The archive goes out through Spark's own file distribution.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="recollect-")) / "recollect.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        # Sessions merge in each task before the shuffle, which spares hot users.
        spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        limit = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(limit).rstrip("bB") == str(_ARROW_DEFAULT):
            spark.conf.set(limit, str(_ARROW_BYTES))
        listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
        if spark.conf.get(listing) == str(_LIST_DEFAULT):
            spark.conf.set(listing, str(max(_LIST_TASKS, 4 * spark.sparkContext.defaultParallelism)))
        _SHIPPED.add(app)
    return spark


_LOCAL_ROOT: dict[str, str] = {}


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory below the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors share one disk, may
    fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOT.setdefault(app, tempfile.mkdtemp(prefix="recollect-"))
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
