"""Sessions: settings for tests and benchmarks, and this package's code for a cluster's workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", name: str = "sextant", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on one machine; on a cluster the submitter's settings hold and this isn't used."""
    settings = {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.files.openCostInBytes": "1m",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for whatever a job writes down on its way. Without one a temporary folder
    serves where all runs on one machine; elsewhere that is an error, as executors couldn't write there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sextant-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts df's lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch: texts may be long, and a worker holds a batch as Arrow's and as Python's.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the size of Arrow batches so that a Python worker holds few texts at once; never raises it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a context: they may not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package, folder = Path(__file__).parent, tempfile.mkdtemp(prefix="sextant-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, f"{folder}/code/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/code"))
