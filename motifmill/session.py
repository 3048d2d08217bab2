"""Session helpers shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def build_session(app: str = "motifmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _scratch(prefix: str) -> str:
    """A folder of this process, deleted when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset a local master (tests, a
    single machine) gets a temporary folder; any other master raises, as its executors share no local folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _scratch("motifmill-checkpoints-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later jobs read it instead of redoing it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table beside the checkpoints: for wide tables of which later jobs read few columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, to be shuffled. Counts ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_motifmill_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(_scratch("motifmill-")) / "motifmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    context._motifmill_shipped = True
