"""Sessions, and the package on every Python worker."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: What `cut` and others have written to the shared folder and nobody has discarded, oldest first.
_WRITTEN: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run: the driver serves it as a zip, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="strataweave-")) / "strataweave.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, or in local mode a temporary one if none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        path = tempfile.mkdtemp(prefix="strataweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the plan ends there, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> DataFrame:
    """A frame of one row, its columns computed now and kept as values."""
    row = df.first()
    return df.sparkSession.range(1).select(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(row, df.schema, strict=True)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by `discard` or when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(discard)
    _WRITTEN.append((spark, path))
    return path


def written() -> int:
    """A mark: how many paths there are so far."""
    return len(_WRITTEN)


def discard(since: int = 0, upto: int | None = None) -> None:
    """Delete what was written to the shared folder between two marks.  Frames that read it can't be used any more."""
    for i in range(since, len(_WRITTEN) if upto is None else upto):
        spark, path = _WRITTEN[i]
        if not path:
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended; the folder is the cluster's to clean
            pass
        _WRITTEN[i] = (spark, "")
