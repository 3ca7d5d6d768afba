"""Session helpers: the shared work folder, table reading."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this library's modules, once a session, wherever it was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    name = Path(tempfile.mkdtemp(prefix="corpusloom-code-")) / "corpusloom_code.zip"
    atexit.register(shutil.rmtree, name.parent, ignore_errors=True)
    with zipfile.ZipFile(name, "w") as z:
        for f in [*sorted((root / "corpusloom").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    _shipped.add(app)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent in a local session, as in tests, a temporary
    folder is made, set as the checkpoint folder and removed at exit; on a cluster
    its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = _own.get(spark.sparkContext.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        _own[spark.sparkContext.applicationId] = found
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


_own: dict[str, str] = {}


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    for made in _watched:
        made.append(path)
    return path


_watched: list[list[str]] = []


@contextlib.contextmanager
def created():
    """The work folders named while the context is open, in order, so that a caller can remove what it no longer needs."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def local_path(uri: str) -> str:
    """The mounted path of a shared-folder URI."""
    if m := re.match(r"file:(?://[^/]*)?(/.*)", uri):
        return m[1]
    if re.match(r"[a-zA-Z][\w+.-]+:", uri):
        raise ValueError(f"{uri}: indexes are memory-mapped, so spark.checkpoint.dir must be a mounted path")
    return uri


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Spark's own file system client."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def materialize(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut lineage: write to the shared folder (options: the Parquet writer's) and read back."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
