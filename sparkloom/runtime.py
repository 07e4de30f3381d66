"""Session helpers shared by all operators: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Texts that go to a Python worker together; Spark's own 10,000 hold hundreds of MB a task where texts are long.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or directory under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep its rows in the shared checkpoint folder, and read them from there on.

    Rows survive the loss of any executor. Meant for narrow tables (keys, digests, counts), not texts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged; its session sends at most BATCH_ROWS rows an Arrow batch from here on (a lower setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def stored(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """As ``cut``, but as compressed Parquet, at ``path`` or in the checkpoint folder; meant for tables that are read more than once.

    ``by`` names a column whose values get a folder each.
    """
    if path is None:
        path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name of its own in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where it is not there."""
    fs, p = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file if nobody has; false if it is there already. The text is put in place by a rename, whole or not at all.

    This asks for a file system with exclusive create and atomic rename, such as HDFS or a shared disk. Most object stores have neither, so
    that one writer at a time must be seen to by other means there. A writer that dies before its rename leaves a ``.lock`` file, which must be
    removed by hand.
    """
    fs, p = _file_system(spark, path)
    if fs.exists(p):
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs.mkdirs(p.getParent())
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
        fs.create(lock, False).close()  # exclusive: of two writers one gets an error
    except Exception:
        fs.delete(part, False)
        return False
    return bool(fs.rename(part, p))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove files and folders, as far as they are there."""
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file or folder of files: another pair says that something was written."""
    fs, p = _file_system(spark, path)
    files = fs.listStatus(p)
    return sum(f.getLen() for f in files), max([f.getModificationTime() for f in files], default=0)


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
