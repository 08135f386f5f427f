"""Session, lineage and table helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a checkpoint goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_CUT = RLock()


def local_session(cores: int | str = 8, memory: str = "6g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrylight")
        .config(map=BASE_CONF)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with the machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    spark = df.sparkSession
    shared_folder(spark)
    # a checkpoint keeps the constraints of its plan, also those on columns that it no
    # longer has, and a later union fails on them: take it without any.  The flag is the
    # session's, so only one thread cuts at a time.
    flag = "spark.sql.constraintPropagation.enabled"
    with _CUT:
        before = spark.conf.get(flag, "true")
        spark.conf.set(flag, "false")
        try:
            return df.checkpoint(eager=True)
        finally:
            spark.conf.set(flag, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str, holding: str = "") -> bool:
    """Whether a path is there, and has an entry whose name begins with ``holding``."""
    fs, p = _hadoop(spark, path)
    return fs.exists(p) and (not holding or any(x.getPath().getName().startswith(holding) for x in fs.listStatus(p)))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a finished folder its name; one that got it first stays."""
    fs, p = _hadoop(spark, path)
    _, q = _hadoop(spark, to)
    if fs.exists(q) or not fs.rename(p, q):
        fs.delete(p, True)


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when a file or the files of a folder do: their number, sizes and times."""
    fs, p = _hadoop(spark, path)
    files = [p] if fs.getFileStatus(p).isFile() else [x.getPath() for x in fs.listStatus(p)]
    seen = [fs.getFileStatus(f) for f in files]
    return f"{len(seen)}-{sum(x.getLen() for x in seen)}-{max((x.getModificationTime() for x in seen), default=0)}"


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, such as a manifest."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in place of a file: written beside it first, then renamed."""
    fs, p = _hadoop(spark, path)
    _, beside = _hadoop(spark, path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot put {path} in place")
