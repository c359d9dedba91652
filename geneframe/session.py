"""A session with the settings that the operators expect, and a folder for files that a query writes and reads again."""

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


_FOLDERS: set[str] = set()


def _clean(spark: SparkSession, folder: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already at the end of the program
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, on a local master, a temporary one.
    It is deleted when the program ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared}/{spark.sparkContext.applicationId}-files"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clean, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def session(master: str | None = None, name: str = "geneframe", partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    return b.getOrCreate()
