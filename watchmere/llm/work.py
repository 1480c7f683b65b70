"""Work tables: intermediate results written to the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a folder of its own that
    goes when Python ends; on a cluster that is an error, as executors couldn't share it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="watchmere-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs held now: shuffle files, which else stay until the driver's next garbage collection, and freed memory.

    The C library keeps what the JVM's compiler and Python's arrays have freed; the
    driver gives it back to the system here.  Results don't depend on this.
    """
    import pyarrow as pa

    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Py4JError):  # a JVM without this command
        named, kinds, none = jvm.Class.forName, spark._sc._gateway.new_array(jvm.Class, 4), spark._sc._gateway.new_array(jvm.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        none[0], none[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is not open to Py4J, its interface is
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), none)


class Work:
    """A folder of Parquet tables that cut lineage: what is read back survives lost executors and isn't computed again.

    A table goes as soon as drop() names it; those that a returned DataFrame still reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}", 0
        self.tables: dict[str, list[str]] = {}

    def save(self, df: DataFrame, name: str = "t", replace: bool = False) -> DataFrame:
        """df, written and read back; replace: earlier tables of this name go afterwards."""
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        schema = df.schema
        df.write.parquet(path)
        if replace:
            self.drop(name)
        self.tables.setdefault(name, []).append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; nothing may read them any more."""
        for name in names:
            for path in self.tables.pop(name, []):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """As release()."""
        release(self.spark)


LOWEST = -(1 << 63)


def one_per_id(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, doc (the id, a null one as LOWEST), text (a null one as empty) and times.

    Rows that repeat an id become one with the smallest of their texts, and times
    says how many there were.  Only ids are shuffled to see whether any repeats.
    """
    from pyspark.sql import functions as F

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if docs.groupBy("doc").count().filter("count > 1").limit(1).collect():
        return work.save(docs.groupBy("doc_id", "doc").agg(F.min("text").alias("text"), F.count("*").alias("times")), "once")
    return docs.withColumn("times", F.lit(1).cast("long"))


def spare_name(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column has it (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sort_globally(df: DataFrame, *columns: str) -> DataFrame:
    """df range partitioned by columns and sorted by them: equal leading columns may span tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
