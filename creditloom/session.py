"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Skewed joins (one question, regulation or chunk holding a large share of the
# rows) are split at run time; partition counts follow the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here are built from many column expressions; recording the Python
    # call site of each one takes longer than planning them.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(name: str = "creditloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in spark.checkpoint.dir.

    Only a session of one process (a local test) may go without: it gets a
    folder of its own, which is removed when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="creditloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """Where all intermediate data of this application lies."""
    return f"{shared_dir(spark)}/creditloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one scratch path, or all that this application has written, once nothing reads it any more."""
    root = scratch_root(spark)
    target = path or root
    if not (target == root or target.startswith(f"{root}/")):
        raise ValueError(f"not a scratch path: {target}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many times: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect plans and broadcasts that nothing refers to, and return native memory it has freed.

    Compiling many plans leaves it with memory that the C library keeps; a JVM that cannot trim that goes on as it is.
    """
    gc.collect()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.gc()
    try:
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        for at, name in enumerate(names):
            kinds[at] = jvm.java.lang.Class.forName(name)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass
