"""Session factory, table loader and durable intermediate results."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(app: str = "quarry", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, ANSI)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps become session-zone (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none, in local mode; on a cluster that is an error.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(there)
        return there
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def trim_driver(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed outside its heap to the system; whether that was done.

    Compiling generated code and planning take native memory in many threads, and the C library keeps what they free: over the stages
    of a pipeline some hundred MB. Java has a command for it (``System.trim_native_heap``), on Linux alone; it takes about 35 ms.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: the class of ``beans`` is closed to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        return invoke.invoke(beans, args).startswith("Trim native heap")
    except Py4JError:
        return False  # another JVM


def durable(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared checkpoint folder (lineage is cut).

    A checkpoint keeps the estimated size of its plan, which multiplies the sizes at every join: in a loop its digits double each
    round, until they fill the driver's memory. An estimate that 64 bits do not hold decides nothing and is dropped.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint()
    plan = kept._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 2**63:
        return kept
    session, jvm = df.sparkSession, df.sparkSession._jvm
    none = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, session._jsparkSession, none, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, bare), session)
