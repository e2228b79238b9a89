"""What the operators of this subpackage share: reading, cutting lineage, Arrow batches, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that go to Python workers hold about this many bytes, however long single texts are.
BATCH_BYTES = 20 << 20
#: Spark's setting that removes a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """`prefix`, with underscores in front until no column of `docs` begins with it (in any case)."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def without(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """`docs` without columns of these names, in any case: what an operator returns takes their place."""
    taken = {n.lower() for n in names}
    return docs.drop(*(c for c in docs.columns if c.lower() in taken))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, where that is unset, what
    setCheckpointDir was given. A local session without either gets a folder of its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='tidepanel-')}"
        if not current.isDefined():
            context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, for `written` tables that `removed` takes away together."""
    return f"{shared_folder(spark).rstrip('/')}/tidepanel/{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder. What was made from its tables must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`df` written as Parquet below the shared folder (or in a scratch folder) and read again: cuts lineage, survives
    lost executors. Shuffle files of the job are of no more use then, and go."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, columns: Sequence[str], schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = BATCH_BYTES
) -> DataFrame:
    """`work` over the Arrow batches of `columns`, whose sizes are bounded in bytes. Spark reads the bound when it runs the
    result: one with another `most` has to run before the next call."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df.select(*columns).mapInArrow(work, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def connected_components(edges: DataFrame, most_rounds: int = 60, folder: str | None = None) -> DataFrame:
    """(node, component) of every node of `edges` (columns a, b): the smallest node reachable.

    Alternates large-star and small-star steps on the edge table, so no node's neighbours are ever gathered in one
    task: each step is a minimum per key (pre-aggregated before its shuffle) and an equi-join that Spark can split.
    Stops once a round changes nothing. Self-loops only name isolated nodes. Empty edges give an empty table. Rounds
    are written in `folder`, a scratch folder, if one is given.
    """
    own = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        folder,
    )
    state = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == state or not sign[0]:
            break
        state = tuple(sign)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), folder)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return own.join(now.withColumnRenamed("u", "node").withColumnRenamed("v", "component"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
