"""What several operators share: tables in the shared folder, ids, numbering within keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to Python: whole texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keeps the batches of texts that go to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a single machine, an error elsewhere."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor costs no more than reading again. The
    table is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def row_order(df: DataFrame) -> Column:
    """A long that rises with the rows' order: of a table read from files, by the number of the part file and the row's place
    in it (files are read in any order), otherwise by partition."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return F.monotonically_increasing_id()
    part = F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as long)")
    return F.shiftleft(F.coalesce(part, F.lit(0)).cast("long"), 40).bitwiseOR(F.col("_metadata.row_index"))


def row_keys(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The documents as a table of files, and two longs that name a row of it in every scan."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs)
    place = docs.metadataColumn("_metadata")
    return docs, [F.xxhash64(place["file_path"]).alias("file_key"), place["row_index"].alias("row_index")]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def number_within(df: DataFrame, key: list[str], order: list[str], name: str, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """Adds the 0-based place of each row among the rows of its key.

    The order is by bucket (a hash of the order columns, or a given one that rises with them), then by those columns. Rows of a key are numbered bucket by
    bucket and shifted by the sizes of the buckets before, so no task ever holds the rows of a large key.
    Nulls are a key of their own; rows equal in all order columns take any order among themselves.
    """
    at = f"{name}_bucket"
    rows = df.withColumn(at, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    sizes = rows.groupBy(*key, at).agg(F.count("*").alias(f"{name}_size"))
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"{name}_{k}") for k in key], F.col(at).alias(f"{at}_of"), F.coalesce(F.sum(f"{name}_size").over(before), F.lit(0)).alias(f"{name}_shift"))
    inner = Window.partitionBy(*key, at).orderBy(*order)
    ranked = rows.withColumn(name, F.row_number().over(inner) - 1)
    same = F.col(at) == F.col(f"{at}_of")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
    return ranked.join(shift, same).select(*df.columns, (F.col(name) + F.col(f"{name}_shift")).cast("long").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) long pairs: one row (node, root) for each node that has an edge to another, root
    being its component's smallest node. Alternating large and small stars; each round is written to the shared folder."""

    def stars(df: DataFrame, small: bool) -> DataFrame:
        """Each node passes its smallest neighbour to its larger neighbours, or to its smaller ones."""
        near = df if small else df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        met = near.join(least, near.u == least.of)
        if small:
            moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        else:
            moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, now = state, written(stars(stars(now, small=False), small=True))
