"""What the operators share: reading tables, shared-folder materialisation, global ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session has none and runs in one process (tests, a laptop) a local folder is used; on a
    cluster every machine would write to its own disk, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shipcheck-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's Arrow batches have at most `rows` rows: whole texts are large, and both a
    task's JVM and its worker hold a batch at a time.  For jobs that run several operators one after the other."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)))))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for the jobs that run inside, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[str], groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds _rank, the row's 0-based position by `order` (in its group, if groups are given).

    One range exchange on (groups, order) splits hot groups and ties evenly; the sorted rows are
    written once with partition number and position, and the offsets come from one count per
    partition and group.  That table has at most (partitions + groups) rows.  Nulls sort first;
    rows equal in every order column get adjacent ranks in an arbitrary order."""
    spark, groups = df.sparkSession, groups or []
    keys = [*groups, *order]
    t = (
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    t = materialise(t, name)
    counts = t.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_pid").alias("_opid"),
        (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_off"),
    )
    on = F.col("_pid") == F.col("_opid")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = t.join(F.broadcast(offsets), on) if not groups else t.join(offsets, on)
    return out.withColumn("_rank", F.col("_idx") + F.col("_off")).drop("_pid", "_idx", "_opid", "_off", *[f"_g{i}" for i in range(len(groups))])


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def id_bucket(n: int) -> Column:
    """crc32 of doc_id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def least_hashed(rows: DataFrame, group: str, most: dict | int, weight: str | None = None, total: int | None = None) -> DataFrame:
    """The distinct rows with _i, their place in their group by the hash of doc_id (then by all columns), up to `most` (one
    number, or by group; nulls are no group).  With `weight`, only while the column's sum stays within `total`, one row at least.

    Only hashes low enough to be among the first are ranked, so what a task holds is bounded."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(group, "_g")
    n = F.lit(most) if isinstance(most, int) else F.coalesce(*[F.when(F.col("_g") == k, v) for k, v in most.items()], F.lit(0))
    hashed = rows.withColumn("_h", F.xxhash64("doc_id")).join(F.broadcast(counts.withColumn("_m", n)), F.col(group) == F.col("_g"))
    near = hashed.where((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("_n") <= 2 * F.col("_m") + 20).distinct()
    order = Window.partitionBy("_g").orderBy("_h", *rows.columns)
    ranked = near.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= F.col("_m"))
    if weight:
        so_far = F.sum(weight).over(Window.partitionBy("_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
        ranked = ranked.withColumn("_sum", so_far).where((F.col("_i") == 1) | (F.col("_sum") <= total))
    return ranked.select(*rows.columns)


def bounded_sample(rows: DataFrame, group: str, most: dict | int, chars: int) -> DataFrame:
    """Whole rows (group, doc_id, text) of a bounded sample: of each group the `most` with the least hash of doc_id, fewer
    where their texts have over `chars` characters together (one at least).

    Ids, hashes and lengths alone are ranked; texts are then fetched by the chosen ids, which are few.  Rows that share
    id and text count once.  The choice doesn't depend on the order of rows."""
    slim = rows.select(group, "doc_id", F.xxhash64("text").alias("_t"), F.length("text").alias("_c"))
    chosen = least_hashed(slim, group, most, "_c", chars).select(F.col(group).alias("_g"), F.col("doc_id").alias("_id"), "_t")
    same = (F.col(group) == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t"))
    return rows.join(F.broadcast(chosen), same, "left_semi").select(group, "doc_id", "text").dropDuplicates()
