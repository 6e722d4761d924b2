"""The judge log as a stream: append, resume, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judging


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder, or one file; the schema is that of the files already there.

    The path is given as a pattern for itself, since a plain path must be a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


BUCKETS = 256


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, state: str, upto: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest manifest (before batch `upto`): its number, and for each bucket the batch that wrote it."""
    fs, home = _files(spark, f"{state}/manifest")
    numbers = [int(x.getPath().getName()) for x in fs.listStatus(home)] if fs.exists(home) else []
    numbers = [n for n in numbers if upto is None or n < upto]
    if not numbers:
        return -1, {}
    rows = spark.read.parquet(f"{state}/manifest/{max(numbers)}").collect()  # at most one row a bucket
    return max(numbers), {r["bucket"]: r["batch"] for r in rows}


def _buckets(spark: SparkSession, state: str, known: dict[int, int]) -> list[str]:
    return [f"{state}/data/{n}/bucket={b}" for b, n in sorted(known.items())]


def current(spark: SparkSession, state: str) -> DataFrame | None:
    """The latest row per model and id as of the last whole batch; None before the first."""
    number, known = _manifest(spark, state)
    return spark.read.parquet(*_buckets(spark, state, known)) if known else None


def compact(log: DataFrame, state: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keeps the latest row per model and id at `state`, one batch after another.

    The state lies in buckets by hash of the id; a batch rewrites only the buckets it touches,
    under its own number, and then writes the manifest of all buckets.  A batch that is repeated
    after a failure replaces its own output.  Only the last two manifests and the data they name are kept.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("_eval_id"), F.lit(buckets)).cast("int")
        new = judging.latest(batch).withColumn("bucket", bucket).persist()
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old, known = _manifest(spark, state, number)
        held = {b: n for b, n in known.items() if b in set(touched)}
        if held:
            new_ = merge(spark.read.option("basePath", state).parquet(*_buckets(spark, state, held)).select(*(c for c in new.columns if c != "bucket")), new.drop("bucket")).withColumn("bucket", bucket)
        else:
            new_ = new
        new_.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/data/{number}")
        new.unpersist()
        now = {**known, **dict.fromkeys(touched, number)}
        spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/{number}")
        fs, past = _files(spark, f"{state}/manifest")
        for x in fs.listStatus(past):
            if int(x.getPath().getName()) < number - 1:
                fs.delete(x.getPath(), True)
        fs, home = _files(spark, f"{state}/data")
        used = {(b, n) for m in (now, known) for b, n in m.items()}
        for folder in fs.listStatus(home) if fs.exists(home) else []:
            n = int(folder.getPath().getName())
            for x in fs.listStatus(folder.getPath()):
                name = x.getPath().getName()
                if n < number and name.startswith("bucket=") and (int(name[7:]), n) not in used:
                    fs.delete(x.getPath(), True)

    log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The better row of each model and id: an ok row before others, then the later one."""
    x = a.unionByName(b)
    rest = [c for c in x.columns if c not in ("_eval_id", "_model")]
    rank = F.struct(F.coalesce(F.col("_status") == "ok", F.lit(False)), F.col("seq"))
    return x.groupBy("_eval_id", "_model").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("_eval_id", "_model", *(F.col(f"r.{c}").alias(c) for c in rest))


def counts(log: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Attempts per model, status and window of log time; rows later than the watermark are dropped by it."""
    return log.withWatermark("logged_at", late).groupBy(F.window("logged_at", window), "_model", "_status").agg(F.count("*").alias("n"))
