"""Sinks.  All write from the executors; only small reports pass through the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, append: bool = False, sort_keys: bool = False) -> int:
    """One record per line, nulls kept, characters as they are; the number of lines written.

    The count is observed while writing, so nothing is computed twice.
    """
    seen = Observation()
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
    return int(seen.get["n"])


def per_subset(df: DataFrame, path: str, column: str = "_subset") -> None:
    """A folder per subset; rows are clustered first, so that no task opens many files."""
    df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("overwrite").partitionBy(column).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def attach(df: DataFrame, scores: DataFrame, key: str, column: str) -> DataFrame:
    """The frame with the column replaced by that of `scores`."""
    return df.drop(column).join(scores.select(key, column), key, "left")


def bundle(df: DataFrame, path: str, column: str = "_subset") -> None:
    """A data set as a folder per subset (`subsets`), a table of all rows (`all`) and the number of rows of each as CSV (`summary`)."""
    per_subset(df, f"{path}/subsets", column)
    df.write.mode("overwrite").parquet(f"{path}/all")
    csv(df.groupBy(column).agg(F.count("*").alias("n")), f"{path}/summary")


def reports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as CSV below the path."""
    for name, df in tables.items():
        csv(df, f"{path}/{name}")


def markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A report table as text; at most `limit` rows reach the driver, which is what a report shows."""
    rows = df.limit(limit).collect()
    if not rows:
        return f"## {title}\n\nNo data.\n"
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def text(spark: SparkSession, content: str, path: str) -> None:
    """A small text file, on any file system that Spark reaches; an existing one is replaced."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def report(spark: SparkSession, tables: dict[str, DataFrame], title: str, path: str, limit: int = 100) -> None:
    """A report of several tables: one Markdown text, and each table as CSV."""
    reports(tables, f"{path}/tables")
    text(spark, f"# {title}\n\n" + "\n".join(markdown(df, name, limit) for name, df in tables.items()), f"{path}/report.md")


def filtered(kept: DataFrame, prevalence: DataFrame, path: str) -> None:
    """Records that passed as Parquet under a new path, beside the prevalence of each detector (one row each) as JSON."""
    kept.write.mode("errorifexists").parquet(f"{path}/records")
    rows = {r["detector"]: {k: v for k, v in r.asDict().items() if k != "detector"} for r in prevalence.collect()}
    text(kept.sparkSession, json.dumps(rows, indent=1, sort_keys=True), f"{path}/prevalence.json")


def audit(summary: DataFrame, counts: DataFrame, settings: dict, path: str) -> None:
    """What one run produced, as JSON: its settings, its summary (one row) and its counts by kind."""
    row = summary.first()
    n: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # a row per kind
        n.setdefault(r["part"], {})[r["name"]] = r["n"]
    text(summary.sparkSession, json.dumps({"settings": settings, "summary": row.asDict() if row else {}, "counts": n}, indent=1, sort_keys=True, default=str), path)


def partial(stream: DataFrame, path: str, checkpoint: str, every: int | None = None) -> list[int]:
    """Batches of a stream of results appended as they come; returns the numbers of those whose write failed.

    A failed write is noted and the run goes on; its rows are written with the next batch that succeeds.
    """
    failed: list[int] = []
    waiting: list[DataFrame] = []

    def push(batch: DataFrame, number: int) -> None:
        waiting.append(batch.withColumn("_batch", F.lit(number)).persist())
        if every and (number + 1) % every:
            return
        try:
            rows = waiting[0]
            for w in waiting[1:]:
                rows = rows.unionByName(w)
            rows.write.mode("append").parquet(path)
        except Exception:  # noqa: BLE001  a sink that fails must not lose the run
            failed.append(number)
            return
        for w in waiting:
            w.unpersist()
        waiting.clear()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(push).start().awaitTermination()
    if waiting:  # the last batches of a run that ended between two pushes
        for w in waiting:
            w.write.mode("append").parquet(path)
            w.unpersist()
    return failed


def clean_utf8(c: Column) -> Column:
    """Text of a binary column: broken bytes replaced, a byte-order mark or control characters in front removed."""
    return F.regexp_replace(F.make_valid_utf8(c.cast("string")), r"^[\x{FEFF}\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}]+", "")
