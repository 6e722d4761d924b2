"""Readers with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import JUDGMENT

JUDGE_LOG = (
    "seq long, _eval_id string, _model string, _status string, _latency_seconds double, _finish_reason string, "
    "_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,reasoning_tokens:int>, "
    "_example_stats struct<n_interactions:int,has_system:boolean,prompt_chars:int>, _source_repo string, _subset string, _split string, _sample_index int, "
    f"judgment {JUDGMENT.simpleString()}, error_type string, error string"
)
SEEDS = "query string, prompt string, question string, instruction string, text string, messages array<struct<role:string,content:string>>, conversation array<struct<role:string,content:string>>, dataset string, category string, lang string, is_haystack boolean"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def seeds(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Seeds as lines or as one array, told apart by the first character; column `seed` is the extracted query.  `most` is the caller's limit of a run."""
    head = spark.read.text(path).filter(F.col("value").rlike(r"\S")).limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    rows = (json_array if many else jsonl)(spark, path, SEEDS).withColumn("seed", seed_query())
    return rows if most is None else rows.limit(most)


def seed_query():
    """The first of the query columns that isn't blank, else the first message."""
    clean = lambda c: F.when(c.rlike(r"\S"), F.regexp_replace(c, r"^\s+|\s+$", ""))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))["content"]
    return F.coalesce(*(clean(F.col(c)) for c in ("query", "prompt", "question", "instruction", "text")), clean(first("messages")), clean(first("conversation")))


def in_memory(spark: SparkSession, items: list[str | dict]) -> DataFrame:
    """(position, seed, dataset, category, lang, is_haystack) from texts or objects given by the caller."""
    rows = [{"query": x} if isinstance(x, str) else x for x in items]
    lines = [(i, json.dumps(x)) for i, x in enumerate(rows)]
    x = spark.createDataFrame(lines, "position long, line string").select("position", F.from_json("line", SEEDS).alias("s"))
    return x.select("position", "s.*").withColumn("seed", seed_query()).select("position", "seed", "dataset", "category", "lang", "is_haystack")


def _listed(spark: SparkSession, folder: str) -> list[str] | None:
    """Names of the Parquet files or folders in a folder of any file system that Spark reaches; None if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return None
    return sorted(n[:-8] for n in (x.getPath().getName() for x in fs.listStatus(path)) if n.endswith(".parquet"))


def dataset(spark: SparkSession, root: str, subset: str, split: str | None = None) -> DataFrame:
    """A subset's folder, in it the wanted split, or the only one; a split named like the subset also serves."""
    root = root.rstrip("/")
    for folder in (f"{root}/{subset}", root):
        names = _listed(spark, folder)
        if names is None:
            continue
        pick = split if split in names else subset if folder == root and subset in names else names[0] if folder != root and len(names) == 1 else None
        if pick:
            return spark.read.parquet(f"{folder}/{pick}.parquet")
    raise ValueError(f"no split {split!r} of {subset!r} below {root}")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at the path, or None if there is nothing at it; a table that can't be read is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def model_logs(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The attempts of several models' JSON-lines logs in one table, and the models without a log.

    A row without a model's name gets that of its file.
    """
    out, missing = None, []
    for model, path in sorted(paths.items()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            missing.append(model)
            continue
        rows = jsonl(spark, path, JUDGE_LOG).withColumn("_model", F.coalesce("_model", F.lit(model)))
        out = rows if out is None else out.unionByName(rows)
    return (spark.createDataFrame([], JUDGE_LOG) if out is None else out), missing
