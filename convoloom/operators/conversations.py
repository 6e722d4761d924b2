"""Projections and filters over conversations held as arrays of interactions.

Interactions are ARRAY<STRUCT<query, think, answer>> (think may be missing in other
data).  A null array counts as empty.  Everything is done inside the row with
higher-order functions; nothing is exploded unless the result has a row per turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import order


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"\S")


def latest_rows(df: DataFrame, key: str, order: str = "ingested_at", columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per key: that of the greatest `order`; rows without a key are left out.

    An aggregation of whole rows with map-side combine.  Of rows that tie in `order`
    one whole row is kept.  Only the named columns are read, if any are named.
    """
    rest = [c for c in (df.columns if columns is None else columns) if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def turns(df: DataFrame, key: str) -> DataFrame:
    """(c, turn_index, query, reasoning, answer): one row per interaction; rows without interactions give none."""
    return df.select(F.col(key).alias("c"), F.posexplode("interactions").alias("turn_index", "i")).select("c", "turn_index", F.col("i.query").alias("query"), F.col("i.think").alias("reasoning"), F.col("i.answer").alias("answer"))


def nonempty(df: DataFrame) -> DataFrame:
    """Rows whose interactions all have a query and an answer; an empty or null array passes."""
    return df.filter(F.coalesce(F.forall("interactions", lambda x: ~blank(x["query"]) & ~blank(x["answer"])), F.lit(True)))


def by_length(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows with a number of interactions within bounds; 0 or None switches a bound off."""
    n = F.coalesce(F.size("interactions"), F.lit(0))
    n = F.when(F.col("interactions").isNull(), 0).otherwise(n)
    keep = F.lit(True)
    if least:
        keep = keep & (n >= least)
    if most:
        keep = keep & (n <= most)
    return df.filter(keep)


def length_histogram(df: DataFrame) -> DataFrame:
    n = F.when(F.col("interactions").isNull(), 0).otherwise(F.size("interactions"))
    return df.groupBy(n.alias("n_interactions")).agg(F.count("*").alias("n"))


def stats(df: DataFrame, key: str) -> DataFrame:
    """n_interactions and characters of query, think and answer of each row."""
    size = lambda x: F.length(F.concat_ws("", x["query"], x["think"], x["answer"]))
    return df.select(F.col(key), F.when(F.col("interactions").isNull(), 0).otherwise(F.size("interactions")).alias("n_interactions"), F.coalesce(F.aggregate("interactions", F.lit(0).cast("long"), lambda a, x: a + size(x)), F.lit(0)).cast("long").alias("n_chars"))


def marked_text(interactions: Column, least_think: int = 10) -> Column:
    """`[Q] q [T] think [A] a`, without the think part if it has no more than `least_think` characters."""

    def one(x: Column) -> Column:
        q, t, a = (F.trim(T.text(x[k])) for k in ("query", "think", "answer"))
        return F.when(F.length(t) > least_think, F.concat(F.lit("[Q] "), q, F.lit(" [T] "), t, F.lit(" [A] "), a)).otherwise(F.concat(F.lit("[Q] "), q, F.lit(" [A] "), a))

    return F.transform(interactions, one)


def transcript(interactions: Column) -> Column:
    """Numbered transcript with reasoning, `(none)` where it is blank."""

    def one(x: Column, i: Column) -> Column:
        think = F.when(blank(x["think"]), F.lit("(none)")).otherwise(x["think"])
        return F.concat(F.lit("[Turn "), i.cast("string"), F.lit("]\nUser: "), T.text(x["query"]), F.lit("\nReasoning: "), think, F.lit("\nAssistant: "), T.text(x["answer"]), F.lit("\n"))

    return F.regexp_replace(F.array_join(F.transform(interactions, one), "\n"), r"\s+$", "")


def plain_transcript(interactions: Column) -> Column:
    """User and assistant lines without reasoning; blank segments are skipped."""

    def one(x: Column) -> Column:
        return F.concat_ws("\n", F.when(~blank(x["query"]), F.concat(F.lit("User: "), x["query"])), F.when(~blank(x["answer"]), F.concat(F.lit("Assistant: "), x["answer"])))

    return F.array_join(F.filter(F.transform(interactions, one), lambda s: s != ""), "\n")


def messages(interactions: Column) -> Column:
    """array<struct<role, content>> of the segments that are not blank."""
    pair = lambda x: F.array(F.struct(F.lit("user").alias("role"), x["query"].alias("content")), F.struct(F.lit("assistant").alias("role"), x["answer"].alias("content")))
    return F.filter(F.flatten(F.transform(interactions, pair)), lambda m: ~blank(m["content"]))


def variants(df: DataFrame, key: str, kinds: tuple[str, ...] = ("reasoning", "instruct", "mixed"), keep: float = 0.5, seed: int = 42) -> DataFrame:
    """Each row once per kind: id `key:kind`, thinks kept, dropped, or kept for a seeded share of the turns.

    Which turns a mixed variant keeps depends only on the seed, the key and the
    position, so it is the same on any cluster.
    """
    unknown = set(kinds) - {"reasoning", "instruct", "mixed"}
    if unknown:
        raise ValueError(f"unknown variants: {sorted(unknown)}")
    x = df.select(F.col(key).alias("k"), "interactions", F.explode(F.array(*map(F.lit, kinds))).alias("variant"))
    draw = lambda i: T.uniform(seed, F.col("k"), i)
    drop = lambda i: (F.col("variant") == "instruct") | ((F.col("variant") == "mixed") & (draw(i) >= keep))
    out = F.transform("interactions", lambda v, i: F.struct(v["query"].alias("query"), F.when(~drop(i), v["think"]).alias("think"), v["answer"].alias("answer")))
    return x.select(F.concat_ws(":", F.col("k").cast("string"), "variant").alias("conversation_id"), "variant", out.alias("interactions"))


def example_id(subset: Column, index: Column, content: Column) -> Column:
    """`subset:index:sha1(content)[:12]` with stand-ins for a missing subset or index."""
    return F.concat_ws(":", F.coalesce(subset, F.lit("unknown_subset")), F.coalesce(index.cast("string"), F.lit("unknown_index")), F.substring(F.sha1(content.cast("binary")), 1, 12))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order and no white space; nulls are kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def joined_by_position(a: DataFrame, b: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows of a with the columns of b that stand at the same place in both orders (keys of order_by are unique in each)."""
    place = lambda d: order.running_total(d.withColumns({"_one": F.lit(1), "_key": F.struct(*order_by)}), "_key", "_one", "_place").drop("_one", "_key")
    return place(a).join(place(b).drop(*order_by), "_place").drop("_place")


def common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both with the columns that both have, in a's order."""
    both = [c for c in a.columns if c in b.columns]
    return a.select(*both).unionByName(b.select(*both))


def exclusive_head(new: DataFrame, existing: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The first n new rows per group that the existing ones don't hold."""
    return head_per(new.join(existing.select(key).distinct(), key, "left_anti"), by, [key], n)


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows of the whole table: the n smallest hashes of seed and key."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def subset_counts(df: DataFrame, by: str = "_subset") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def first_of(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row of each value of `by`; a null value is one of its own."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, *(F.col(f"r.{c}").alias(c) for c in rest))


def head_per(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group.

    A group-limit is pushed below the shuffle by Catalyst, so a hot group sends at most n rows a partition.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_per(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows per group: the n smallest hashes of seed and key; repeatable on any cluster."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return head_per(df.withColumn("_h", h), by, ["_h", key], n).drop("_h")


def split_at(df: DataFrame, key: str, position: int) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the given position in the order of distinct keys; rows without a key come last."""
    bound = order.key_at(df, key, position)
    before = F.lit(False) if bound is None else F.coalesce(F.col(key) <= F.lit(bound), F.lit(False))
    return df.filter(before), df.filter(~before)


def append(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Existing rows before new ones; columns missing on one side are null."""
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def identical_rewrites(t: DataFrame) -> DataFrame:
    """Turns whose answer is the previous answer again."""
    prev = F.lag("answer").over(Window.partitionBy("c").orderBy("turn_index"))
    x = t.withColumn("prev", prev)
    return x.filter(~blank(F.col("answer")) & (F.trim("answer") == F.trim("prev"))).select("c", "turn_index")


def seeds(df: DataFrame, key: str, query: str = "query") -> DataFrame:
    """Curated seeds: action, sensitivity, haystack, domain and topic of each query."""
    q = F.trim(T.text(query))
    skip = T.has(q, P.CONTENTLESS) | (F.length(q) < 6)
    return df.select(F.col(key), F.when(skip, "skip").otherwise("keep").alias("action"), F.when(T.has(q, P.SENSITIVE), "sensitive").otherwise("none").alias("sensitivity"), (F.length(q) >= 1500).alias("is_haystack"), T.domain(q).alias("domain"), T.topic(q).alias("topic"))


def extracted(df: DataFrame) -> DataFrame:
    """interactions, and the system text where it isn't blank; rows without interactions are left out."""
    system = F.when(~blank(F.col("system")), F.col("system")) if "system" in df.columns else F.lit(None).cast("string")
    return df.filter(F.col("interactions").isNotNull()).select(system.alias("system"), "interactions")


def stripped(interactions: Column) -> Column:
    """Interactions with white space around query and answer removed; thinks stay."""
    return F.transform(interactions, lambda x: x.withField("query", F.trim(x["query"])).withField("answer", F.trim(x["answer"])))


def materialised(df: DataFrame, repo: str, by: str, key: str, n: int, split: str = "train", seed: int = 42) -> DataFrame:
    """A seeded sample of n rows per subset with its origin and its index within the subset."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy(by).orderBy("_h", key)
    x = df.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return x.withColumns({"_source_repo": F.lit(repo), "_split": F.lit(split), "_sample_index": F.col("_rn") - 1, "_sampling_seed": F.lit(seed)}).drop("_h", "_rn")


def dangling_notes(interactions: Column) -> Column:
    """Self-containment notes: array<struct<turn_index, phrases>> of the answers that lean on dropped reasoning."""
    notes = F.transform(interactions, lambda x, i: F.struct(i.alias("turn_index"), F.regexp_extract_all(T.text(x["answer"]), F.lit("(?i)(" + "|".join(f"(?:{p})" for p in P.DANGLING) + ")"), 1).alias("phrases")))
    return F.filter(notes, lambda v: F.size(v["phrases"]) > 0)
