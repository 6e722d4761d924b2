"""Problem 2: near-duplicate records with small edits.

Method: sequential Bayesian verification.  Records are bags of words; the k-th
occurrence of a word is a token of its own, so the Jaccard similarity of token
sets is the similarity of bags.  Banded min-hashes give candidates; batches of a
separate signature are compared one after another, and a candidate is pruned as
soon as the posterior probability of its being similar falls under the chosen
miss probability; survivors are verified exactly on their words.

Identical bags are one class from the start: one representative goes on, and the
pairs of copies are written from the membership.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bloom import Bloom
from .words import blocks, mix, occurrence, words

THRESHOLD = 0.8
BANDS, ROWS = 56, 9  # misses a pair of similarity 0.8 with probability 3e-4, of 0.85 with 2e-6
CHECK, BATCH = 128, 32
MISS = 1e-4
SPLIT = 256  # members of a bucket that are paired in one task


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _minima(hashes: np.ndarray, first: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """[rows, constants] min-hashes; every row has at least one hash."""
    out = np.empty((len(first) - 1, len(constants)), np.uint32)
    h = hashes.astype(np.uint32) | np.uint32(0)
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    at = first[:-1]
    with np.errstate(over="ignore"):
        for k, c in enumerate(constants):
            a, b = np.uint32(int(c) & 0xFFFFFFFF | 1), np.uint32(int(c) >> 32 | 1)
            x = (h ^ b) * a
            x ^= top
            x *= b
            x ^= x >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(x, at)
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted token hashes of each text, flat, and each text's first position (one more at the end)."""
    w = words(texts)
    with np.errstate(over="ignore"):
        t = mix(w.hash + mix(occurrence(w.hash, w.row).astype(np.uint64) + np.uint64(3)))
    order = np.lexsort((t, w.row))
    return t[order], w.first


_SIGNED = "id long, doc long, n int, bag long, bands array<long>, sig binary"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    band_c, sig_c = _constants(BANDS * ROWS, 17), _constants(CHECK, 91)
    for big in batches:
        for pdf in blocks(big, 400):
            t, first = tokens(pdf["text"].tolist())
            n = np.diff(first)
            keep = np.flatnonzero(n > 0)
            if not len(keep):
                continue
            first = np.concatenate((first[:-1][keep], [len(t)]))
            with np.errstate(over="ignore"):
                bag = mix(np.add.reduceat(mix(t), first[:-1]) + n[keep].astype(np.uint64))
                m = _minima(t, first, band_c).astype(np.uint64).reshape(len(keep), BANDS, ROWS)
                key = np.zeros(m.shape[:2], np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + m[:, :, r] + np.uint64(1))
                key += np.arange(BANDS, dtype=np.uint64)[None, :]
            sig = (_minima(t, first, sig_c) & np.uint32(0xFF)).astype(np.uint8)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[keep], "doc": pdf["doc"].to_numpy()[keep], "n": n[keep], "bag": bag.view(np.int64), "bands": list(mix(key).view(np.int64)), "sig": [x.tobytes() for x in sig]})


def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches at which P(similarity >= threshold) is at least `miss`.

    Uniform prior over similarities; two different hashes agree in their last byte with probability 1/256.
    """
    s = np.linspace(0.0005, 0.9995, 1000)
    p = s + (1 - s) / 256
    out = {}
    for n in range(BATCH, CHECK + 1, BATCH):
        for m in range(n + 1):
            ll = m * np.log(p) + (n - m) * np.log(1 - p)
            w = np.exp(ll - ll.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                out[n] = m
                break
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential comparison of signature batches; pruned candidates leave early."""
    least = least_matches()
    for pdf in batches:
        if not len(pdf):
            continue
        a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint8).reshape(len(pdf), CHECK)
        b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint8).reshape(len(pdf), CHECK)
        alive, match = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        for n, m in least.items():
            match[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
            alive = alive[match[alive] >= m]
        yield pdf.iloc[alive][["a", "b"]]


_SHARED = "a long, b long, similarity double"


def _exact(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for pdf in blocks(big, 1000):
                n = len(pdf)
                t, first = tokens([*pdf["text_a"], *pdf["text_b"]])
                row = np.repeat(np.arange(2 * n), np.diff(first))
                with np.errstate(over="ignore"):
                    k = mix(t + mix((row % n).astype(np.uint64)))
                u, c = np.unique(k, return_counts=True)
                shared = np.bincount(row[: first[n]], weights=(c == 2)[np.searchsorted(u, k[: first[n]])], minlength=n)[:n]
                size = np.diff(first)
                sim = shared / np.maximum(size[:n] + size[n:] - shared, 1)
                ok = sim >= threshold - 1e-12
                yield pd.DataFrame({"a": pdf["a"][ok], "b": pdf["b"][ok], "similarity": sim[ok]})

    return run


def record_texts(mrl: DataFrame) -> DataFrame:
    """(id, text): query, answer and all interactions of each record in one text; repeated deliveries are kept."""
    inner = F.concat_ws("\n", F.flatten(F.transform(F.coalesce("interactions", F.array()), lambda x: F.array(x["query"], x["answer"]))))
    return mrl.select(F.col("record_id").alias("id"), F.concat_ws("\n", "query", "answer", inner).alias("text")).filter(F.col("id").isNotNull())


def _bucket_pairs(bands: DataFrame) -> DataFrame:
    """Distinct id pairs that share a bucket.

    Buckets of one are dropped before any list is built.  A bucket is dealt into
    parts of about SPLIT members, and each pair of parts meets in a group of its
    own, so no task holds a whole hot bucket and no pair is lost.
    """
    size = bands.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = bands.join(size, "k").withColumn("parts", F.ceil(F.col("m") / SPLIT).cast("int")).withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meet = dealt.select("k", "id", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select("k", "id", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    groups = meet.groupBy("k", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("m")).filter(F.size("m") > 1)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for lo, hi, m in zip(pdf["lo"], pdf["hi"], pdf["m"], strict=True):
                ids = np.array([x["id"] for x in m], np.int64)
                p = np.array([x["p"] for x in m])
                i, j = np.triu_indices(len(ids), 1) if lo == hi else (z.ravel() for z in np.meshgrid(np.flatnonzero(p == lo), np.flatnonzero(p == hi), indexing="ij"))
                if len(i):
                    x, y = ids[i], ids[j]
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
                if sum(map(len, a)) > 200_000:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                    a, b = [], []
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return groups.select("lo", "hi", "m").mapInPandas(expand, "a long, b long").distinct()


def similar_representatives(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members) of (id, text).

    members: id, rep: every record with words and the representatives of its bags, one row for
    each bag it was delivered with.  A representative stands for one bag: it is the hash of
    an id and a text, not an id, as an id with several texts has several bags.
    links: a, b, similarity: similar pairs of representatives, a < b.
    Records without words are similar to nothing and have no row.
    """
    texts = texts.filter(F.length("text") > 0).withColumn("doc", F.xxhash64("id", "text"))
    signed = texts.mapInPandas(_sign, _SIGNED)
    members = cut(signed)
    reps = members.groupBy("bag", "n").agg(F.min("doc").alias("rep"))
    membership = members.select("id", "bag", "n").join(reps, ["bag", "n"]).select("id", "rep").distinct()
    own = members.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("id"), "bands", "sig").dropDuplicates(["id"])
    bands = own.select("id", F.explode("bands").alias("k"))
    candidates = _bucket_pairs(bands)
    sig = own.select("id", "sig")
    compared = candidates.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    survivors = cut(compared.mapInPandas(_verify, "a long, b long"))
    # Only texts of survivors are shuffled, once: most others are dropped where they are read.
    ends = survivors.select(F.col("a").alias("k")).unionByName(survivors.select(F.col("b").alias("k")))
    asked = Bloom(ends)

    def of_survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[asked.may_hold(pdf["doc"].to_numpy(np.int64))]

    needed = cut(texts.select("doc", "text").mapInPandas(of_survivors, "doc long, text string").dropDuplicates(["doc"]))
    full = survivors.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b")
    return cut(full.mapInPandas(_exact(threshold), _SHARED)), membership


def similar_pairs(mrl: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id_a, record_id_b) of all distinct ids with similarity of at least `threshold`, a < b.

    Null ids are left out; ids delivered with several texts count if any of them agrees.
    """
    links, members = similar_representatives(record_texts(mrl), threshold)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").drop("c"))
    left = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    return left.join(both, "a").join(right, "b").filter("x < y").select(F.col("x").alias("record_id_a"), F.col("y").alias("record_id_b")).distinct()


def components(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): every record's connected class (its smallest id) and its number of linked records.

    The representatives of a record with several texts are joined like linked ones.

    In a round a record and its label's record take the smallest label's label among the
    record's links, and every label jumps to its own label (pointer doubling).  A label that
    isn't the smallest is hooked to a smaller one itself, so that regions merge whole:
    in a simulation chains of 100, 10,000 and a million records took at most 9, 16 and 22
    rounds.  Rounds go on until no label moves; then the ends of every link agree.  Each round
    is checkpointed.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    members = cut(members)
    several = cut(members.groupBy("id").agg(F.count("*").alias("c"), F.min("rep").alias("first")).filter("c > 1").select("id", "first"))
    same = several.join(members, "id").filter("rep <> first")
    joined = cut(edges.unionByName(same.select(F.col("first").alias("a"), F.col("rep").alias("b"))).unionByName(same.select(F.col("rep").alias("a"), F.col("first").alias("b"))))
    label = cut(members.select(F.col("rep").alias("id")).distinct().withColumn("label", F.col("id")))
    moved = True
    while moved:
        up = label.select(F.col("id").alias("l"), F.col("label").alias("j"))
        jump = label.join(up, label["label"] == up["l"]).select("id", "label", "j")
        near = joined.join(jump.select(F.col("id").alias("b"), "j"), "b").groupBy("a").agg(F.min("j").alias("m"))
        own = jump.join(near, jump["id"] == near["a"], "left").select("id", "label", F.least("j", F.coalesce("m", "j")).alias("to"))
        hooked = own.groupBy(F.col("label").alias("root")).agg(F.min("to").alias("h"))
        new = cut(own.join(hooked, own["id"] == hooked["root"], "left").select("id", "label", F.least("to", F.coalesce("h", "to")).alias("to")))
        moved = new.filter(F.col("to") < F.col("label")).limit(1).count() > 0
        label = new.select("id", F.col("to").alias("label"))
    # Records of one bag each are counted by representatives, pairs with a record of several one by one, as these can meet more than once.
    near = edges.unionByName(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    single = members.join(several, "id", "left_anti")
    sizes = single.groupBy("rep").agg(F.count("*").alias("copies"))
    degree = near.join(sizes, near["b"] == sizes["rep"]).groupBy("a").agg(F.sum("copies").alias("d"))
    plain = single.join(degree, single["rep"] == degree["a"]).select("id", (F.col("d") - 1).alias("links"))
    from_several = members.join(several, "id", "left_semi").select(F.col("id").alias("x"), F.col("rep").alias("a"))
    met = cut(from_several.join(near, "a").join(members.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").filter("x <> y").select("x", "y").distinct())
    back = met.join(several.select(F.col("id").alias("y")), "y", "left_anti").select(F.col("y").alias("id"), F.lit(1).cast("long").alias("links"))
    count = plain.unionByName(met.select(F.col("x").alias("id"), F.lit(1).cast("long").alias("links"))).unionByName(back).groupBy("id").agg(F.sum("links").alias("links"))
    owned = members.join(label.select(F.col("id").alias("rep"), "label"), "rep").select("id", "label").distinct()
    least = owned.groupBy("label").agg(F.min("id").alias("class_id"))
    return owned.join(least, "label").join(count, "id", "left").select("id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicate_classes(mrl: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_id, class_id, links): one row per record with words."""
    links, members = similar_representatives(record_texts(mrl), threshold)
    return components(links, members).select(F.col("id").alias("record_id"), "class_id", "links")
