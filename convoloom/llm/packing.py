"""Problem 8: filling fixed-capacity containers with items.

Method: space-filling-curve order.  Hashed document vectors are projected to a few
dimensions, documents are range-sorted by the Hilbert key of the projection, and
neighbours along the curve are packed together: within a bounded stretch of the
curve by best fit, longest first.  Only a text longer than the capacity is split.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import chunks, mix, words

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # read on the driver only; executors get the ranks
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIMENSIONS, ORDER = 3, 10
STRETCH = 4096  # neighbouring pieces that are packed against each other


@cache
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(texts: list[str], ranks: bytes) -> np.ndarray:
    """Tokens of each text; ranks is the content of a vocabulary file."""
    e = _encoding(ranks)
    safe = [(t or "").encode("utf-8", "replace").decode("utf-8") for t in texts]
    return np.fromiter(map(len, e.encode_ordinary_batch(safe, num_threads=1)), np.int64, len(texts))


def project(texts: list[str], dimensions: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """[texts, dimensions] grid cells: signed hash sums of the words, scaled by length and spread by a logistic curve."""
    w = words(texts)
    n = np.maximum(np.diff(w.first), 1)
    out = np.empty((len(texts), dimensions), np.int64)
    for d in range(dimensions):
        bit = (mix(w.hash + np.uint64(1001 + d)) >> np.uint64(63)).astype(np.float64) * 2 - 1
        z = np.bincount(w.row, weights=bit, minlength=len(texts)) / np.sqrt(n)
        out[:, d] = np.minimum((1 / (1 + np.exp(-1.7 * z)) * (1 << order)).astype(np.int64), (1 << order) - 1)
    return out


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Position along the Hilbert curve (Skilling's transform), vectorised over rows."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (order - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin number of each piece: longest first, each into the fullest bin that takes it."""
    bins = [0] * len(sizes)
    free: list[tuple[int, int]] = []
    made = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        k = bisect.bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        if room - s > 0:
            bisect.insort(free, (room - s, b))
    return bins


_SIZED = "doc_id long, n_tokens int, key long"
_PLACED = "container_id long, doc_id long, piece int, token_start int, n_tokens int"


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, Hilbert key of each document with at least one token.

    The vocabulary (about 1 MB) is broadcast, so that no executor needs the file.
    """
    with open(path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for pdf in chunks(big, "text"):
                t = pdf["text"].tolist()
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": token_counts(t, ranks.value), "key": hilbert_key(project(t))})

    return documents.select("doc_id", "text").filter(F.length("text") > 0).mapInPandas(run, _SIZED).filter("n_tokens > 0")


def packed(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """container_id, doc_id, piece, token_start, n_tokens.

    Every token of every row lies in exactly one container; containers hold at most
    `capacity` tokens.  Null and empty texts take no room.  Repeated rows are packed
    as often as they come.  The sizes (three numbers a document) are checkpointed before they are
    sorted by range, as the sampling of the ranges would measure all texts once more.
    """
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))
    part = cut(sized(documents, path)).select("key", "doc_id", "n_tokens", pieces.alias("piece"))
    part = part.select("key", "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    along = part.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made = 0
        rest: list[pd.DataFrame] = []
        held = 0

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            b = np.asarray(best_fit(pdf["n_tokens"].tolist(), capacity), np.int64)
            out = pdf.assign(container_id=base + made + b)[["container_id", "doc_id", "piece", "token_start", "n_tokens"]]
            made += int(b.max()) + 1
            return out

        for pdf in batches:
            rest.append(pdf)
            held += len(pdf)
            while held >= STRETCH:
                whole = pd.concat(rest, ignore_index=True)
                yield pack(whole.iloc[:STRETCH])
                rest, held = [whole.iloc[STRETCH:]], held - STRETCH
        if held:
            yield pack(pd.concat(rest, ignore_index=True))

    return along.mapInPandas(run, _PLACED)


def fill_report(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """One row: containers, tokens, the share of room used, and split documents."""
    p = packed(documents, capacity, path)
    c = p.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.sum((F.col("piece") > 0).cast("int")).alias("splits"))
    return c.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("fill"), F.max("t").alias("fullest"), F.sum("splits").alias("n_extra_pieces"))
