"""Problem 9: evaluation texts leaking into training text.

Method: SimHash of item-sized windows with a multi-index over Hamming blocks.  A
window of 22 words is cut into blocks of five words; a block's 64-bit fingerprint
is the bitwise majority of its five position-tagged word hashes.  At most three
changed words (or words put in or left out) leave one of four disjoint blocks
untouched, so looking up blocks exactly finds every window within the radius; by
the q-gram lemma such a window even shares three blocks.  Candidates are verified
exactly: shared word weight first, then the alignment of the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .bloom import Bloom
from .words import Words, chunks, mix, words

WINDOW, CHANGES, BLOCK = 22, 3, 5
LEAST_BLOCKS = WINDOW - BLOCK + 1 - CHANGES * BLOCK
PIECE = 2000  # words of a document that are aligned at once
MAX_INDEX = 4_000_000  # item blocks that are sent to every executor; beyond, documents and items meet by a join


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of every block of BLOCK words within one text, and the block's first word."""
    m = len(w.hash) - BLOCK + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = []
    for i in range(BLOCK):
        x = w.hash[i : m + i]
        r = np.uint64(9 * i + 1)
        h.append((x << r) | (x >> (np.uint64(64) - r)))
    # Bitwise majority of five by two full adders and the carries.
    s1 = h[0] ^ h[1] ^ h[2]
    c1 = (h[0] & h[1]) | (h[2] & (h[0] ^ h[1]))
    s2 = s1 ^ h[3] ^ h[4]
    c2 = (s1 & h[3]) | (h[4] & (s1 ^ h[3]))
    major = (c1 & c2) | ((c1 | c2) & s2)
    keep = np.flatnonzero(w.row[:m] == w.row[BLOCK - 1 :])
    return major[keep], keep


def item_body(text: str | None) -> str:
    """An item without its suite's instruction, which is the first paragraph if there are several."""
    parts = re.split(r"\n\s*\n", text or "")
    return "\n\n".join(parts[1:]) if len(parts) > 1 else (text or "")


class ItemIndex:
    """The blocks of all items, sorted by fingerprint."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.asarray(ids, np.int64)
        self.words = words([item_body(t) for t in texts])
        f, at = fingerprints(self.words)
        order = np.argsort(f, kind="stable")
        self.print, self.at = f[order], at[order]
        self.item = self.words.row[self.at]
        bits = 22
        self.bits = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(mix(self.print) >> self.bits).astype(np.int64)] = True
        u, c = np.unique(self.words.hash, return_counts=True)
        self.weights = (u, 1 / (1 + np.log(c)))

    def body(self, item: int) -> np.ndarray:
        return self.words.hash[self.words.first[item] : self.words.first[item + 1]]

    def may_hold(self, body: np.ndarray, text: np.ndarray) -> bool:
        """Weighted words in common: the unchanged words of a window weigh at least as much as the lightest of the item."""
        u, v = self.weights
        w = v[np.minimum(np.searchsorted(u, body), len(u) - 1)]
        return w[np.isin(body, text)].sum() >= np.sort(w)[: WINDOW - CHANGES].sum() - 1e-9


def window_within(item: np.ndarray, text: np.ndarray) -> bool:
    """Do WINDOW consecutive words of the item stand in the text in order with at most CHANGES changes?

    For each start in the item, the furthest reach with e changes is followed along
    all diagonals at once (the changes are substitutions, insertions and deletions).
    """
    n, m = len(item), len(text)
    if n < WINDOW or m < WINDOW - CHANGES:
        return False
    eq = item[:, None] == text[None, :]
    # run[i, j]: length of the equal run from (i, j).
    run = np.zeros((n + 1, m + 1), np.int16)
    for i in range(n - 1, -1, -1):
        run[i, :m] = np.where(eq[i], run[i + 1, 1:] + 1, 0)
    start = np.argwhere(eq)
    if not len(start):
        return False
    i0 = start[:, 0]
    # A window may begin with changed words: allow the first equal word to come after e of them.
    # reach[d]: item position reached on text shift d in -CHANGES..CHANGES.
    D = 2 * CHANGES + 1
    for skipped in range(CHANGES + 1):
        goal = i0 - skipped + WINDOW
        ok = (i0 - skipped >= 0) & (goal <= n)
        a, g = start[ok], goal[ok]
        if not len(a):
            continue
        i = np.full((len(a), D), -1, np.int64)
        i[:, CHANGES] = a[:, 0] + run[a[:, 0], a[:, 1]]
        base = a[:, 1] - a[:, 0]
        shift = np.arange(-CHANGES, CHANGES + 1)[None, :]
        for e in range(skipped, CHANGES + 1):
            best = i.max(1)
            if (best >= g).any():
                return True
            if e == CHANGES:
                break
            new = np.where(i >= 0, i + 1, -1)
            new[:, 1:] = np.maximum(new[:, 1:], i[:, :-1])  # a word put in
            new[:, :-1] = np.maximum(new[:, :-1], np.where(i[:, 1:] >= 0, i[:, 1:] + 1, -1))  # a word left out
            j = new + base[:, None] + shift
            on = (new >= 0) & (j >= 0) & (j <= m)
            new = np.where(new >= 0, np.minimum(new, n), -1)
            i = np.where(on, new + run[np.clip(new, 0, n), np.clip(j, 0, m)], np.where((new >= 0) & (j > m), np.minimum(new, n), -1))
        # Changes left over at the end stand for changed last words.
    return False


def _spans(doc: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which sorted hits have LEAST_BLOCKS hits of their pair within one window's length."""
    k = LEAST_BLOCKS - 1
    ok = np.zeros(len(doc), bool)
    if len(doc) > k:
        near = (pair[k:] == pair[:-k]) & (doc[k:] - doc[:-k] <= WINDOW - BLOCK + CHANGES)
        for i in range(k + 1):
            ok[i : len(doc) - k + i] |= near
    return ok


def find(index: ItemIndex, ids: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """(document id, item id) of every leak in the texts."""
    w = words(texts)
    f, at = fingerprints(w)
    hit = np.flatnonzero(index.seen[(mix(f) >> index.bits).astype(np.int64)]) if len(f) else np.zeros(0, np.int64)
    if not len(hit) or not len(index.print):
        return []
    f, at = f[hit], at[hit]
    lo, hi = np.searchsorted(index.print, f, "left"), np.searchsorted(index.print, f, "right")
    n = hi - lo
    rep = np.repeat(np.arange(len(f)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[rep]
    doc = w.row[at[rep]]
    item = index.item[k]
    place = at[rep] - w.first[doc]
    pair = doc.astype(np.int64) * len(index.ids) + item
    order = np.lexsort((place, pair))
    pair, place = pair[order], place[order]
    good = _spans(place, pair)
    pair, place = pair[good], place[good]
    edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True]))) if len(pair) else np.zeros(0, np.int64)
    out = []
    for lo_, hi_ in zip(edge[:-1], edge[1:], strict=True):
        d, i = int(pair[lo_] // len(index.ids)), int(pair[lo_] % len(index.ids))
        body, text = index.body(i), w.hash[w.first[d] : w.first[d + 1]]
        if any(index.may_hold(body, x) and window_within(body, x) for x in _pieces(text, place[lo_:hi_])):
            out.append((int(ids[d]), int(index.ids[i])))
    return out


def _pieces(text: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of the text around the hits; overlapping parts of bounded length where hits go on for long."""
    far = np.flatnonzero(np.diff(place) > WINDOW + CHANGES) + 1
    for hits in np.split(place, far):
        a, b = max(0, int(hits[0]) - WINDOW), int(hits[-1]) + BLOCK + WINDOW
        for s in range(a, b, PIECE):
            yield text[s : min(b, s + PIECE + 2 * WINDOW)]


def leaked(documents: DataFrame, items: DataFrame, max_index: int = MAX_INDEX) -> DataFrame:
    """(doc_id, item_id): every document that holds at least WINDOW consecutive words of the item with at most CHANGES changed.

    Null and empty texts match nothing; items of fewer than WINDOW words are never found.
    Items are sent to the executors if their blocks are at most `max_index`; a larger
    set of items meets the documents in a join on block fingerprints.
    """
    spark = documents.sparkSession
    known = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    size = known.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    docs = documents.select("doc_id", "text").filter(F.length("text") > 0)
    if size > max_index:
        return _by_join(docs, known)
    rows = known.collect()
    index = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])
    state: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "i" not in state:
            state["i"] = ItemIndex([x[0] for x in index.value], [x[1] for x in index.value])
        for big in batches:
            for pdf in chunks(big, "text"):
                yield pd.DataFrame(find(state["i"], pdf["doc_id"].to_numpy(), pdf["text"].tolist()), columns=["doc_id", "item_id"])

    return docs.mapInPandas(run, "doc_id long, item_id long").distinct()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for big in batches:
        for pdf in chunks(big, "text"):
            w = words(pdf["text"].tolist())
            f, at = fingerprints(w)
            row = w.row[at]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "at": at - w.first[row], "f": f.view(np.int64)})


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same result for any number of items: blocks meet in a shuffle join, then the places of the hits are verified.

    Blocks of documents that no item has are dropped where they are read (Bloom filter).
    """
    body = F.when(F.col("text").rlike(r"\n\s*\n"), F.regexp_replace("text", r"^(?s)(?:(?!\n\s*\n).)*\n\s*\n", "")).otherwise(F.col("text"))
    schema = "id long, at int, f long"
    right = cut(items.select(F.col("item_id").alias("id"), body.alias("text")).mapInPandas(_blocks, schema).select(F.col("id").alias("item_id"), "f").distinct())
    known = Bloom(right.select(F.col("f").alias("k")))

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            yield pdf[known.may_hold(pdf["f"].to_numpy(np.int64))]

    left = docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(of_items, schema).select(F.col("id").alias("doc_id"), F.col("at").alias("place"), "f")
    hits = left.join(right, "f").select("doc_id", "item_id", "place").distinct()
    w = Window.partitionBy("doc_id", "item_id").orderBy("place")
    near = hits.withColumn("ahead", F.lead("place", LEAST_BLOCKS - 1).over(w)).filter(F.col("ahead") - F.col("place") <= WINDOW - BLOCK + CHANGES)
    pairs = near.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    full = pairs.join(docs, "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for t, x, places in zip(pdf["text"], pdf["item"], pdf["places"], strict=True):
                a, b = words([t]).hash, words([item_body(x)]).hash
                ok.append(any(window_within(b, part) for part in _pieces(a, np.asarray(places))))
            yield pdf.loc[ok, ["doc_id", "item_id"]]

    return full.mapInPandas(verify, "doc_id long, item_id long").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents): the items that leaked and into how many documents."""
    return leaked(documents, items).join(items.select("item_id", "suite").distinct(), "item_id").groupBy("item_id", "suite").agg(F.countDistinct("doc_id").alias("n_documents"))
