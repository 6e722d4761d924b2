"""Problem 10: abusive, hateful or sexual content.

Method: a linear-chain conditional random field tags toxic spans.  Token labels
come from the reviewed documents (a sentence of a positive document whose words
are typical of the category is a span); forward-backward marginals of every
token give document scores and the offending offsets.  Everything but the fit
runs as one map over Arrow batches, in numpy, without a loop per token.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .disguise import plain
from .words import chunks, hash_runs, mix, word_table

CATEGORIES = ("abusive", "hateful", "sexual")
STATES = len(CATEGORIES) + 1  # state 0: nothing
BITS = 19
MAX_LABELLED = 6000  # reviewed documents that the model is fitted on, taken in order of a hash of their id
MAX_TRAIN_CHARS = 20_000  # longer reviewed documents are not used for the fit; scoring reads whole texts
MIN_OTHERS = 200
STRONG = 2.7  # log odds from which a word or bigram is typical of a category
EPOCHS = 10
FOLDS = 2
MIN_SCORE = 0.5
_STOPS = np.array([10, 46, 33, 63, 0x2026, 0x3002, 0], np.uint32)
_QUOTES = np.array([34, 0x201C, 0x201D, 0x201E, 0xAB, 0xBB], np.uint32)


@dataclass
class Tokens:
    feature: np.ndarray  # [tokens, features] positions in the weight table
    unigram: np.ndarray
    sentence: np.ndarray  # number of the token's sentence
    doc: np.ndarray
    begin: np.ndarray  # offsets in the source text
    end: np.ndarray
    bounds: np.ndarray  # first token of each sentence, one more at the end


def tokenise(texts: list[str]) -> Tokens:
    texts = [t or "" for t in texts]
    raw = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    c, at = plain(raw)
    c = np.where(c < 0x10000, c, 32).astype(np.uint32)
    ok = word_table()[c] | (c == 36)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
    s, e = edge[::2], edge[1::2]
    h = hash_runs(c, s, e)
    digit = (c[s] >= 48) & (c[s] <= 57) & (c[e - 1] >= 48) & (c[e - 1] <= 57)
    h[digit] = np.uint64(12345)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start = np.concatenate(([0], np.cumsum(length)))
    doc = np.searchsorted(start, at[s], "right") - 1
    # A full stop ends a sentence only before white space or a closing sign.
    nxt = np.concatenate((c[1:], [0]))
    stop = np.isin(c, _STOPS) & ((c != 46) | np.isin(nxt, [32, 10, 0, 34, 0x201D, 41, 46, 13]))
    sentence = np.cumsum(stop)[s] if len(s) else np.zeros(0, np.int64)
    new = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1]))) if len(s) else np.zeros(0, bool)
    bounds = np.concatenate((np.flatnonzero(new), [len(s)]))
    number = np.cumsum(new) - 1
    quoted = (np.cumsum(np.isin(c, _QUOTES))[s] % 2).astype(np.uint64) if len(s) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        edge_ = np.uint64(99)
        inside = ~new
        prev = np.where(inside, np.concatenate(([edge_], h[:-1])), edge_) if len(s) else h
        last = np.concatenate((new[1:], [True])) if len(s) else new
        follow = np.where(~last, np.concatenate((h[1:], [edge_])), edge_) if len(s) else h
        prev2 = np.where(inside & np.concatenate(([False], inside[:-1])), np.concatenate(([edge_, edge_], h[:-2]))[: len(h)], edge_) if len(s) else h
        first = h[bounds[:-1]][number] if len(s) else h
        f = [mix(h + np.uint64(1)), mix(h * np.uint64(3) + mix(prev) + np.uint64(2)), mix(h * np.uint64(5) + mix(follow) + np.uint64(3)), mix(h * np.uint64(7) + mix(prev2) + np.uint64(4)), mix(mix(first) + quoted + np.uint64(5))]
    feature = (np.stack(f, 1) >> np.uint64(64 - BITS)).astype(np.int32) if len(s) else np.zeros((0, 5), np.int32)
    return Tokens(feature, h, number, doc, at[s] - start[doc], at[np.maximum(e - 1, 0)] + 1 - start[doc] if len(s) else s, bounds)


def tokenise_all(texts: list[str], step: int = 500) -> Tokens:
    """The same as `tokenise`, some texts at a time, so that work arrays stay small."""
    parts = [tokenise(texts[i : i + step]) for i in range(0, len(texts), step)] or [tokenise([])]
    words = np.cumsum([0, *(len(p.doc) for p in parts)])
    sentences = np.cumsum([0, *(len(p.bounds) - 1 for p in parts)])
    join = lambda name, shift: np.concatenate([getattr(p, name) + s for p, s in zip(parts, shift, strict=True)])
    none = [0] * len(parts)
    bounds = np.concatenate([*(p.bounds[:-1] + s for p, s in zip(parts, words[:-1], strict=True)), words[-1:]])
    return Tokens(np.concatenate([p.feature for p in parts]), np.concatenate([p.unigram for p in parts]), join("sentence", sentences[:-1]), join("doc", range(0, step * len(parts), step)), join("begin", none), join("end", none), bounds)


class Field:
    """Weights of the chain: one row per hashed feature, and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, feature: np.ndarray) -> np.ndarray:
        out = self.weights[feature[:, 0]].copy()
        for k in range(1, feature.shape[1]):
            out += self.weights[feature[:, k]]
        return out

    def marginals(self, t: Tokens, pairs: bool = False):
        """Marginal of every token's state; with `pairs` also the expected transitions."""
        score = self.scores(t.feature)
        score -= score.max(1, keepdims=True)
        em = np.exp(np.maximum(score, -30, out=score), out=score)
        tr = np.exp(self.moves)
        out = np.zeros_like(em)
        expected = np.zeros((STATES, STATES))
        n = np.diff(t.bounds)
        order = np.argsort(n, kind="stable")
        i = 0
        while i < len(order):
            size = n[order[i]]
            j = int(np.searchsorted(n[order], max(size, int(size * 1.25)), "right"))
            j = min(j, i + max(1, 100_000 // max(1, int(n[order[j - 1]]))))
            group = order[i:j]
            i = j
            top = int(n[group].max())
            lens = n[group]
            place = t.bounds[group][:, None] + np.arange(top)[None, :]
            live = np.arange(top)[None, :] < lens[:, None]
            place = np.where(live, place, t.bounds[group][:, None])
            e = em[place.T].astype(np.float64)  # [top, group, states]
            e[~live.T] = 1.0
            fw = np.empty_like(e)
            a = e[0] / e[0].sum(1, keepdims=True)
            fw[0] = a
            for k in range(1, top):
                b = (a @ tr) * e[k]
                b /= b.sum(1, keepdims=True)
                a = np.where(live[:, k, None], b, a)
                fw[k] = a
            bw = np.ones((len(group), STATES))
            for k in range(top - 1, -1, -1):
                m = fw[k] * bw
                m /= m.sum(1, keepdims=True)
                ok = live[:, k]
                out[place[ok, k]] = m[ok]
                if k:
                    x = e[k] * bw
                    if pairs:
                        q = fw[k - 1][:, :, None] * tr[None] * x[:, None, :]
                        q /= q.sum((1, 2), keepdims=True)
                        expected += q[ok].sum(0)
                    y = x @ tr.T
                    y /= y.sum(1, keepdims=True)
                    bw = np.where(ok[:, None], y, bw)
        return (out, expected) if pairs else out


def _odds(t: Tokens, positive: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Per token: largest log odds of its unigram and bigrams between positive and other documents.

    The others are the reviewed ones; documents without votes help out if those are few.
    """
    other = ~positive & ~unknown
    if other.sum() < MIN_OTHERS:
        other = ~positive
    best = np.full(len(t.doc), -9.0)
    for k in range(3):
        key = t.feature[:, k]
        pair = np.sort(key.astype(np.int64) * len(positive) + t.doc)  # each word once a document
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
        where, doc = pair // len(positive), pair % len(positive)
        p = np.bincount(where, weights=positive[doc], minlength=1 << BITS)
        q = np.bincount(where, weights=other[doc], minlength=1 << BITS)
        del pair, where, doc
        a, b = positive.sum(), other.sum()
        lo = np.log((p + 0.2) / (a + 0.4)) - np.log((q + 0.2) / (b + 0.4))
        lo = np.where(p >= (3 if a >= 100 else 2), lo, np.minimum(lo, 0.0))
        best = np.maximum(best, lo[key]) if k else lo[key]
    return best


def spans(t: Tokens, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token states from document labels [docs, categories] (mean vote, nan unknown), and which sentences are telling.

    Unlabelled documents count as background; of their sentences only those
    without any word typical of a category are telling.
    """
    unknown = np.isnan(labels).all(1)
    state = np.zeros(len(t.doc), np.int8)
    strength = np.zeros(len(t.doc))
    n = np.diff(t.bounds)
    if not len(n):
        return state, np.zeros(0, bool)
    doc = t.doc[t.bounds[:-1]]
    telling = np.ones(len(n), bool)
    for k in range(len(CATEGORIES)):
        positive = labels[:, k] >= 0.5
        if not positive.any():
            continue
        lo = np.clip(_odds(t, positive, np.isnan(labels[:, k])), -4, 6)
        mean = np.add.reduceat(lo, t.bounds[:-1]) / n
        strong = np.add.reduceat((lo > STRONG).astype(float), t.bounds[:-1])
        typical = (mean > 1.0) & (strong >= np.minimum(2, n))
        telling &= ~(unknown[doc] & ((strong > 0) | (mean > 0.3)))
        good = typical & positive[doc]
        token = np.repeat(good, n) & (np.repeat(mean, n) > strength)
        state[token] = k + 1
        strength[token] = np.repeat(mean, n)[token]
    return state, telling


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Field:
    """The field, from documents and their labels [docs, categories]."""
    t = tokenise_all(texts)
    weights = np.zeros((1 << BITS, STATES), np.float32)
    moves = np.zeros((STATES, STATES))
    field = Field(weights, moves)
    if not len(t.doc):
        return field
    rng = np.random.default_rng(seed)
    state, telling = spans(t, labels)
    n = np.diff(t.bounds)
    # Repeated sentences teach nothing new: each is kept once per state.
    with np.errstate(over="ignore"):
        key = np.add.reduceat(mix(t.unigram + state.astype(np.uint64)), t.bounds[:-1])
    _, once = np.unique(key, return_index=True)
    once = once[telling[once]]
    vocabulary = [np.unique(t.feature[:, k], return_inverse=True) for k in range(t.feature.shape[1])]
    g2, gm = np.full(weights.shape, 1e-6, np.float32), np.full(moves.shape, 1e-6)
    hot = np.eye(STATES, dtype=np.float32)[state]
    for epoch in range(epochs):
        if epoch == epochs // 2:  # the field's own reading decides which sentences of a positive document are spans
            p = field.marginals(t)
            mean = np.add.reduceat(p, t.bounds[:-1]) / n[:, None]
            allowed = np.nan_to_num(labels[t.doc[t.bounds[:-1]]], nan=0.0) >= 0.5
            s = np.where((mean[:, 1:] * allowed).max(1) > 0.5, (mean[:, 1:] * allowed).argmax(1) + 1, 0)
            state = np.repeat(s, n)
            hot = np.eye(STATES, dtype=np.float32)[state]
        order = rng.permutation(once)
        for part in np.array_split(order, max(1, len(order) // 5000)):
            t_sub = _take(t, part)
            p, expected = field.marginals(t_sub, pairs=True)
            h = hot[t_sub.source]
            d = (h - p).astype(np.float32)
            for k, (known, number) in enumerate(vocabulary):
                inv = number[t_sub.source]
                here = np.flatnonzero(np.bincount(inv, minlength=len(known)))
                ids = known[here]
                g = np.stack([np.bincount(inv, weights=d[:, y], minlength=len(known))[here] for y in range(STATES)], 1).astype(np.float32)
                g -= 0.02 * weights[ids]
                g2[ids] += g * g
                weights[ids] += 0.25 * g / np.sqrt(g2[ids] + 1e-3)
            a, b = state[t_sub.source][:-1], state[t_sub.source][1:]
            same = t_sub.sentence[1:] == t_sub.sentence[:-1]
            seen = np.zeros_like(moves)
            np.add.at(seen, (a[same], b[same]), 1)
            gm += (seen - expected) ** 2
            moves += 0.2 * (seen - expected) / np.sqrt(gm)
            np.clip(moves, -6, 6, out=moves)
    return field


@dataclass
class _Part(Tokens):
    source: np.ndarray = None  # type: ignore[assignment]


def _take(t: Tokens, sentences: np.ndarray) -> _Part:
    n = np.diff(t.bounds)[sentences]
    first = np.repeat(t.bounds[sentences] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    src = np.arange(n.sum()) + first
    return _Part(t.feature[src], t.unigram[src], t.sentence[src], t.doc[src], t.begin[src], t.end[src], np.concatenate(([0], np.cumsum(n))), src)


def _cutoff(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the cutoffs whose F1 on the reviewed documents is within 0.005 of the best."""
    ok = ~np.isnan(label)
    s, y = score[ok], label[ok] >= 0.5
    if not y.any():
        return MIN_SCORE
    grid = np.linspace(0.2, 0.8, 25)
    f1 = np.array([2 * (y & (s >= g)).sum() / max(1, y.sum() + (s >= g).sum()) for g in grid])
    return float(np.median(grid[f1 >= f1.max() - 0.005]))


def document_scores(p: np.ndarray, t: Tokens, docs: int) -> np.ndarray:
    """[docs, categories]: the largest share of a sentence's words that is tagged, with a span of half of it counting in full."""
    out = np.zeros((docs, len(CATEGORIES)))
    n = np.diff(t.bounds)
    if len(n):
        share = np.add.reduceat(p, t.bounds[:-1])[:, 1:] / np.maximum(3, 0.5 * n)[:, None]
        np.maximum.at(out, t.doc[t.bounds[:-1]], np.minimum(share, 1))
    return out


_SCORED = "doc_id long, source string, abusive double, hateful double, sexual double, spans array<struct<start:int,end:int,category:string>>"


def _spans(p: np.ndarray, t: Tokens, docs: int) -> list[list[tuple[int, int, str]]]:
    out: list[list] = [[] for _ in range(docs)]
    best = p.argmax(1)
    best[p[np.arange(len(p)), best] < 0.5] = 0
    if not best.any():
        return out
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (t.sentence[1:] != t.sentence[:-1])))
    s = np.flatnonzero(new)
    e = np.concatenate((s[1:], [len(best)])) - 1
    for a, b in zip(s[best[s] > 0], e[best[s] > 0], strict=True):
        out[t.doc[a]].append((int(t.begin[a]), int(t.end[b]), CATEGORIES[best[a] - 1]))
    return out


def reviewed(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """`most` documents with the mean vote per category; null votes don't count.

    Reviewed ones come first; if they are too few, others without votes serve as background.
    """
    votes = labels.groupBy("doc_id").agg(*(F.avg(c).alias(c) for c in CATEGORIES))
    text = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
    keys = text.select("doc_id").join(votes, "doc_id", "left").dropDuplicates(["doc_id"])
    sample = keys.orderBy(F.coalesce(*(F.col(c) for c in CATEGORIES)).isNull(), F.xxhash64("doc_id"), "doc_id").limit(most)
    return text.join(F.broadcast(sample), "doc_id")


_FITTED = "fold int, weights binary, moves array<double>, row int, score array<double>"


def trained(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[Field, np.ndarray]:
    """The field, fitted on all sampled documents, and the categories' cutoffs.

    Cutoffs rest on documents that a field hasn't seen: in each fold another part of the sample is
    scored by a field of the rest.  The sample is bounded (`most` documents of MAX_TRAIN_CHARS), so it
    is broadcast; the fits are independent and run on the executors at the same time.
    """
    spark = documents.sparkSession
    rows = reviewed(documents, labels, most).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    labels_ = rows[list(CATEGORIES)].to_numpy(dtype=float)
    sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps((rows["text"].tolist(), labels_))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, votes = pickle.loads(zlib.decompress(sent.value))
        own = np.arange(len(texts)) % FOLDS
        for pdf in batches:
            for fold in pdf["id"]:
                use, out = np.flatnonzero(own != fold), np.flatnonzero((own == fold) & ~np.isnan(votes).all(1))
                field = fit([texts[i] for i in use], votes[use])
                if fold == FOLDS:  # no document's own: the field of the whole sample
                    yield pd.DataFrame({"fold": [fold], "weights": [zlib.compress(field.weights.tobytes())], "moves": [field.moves.ravel()], "row": [None], "score": [None]})
                elif len(out):
                    t = tokenise_all([texts[i] for i in out])
                    score = document_scores(field.marginals(t), t, len(out))
                    yield pd.DataFrame({"fold": fold, "weights": None, "moves": None, "row": out, "score": list(score)})

    got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, _FITTED).collect()
    whole = next(r for r in got if r["fold"] == FOLDS)
    field = Field(np.frombuffer(zlib.decompress(whole["weights"]), np.float32).reshape(-1, STATES), np.array(whole["moves"]).reshape(STATES, STATES))
    held = [r for r in got if r["fold"] != FOLDS]
    if not held:
        return field, np.full(len(CATEGORIES), MIN_SCORE)
    score, label = np.array([r["score"] for r in held]), labels_[[r["row"] for r in held]]
    return field, np.array([_cutoff(score[:, k], label[:, k]) for k in range(len(CATEGORIES))])


def scored(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, source, a score in 0..1 per category and the spans (offsets in code points) of each document.

    Null and empty texts score 0 and have no spans.  Repeated rows give repeated results.
    """
    sent = documents.sparkSession.sparkContext.broadcast((zlib.compress(field.weights.tobytes()), field.moves))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(np.frombuffer(zlib.decompress(sent.value[0]), np.float32).reshape(-1, STATES), sent.value[1])
        for big in batches:
            for pdf in chunks(big, "text", 1_000_000, 2_000):
                t = tokenise(pdf["text"].tolist())
                p = own.marginals(t)
                s = document_scores(p, t, len(pdf))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], **{c: s[:, k] for k, c in enumerate(CATEGORIES)}, "spans": _spans(p, t, len(pdf))})

    return documents.select("doc_id", "source", "text").mapInPandas(run, _SCORED)


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category) of every document that reaches the category's cutoff, once."""
    field, cutoff = trained(documents, labels)
    s = scored(documents, field)
    hits = F.array(*(F.when(F.col(c) >= float(cutoff[k]), F.lit(c)) for k, c in enumerate(CATEGORIES)))
    return s.select("doc_id", F.explode(hits).alias("category")).filter(F.col("category").isNotNull()).distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, n_abusive, n_hateful, n_sexual, rate): rates per source, null source kept."""
    field, cutoff = trained(documents, labels)
    s = scored(documents, field).dropDuplicates(["doc_id"])
    over = [F.sum((F.col(c) >= float(cutoff[k])).cast("long")).alias(f"n_{c}") for k, c in enumerate(CATEGORIES)]
    some = F.avg(F.greatest(*((F.col(c) >= float(cutoff[k])).cast("double") for k, c in enumerate(CATEGORIES)))).alias("rate")
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), *over, some)
