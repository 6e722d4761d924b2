"""Problem 7: consensus from several annotators' labels.

Method: competence-and-spamming mixture.  Each label is truthful with the
annotator's competence, else drawn from the annotator's personal guess
distribution; expectation-maximisation yields both.  Scores are ordered, so a
truthful label is the true score read on the annotator's own scale (a shift and a
blur, also estimated); without that, a severe but consistent annotator would count
as a spammer.

An E-step is one pass over the items; it leaves one small table of expected counts
(annotators x labels x true scores), whose size doesn't depend on the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

LEVELS = 10
SCORES = ("overall_score", "memory_score")
BANDS = (("low", 1, 4), ("mid", 5, 7), ("high", 8, 10))
MAX_MODELS = 4096
COMPETENCE = (0.005, 0.995)
TOLERANCE = 1e-6  # gain of log-likelihood a label under which the EM has converged
GROWTH = 1.2  # of the relaxation, while the likelihood rises
MOST_ROUNDS = 300  # an EM that needs more is reported as not converged


class Mixture:
    """Parameters of J annotators over L ordered levels."""

    def __init__(self, annotators: int, levels: int = LEVELS):
        self.levels = levels
        self.prior = np.full(levels, 1 / levels)
        self.theta = np.full(annotators, 0.7)
        self.guess = np.full((annotators, levels), 1 / levels)
        self.shift = np.zeros(annotators)
        self.blur = np.full(annotators, 1.5)
        self.rounds, self.converged = 0, False
        self._relax, self._seen, self._plain = 1.0, -np.inf, self.theta

    def truthful(self) -> np.ndarray:
        """[J, label, truth]: probability of a label if it is truthful."""
        t = np.arange(1, self.levels + 1)[None, None, :] + self.shift[:, None, None]
        edges = np.arange(self.levels + 1) + 0.5
        edges[0], edges[-1] = -np.inf, np.inf
        z = (edges[None, :, None] - t) / self.blur[:, None, None]
        c = _normal(z)
        return np.maximum(c[:, 1:, :] - c[:, :-1, :], 1e-9)

    def label_given_truth(self) -> np.ndarray:
        return self.theta[:, None, None] * self.truthful() + (1 - self.theta)[:, None, None] * self.guess[:, :, None]

    def advance(self, expected: np.ndarray, likelihood: float) -> None:
        """One round of the EM from the expected counts and the mean log-likelihood a label that the present parameters gave.

        Competences take longer and longer steps while the likelihood rises; when it falls,
        they go back to the last plain step.
        """
        self.rounds += 1
        if likelihood < self._seen and self._relax > 1:
            self.theta, self._relax = self._plain.copy(), 1.0
            return
        self.converged = bool(abs(likelihood - self._seen) < TOLERANCE)
        if self.converged:
            return
        self._seen, old = likelihood, self.theta
        self.step(expected)
        self._plain = self.theta
        self.theta = np.clip(old + self._relax * (self.theta - old), *COMPETENCE)
        self._relax *= GROWTH

    def step(self, expected: np.ndarray) -> None:
        """M-step from expected[J, label, truth]."""
        true = self.theta[:, None, None] * self.truthful()
        share = true / (true + (1 - self.theta)[:, None, None] * self.guess[:, :, None])
        t_mass, g_mass = expected * share, expected * (1 - share)
        total = expected.sum((1, 2))
        self.theta = np.clip((t_mass.sum((1, 2)) + 1) / (total + 2), *COMPETENCE)
        self.guess = (g_mass.sum(2) + 0.5) / (g_mass.sum((1, 2)) + 0.5 * self.levels)[:, None]
        # Shift and blur that explain the truthful labels best, over a grid; labels cut at the ends of the scale fit too.
        grid = np.arange(-4, 4.01, 0.25)
        widths = np.array([0.5, 0.7, 0.9, 1.2, 1.5, 2.0, 2.6])
        table = _grid_kernels(grid, widths, self.levels)  # [g, w, label, truth]
        ll = np.einsum("jlt,gwlt->jgw", t_mass, np.log(table))
        best = ll.reshape(len(ll), -1).argmax(1)
        known = total > 0
        self.shift = np.where(known, grid[best // len(widths)], 0.0)
        self.blur = widths[best % len(widths)]
        weight = self.theta * known
        order = np.argsort(self.shift)
        if weight.sum() > 0:  # the scale's zero: the weighted median annotator
            c = np.cumsum(weight[order])
            self.shift = self.shift - self.shift[order][np.searchsorted(c, c[-1] / 2)]
        prior = expected.sum((0, 1)) + 1
        self.prior = prior / prior.sum()


_KERNELS: dict[tuple, np.ndarray] = {}


def _normal(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz and Stegun 7.1.26 on |z|)."""
    x = np.abs(np.where(np.isinf(z), 9.0 * np.sign(z), z)) / np.sqrt(2)
    k = 1 / (1 + 0.3275911 * x)
    e = 1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * e)


def _grid_kernels(grid: np.ndarray, widths: np.ndarray, levels: int) -> np.ndarray:
    key = (len(grid), len(widths), levels)
    if key not in _KERNELS:
        m = Mixture(len(grid) * len(widths), levels)
        m.shift, m.blur = np.repeat(grid, len(widths)), np.tile(widths, len(grid))
        _KERNELS[key] = m.truthful().reshape(len(grid), len(widths), levels, levels)
    return _KERNELS[key]


def posterior(log_given: np.ndarray, log_prior: np.ndarray, counts: np.ndarray, annotators: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """[items, truth] posterior and the log-likelihood; annotators and labels (from 0) are flat, counts has the number of each item's labels."""
    out = np.repeat(log_prior[None, :], len(counts), 0)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.cumsum(counts) - counts
        out[some] += np.add.reduceat(log_given[annotators, labels], first[some], axis=0)
    top = out.max(1, keepdims=True)
    out -= top
    np.exp(out, out)
    total = out.sum(1, keepdims=True)
    return out / total, float((np.log(total) + top).sum())


def _flat(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = part["annotators"].tolist(), part["labels"].tolist()
    n = np.fromiter(map(len, a), np.int64, len(a))
    join = lambda x: np.concatenate(x).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
    return n, join(a), join(b)


_BLOCK = "score_name string, counts binary, annotators binary, labels binary"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many items in one row of flat arrays, so that a pass of the EM doesn't unpack lists again."""
    for pdf in batches:
        for s, part in pdf.groupby("score_name"):
            n, a, b = _flat(part)
            yield pd.DataFrame({"score_name": [s], "counts": [n.astype("<u2").tobytes()], "annotators": [a.astype("<u2").tobytes()], "labels": [b.astype("<u1").tobytes()]})


def votes(judge_log: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(_eval_id, score_name, _model, label): each model's last valid score of an id; retries and repeated lines fall together.

    Rows without id, model or judgment are left out, as are null and out-of-range scores.
    """
    ok = judge_log.filter((F.col("_status") == "ok") & F.col("_eval_id").isNotNull() & F.col("_model").isNotNull() & F.col("judgment").isNotNull())
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("score_name"), F.col(f"judgment.{n}").alias("label")) for n in scores))).alias("s")
    valid = ok.select("_eval_id", "_model", "seq", s).select("_eval_id", "_model", "seq", "s.score_name", "s.label").filter(F.col("label").between(1, LEVELS))
    return valid.groupBy("_eval_id", "score_name", "_model").agg(F.max_by("label", "seq").alias("label"))


def _models(votes_: DataFrame) -> list[str]:
    names = [r[0] for r in votes_.select("_model").distinct().limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} annotators: group them first")
    return sorted(names)


def fit(items: DataFrame, names: list[str], scores: tuple[str, ...] = SCORES, rounds: int = MOST_ROUNDS) -> dict[str, Mixture]:
    """EM over `items` (score_name, annotators array<int>, labels array<int>), at most one label per annotator."""
    packed = cut(items.mapInPandas(_pack, _BLOCK))
    models = {s: Mixture(len(names)) for s in scores}
    open_ = set(scores) if names else set()
    for _ in range(rounds):
        given = {s: (np.log(models[s].label_given_truth()), np.log(models[s].prior)) for s in open_}

        def expect(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            # The last two entries are the labels' number and their log-likelihood, made positive.
            total = {s: np.zeros(len(names) * LEVELS * LEVELS + 2) for s in given}
            for pdf in batches:
                for s, *blob in zip(pdf["score_name"], pdf["counts"], pdf["annotators"], pdf["labels"], strict=True):
                    if s not in given:
                        continue
                    n, a, b = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(blob, ("<u2", "<u2", "<u1"), strict=True))
                    p, ll = posterior(*given[s], n, a, b)
                    total[s][-2:] += len(b), -ll
                    at, row = a * LEVELS + b, np.repeat(np.arange(len(n)), n)
                    flat = total[s][:-2].reshape(-1, LEVELS)
                    for k in range(LEVELS):
                        flat[:, k] += np.bincount(at, weights=p[row, k], minlength=len(flat))
            yield pd.DataFrame({"score_name": list(total), "counts": [x.tolist() for x in total.values()]})

        sums = packed.mapInPandas(expect, "score_name string, counts array<double>")
        each = sums.select("score_name", F.posexplode("counts").alias("k", "v")).groupBy("score_name", "k").agg(F.sum("v").alias("v"))
        expected = {s: np.zeros(len(names) * LEVELS * LEVELS + 2) for s in scores}
        for s, k, v in each.filter("v > 0").collect():
            expected[s][k] = v
        for s in list(open_):
            *cells, n, loss = expected[s]
            models[s].advance(np.array(cells).reshape(len(names), LEVELS, LEVELS), -loss / max(n, 1))
            if models[s].converged:
                open_.discard(s)
        if not open_:
            break
    return models


def consensus(judge_log: DataFrame, scores: tuple[str, ...] = SCORES) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: _eval_id, score_name, consensus (likeliest score), band, certainty (of the
    band), agreement (share of labels within one of the consensus), n_labels.  Every
    id with an ok judgment has a row per score; without a valid label the prior decides.
    annotators: _model, score_name, competence, shift, blur, n_labels, and the rounds of the EM
    with whether it converged.  An empty log gives empty tables.
    """
    spark = judge_log.sparkSession
    ok = judge_log.filter((F.col("_status") == "ok") & F.col("_eval_id").isNotNull() & F.col("judgment").isNotNull())
    ids = ok.select("_eval_id", F.explode(F.array(*map(F.lit, scores))).alias("score_name")).distinct()
    v = votes(judge_log, scores)
    names = _models(v)
    index = spark.createDataFrame(list(enumerate(names)), "a int, _model string")
    packed = v.join(F.broadcast(index), "_model").groupBy("_eval_id", "score_name").agg(F.sort_array(F.collect_list(F.struct("a", (F.col("label") - 1).alias("l")))).alias("x"))
    items = cut(ids.join(packed, ["_eval_id", "score_name"], "left").select("_eval_id", "score_name", F.coalesce(F.col("x.a"), F.array().cast("array<int>")).alias("annotators"), F.coalesce(F.col("x.l"), F.array().cast("array<int>")).alias("labels")))
    models = fit(items.filter(F.size("labels") > 0).select("score_name", "annotators", "labels"), names, scores)
    given = {s: (np.log(m.label_given_truth()), np.log(m.prior)) for s, m in models.items()}
    lows = np.array([b[1] - 1 for b in BANDS])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, part in pdf.groupby("score_name"):
                n, a, b = _flat(part)
                p, _ = posterior(*given[s], n, a, b)
                bands = np.add.reduceat(p, lows, axis=1)
                best = p.argmax(1)
                close = np.bincount(np.repeat(np.arange(len(n)), n), weights=np.abs(b - np.repeat(best, n)) <= 1, minlength=len(n))
                near = np.where(n > 0, close / np.maximum(n, 1), np.nan)
                yield pd.DataFrame(
                    {"_eval_id": part["_eval_id"], "score_name": s, "consensus": best + 1, "band": [BANDS[k][0] for k in bands.argmax(1)], "certainty": bands.max(1), "agreement": near, "n_labels": n}
                )

    out = items.mapInPandas(decide, "_eval_id string, score_name string, consensus int, band string, certainty double, agreement double, n_labels int")
    rows = [(n, s, float(m.theta[k]), float(m.shift[k]), float(m.blur[k]), m.rounds, m.converged) for s, m in models.items() for k, n in enumerate(names)]
    known = spark.createDataFrame(rows, "_model string, score_name string, competence double, shift double, blur double, rounds int, converged boolean")
    return out, known.join(v.groupBy("_model", "score_name").agg(F.count("*").alias("n_labels")), ["_model", "score_name"])
