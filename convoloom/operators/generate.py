"""Generation behind an injected client: rows in, records out, resumable and repeatable.

A client is any object with `generate(prompt, seed) -> str` that can be pickled.
Workers call it row by row inside mapInPandas; whatever a call raises becomes an
error row, never a lost row.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parsing import AXES, judgment, parse_rubric


class Client(Protocol):
    def generate(self, prompt: str, seed: int) -> str: ...


class MockClient:
    """Deterministic: the answer depends on prompt and seed only."""

    def generate(self, prompt: str, seed: int) -> str:
        d = hashlib.sha256(f"{seed}:{prompt}".encode()).digest()
        s = {k: 1 + d[i] % 10 for i, k in enumerate(("memory_score", "instruction_score", "freshness_score", "overall_score"))}
        return "Here it is: " + json.dumps({**s, "confidence": ("low", "medium", "high")[d[5] % 3], "issues": [], "rationale": {"memory": "m", "instruction": "i", "freshness": "f"}})


# Names of errors that pass, and status numbers worth another call.
TRANSIENT = ("InternalServerError", "APITimeoutError", "APIConnectionError", "RateLimitError", "APIError", "Timeout", "TimeoutError", "ConnectionError")
STATUS = (408, 409, 429, 500, 502, 503, 504)
_PASSING = re.compile(r"timed out|timeout|connection|unexpected error|temporarily|\b(?:408|409|429|500|502|503|504)\b", re.I)


def transient(e: Exception) -> bool:
    """Is the error worth another call: by its status, its name, or its text."""
    code = getattr(e, "status_code", None) or getattr(e, "code", None)
    return code in STATUS or type(e).__name__ in TRANSIENT or bool(_PASSING.search(str(e)))


_OUT = "_eval_id string, _model string, _status string, _latency_seconds double, judgment string, error_type string, error string"


def judge(pending: DataFrame, client: Client, model: str, template: str, seed: int = 42, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """One log row per pending (_eval_id, transcript): a schema-valid judgment as JSON, or the error.

    The template's `{conversation}` takes the transcript.  The seed of a call depends on
    the row's id and the attempt, so results don't depend on the partitioning.  A reply that
    can't be read and a passing error are followed by another call, after `wait` seconds that
    double each time; any other error ends the row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["_eval_id"], pdf["transcript"], strict=True):
                began, kind, error, got = time.time(), None, None, None
                for k in range(attempts):
                    try:
                        s = int.from_bytes(hashlib.sha256(f"{seed}:{i}:{k}".encode()).digest()[:4], "big")
                        text = client.generate(template.replace("{conversation}", t or ""), s)
                    except Exception as e:  # noqa: BLE001  whatever a client raises is data here
                        kind, error = type(e).__name__, str(e)
                        if not transient(e):
                            break
                        time.sleep(wait * 2**k if k + 1 < attempts else 0)
                        continue
                    got = judgment(text)
                    if got:
                        kind = error = None
                        break
                    kind, error = "ValueError", "no valid JSON object: " + text.strip()[:500]
                out.append((i, model, "ok" if got else "error", time.time() - began, json.dumps(got) if got else None, kind, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return pending.select("_eval_id", "transcript").mapInPandas(run, _OUT)


def judge_all(pending: DataFrame, clients: dict[str, Client], template: str, **options) -> DataFrame:
    """The log rows of every model in turn; a model that fails leaves error rows, and the others go on."""
    out = None
    for model, client in clients.items():
        rows = judge(pending, client, model, template, **options)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no models")
    return out


def scored(conversations: DataFrame, key: str, client: Client, template: str, seed: int = 42) -> DataFrame:
    """(key, rubric): the rubric of each (key, transcript); null where the client fails or replies without a known axis."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for i, t in zip(pdf[key], pdf["transcript"], strict=True):
                try:
                    s = int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big")
                    got.append(client.generate(template.replace("{conversation}", t or ""), s))
                except Exception:  # noqa: BLE001  a judge that fails gives no score
                    got.append(None)
            yield pd.DataFrame({key: pdf[key], "reply": got})

    kind = conversations.schema[key].dataType.simpleString()
    r = conversations.select(key, "transcript").mapInPandas(run, f"`{key}` {kind}, reply string").withColumn("r", parse_rubric("reply"))
    known = F.coalesce(*(F.col(f"r.{a}") for a in AXES)).isNotNull()
    return r.select(key, F.when(known, F.col("r")).alias("rubric"))


class MockRubric:
    """Deterministic rubric inside prose; every eleventh reply names no axis."""

    def generate(self, prompt: str, seed: int) -> str:
        d = hashlib.sha256(f"{seed}:{prompt}".encode()).digest()
        if d[0] % 11 == 0:
            return "I have no opinion. {}"
        return "My view: " + json.dumps({**{a: 1 + d[i + 1] % 10 for i, a in enumerate(AXES)}, "flagged_turns": [], "notes": "n"}) + " That is all."


def plan(seeds: DataFrame, key: str, turns: int, mix: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, turn_index, category): a seeded category per follow-up turn; the first follow-up explores.

    The inverse of the cumulative weights, evaluated on a hash: the same plan on any cluster.
    """
    x = seeds.select(F.col(key), F.explode(F.sequence(F.lit(1), F.lit(turns - 1))).alias("turn_index"))
    u = T.uniform(seed, F.col(key), F.col("turn_index"))
    total, at, pick = sum(mix.values()), 0.0, None
    for name, w in mix.items():
        at += w / total
        pick = F.when(u < at, name) if pick is None else pick.when(u < at, name)
    return x.select(key, "turn_index", F.when(F.col("turn_index") == 1, "explore").otherwise(F.coalesce(pick, F.lit(list(mix)[-1]))).alias("category"))


def draw_pairs(rows: DataFrame, key: list[str], intents: dict[str, float], policies: dict[str, float], invalid: set[tuple[str, str]] = frozenset(), allowed: str | None = None, seed: int = 42) -> DataFrame:
    """rows with intent and policy drawn independently by weight, given that the pair is valid.

    Drawing until a valid pair comes has a closed form: pairs are drawn by the product
    of their weights among the valid ones.  `allowed` names an ARRAY<STRING> column of
    permitted intents; null permits all, as does a list that permits none of the intents.
    """
    pairs = [(i, p, w * v) for i, w in intents.items() for p, v in policies.items() if (i, p) not in invalid and w * v > 0]
    if not pairs:
        raise ValueError("no valid pair of intent and policy")
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(float(w)).alias("w")) for i, p, w in pairs))
    some = table if allowed is None else F.filter(table, lambda x: F.array_contains(F.coalesce(F.col(allowed), F.array().cast("array<string>")), x["i"]))
    ok = table if allowed is None else F.when(F.size(some) > 0, some).otherwise(table)
    u = T.uniform(seed, *(F.col(k) for k in key))
    total = F.aggregate("_ok", F.lit(0.0), lambda a, x: a + x["w"])
    none = F.lit(None).cast("struct<i:string,p:string,w:double>")
    # The fold keeps the weight passed so far and the first pair that passes the target.
    pick = F.aggregate("_ok", F.struct(F.lit(0.0).alias("s"), none.alias("x")), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["x"].isNull() & (a["s"] + x["w"] > F.col("_u") * F.col("_t")), x).otherwise(a["x"]).alias("x")))["x"]
    out = rows.withColumns({"_ok": ok, "_u": u}).withColumn("_t", total).withColumn("_x", F.coalesce(pick, F.try_element_at("_ok", F.lit(-1))))
    return out.withColumns({"intent": F.col("_x.i"), "policy": F.col("_x.p")}).drop("_ok", "_u", "_t", "_x")
