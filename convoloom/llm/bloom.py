"""A Bloom filter of hashes, of one fixed size, built on the executors and sent to all of them.

It spares rows a shuffle; what it lets through by chance is dropped by the join that
follows, so results never depend on it.  With very many keys it lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BITS = 24
_BLOCK = 1 << 16  # bytes of the filter in one row
_SCHEMA = "block int, bits binary"


def _positions(keys: np.ndarray) -> np.ndarray:
    """[keys, 2] bits of each key."""
    k = keys.view(np.uint64)
    return np.stack((k >> np.uint64(64 - BITS), (k << np.uint64(BITS)) >> np.uint64(64 - BITS)), 1).astype(np.int64)


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(1 << BITS, bool)
    for pdf in batches:
        bits[_positions(pdf["k"].to_numpy(np.int64)).ravel()] = True
    for b, part in enumerate(np.packbits(bits).reshape(-1, _BLOCK)):
        if part.any():
            yield pd.DataFrame({"block": [b], "bits": [part.tobytes()]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})


class Bloom:
    """Filter of the column `k` of 64-bit hashes: 2 MB whatever their number.  Partitions are merged block by block."""

    def __init__(self, keys: DataFrame):
        bits = np.zeros((1 << BITS) // 8, np.uint8).reshape(-1, _BLOCK)
        for r in keys.select("k").mapInPandas(_fill, _SCHEMA).groupBy("block").applyInPandas(_merge, _SCHEMA).collect():
            bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.ravel())
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "table": None}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.unpackbits(self.sent.value).view(bool)
        return self.table[_positions(keys)].all(1) if len(keys) else np.zeros(0, bool)
