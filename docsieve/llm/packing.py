"""Problem 6: filling containers of fixed capacity with texts.

Bounded-space online best-fit. Each partition is packed as it streams by: a
fixed number of bins is open, a bitset keyed by free space finds the bin that an
item fills best, and when no bin fits and all are open the fullest is closed. An
item is split only when it exceeds the capacity. Memory per task is the open
bins, whatever the data; there is no shuffle. A bin is opened only when the item
fits in none, so the bins left open at the end of a partition are mostly full.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OPEN_BINS = 128
PACK_SCHEMA = "target_id INT, container_id STRING, doc_id BIGINT, part INT, first_token BIGINT, n_tokens BIGINT"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: Sequence[str], path: str) -> list[int]:
    """Tokens of each whole text; special tokens' strings are ordinary text."""
    enc = _encoding(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


class BestFit:
    """Open bins of one capacity; the bitset has bit f where an open bin has f free."""

    def __init__(self, capacity: int, bins: int, prefix: str):
        if capacity <= 0 or bins <= 0:
            raise ValueError("capacity and bins must be positive")
        self.capacity, self.bins, self.prefix = capacity, bins, prefix
        self.free, self.at, self.n, self.seq = 0, {}, 0, 0

    def _take(self, f: int) -> str:
        ids = self.at[f]
        b = ids.pop()
        if not ids:
            del self.at[f]
            self.free ^= 1 << f
        self.n -= 1
        return b

    def _put(self, f: int, b: str) -> None:
        if f == 0:
            return  # full: closed
        self.at.setdefault(f, []).append(b)
        self.free |= 1 << f
        self.n += 1

    def place(self, size: int) -> str:
        """The container of an item of at most the capacity."""
        fits = self.free >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if self.n >= self.bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            f, b = self.capacity, f"{self.prefix}-{self.seq}"
            self.seq += 1
        self._put(f - size, b)
        return b

    def parts(self, size: int) -> list[tuple[int, int]]:
        """(first token, tokens) of the pieces of an item; one unless it exceeds the capacity."""
        if size <= self.capacity:
            return [(0, size)]
        return [(a, min(self.capacity, size - a)) for a in range(0, size, self.capacity)]


def pack(documents: DataFrame, targets: Sequence[tuple[int, int]], tokenizer: str = TOKENIZER, bins: int = OPEN_BINS) -> DataFrame:
    """Assign each document to containers of every target (PACK_SCHEMA).

    ``targets``: (target_id, capacity) of a small fixed table. A document of at
    most the capacity is one row (part 0); a larger one has a row per piece, in
    token order. Texts without tokens have a row of 0 tokens; NULL ids or texts
    have none. Repeated rows are packed each by itself.
    """
    targets = list(targets)
    names = [c.split()[0] for c in PACK_SCHEMA.split(", ")]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        fits = [(t, BestFit(c, bins, f"{t}-{task}")) for t, c in targets]
        for b in batches:
            out = []
            sizes = count_tokens(b["text"].tolist(), tokenizer)
            for doc, size in zip(b["doc_id"].tolist(), sizes):
                for t, fit in fits:
                    for part, (first, n) in enumerate(fit.parts(size)):
                        out.append((t, fit.place(n), doc, part, first, n))
            yield pd.DataFrame(out, columns=names)

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(fill, PACK_SCHEMA)


def utilisation(packed: DataFrame, capacities: dict[int, int]) -> np.ndarray:
    """Share of the space used, per target (for reports and tests; one row a target)."""
    rows = packed.groupBy("target_id").agg({"n_tokens": "sum"}).collect()
    bins = {r.target_id: r["count"] for r in packed.select("target_id", "container_id").distinct().groupBy("target_id").count().collect()}
    return np.array([[r.target_id, r["sum(n_tokens)"] / (bins[r.target_id] * capacities[r.target_id])] for r in rows])
