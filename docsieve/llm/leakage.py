"""Problem 7: evaluation passages that stand, wholly or in part, in the corpus.

A hash set of normalised test n-grams is broadcast (the test items are a fixed,
small table, so its size has a bound of its own) and every window of every
document is looked up in it. As damage joins and splits words, the token of the
n-gram is the character: a text is its letters and digits without accents, case,
marks and blanks, with the letters that scanners take for digits folded, and the
n-gram is ``GRAM`` of them (about three words). Hits that follow each other in
both texts are chained, and a chain is verified: it must be as long as
``MIN_WORDS`` words, and the words rare among the items must be found in it,
since sentences of one mould agree in all the rest. No document is cut, no hit
list capped; memory is bounded by a batch of documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GRAM = 16
MIN_WORDS = 20
#: Longest gap between two hits of a chain, in characters of the item and of the document.
GAP_ITEM, GAP_DOC = 200, 120
RARE_SHARE, WORD_SHARE, SURE_SHARE = 0.45, 0.5, 0.85
#: A passage with fewer windows of its own than this share keeps the windows that it shares.
OWN_SHARE = 0.3
SPAN_SCHEMA = "doc_id BIGINT, item_id BIGINT, n_words INT, n_rare INT, rare_found DOUBLE, words_found DOUBLE, doc_from INT, doc_to INT, whole BOOLEAN"

# fixed values: letters without a decomposition, and shapes that scanners confuse
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"})
_FOLD = bytes.maketrans(b"0158i", b"olsbl")
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_TEXT = re.compile(r"[^\w]|_")


def fold(text: str) -> bytes:
    """Letters and digits only, without case, accents and look-alikes; those of other scripts in UTF-8."""
    s = text.casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(_LETTERS))
        if not s.isascii():
            s = _NOT_TEXT.sub("", s)
    return s.encode("utf-8", "ignore").translate(_FOLD, _DROP)


def places(text: str) -> np.ndarray:
    """For each byte of ``fold(text)`` the place in the text of the character it comes from."""
    out: list[int] = []
    for i, c in enumerate(text):
        out += [i] * len(fold(c))
    return np.array(out, dtype=np.int64)


def windows(a: np.ndarray) -> np.ndarray:
    """Hash of each window of GRAM characters, by doubling."""
    h, b, n = a.astype(np.uint64) + np.uint64(1), _BASE, 1
    while n < GRAM:
        h = h[: len(h) - n] * b + h[n:] if len(h) > n else h[:0]
        b, n = b * b, n * 2
    return h ^ (h >> np.uint64(29))


class TestGrams:
    """The n-grams that occur once in a passage and in those of one item only, and the passages' words.

    Items with the same passage are one passage of several items. Of passages
    of one item, the first has the n-grams that they share.
    """

    def __init__(self, items: list[tuple[int, str]]):
        same: dict[bytes, tuple[str, list[int]]] = {}
        for i, passage in items:
            ids = same.setdefault(fold(passage or ""), (passage, []))[1]
            if i not in ids:
                ids.append(i)
        self.ids = [ids for _, ids in same.values()]
        items = [(ids, passage) for passage, ids in same.values()]
        hs, ks, ps = [], [], []
        self.words: list[list[tuple[int, bytes]]] = []
        with np.errstate(over="ignore"):
            for k, (_, passage) in enumerate(items):
                a = np.frombuffer(fold(passage or ""), dtype=np.uint8)
                h = windows(a)
                hs.append(h), ks.append(np.full(len(h), k)), ps.append(np.arange(len(h)))
                at, words = 0, []
                for w in (fold(x) for x in (passage or "").split()):
                    if w:
                        words.append((at, w))
                        at += len(w)
                self.words.append(words)
        h, k, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hs, np.uint64), (ks, np.int64), (ps, np.int64)))
        o = np.argsort(h, kind="stable")
        h, k, p = h[o], k[o], p[o]
        once = np.ones(len(h), bool)  # what two items share is a standing clause or a mould
        once[1:] = h[1:] != h[:-1]
        if len(h):
            number: dict[tuple, int] = {}
            owner = np.array([number.setdefault(tuple(ids), len(number)) for ids in self.ids])[k]
            begin, group = np.flatnonzero(once), np.cumsum(once) - 1
            one = np.minimum.reduceat(owner, begin) == np.maximum.reduceat(owner, begin)
            one[group[1:][~once[1:] & (k[1:] == k[:-1])]] = False  # twice in one passage
            once &= one[group]
        own_n, all_n = (np.bincount(x, minlength=len(self.ids)) for x in (k[once], k))
        once |= (own_n < OWN_SHARE * all_n)[k] & (all_n > 0)[k]  # nearly all of it stands in other passages too
        self.h, self.k, self.p = h[once], k[once], p[once]
        self.size = [len(fold(passage or "")) for _, passage in items]
        self.tiny = [(i, fold(passage or "")) for i, (_, passage) in enumerate(items) if 0 < self.size[i] < GRAM]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.h >> np.uint64(42)).astype(np.int64)] = True
        df = Counter(w for words in self.words for w in {x for _, x in words})
        # numbers and references tell two texts of one mould apart; in items without any, the words of few items do
        self.rare = []
        for (_, passage), words in zip(items, self.words):
            told = [sum(c.isdigit() for c in x) >= 3 for x in (passage or "").split() if fold(x)]
            self.rare.append(told if sum(told) >= 3 else [len(w) >= 4 and df[w] <= 2 for _, w in words])
        # words of shared stretches: their windows are all shared; they don't count as words of the item
        self.own = []
        for j, words in enumerate(self.words):
            mask = np.zeros(max([a + len(w) for a, w in words], default=0) + GRAM, bool)
            for q in self.p[self.k == j]:
                mask[q:q + GRAM] = True
            self.own.append([self.size[j] < GRAM or bool(mask[a:a + len(w)].any()) for a, w in words])

    def spans(self, ids: np.ndarray, texts: list[str]) -> list[tuple]:
        """Verified chains of a batch of documents."""
        parts = [fold(t) if t else b"" for t in texts]
        gap = b"\xff" * GRAM  # no window reaches over two documents
        start = np.cumsum([0] + [len(p) + GRAM for p in parts])
        data = gap.join(parts) + gap
        found = [(d, k, 0, len(w), parts[d].index(w), parts[d].index(w) + len(w)) for k, w in self.tiny for d in range(len(parts)) if w in parts[d]]
        found += self._chains(data, start) if len(self.h) else []
        found = [(x[1], r) for x in found if (r := self._verify(int(ids[x[0]]), parts[x[0]], *x[1:]))]
        return [(doc_id, i, *rest) for k, (doc_id, *rest) in found for i in self.ids[k]]

    def _chains(self, data: bytes, start: np.ndarray) -> list[tuple]:
        """(document, passage, from and to in it, from and to in the document) of hits that follow each other."""
        with np.errstate(over="ignore"):
            h = windows(np.frombuffer(data, dtype=np.uint8))
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        j, end = (np.searchsorted(self.h, h[at], side=x) for x in ("left", "right"))
        n = end - j
        at = np.repeat(at, n)  # a window of several passages counts for each
        j = np.repeat(j - np.cumsum(n) + n, n) + np.arange(n.sum())
        if not len(at):
            return []
        doc = np.searchsorted(start, at, side="right") - 1
        item, pos = self.k[j], self.p[j]
        o = np.lexsort((at, item, doc))
        doc, item, pos, at = doc[o], item[o], pos[o], at[o]
        di, dd = np.diff(pos), np.diff(at)
        joined = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (di > 0) & (di <= GAP_ITEM) & (dd <= GAP_DOC)
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        least = np.minimum(3 * MIN_WORDS, (0.7 * np.array(self.size)).astype(int))
        long = np.flatnonzero(pos[last] - pos[first] + GRAM >= least[item[first]])
        out = []
        for c in long:
            f, l = first[c], last[c]
            d, k = int(doc[f]), int(item[f])
            lo, hi = int(pos[f]), int(pos[l]) + GRAM
            begin, end = int(at[f] - start[d]), int(at[l] - start[d]) + GRAM
            out.append((d, k, lo, hi, begin, end))
        return out

    def _verify(self, doc_id: int, text: bytes, k: int, lo: int, hi: int, begin: int, end: int) -> tuple | None:
        """Grow the chain over words that still agree, then count what it holds."""
        words, rare, own = self.words[k], self.rare[k], self.own[k]
        slack = 60
        region_from = max(0, begin - 160)
        region_to = min(len(text), end + 160)
        region = text[region_from:region_to]
        inside = [i for i, (a, w) in enumerate(words) if a + len(w) > lo and a < hi]
        if not inside:
            return None

        def there(i: int, near: int) -> bool:
            a, w = words[i]
            return region.find(w, max(0, near - slack), near + slack + len(w)) >= 0

        i0, i1 = inside[0], inside[-1]
        for step in (-1, 1):  # a few words further while most agree
            i = i0 if step < 0 else i1
            miss = 0
            while 0 <= i + step < len(words) and miss < 3:
                i += step
                near = begin + (words[i][0] - lo) if step < 0 else end + (words[i][0] - hi)
                if len(words[i][1]) > 2 and there(i, near - region_from):
                    miss = 0
                    i0, i1 = (i, i1) if step < 0 else (i0, i)
                else:
                    miss += 1
        span = [i for i in range(i0, i1 + 1) if own[i]]
        found = {i for i in span if words[i][1] in region}
        r = [i for i in span if rare[i]]
        n_rare = sum(i in found for i in r)
        rare_found = n_rare / len(r) if r else 0.0
        words_found = len(found) / max(1, len(span))
        whole = len(words) < MIN_WORDS and i0 == 0 and i1 == len(words) - 1
        return doc_id, len(span), n_rare, rare_found, words_found, begin, end, whole


@lru_cache(maxsize=2)
def _grams(key: tuple) -> TestGrams:
    return TestGrams(list(key))


def leak_spans(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Every chained stretch of an item in a document, with its measures (SPAN_SCHEMA).

    ``items``: (item_id, passage) rows of the fixed test set. NULL and empty
    texts have no stretch. doc_from and doc_to count letters and digits.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(items))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _grams(shared.value)
        names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame(grams.spans(b["doc_id"].to_numpy(), b["text"].tolist()), columns=names)

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(scan, SPAN_SCHEMA)


#: A short passage counts if it is there as a whole and hardly damaged, a longer one from MIN_WORDS of its words in one run.
LEAK = (
    f"(n_words >= {MIN_WORDS} AND rare_found >= {RARE_SHARE} AND words_found >= {WORD_SHARE} AND (n_rare >= 2 OR words_found >= {SURE_SHARE}))"
    f" OR (whole AND words_found >= {SURE_SHARE})"
)


def leaked(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, item_id) of the documents that hold an item, or MIN_WORDS words of it in one run."""
    return leak_spans(documents, items).where(LEAK).select("doc_id", "item_id").distinct()


def _is_leak(n_words: int, n_rare: int, rare_found: float, words_found: float, whole: bool) -> bool:
    long = n_words >= MIN_WORDS and rare_found >= RARE_SHARE and words_found >= WORD_SHARE and (n_rare >= 2 or words_found >= SURE_SHARE)
    return long or (whole and words_found >= SURE_SHARE)


def without_leaks(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, text, n_removed): every document, its leaked spans cut out (each becomes one blank).

    A document without a leak keeps its text as it is, NULL too. To drop whole
    documents, join ``leaked`` as an anti join, or keep n_removed = 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(items))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = _grams(shared.value)
        for b in batches:
            texts, removed = b["text"].tolist(), [0] * len(b)
            cuts: dict[int, list] = {}
            for row, _, n_words, n_rare, rare, found, begin, end, whole in grams.spans(np.arange(len(b)), texts):
                if _is_leak(n_words, n_rare, rare, found, whole):
                    cuts.setdefault(row, []).append((begin, end))
            for row, spans in cuts.items():
                at, text, pieces, last = places(texts[row]), texts[row], [], 0
                for begin, end in sorted(spans):
                    lo, hi = int(at[begin]), int(at[min(end, len(at)) - 1]) + 1
                    if lo >= last:
                        pieces.append(text[last:lo])
                        removed[row] += 1
                    last = max(last, hi)
                texts[row] = " ".join([*pieces, text[last:]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "n_removed": removed})

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(clean, "doc_id BIGINT, text STRING, n_removed INT")
