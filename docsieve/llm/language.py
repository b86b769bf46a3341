"""Problem 8: the language of each document and of each stretch in another language.

Evidence is fused by Bayes' rule: the likelihood of the words under each
language, the language the document declares, the country suffix of addresses in
it, and a prior of its host (the source), smoothed towards that of the host's
kind and of all hosts; the counts behind the priors are one grouped aggregation
over all documents. Word likelihoods come from documents that declare a
language; the sample they are fitted on is bounded by ``TRAIN_DOCS``, and since
some labels are wrong, they are fitted a second time on the documents whose text
agrees with the first fit. Stretches come from a Viterbi pass over the words
with a price for each change of language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.runtime import written

LANGS = ["de", "en", "es", "fr", "it", "nl", "pl", "pt"]
TRAIN_DOCS = 3000
#: Price of a change of language, in nats; evidence a word may give at most.
SWITCH, WORD_MAX = 9.0, 3.0
#: A stretch holds a whole sentence from so many telling words on, of so many words.
TELLING, SENTENCE_WORDS = 6, 10
#: Reliability of a declared language; weight of the smoothing towards the parent.
DECLARED, SMOOTHING, SUFFIX = 0.9, 20.0, 1.0
SEGMENT_SCHEMA = "doc_id BIGINT, declared STRING, segment INT, lang_code STRING, n_words INT, telling INT, confidence DOUBLE, main BOOLEAN"

# fixed values: ISO 639 codes and names of the languages
CODES = {
    "de": ["de", "deu", "ger", "german", "deutsch"], "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "espanol", "español"], "fr": ["fr", "fra", "fre", "french", "francais", "français"],
    "it": ["it", "ita", "italian", "italiano"], "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pl": ["pl", "pol", "polish", "polski"], "pt": ["pt", "por", "portuguese", "portugues", "português"],
}
# fixed values: labels that name no language
NO_LANGUAGE = ["", "xx", "und", "zxx", "mis", "mul", "n/a", "na", "none", "null", "unknown", "-", "?", "other"]
# fixed values: country suffixes of addresses
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "ie": "en", "es": "es", "mx": "es", "fr": "fr", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN = re.compile(r"[a-z]+(?:'[a-z]+)*")
_ADDRESS = re.compile(r"[@.][\w-]+\.([a-z]{2})\b(?![\w.])")
_LETTERS = [("ł", "l"), ("ø", "o"), ("’", "'")]
#: Lines of tables: an item with a count and a price, or a label with its value.
_ITEM = re.compile(r"^\s*\d+\s+.*\d+\s*[xX×]\s*[\d.,]+\W*$")


def declared_language(label: Column) -> Column:
    """Two-letter code of a label in any code style; NULL where it is no language; others as written."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[-_].*$", "")
    out = F.when(F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(NO_LANGUAGE) | base.isin(NO_LANGUAGE), None)
    for code, names in CODES.items():
        out = out.when(base.isin(names), F.lit(code))
    return out.otherwise(base)


def words_of(text: str) -> list[str]:
    """The words of a text without case and accents (both are often lost)."""
    t = text.casefold()
    if not t.isascii():
        for a, b in _LETTERS:
            t = t.replace(a, b)
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return _PLAIN.findall(t)


def prose(text: str) -> str:
    """The text without the lines of tables and labels, whose words are no sentences."""
    keep = []
    for line in re.split(r"[\r\n]+", text):
        words = _WORD.findall(line)
        if len(words) < SENTENCE_WORDS and _ITEM.match(line):
            continue  # a line with words for a whole sentence is always read
        if len(words) <= 9:
            body = line.strip().rstrip("|").rstrip()
            low = sum(w[0].islower() for w in words)
            label = re.match(r"^\W*(?:[^\W\d]\S*\s?){1,4}?(?:\s*[:|]|\s{2,}|\s(?=\S*\d))", body)
            if label and low <= 2 and not re.search(r"[.!?]$", body):
                continue
            if label and re.search(r"[:|]|\s{2,}", body) and len(words) <= 6:
                continue
        keep.append(line)
    return "\n".join(keep)


class WordModel:
    """Evidence of each word for each language, in nats against the mean of all."""

    def __init__(self, counts: dict[str, Counter]):
        totals = np.array([sum(counts[x].values()) + 1 for x in LANGS], float)
        grams = {x: Counter() for x in LANGS}
        self.index: dict[str, int] = {}
        rows = []
        for x in LANGS:
            for w, n in counts[x].items():
                if n >= 3:
                    grams[x].update(self._grams(w))
        for w in set().union(*counts.values()):
            n = np.array([counts[x][w] for x in LANGS], float)
            if n.sum() >= 3:
                rate = n / totals
                v = np.log(rate + 0.02 * rate.max() + 0.5 / totals.max())
                self.index[w] = len(rows)
                rows.append(np.clip(v - v.mean(), -WORD_MAX, WORD_MAX))
        gram_n = np.array([sum(grams[x].values()) + 400 for x in LANGS], float)
        self.gram = {g: np.log((np.array([grams[x][g] for x in LANGS], float) + 1) / gram_n) for g in set().union(*grams.values())}
        self.known = len(rows)
        self.rows = np.array(rows or np.zeros((0, len(LANGS))), np.float32)

    @staticmethod
    def _grams(w: str) -> list[str]:
        w = f" {w} "
        return [w[i:i + 3] for i in range(len(w) - 2)]

    def _unknown(self, w: str) -> np.ndarray:
        """Unknown, misread or joined: a little evidence from its letters."""
        g = [self.gram[x] for x in self._grams(w) if x in self.gram] if 3 <= len(w) <= 24 else []
        if not g:
            return np.zeros(len(LANGS))
        v = np.sum(g, axis=0)
        return np.clip(0.25 * (v - v.mean()), -0.6, 0.6)

    def evidence(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            if len(self.index) > 1_000_000:  # forget unknown words that were worked out, never known ones
                self.index = {w: i for w, i in self.index.items() if i < self.known}
                self.rows = self.rows[: self.known]
                new = [w for w in dict.fromkeys(words) if w not in self.index]
            self.rows_add(new)
        return self.rows[[self.index[w] for w in words]].astype(float)

    def rows_add(self, new: list[str]) -> None:
        n = len(self.index)
        if n + len(new) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), n + len(new) + 1024), len(LANGS)), np.float32)
            grown[:n] = self.rows[:n]
            self.rows = grown
        for i, w in enumerate(new, n):
            self.index[w] = i
            self.rows[i] = self._unknown(w)


def fit_words(rows: list[tuple[str, str]]) -> WordModel:
    """Word model of (declared language, text) rows, fitted twice to shed wrong labels."""
    docs = [(x, Counter(words_of(prose(t)))) for x, t in rows if x in LANGS and t]

    def fit(pairs) -> WordModel:
        counts = {x: Counter() for x in LANGS}
        for x, c in pairs:
            counts[x].update({w: min(n, 20) for w, n in c.items()})
        return WordModel(counts)

    model = fit(docs)
    agree = []
    for x, c in docs:
        total = np.array(list(c.values())) @ model.evidence(list(c)) if c else np.zeros(len(LANGS))
        if LANGS[int(np.argmax(total))] == x:
            agree.append((x, c))
    return fit(agree)


def _viterbi(ev: np.ndarray, start: np.ndarray) -> list[int]:
    """Best sequence of states under a fixed price for each change."""
    states = range(ev.shape[1])
    score, back = list(start), []
    for row in ev.tolist():
        top = max(score)
        best, jump = score.index(top), top - SWITCH
        back.append([x if score[x] >= jump else best for x in states])
        score = [(score[x] if score[x] >= jump else jump) + row[x] for x in states]
    x = score.index(max(score))
    path = []
    for step in reversed(back):
        path.append(x)
        x = step[x]
    return path[::-1]


def segments(model: WordModel, text: str, prior: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(language, words, telling words, confidence) of each stretch of the prose."""
    words = words_of(prose(text))
    if not words:
        return []
    ev = model.evidence(words)
    n, k = ev.shape
    main = int((ev.sum(0) + prior).argmax())
    # a change pays only where some stretch gains more than its price over the main language
    gain = np.cumsum(ev - ev[:, [main]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    gains = (gain - low).max(0)
    active = [main, *np.flatnonzero(gains > SWITCH - max(0.0, float((prior - prior[main]).max())))]
    path = np.full(n, main) if len(active) == 1 else np.array(active)[_viterbi(ev[:, active], prior[active])]
    cuts = np.flatnonzero(np.diff(path)) + 1
    out = []
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, n]):
        x = int(path[a])
        tot = ev[a:b].sum(0) + prior
        p = np.exp(tot - tot.max())
        telling = int(((ev[a:b, x] > 1.0) & (ev[a:b].argmax(1) == x)).sum())
        out.append((x, int(b - a), telling, float(p[x] / p.sum())))
    return out


def host_priors(docs: DataFrame) -> DataFrame:
    """(source, counts): documents that declare each language, of the source, of its kind, of all (three lists).

    ``docs``: source, declared. The kind is the source's name without its number.
    Grouped aggregations over all documents; a source without labels has its kind's prior.
    """
    kind = F.regexp_replace(F.coalesce("source", F.lit("")), r"[-_]?\w*\d\w*$", "")
    counts = docs.select(F.coalesce("source", F.lit("")).alias("source"), kind.alias("kind"), "declared")
    sums = [F.sum(F.when(F.col("declared") == x, 1).otherwise(0)).alias(x) for x in LANGS]
    host = counts.groupBy("source", "kind").agg(*sums)
    by_kind = host.groupBy("kind").agg(*[F.sum(x).alias(f"k_{x}") for x in LANGS])
    all_ = host.agg(*[F.sum(x).alias(f"a_{x}") for x in LANGS])
    joined = host.join(by_kind, "kind").crossJoin(F.broadcast(all_))  # all_ is one row
    return joined.select("source", F.array(*[F.array(*[F.col(f"{p}{x}").cast("double") for x in LANGS]) for p in ("", "k_", "a_")]).alias("counts"))


def log_prior(counts: np.ndarray, declared: str | None) -> np.ndarray:
    """Log prior of each language from the counts of ``host_priors``, smoothed towards the host's kind and all.

    The document's own label is taken out of the counts, as it is evidence by itself.
    """
    n = np.array(counts, float)
    if declared in LANGS:
        n[:, LANGS.index(declared)] -= 1
    n = np.maximum(n, 0)
    top = (n[2] + 1) / (n[2].sum() + len(LANGS))
    mid = (n[1] + SMOOTHING * top) / (n[1].sum() + SMOOTHING)
    return np.log((n[0] + SMOOTHING * mid) / (n[0].sum() + SMOOTHING))


def train(documents: DataFrame, bound: int = TRAIN_DOCS) -> WordModel:
    """Fit on at most ``bound`` labelled documents per run, drawn by the hash of the id.

    The rest of the corpus is not sampled: every document is labelled.
    """
    labelled = documents.select("doc_id", "text", declared_language(F.col("lang")).alias("declared")).where(
        F.col("declared").isin(LANGS) & F.length("text").between(200, 20000)
    )
    n = labelled.count()
    share = min(1.0, 0.9 * bound / max(n, 1))  # of the hash range, so that what is sent to the driver is bounded
    rows = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "declared", "text").limit(bound).collect()
    return fit_words([(r.declared, r.text) for r in sorted(rows)])


def label_segments(documents: DataFrame, model: WordModel, use_label: bool = True) -> DataFrame:
    """Each stretch of each document with its language (SEGMENT_SCHEMA). use_label: whether the declared language is evidence.

    ``main`` marks the language with most words. NULL, empty and wordless texts
    have no stretch. Texts are taken whole; very long ones cost in proportion.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    base = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), declared_language(F.col("lang")).alias("declared")
    )
    # written, so that its size is known: few hosts are broadcast, many are joined by a shuffle
    priors = written(host_priors(base.select("source", "declared")), "host-priors")
    rows = base.join(priors, "source", "left").select("doc_id", "text", "declared", "counts")
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for doc_id, text, declared, counts in zip(b["doc_id"], b["text"], b["declared"], b["counts"]):
                lp = log_prior(np.stack(counts), declared) if counts is not None else np.zeros(len(LANGS))
                if declared in LANGS and use_label:
                    d = np.full(len(LANGS), math.log((1 - DECLARED) / (len(LANGS) - 1)))
                    d[LANGS.index(declared)] = math.log(DECLARED)
                    lp = lp + d
                for s in set(_ADDRESS.findall(text)):
                    if s in SUFFIXES:
                        lp[LANGS.index(SUFFIXES[s])] += SUFFIX
                segs = segments(m, text, lp)
                words = Counter()
                for x, n, _, _ in segs:
                    words[x] += n
                top = max(words, key=lambda x: (words[x], -x)) if words else None
                out += [(doc_id, declared, i, LANGS[x], n, t, c, x == top) for i, (x, n, t, c) in enumerate(segs)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(scan, SEGMENT_SCHEMA)


def calibration(documents: DataFrame, model: WordModel) -> DataFrame:
    """(bucket, n, mean_confidence, agree): confidence of each document's main stretch against its label, the label not being evidence.

    A bucket is a tenth of confidence. Labels are wrong at times, so agreement
    can't reach 1; documents without a label, or with one of no known language, are left out.
    """
    s = label_segments(documents, model, use_label=False).where(F.col("main") & F.col("declared").isin(LANGS))
    one = s.groupBy("doc_id").agg(F.max_by(F.struct("confidence", "lang_code", "declared"), F.struct("n_words", "segment")).alias("r")).select("r.*")
    g = one.groupBy(F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("bucket"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg((F.col("lang_code") == F.col("declared")).cast("int")), 6).alias("agree"))


def corrected_labels(documents: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, lang_code) of the documents whose label is missing, wrong or too narrow.

    One row per language in which a whole sentence is written. A document whose
    label, in any code style, names the only language of its text has no row.
    """
    whole = f"telling >= {TELLING} AND n_words >= {SENTENCE_WORDS}"
    langs = label_segments(documents, model).where(whole).groupBy("doc_id").agg(
        F.collect_set("lang_code").alias("langs"), F.max("declared").alias("declared")  # at most eight languages
    )
    wrong = F.col("declared").isNull() | (F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("declared"))
    return langs.where(wrong).select("doc_id", F.explode("langs").alias("lang_code"))
