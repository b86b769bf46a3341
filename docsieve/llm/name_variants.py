"""Problem 3: variant spellings of names typed by people.

A trie join. A registered name is split into its telling part (the rare word of
an organisation, the family name of a person) and the common words beside it,
and the telling parts stand in a trie for each kind. Each distinct spelling is
taken apart in the same way for every order of its words that makes sense, a
Levenshtein automaton enumerates the trie's names within a bounded distance of
its telling part, and the other words must agree. A spelling that fits two
entities equally well means none.

There are no word lists. Which words are common, what they stand for ("constr"
for "construction", "limited" for "ltd", a short first name for a long one) and
which say nothing ("the", "billing", a title) is learnt from all spellings by
one grouped aggregation: beside how many different telling words of the register
a word stands, and what the registered names with these have in common.
The register is a small fixed table, so it may be broadcast; so may what is
learnt, a word or two for each way to write a registered common word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.runtime import written

#: A word in so many registered names is a common one (a trade, a legal form).
COMMON = 8
#: A word is learnt from so many telling words on: organisations, persons, words that say nothing beside a person.
SUPPORT, SUPPORT_PERSON, SUPPORT_TITLE = 5, 2, 6
#: It stands for a registered word that so large a share of them has.
SHARE, SHARE_PERSON = 0.75, 0.6
#: A word of so many letters may be several without blanks.
GLUED = 12
MATCH_SCHEMA = "kind STRING, value STRING, entity_id BIGINT, distance INT"

# fixed values: letters without a decomposition; figures read for letters
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "0": "o", "1": "l", "5": "s", "8": "b", "|": "l", "’": "'", "`": "'"})


def simple(value: str) -> str:
    """Lower case, without accents, digits that stand for letters put right."""
    s = unicodedata.normalize("NFKD", value.casefold())
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_LETTERS)


def letters(s: str) -> str:
    return "".join(c for c in s if c.isalpha() and c.isascii())


def words_of(value: str) -> list[str]:
    """The words of a name, letters only; letters with dots between them (s. a.) are one word, & and + are "and"."""
    s = re.sub(r"\b((?:[a-z][./]\s*){2,}(?:[a-z]\b)?)", lambda m: letters(m[1]) + " ", simple(value))
    return [w for w in (letters(x) for x in re.split(r"[\s,;/()_-]+", re.sub("[&+]", " and ", s))) if w]


def heard(name: str) -> str:
    """Spellings that sound the same, made the same (as a name taken down by ear)."""
    for a, b in (("ph", "f"), ("oo", "u"), ("qu", "kw"), ("ck", "k"), ("c", "k"), ("y", "i")):
        name = name.replace(a, b)
    return name


class Trie:
    """A trie of names; ``near`` walks it with the rows of a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, name: str) -> None:
        node = self.root
        for c in name:
            node = node.setdefault(c, {})
        node[""] = name

    def near(self, word: str, bound: int) -> list[tuple[int, str]]:
        """(distance, name) of every name within the bound; neighbours swapped count one."""
        found: list[tuple[int, str]] = []
        n = len(word)
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            if "" in node and row[n] <= bound:
                found.append((row[n], node[""]))
            for c, child in node.items():
                if c == "":
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    w = word[i - 1]
                    d = row[i - 1] if w == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if before is not None and i > 1 and w == last and word[i - 2] == c and before[i - 2] + 1 < d:
                        d = before[i - 2] + 1
                    new.append(d)
                if min(new) <= bound:
                    stack.append((child, c, new, row))
        return found

    def under(self, start: str) -> list[str]:
        """The names that begin with a text."""
        node = self.root
        for c in start:
            node = node.get(c)
            if node is None:
                return []
        found, stack = [], [node]
        while stack:
            node = stack.pop()
            found += [x for c, x in node.items() if c == ""]
            stack += [x for c, x in node.items() if c != ""]
        return found

    def begins(self, text: str) -> list[tuple[int, str, int]]:
        """(distance, name, end) of the names that a text begins with, within their bounds."""
        found: list[tuple[int, str, int]] = []
        n = len(text)
        stack = [(self.root, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            if "" in node and len(node[""]) >= 5:
                bound = bound_for(node[""])
                found += [(row[i], node[""], i) for i in range(1, n + 1) if row[i] <= bound]
            for c, child in node.items():
                if c == "":
                    continue
                new, low = [row[0] + 1], row[0] + 1
                for i in range(1, n + 1):
                    d = row[i - 1] if text[i - 1] == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    new.append(d)
                    low = d if d < low else low
                if low <= 2:
                    stack.append((child, new))
        return found


def bound_for(name: str) -> int:
    """Edits allowed in a telling part: none in short ones, one, two in long ones."""
    return 0 if len(name) < 5 else 1 if len(name) < 9 else 2


def abbreviates(short: str, word: str, edits: int = 2) -> bool:
    """A beginning, a contraction in order from the same letter, or a misspelling of a common word."""
    if not short or short[0] != word[0]:
        return len(short) >= 5 and _distance(short, word, 2) <= 1
    if word.startswith(short):
        return True
    it = iter(word)
    if len(short) >= 3 and all(c in it for c in short):
        return True
    return len(short) >= 5 and _distance(short, word, edits) <= edits


@lru_cache(maxsize=200_000)
def _letter_set(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def _distance(a: str, b: str, bound: int) -> int:
    """Edits between two words, neighbours swapped count one; bound + 1 if there are more than the bound.

    An edit changes two letters of the set of letters at most, which settles most words.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > bound or (_letter_set(a) ^ _letter_set(b)).bit_count() > 2 * bound:
        return bound + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = row[j - 1] if x == y else 1 + min(row[j - 1], row[j], new[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            new.append(d)
        if min(new) > bound:
            return bound + 1
        before, row = row, new
    return min(row[-1], bound + 1)


@dataclass(frozen=True)
class Lexicon:
    """What words beside the telling part mean: the registered words they stand for, none if they say nothing."""

    organisation: dict[str, frozenset[str]] = field(default_factory=dict)
    person: dict[str, frozenset[str]] = field(default_factory=dict)


def _taken_apart(rows: list[tuple[int, str, str]]) -> tuple[set[str], list[tuple[int, str, list[str], list[str]]]]:
    """Common words of the registered organisations; (entity, kind, telling words, other words) of each name."""
    words = Counter(w for _, kind, n in rows if kind == "organisation" for w in set(words_of(n)))
    common = {w for w, n in words.items() if n >= COMMON}
    out = []
    for i, kind, name in rows:
        ws = words_of(name)
        if kind == "organisation":
            tell = [w for w in ws if w not in common] or ws
            out.append((i, kind, tell, [w for w in ws if w in common]))
        elif ws:
            out.append((i, kind, ws[-1:], ws[:-1]))
    return common, [x for x in out if x[2]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(values: pd.Series) -> pd.Series:
    return values.map(lambda v: sorted(set(words_of(v))))


def learn(values: DataFrame, register: DataFrame) -> Lexicon:
    """The lexicon of all spellings. values: kind, value (distinct ones do); register: entity_id, kind, registered_name.

    Counted is beside how many different telling words a word stands, so that a
    hot name counts once. What comes to the driver are the words with support.
    """
    spark = values.sparkSession
    common, apart = _taken_apart(_register_rows(register))
    own = sorted({(kind, tell[0], w) for _, kind, tell, other in apart for w in other if len(tell) == 1})
    given = {w for _, kind, _, other in apart if kind == "person" for w in other}
    known = {k: {t for _, kind, tell, _ in apart if kind == k for t in tell} for k in ("organisation", "person")}
    if not own:
        return Lexicon({w: frozenset([w]) for w in common})
    beside = F.broadcast(spark.createDataFrame(own, "kind STRING, tell STRING, stands STRING"))  # rows of the fixed register
    tells = F.broadcast(spark.createDataFrame(sorted({x[:2] for x in own}), "kind STRING, tell STRING"))
    named = values.where("kind IS NOT NULL AND value IS NOT NULL").select("kind", _words("value").alias("ws"))
    seen = named.select("kind", "ws", F.explode("ws").alias("tell")).join(tells, ["kind", "tell"]).select("kind", "tell", F.explode("ws").alias("w")).where("w <> tell").distinct()
    n = seen.groupBy("kind", "w").agg(F.count("*").alias("n"))
    pairs = seen.join(beside, ["kind", "tell"]).groupBy("kind", "w", "stands").agg(F.count("*").alias("m"))
    rows = n.where(F.col("n") >= F.when(F.col("kind") == "person", SUPPORT_PERSON).otherwise(SUPPORT)).join(pairs, ["kind", "w"]).collect()
    by: dict[tuple[str, str], list] = defaultdict(list)
    for r in rows:
        if r.w not in known[r.kind] and r.w not in common and r.w not in given and (r.kind == "organisation" or len(r.w) > 1):
            by[r.kind, r.w].append((r.stands, r.m, r.n))
    org, person = {w: frozenset([w]) for w in common}, {}
    for (kind, w), xs in by.items():
        stands = frozenset(x for x, m, k in xs if m >= (SHARE_PERSON if kind == "person" else SHARE) * k)
        if kind == "organisation":
            org[w] = stands
        elif stands or xs[0][2] >= SUPPORT_TITLE:
            person[w] = stands
    return Lexicon(org, person)


@dataclass
class Register:
    """The registered names, taken apart; built once on each executor."""

    rows: list[tuple[int, str, str]]
    lexicon: Lexicon = field(default_factory=Lexicon)

    def __post_init__(self) -> None:
        common, apart = _taken_apart(self.rows)
        self.stands = {w: frozenset([w]) for w in common} | self.lexicon.organisation
        self.written: dict[str, set[str]] = defaultdict(set)
        for w, xs in self.stands.items():
            for x in xs:
                self.written[x].add(w)
        kinds = ("organisation", "person")
        self.by_key: dict[str, dict[str, list]] = {k: defaultdict(list) for k in kinds}
        self.full: dict[str, list] = defaultdict(list)
        self.tries, self.whole, self.memo = {k: Trie() for k in kinds}, Trie(), {}
        for i, kind, tell, other in apart:
            self.by_key[kind][heard("".join(tell))].append((i, other))
            if kind == "person":
                self.full["".join(other + tell)].append(i)
        for kind, keys in self.by_key.items():
            for k in keys:
                self.tries[kind].add(k)
        for k in self.full:
            self.whole.add(k)
        self.longest = max([0, *(len(k) for keys in self.by_key.values() for k in keys)])

    def _near(self, kind: str, key: str) -> list[tuple[int, str]]:
        """(distance, telling part) within its bound; each telling part is searched once a task."""
        found = self.memo.get((kind, key))
        if found is None:
            found = [(0, key)] if key in self.by_key[kind] else self.tries[kind].near(key, bound_for(key)) if len(key) <= self.longest + 2 else []
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[kind, key] = found
        return found

    # -------------------------------------------------------- organisations

    def organisation(self, value: str) -> tuple[int, int] | None:
        cut = bool(re.search(r"(\.{2,}|…|-)\W*$", value))
        words = words_of(re.sub(r"\([^)]*\)?\s*$", "", value) if not value.startswith("(") else value)
        plain = [w for w in words if w not in self.stands]
        needs = [self.stands[w] for w in words if self.stands.get(w)]
        if not words:
            return None
        best: dict[int, int] = {}
        readings = list(self._readings(plain or words))
        for exact in (True, False):  # cheapest first: telling parts letter for letter, then the trie
            for key, rest in readings:
                if (key in self.by_key["organisation"]) == exact:
                    for d, name in self._found(key, cut and not rest):
                        for i, own in self.by_key["organisation"][name]:
                            if all(x & set(own) for x in needs) and self._agree(rest, own):
                                best[i] = min(best.get(i, 99), d)
            if best:
                return self._only(best)
        if not needs or max(map(len, plain), default=0) >= GLUED:  # blanks may be lost
            glued = heard("".join(plain or words))
            for d, name, end in self.tries["organisation"].begins(glued[: self.longest + 2]):
                for i, own in self.by_key["organisation"][name]:
                    if end < len(glued) and all(x & set(own) for x in needs) and self._tail_agrees(glued[end:], tuple(own)):
                        best[i] = min(best.get(i, 99), d)
        return self._only(best)

    def _readings(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(telling part, other words): one run of the words at their start or end, as long as a registered one may be."""
        for order in (1, -1):
            size = 0
            for k in range(1, len(words) + 1):
                size += len(words[k - 1] if order > 0 else words[-k])
                if size > self.longest + 4:
                    break
                if order > 0:
                    yield heard("".join(words[:k])), words[k:]
                elif k < len(words):
                    yield heard("".join(words[-k:])), words[:-k]

    def _found(self, key: str, cut: bool) -> list[tuple[int, str]]:
        if cut and len(key) >= 6 and key not in self.by_key["organisation"]:
            found = self.tries["organisation"].under(key)
            if found:
                return [(1, k) for k in found]
        return self._near("organisation", key)

    def _agree(self, rest: list[str], own: list[str]) -> bool:
        """Whether words without a meaning of their own are the name's common words, short or misspelt."""
        if not rest:
            return True
        if len(rest) > 2 * len(own) + 2:
            return False
        fits = lambda w: any(abbreviates(w, x) for x in own)
        return all(map(fits, rest)) or fits("".join(rest))

    def _tail_agrees(self, tail: str, own: tuple[str, ...]) -> bool:
        """Whether letters without blanks are the name's common words, one of them perhaps short or misspelt."""
        ends = self.memo.get(own)
        if ends is None:
            ends = {""}
            for k in range(1, len(own)):  # the words at the end, each as it may be written
                ends |= {heard(v) + e for v in self.written[own[-k]] | {own[-k], ""} for e in ends}
            self.memo[own] = ends
        return any(tail.endswith(e) and (tail == e or any(abbreviates(tail[: len(tail) - len(e)], heard(x), 1) for x in own)) for e in ends)

    # --------------------------------------------------------------- persons

    def person(self, value: str) -> tuple[int, int] | None:
        s = re.sub(r"\([^)]*\)?\s*$", "", value)
        words = words_of(s)
        named = [w for w in words if self.lexicon.person.get(w, True)]  # words that say nothing left out
        words = named or words
        best: dict[int, int] = {}
        for first, last in self._orders(words, "," in s):
            for d, name in self._near("person", heard(last)):
                for i, given in self.by_key["person"][name]:
                    e = self._given(first, given)
                    if e is not None and d + e <= 2:
                        best[i] = min(best.get(i, 99), d + e)
        if not best and len(words) == 1:  # blanks lost
            for d, name in self.whole.near(words[0], 1) if len(words[0]) <= 2 * self.longest else []:
                for i in self.full[name]:
                    best[i] = min(best.get(i, 99), d)
        return self._only(best)

    def _orders(self, words: list[str], comma: bool) -> Iterator[tuple[list[str], str]]:
        n = len(words)
        if n == 1:
            yield [], words[0]
        for k in range(1, n):
            if sum(map(len, words[k:])) <= self.longest + 2:
                yield words[:k], "".join(words[k:])  # given names first
            if sum(map(len, words[:k])) <= self.longest + 2:
                yield words[k:], "".join(words[:k])  # family name first
        if n > 2 and not comma:
            yield words[:-1], words[-1]

    def _given(self, first: list[str], given: list[str]) -> int | None:
        """Edits between the given names, None if they differ; initials, beginnings and learnt short forms are equal."""
        if not first:
            return 0
        f, g = first[0], given[0] if given else ""
        if len(first) > 1 and not all(len(x) <= 2 for x in first[1:]):
            joined = "".join(first)
            return 0 if joined == g else 1 if _distance(joined, g, 1) <= 1 else None
        stem = re.sub(r"(.)\1$", r"\1", re.sub(r"(y|ie)$", "", f))  # a diminutive of the beginning
        if f == g or (len(f) != 2 and g.startswith(f)) or (len(stem) >= 3 and g.startswith(stem)) or g in self.lexicon.person.get(f, ()):
            return 0
        if len(f) >= 4 and _distance(f, g, 2) <= (1 if len(g) < 7 else 2):
            return 1
        return None

    @staticmethod
    def _only(best: dict[int, int]) -> tuple[int, int] | None:
        if not best:
            return None
        d = min(best.values())
        ids = [i for i, x in best.items() if x == d]
        return (ids[0], d) if len(ids) == 1 else None

    def match(self, kind: str, value: str) -> tuple[int, int] | None:
        """(entity, edits) that a spelling means; None if there is none or more than one."""
        if not value or not any(c.isalpha() for c in value):
            return None
        return self.person(value) if kind == "person" else self.organisation(value)


def _register_rows(register: DataFrame) -> list[tuple[int, str, str]]:
    rows = register.select("entity_id", "kind", "registered_name").distinct().collect()  # fixed, small
    return sorted((r.entity_id, r.kind, r.registered_name) for r in rows if r.registered_name and r.kind in ("organisation", "person"))


def link_spellings(values: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, value, entity_id, distance) of each distinct spelling that means a registered entity.

    values: kind ('organisation' or 'person'), value. NULL and empty values link
    to nothing; a value of any length is read. The spellings are de-duplicated
    first, so a hot name is looked up once.
    """
    spark = values.sparkSession
    spellings = written(values.where("value IS NOT NULL AND kind IS NOT NULL").select("kind", "value").distinct(), "spellings")
    shared = spark.sparkContext.broadcast((_register_rows(register), learn(spellings, register)))
    names = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reg = Register(*shared.value)
        for b in batches:
            out = []
            for kind, value in zip(b["kind"], b["value"]):
                m = reg.match(kind, value)
                if m:
                    out.append((kind, value, *m))
            yield pd.DataFrame(out, columns=names)

    # few bytes but much work a row: spread by number, as adaptive coalescing goes by size
    spread = 4 * spark.sparkContext.defaultParallelism
    return spellings.repartition(spread, "kind", "value").mapInPandas(search, MATCH_SCHEMA)
