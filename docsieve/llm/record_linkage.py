"""Problem 2: matching records across sources that share no key.

Sorted neighbourhood over several composite sort keys: the records of both sides
are brought into one order per key, and a window slides over it. The window is a
range of the key's last part (days), not a number of rows, so that it loses no
partner where many records share a key. Each key is cut into stretches of days
and a window is a join within a stretch, so hot keys are many groups and no list
of neighbours is ever collected; the weighted field similarities are part of the
join, and only pairs that pass them leave it. From these a one-to-one assignment
of greatest total confidence is taken.

The keys: each stated sum (total or net, within two cents) and the day; the first
letters of the seller and the day; those of the buyer and the day; the sum alone
for records without a day. So one of sum, seller, buyer and day may be absent or
misread, and with a sum in common both parties. Records with neither a sum nor a
day in common are not compared. The keys of parties hold only pairs whose sums
can't be compared; all others meet by a sum or contradict each other.
"""

from __future__ import annotations

from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.matching import greatest_matching
from docsieve.llm.name_variants import abbreviates, heard, words_of
from docsieve.llm.survivorship import is_blank
from docsieve.runtime import written

#: An order goes before its invoice by so many days at most; sums agree within so many cents.
DAYS, CENTS = 7, 2
WEIGHTS = {"seller": 0.3, "buyer": 0.3, "total": 0.3, "day": 0.1}
ACCEPT = 0.75
#: A field that one side lacks counts as much; without sums to compare both parties must agree so well.
ABSENT, PARTIES = 0.6, 0.8
#: Every component is assigned exactly. A caller may set a number of pairs, above which one is taken in rounds of mutual best pairs.
EXACT_PAIRS: int | None = None
#: Confidences are added as whole numbers of this fraction.
WEIGHT_UNITS = 10**9


def amount_cents(value: Column) -> Column:
    """Cents of an amount in either notation, with or without currency; NULL if unreadable."""
    s = F.regexp_replace(F.upper(value), r"(USD|EUR|GBP|CHF|[$€£\s ])", "")
    s = F.translate(s, "OILS|B", "011518")
    us = s.rlike(r"^\d{1,3}(,\d{3})+(\.\d{1,2})?$") | s.rlike(r"^\d+(\.\d{1,2})?$")
    eu = s.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$") | s.rlike(r"^\d+,\d{1,2}$")
    num = F.when(us, F.regexp_replace(s, ",", "")).when(eu, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", "."))
    return F.round(num.try_cast("double") * 100).cast("bigint")


def day_number(value: Column) -> Column:
    """Days since 1970 of a date in any of the notations; month first with slashes; NULL if unreadable."""
    v = F.trim(value)
    n = F.translate(v, "OoIl|", "00111")  # figures misread as letters, in all-figure notations
    numeric = [(n, p) for p in ("yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "M/d/yyyy")]
    worded = [(F.initcap(v), p) for p in ("d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy")]
    parsed = [F.try_to_timestamp(c, F.lit(p)) for c, p in numeric + worded]
    return F.unix_date(F.coalesce(*parsed).cast("date"))


def telling_part(name: str, common: Collection[str], memo: dict[str, bool] | None = None) -> str:
    """The rare words of a party's name, as they sound; all its words where blanks were lost. memo: words seen before."""
    memo = {} if memo is None else memo

    def rare(w: str) -> bool:
        if w not in memo:
            memo[w] = len(w) < 3 or not any(len(t) >= 6 and abbreviates(w, t) for t in common)
        return memo[w]

    words = words_of(name)
    rest = [w for w in words if w not in common]
    return heard("".join([w for w in rest if rare(w)] or rest or words))


def _inside(part: Column, whole: Column) -> Column:
    """Whether a part stands in the letters of a whole, with an edit for every three letters, three at most."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole) - F.length(part) + 1))
    near = F.exists(at, lambda i: F.levenshtein(part, F.substring(whole, i, F.length(part)), 3).between(0, F.greatest(F.lit(1), F.floor(F.length(part) / 3))))
    return (F.length(part) >= 5) & (F.contains(whole, part) | near)


def party_similarity(a: Column, b: Column, all_a: Column, all_b: Column) -> Column:
    """1 for equal telling parts, less for a few edits or one inside the other, ABSENT if one is empty."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, lev = F.length(short), F.levenshtein(a, b, 5)
    bound = F.when(n < 9, 1).otherwise(2)
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), ABSENT)
        .when(a == b, 1.0)
        .when(((n >= 5) & F.startswith(long, short)) | ((lev >= 0) & (lev <= bound)), 0.95)
        .when((n >= 6) & (F.length(long) > n + 3) & (F.contains(long, short) | F.levenshtein(short, F.substring(long, F.lit(1), n), 2).between(0, 2)), 0.9)
        .when(_inside(a, all_b) | _inside(b, all_a), 0.8)
        .when((lev >= 0) & (n >= 5), 1 - lev / n)
        .otherwise(0.0)
    )


def _same(x: Column, y: Column) -> Column:
    return F.coalesce(F.abs(x - y) <= CENTS, F.lit(False))


def _open(l: dict, r: dict) -> Column:
    """Whether two records state no sums that could agree or contradict each other."""
    apart = lambda net, total: F.coalesce((total < net - CENTS) | (total > 1.3 * net + CENTS), F.lit(False))
    both = [l[c].isNotNull() & r[c].isNotNull() for c in ("total", "net")]
    return ~(both[0] | both[1] | apart(l["net"], r["total"]) | apart(r["net"], l["total"]))


def sum_similarity(l: dict, r: dict) -> Column:
    """1 for an equal total or net sum, 0.9 for one side's total that is the other's net, 0 for a contradiction, else ABSENT."""
    return (
        F.when(_same(l["total"], r["total"]), 1.0)
        .when(_same(l["net"], r["total"]) | _same(l["total"], r["net"]), 0.9)  # an order may give the sum before tax
        .when(_same(l["net"], r["net"]), 1.0).when(_open(l, r), ABSENT).otherwise(0.0)
    )


FIELDS = ["id", "day", "total", "net", "seller", "buyer", "seller_all", "buyer_all"]


def _scored(pairs: DataFrame) -> DataFrame:
    """l, r, the similarities and the confidence of joined records (l_*, r_*) that may be one transaction."""
    l, r = ({c: F.col(f"{x}_{c}") for c in FIELDS} for x in "lr")
    days = l["day"] - r["day"]
    sims = {
        "total_sim": sum_similarity(l, r), "day_sim": F.when(days.isNull(), ABSENT).when(days.between(0, DAYS), 1.0).otherwise(0.0),
        "seller_sim": party_similarity(l["seller"], r["seller"], l["seller_all"], r["seller_all"]), "buyer_sim": party_similarity(l["buyer"], r["buyer"], l["buyer_all"], r["buyer_all"]),
    }
    out = pairs.where((l["id"] != r["id"]) & (sims["total_sim"] >= 0.5) & (sims["day_sim"] >= 0.5))  # the cheap ones first
    out = out.select(l["id"].alias("l"), r["id"].alias("r"), *[v.alias(k) for k, v in sims.items()])
    agree = [(F.col(c) >= PARTIES) | (F.col(c) == ABSENT) for c in ("seller_sim", "buyer_sim")]
    out = out.where((F.least("seller_sim", "buyer_sim") >= 0.5) & ((F.col("total_sim") != ABSENT) | (agree[0] & agree[1])))
    return out.withColumn("confidence", sum(w * F.col(f"{k}_sim") for k, w in WEIGHTS.items())).where(F.col("confidence") >= ACCEPT)


def _side(records: DataFrame, side: int, name: str, *more: Column) -> DataFrame:
    return records.where(F.col("side") == side).select(*[F.col(c).alias(f"{name}_{c}") for c in FIELDS], *more)


def _window(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of one key whose right record lies within DAYS before the left one.

    A key is cut into stretches of time; right records go into the next stretch too.
    """
    span = 2 * (DAYS + 1)
    cut = F.floor(F.col("l_day") / span)
    first = F.floor(F.col("r_day") / span)
    cuts = F.when(F.pmod("r_day", F.lit(span)) >= span - DAYS, F.array(first, first + 1)).otherwise(F.array(first))
    l, r = left.where("l_day IS NOT NULL").withColumn("cut", cut), right.where("r_day IS NOT NULL").withColumn("cut", F.explode(cuts))
    return l.join(r, [*keys, "cut"]).where(F.col("l_day").between(F.col("r_day"), F.col("r_day") + DAYS)).drop(*keys, "cut")


def linkable_pairs(records: DataFrame) -> DataFrame:
    """Scored pairs (l, r, similarities, confidence) of all sort keys, each once. records: side (0 right, 1 left) and FIELDS.

    A record has a row for each sum it states, total or net, and right records
    for the neighbouring cents too. Records without a day meet by sum alone.
    """
    sums = F.array_compact(F.array("total", "net"))
    around = F.flatten(F.transform(sums, lambda x: F.transform(F.sequence(F.lit(-CENTS), F.lit(CENTS)), lambda d: x + d)))
    left, right = (_side(records, s, n, F.explode(F.array_distinct(x)).alias("cents")) for s, n, x in ((1, "l", sums), (0, "r", around)))
    out = _scored(_window(left, right, ["cents"]))
    for x, y in ((left.where("l_day IS NULL"), right), (left.where("l_day IS NOT NULL"), right.where("r_day IS NULL"))):
        out = out.unionByName(_scored(x.join(y, "cents").drop("cents")))
    # sums can't be compared: one side has none, or one only totals and the other only net sums
    stated = F.concat(F.when(F.col("total").isNotNull(), "t").otherwise(""), F.when(F.col("net").isNotNull(), "n").otherwise(""))
    partner = F.explode(F.when(stated == "", F.array(*map(F.lit, ("", "t", "n", "tn")))).when(stated == "t", F.array(F.lit(""), F.lit("n"))).when(stated == "n", F.array(F.lit(""), F.lit("t"))).otherwise(F.array(F.lit(""))))
    for party in ("seller", "buyer"):
        start = F.substring(party, 1, 4).alias("start")
        l, r = _side(records, 1, "l", start, partner.alias("stated")), _side(records, 0, "r", start, stated.alias("stated"))
        out = out.unionByName(_scored(_window(l.where("start <> ''"), r.where("start <> ''"), ["start", "stated"])))
    return out.groupBy("l", "r").agg(*[F.max(c).alias(c) for c in ("seller_sim", "buyer_sim", "total_sim", "day_sim", "confidence")])


# ----------------------------------------------------------------- assignment

def best_assignment(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The pairs of greatest total weight in which each record stands once, also where one is a left and a right record."""
    best: dict[tuple[str, str], tuple[str, str, float]] = {}
    for e in sorted(edges):
        if e[2] > best.get((min(e[:2]), max(e[:2])), (0, 0, 0.0))[2]:
            best[min(e[:2]), max(e[:2])] = e
    ids = sorted({x for e in best for x in e})
    at = {x: i for i, x in enumerate(ids)}
    mate = greatest_matching(len(ids), [(at[a], at[b], round(e[2] * WEIGHT_UNITS)) for (a, b), e in best.items()])
    return sorted(e for (a, b), e in best.items() if mate[at[a]] == at[b])


def components(pairs: DataFrame) -> DataFrame:
    """pairs (l, r, ...) with the least record of their component; as many rounds as the longest shortest path."""
    live = written(pairs.withColumn("comp", F.least("l", "r")), "components")
    while True:
        least = live.select(F.explode(F.array("l", "r")).alias("id"), "comp").groupBy("id").agg(F.min("comp").alias("m"))
        now = live.join(least.toDF("l", "ml"), "l").join(least.toDF("r", "mr"), "r").withColumn("to", F.least("ml", "mr"))
        live2 = written(now.select(*pairs.columns, F.col("to").alias("comp"), (F.col("to") < F.col("comp")).alias("moved")), "components")
        live = live2.drop("moved")
        if live2.where("moved").isEmpty():
            return live


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment of greatest total confidence. pairs: l, r, confidence; a record stands in one pair of all.

    A pair without rivals stands. The others are assigned exactly, component by
    component whatever its size, each by one task. Of equal totals the same one is
    taken for the same pairs.
    """
    rows = written(pairs.select("l", "r", "confidence"), "assign")
    ends = rows.select(F.explode(F.array("l", "r")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    held = ends.where("n > 1").select("id")
    rivals = rows.join(held.toDF("l"), "l", "left_semi").unionByName(rows.join(held.toDF("r"), "r", "left_semi")).distinct()
    rivals = components(written(rivals, "rivals"))
    alone = rows.join(rivals.select("l", "r"), ["l", "r"], "left_anti")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_assignment(list(rows[["l", "r", "confidence"]].itertuples(index=False, name=None))), columns=["l", "r", "confidence"])

    schema = "l STRING, r STRING, confidence DOUBLE"
    if EXACT_PAIRS is None:
        return alone.unionByName(rivals.groupBy("comp").applyInPandas(solve, schema))
    sizes = rivals.groupBy("comp").agg(F.count("*").alias("n"))
    small, large = (rivals.join(sizes.where(x), "comp", "left_semi") for x in (F.col("n") <= EXACT_PAIRS, F.col("n") > EXACT_PAIRS))
    return alone.unionByName(small.groupBy("comp").applyInPandas(solve, schema)).unionByName(_mutual_best(large.drop("comp")))


def _mutual_best(pairs: DataFrame) -> DataFrame:
    """Rounds of pairs that are best for both records; each settles all pairs that no better pair touches."""
    taken = pairs.limit(0)
    live = written(pairs.select("l", "r", "confidence"), "assign")
    rank = F.struct(-F.col("confidence"), F.col("l"), F.col("r"))
    while not live.isEmpty():
        best = live.select(F.explode(F.array("l", "r")).alias("id"), rank.alias("rank")).groupBy("id").agg(F.min("rank").alias("best"))
        best_l, best_r = best.toDF("l", "bl"), best.toDF("r", "br")
        won = live.join(best_l, "l").join(best_r, "r").where((rank == F.col("bl")) & (rank == F.col("br"))).select("l", "r", "confidence")
        won = written(won, "assigned")
        gone = won.select(F.explode(F.array("l", "r")).alias("id"))
        taken = taken.unionByName(won)
        live = written(live.join(gone.toDF("l"), "l", "left_anti").join(gone.toDF("r"), "r", "left_anti"), "assign")
    return taken


def records_of(claims: DataFrame, common: Collection[str]) -> DataFrame:
    """One record a document and side: id, side, day, total, net (cents), the
    telling parts and all letters of seller and buyer.

    claims: document_id, field_name, entity_key, value. A document is an order or
    an invoice by the fields that only one of them has, and stands on both sides
    if those leave it open; others (receipts, payslips) are left out.
    Blank and placeholder values are absent; of several values of a field, the
    first in order counts. Repeated rows change nothing.
    """
    order = F.col("entity_key").isin("po_number") | F.col("field_name").isin("OrderDate", "OrderAmount", "order_total", "BuyerName", "soldTo", "DeliveryDate", "RequiredDate")
    bill = F.col("entity_key").isin("invoice_id", "tax_amount") | F.col("field_name").isin("InvoiceDate", "BillDate", "DueDate", "PaymentDue", "AmountDue", "InvoiceTotal", "payee", "ClientName", "BillTo")
    other = F.col("entity_key").isin("employee_id", "employee_name", "gross_pay") | F.col("field_name").isin("MerchantName", "TransactionDate")
    good = ~is_blank(F.col("value"))

    def first(key: str) -> Column:
        return F.min(F.when(good & (F.col("entity_key") == key), F.col("value"))).alias(key)

    docs = (
        claims.where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("id"))
        .agg(
            F.sum(F.when(order, 1).otherwise(0)).alias("o"), F.sum(F.when(bill, 1).otherwise(0)).alias("i"), F.max(other).alias("x"),
            *[first(k) for k in ("vendor_name", "customer_name", "invoice_date", "invoice_total", "subtotal", "tax_amount")],
        )
        .where("NOT coalesce(x, false)")
    )
    words, seen = frozenset(common), {}

    @F.pandas_udf(T.StringType())
    def telling(names: pd.Series) -> pd.Series:
        memo: dict = {}
        return names.map(lambda n: (memo[n] if n in memo else memo.setdefault(n, telling_part(n, words, seen))) if n else "")

    @F.pandas_udf(T.StringType())
    def all_letters(names: pd.Series) -> pd.Series:
        return names.map(lambda n: heard("".join(words_of(n))) if n else "")

    total, net, tax = (amount_cents(F.col(c)) for c in ("invoice_total", "subtotal", "tax_amount"))
    side = F.when(F.col("o") > F.col("i"), F.array(F.lit(0))).when(F.col("o") < F.col("i"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return docs.select(
        "id", F.explode(side).alias("side"), day_number(F.col("invoice_date")).alias("day"),
        F.coalesce(total, net + tax).alias("total"), F.coalesce(net, total - tax).alias("net"),
        telling(F.col("vendor_name")).alias("seller"), telling(F.col("customer_name")).alias("buyer"),
        all_letters(F.col("vendor_name")).alias("seller_all"), all_letters(F.col("customer_name")).alias("buyer_all"),
    )


def link_records(claims: DataFrame, common: Collection[str]) -> DataFrame:
    """(document_id_1, document_id_2, confidence): one pair a transaction, ids in order. common: words that tell no party apart."""
    pairs = assign(linkable_pairs(written(records_of(claims, common), "records")))
    return pairs.select(F.least("l", "r").alias("document_id_1"), F.greatest("l", "r").alias("document_id_2"), F.round("confidence", 3).alias("confidence"))
