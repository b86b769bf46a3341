"""Scalar functions on columns: parsing, comparison, fusion. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve import dims

NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up in binary arithmetic, the same in every engine."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def field_type(name: Column) -> Column:
    """IDENTIFIER, DATE, NUMERIC or FREE_TEXT; NULL names are FREE_TEXT."""
    out = None
    for kind, names in dims.FIELD_TYPES.items():
        out = F.when(name.isin(names), kind) if out is None else out.when(name.isin(names), kind)
    for kind, hint in dims.TYPE_HINTS:
        out = out.when(F.lower(name).rlike(hint), kind)
    return out.otherwise("FREE_TEXT")


def plain_number(value: Column) -> Column:
    """A number as written, no currency; NULL for anything else (also nan, inf, digit groups)."""
    return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))


def parse_number(value: Column) -> Column:
    """A number with currency signs, commas and blanks dropped; NULL if unreadable."""
    return plain_number(F.regexp_replace(value, r"[$,€£\s]", ""))


def first_date(value: Column, patterns: list[str]) -> Column:
    """The date of the first pattern that reads the whole value; NULL if none does."""
    v = F.trim(value)
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for p in patterns]).cast("date")


# fixed values: date notations, in order of precedence
AGREEMENT_DATES = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
EVALUATION_DATES = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy"]
VALIDATION_DATES = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy"]


def bare(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def readable(value: Column, kind: Column) -> tuple[Column, Column]:
    """(number, date) of a value, each only where its field type asks for it; compute them once, before any join."""
    return F.when(kind == "NUMERIC", parse_number(value)), F.when(kind == "DATE", first_date(value, AGREEMENT_DATES))


def agreement(a: Column, b: Column, kind: Column) -> Column:
    """How two readings of a field agree, by its type; single_source if one is NULL."""
    return agreement_of(a, b, kind, readable(a, kind), readable(b, kind))


def agreement_of(a: Column, b: Column, kind: Column, read_a: tuple[Column, Column], read_b: tuple[Column, Column]) -> Column:
    """``agreement`` of values whose number and date have been read before (``readable``)."""
    (na, da), (nb, db) = read_a, read_b
    ta, tb, xa, xb = F.trim(a), F.trim(b), bare(a), bare(b)
    longest, lev = F.greatest(F.length(xa), F.length(xb)), F.levenshtein(xa, xb)
    text = (
        F.when((ta == tb) | ((xa == xb) & (xa != "")), "ocr==vision")
        .when((longest > 0) & (((lev <= 2) & (longest >= 5)) | ((longest - lev) / longest >= 0.85)), "ocr_near_match")
        .otherwise("ocr!=vision")
    )
    return (
        F.when(a.isNull() | b.isNull(), "single_source")
        .when(kind == "IDENTIFIER", F.when(ta == tb, "ocr==vision").otherwise("ocr!=vision"))
        .when(
            (kind == "NUMERIC") & na.isNotNull() & nb.isNotNull(),
            F.when(F.abs(na - nb) < 0.01, "ocr==vision").when(F.abs(na - nb) <= 1.0, "ocr_near_match").otherwise("ocr!=vision"),
        )
        .when((kind == "DATE") & da.isNotNull() & db.isNotNull(), F.when(da == db, "ocr==vision").otherwise("ocr!=vision"))
        .otherwise(text)
    )


def penalty(agree: Column) -> Column:
    return F.when(agree == "ocr_near_match", 0.95).when(agree == "ocr!=vision", 0.90).otherwise(1.0)


def fused(native: Column, agree: Column, consistency: Column, passed: Column, cap: Column) -> Column:
    """Weighted sum of four signals; without consistency the rest is rescaled; a failed check caps it."""
    w = dims.WEIGHTS
    signal = reduce(lambda c, kv: c.when(agree == kv[0], kv[1]), list(dims.AGREEMENT_SIGNAL.items())[1:], F.when(agree == "ocr==vision", 1.0)).otherwise(0.60)
    valid = F.when(passed, 1.0).otherwise(0.0)
    rest = F.lit(w["native"]) * native + F.lit(w["agreement"]) * signal + F.lit(w["validation"]) * valid
    total = F.when(consistency.isNull(), rest / (1 - w["consistency"])).otherwise(rest + F.lit(w["consistency"]) * consistency)
    total = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)
    return F.when(~passed, F.least(total, F.coalesce(cap, F.lit(0.50)))).otherwise(total)


def values_match(extracted: Column, truth: Column, field_name: Column) -> Column:
    """Whether a value equals its label in meaning, by the field's type; two NULLs do, one doesn't.

    Identifiers must be equal but for blanks around; amounts within two cents
    (unreadable ones never match); dates as dates, else as text; free text
    without case and marks, or the label inside the value (never the reverse).
    """
    kind = field_type(field_name)
    ne, ng = parse_number(extracted), parse_number(truth)
    de, dg = first_date(extracted, EVALUATION_DATES), first_date(truth, EVALUATION_DATES)
    be, bg, same = bare(extracted), bare(truth), F.trim(extracted) == F.trim(truth)
    return (
        F.when(extracted.isNull() & truth.isNull(), True).when(extracted.isNull() | truth.isNull(), False)
        .when(kind == "IDENTIFIER", same)
        .when(kind == "NUMERIC", F.coalesce(F.abs(ne - ng) <= dims.MONEY_TOLERANCE, F.lit(False)))
        .when(kind == "DATE", F.when(de.isNotNull() & dg.isNotNull(), de == dg).otherwise(same))
        .otherwise((be == bg) | ((F.length(bg) >= 3) & F.contains(be, bg)))
    )


def entity_key(name: Column) -> Column:
    """Canonical key of a field name; the first key with an alias that equals it, or holds it or is held in it."""
    n = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))
    out = None
    for key, aliases in dims.ENTITY_ALIASES.items():
        names = list(dict.fromkeys(a.replace("_", "") for a in aliases))
        hit = n.isin(names)
        for a in (x for x in names if len(x) >= 6):
            hit = hit | F.contains(n, F.lit(a)) | F.contains(F.lit(a), n)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise(n)


def quoted(value: Column) -> Column:
    """A text in quotes as reports show it: single ones, or double ones around a text with only single ones in it."""
    apostrophe, plain = F.contains(value, F.lit("'")), F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.when(apostrophe & ~F.contains(value, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def low_confidence_reason(name: Column, final: Column, threshold: float = dims.ESCALATE_BELOW) -> Column:
    return F.concat(F.lit("Field '"), name, F.lit("': final confidence "), F.format_string("%.3f", final), F.lit(f" < threshold {threshold:.2f}"))


def disagreement_reason(name: Column, value: Column) -> Column:
    return F.concat(F.lit("Field '"), name, F.lit("': ocr!=vision disagreement (Path A="), quoted(value), F.lit(" selected; paths diverged)"))


def money_text(value: Column) -> Column:
    """Currency, commas and blanks dropped, and all dots but the last (4.580.49 becomes 4580.49)."""
    return F.regexp_replace(F.regexp_replace(value, r"[$, ]", ""), r"[.](?=.*[.])", "")


def redacted(key: Column, value: Column) -> Column:
    """The value, or a digest of it if the key names something sensitive."""
    digest = F.concat(F.lit("[REDACTED:sha256="), F.substring(F.sha2(value.cast("binary"), 256), 1, 12), F.lit("]"))
    return F.when(F.lower(key).rlike("|".join(dims.SENSITIVE_KEYS)), F.coalesce(digest, F.lit("[REDACTED]"))).otherwise(value)


def file_format(content: Column) -> Column:
    """Format by the leading bytes; UNKNOWN for none of them, NULL for NULL."""
    head = F.hex(F.substring(content, 1, 12))

    def starts(*prefixes: str) -> Column:
        return reduce(lambda x, y: x | y, [F.startswith(head, F.lit(p)) for p in prefixes])

    heic = (F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "6D696631", "6D736631", "68656978", "68657663")
    return (
        F.when(content.isNull(), None)
        .when(starts("255044462D"), "pdf").when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg")
        .when(starts("49492A00", "4D4D002A"), "tiff").when(heic, "heic")
        .when(starts("504B0304"), "zip").otherwise("UNKNOWN")
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def integrity_score(flags: Column) -> Column:
    """1 less the penalties of the flags, within 0 and 1, to three decimals."""
    p = F.create_map(*[F.lit(x) for kv in dims.FLAG_PENALTIES.items() for x in kv])
    total = F.aggregate(F.coalesce(flags, F.array().cast("array<string>")), F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(p, f), F.lit(dims.DEFAULT_PENALTY)))
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total)), 3)


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword of the list found in the lower-case text; NULL if none is."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k)), k) for k in keywords])
