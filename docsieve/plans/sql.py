"""The same relations and rules as SQL text, for the oracle."""

from __future__ import annotations

from docsieve import dims


def money(c: str) -> str:
    return f"(cast(({c}) // 100 as varchar) || '.' || lpad(cast(({c}) % 100 as varchar), 2, '0'))"


def half_up(x: str, n: int) -> str:
    return f"(floor(({x}) * {10.0**n} + 0.5) / {10.0**n})"


def kind(c: str) -> str:
    whens = " ".join(f"WHEN {c} IN ({', '.join(repr(x) for x in xs)}) THEN '{t}'" for t, xs in dims.FIELD_TYPES.items())
    hints = " ".join(f"WHEN regexp_matches(lower({c}), '{h}') THEN '{t}'" for t, h in dims.TYPE_HINTS)
    return f"(CASE {whens} {hints} ELSE 'FREE_TEXT' END)"


def number(c: str, strip: bool = True) -> str:
    v = f"regexp_replace({c}, '[$,€£\\s]', '', 'g')" if strip else f"trim({c})"
    return f"(CASE WHEN regexp_matches({v}, '^\\s*[-+]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][-+]?\\d+)?\\s*$') THEN try_cast({v} AS DOUBLE) END)"


def date(c: str, formats: list[str]) -> str:
    return f"cast(try_strptime(trim({c}), {formats!r}) as date)"


AGREEMENT_DATES = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%m-%d-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
EVALUATION_DATES = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%m-%d-%Y"]
VALIDATION_DATES = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%m.%d.%Y"]


def bare(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def read(c: str, k: str, name: str) -> str:
    """Columns: the number, the date, the trimmed and the bare text of a value, to be read once."""
    return f"CASE WHEN {k} = 'NUMERIC' THEN {number(c)} END n_{name}, CASE WHEN {k} = 'DATE' THEN {date(c, AGREEMENT_DATES)} END d_{name}, trim({c}) t_{name}, {bare(c)} x_{name}"


def agreement(a: str, b: str, k: str) -> str:
    """From the columns of ``read`` under the names a and b."""
    n, lev = f"greatest(length(x_{a}), length(x_{b}))", f"levenshtein(x_{a}, x_{b})"
    return f"""(CASE WHEN t_{a} IS NULL OR t_{b} IS NULL THEN 'single_source'
      WHEN {k} = 'IDENTIFIER' THEN CASE WHEN t_{a} = t_{b} THEN 'ocr==vision' ELSE 'ocr!=vision' END
      WHEN n_{a} IS NOT NULL AND n_{b} IS NOT NULL THEN
        CASE WHEN abs(n_{a} - n_{b}) < 0.01 THEN 'ocr==vision' WHEN abs(n_{a} - n_{b}) <= 1.0 THEN 'ocr_near_match' ELSE 'ocr!=vision' END
      WHEN d_{a} IS NOT NULL AND d_{b} IS NOT NULL THEN CASE WHEN d_{a} = d_{b} THEN 'ocr==vision' ELSE 'ocr!=vision' END
      WHEN t_{a} = t_{b} OR (x_{a} = x_{b} AND x_{a} <> '') THEN 'ocr==vision'
      WHEN {n} > 0 AND (({lev} <= 2 AND {n} >= 5) OR ({n} - {lev}) / {n} >= 0.85) THEN 'ocr_near_match'
      ELSE 'ocr!=vision' END)"""


def matches(e: str, g: str, name: str) -> str:
    k, de, dg, same = kind(name), date(e, EVALUATION_DATES), date(g, EVALUATION_DATES), f"trim({e}) = trim({g})"
    return f"""(CASE WHEN {e} IS NULL AND {g} IS NULL THEN true WHEN {e} IS NULL OR {g} IS NULL THEN false
      WHEN {k} = 'IDENTIFIER' THEN {same}
      WHEN {k} = 'NUMERIC' THEN coalesce(abs({number(e)} - {number(g)}) <= 0.02, false)
      WHEN {k} = 'DATE' THEN CASE WHEN {de} IS NOT NULL AND {dg} IS NOT NULL THEN {de} = {dg} ELSE {same} END
      ELSE {bare(e)} = {bare(g)} OR (length({bare(g)}) >= 3 AND contains({bare(e)}, {bare(g)})) END)"""


def fused(native: str, agree: str, cons: str, passed: str, cap: str) -> str:
    sig = f"(CASE {agree} WHEN 'ocr==vision' THEN 1.0::double WHEN 'ocr_near_match' THEN 0.85::double WHEN 'single_source' THEN 0.80::double ELSE 0.60::double END)"
    rest = f"(0.35::double * {native} + 0.25::double * {sig} + 0.15::double * (CASE WHEN {passed} THEN 1.0::double ELSE 0.0::double END))"
    tot = f"(CASE WHEN {cons} IS NULL THEN {rest} / 0.75::double ELSE {rest} + 0.25::double * {cons} END)"
    r = half_up(f"greatest(0.0::double, least(1.0::double, {tot}))", 3)
    return f"(CASE WHEN NOT {passed} THEN least({r}, coalesce({cap}, 0.50::double)) ELSE {r} END)"


def entity(c: str) -> str:
    n = f"lower(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g'))"
    whens = []
    for key, aliases in dims.ENTITY_ALIASES.items():
        names = [a.replace("_", "") for a in aliases]
        hit = [f"{n} IN ({', '.join(repr(x) for x in names)})"]
        hit += [f"contains({n}, '{a}') OR contains('{a}', {n})" for a in names if len(a) >= 6]
        whens.append(f"WHEN {' OR '.join(hit)} THEN '{key}'")
    return f"(CASE {' '.join(whens)} ELSE {n} END)"


def ymd(d: str, fmt: str = "%Y-%m-%d") -> str:
    return f"strftime({d}, '{fmt}')"


ORDERS = """li AS (SELECT l_orderkey k, sum(cast(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS bigint))::bigint sub FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey k, cast(o_orderdate AS date) od, c_name nm, sub, cast(floor(sub * 0.08::double + 0.5) AS bigint) tax, sub + cast(floor(sub * 0.08::double + 0.5) AS bigint) total
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON li.k = o_orderkey)"""


def _rows(name: str, values: dict[str, str], conf: str, where: str = "true") -> str:
    parts = " UNION ALL ".join(f"SELECT k document_id, '{f}' field_name, {v} AS value, {conf} AS conf FROM o WHERE {where}" for f, v in values.items())
    return f"{name} AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL)"


_id = "'INV-' || year(od) || '-' || k"
A = _rows("a", {
    "InvoiceId": f"CASE WHEN k % 19 = 0 THEN 'inv#' || k ELSE {_id} END", "CustomerName": "nm", "InvoiceDate": ymd("od"),
    "DueDate": f"CASE WHEN k % 17 = 0 THEN NULL WHEN k % 29 = 0 THEN 'not-a-date' WHEN k % 23 = 0 THEN {ymd('od - 5')} WHEN k % 43 = 0 THEN {ymd('od')} ELSE {ymd('od + 30')} END",
    "Subtotal": money("sub"), "TotalTax": money("tax"), "InvoiceTotal": f"CASE WHEN k % 31 = 0 THEN {money('total + 10000')} ELSE {money('total')} END",
}, "0.80::double + (k % 20) / 100.0::double")
B = _rows("b", {
    "InvoiceId": f"CASE WHEN k % 19 = 0 THEN 'inv#' || k WHEN k % 7 = 1 THEN {_id} || 'I' ELSE {_id} END",
    "CustomerName": "CASE WHEN k % 7 = 2 THEN upper(substr(nm, 1, length(nm) - 1)) WHEN k % 7 = 3 THEN 'Unrelated O''Trading ' || k ELSE upper(nm) END",
    "InvoiceDate": f"CASE WHEN k % 7 = 4 THEN {ymd('od', '%m/%d/%Y')} WHEN k % 7 = 5 THEN {ymd('od', '%d-%m-%Y')} WHEN k % 11 = 5 THEN {ymd('od + 1')} ELSE {ymd('od')} END",
    "DueDate": f"CASE WHEN k % 29 = 0 THEN 'not-a-date' WHEN k % 23 = 0 THEN {ymd('od - 5')} WHEN k % 43 = 0 THEN {ymd('od')} ELSE {ymd('od + 30')} END",
    "Subtotal": f"CASE WHEN k % 11 = 1 THEN {money('sub + 50')} WHEN k % 11 = 2 THEN {money('sub + 500')} ELSE {money('sub')} END",
    "TotalTax": f"CASE WHEN k % 13 = 0 THEN NULL ELSE {money('tax')} END",
    "InvoiceTotal": f"CASE WHEN k % 3 = 0 THEN '$' ELSE '' END || CASE WHEN k % 31 = 0 THEN {money('total + 10000')} ELSE {money('total')} END",
}, "0.80::double + ((k * 7) % 20) / 100.0::double")
T = _rows("t", {
    "InvoiceId": _id, "CustomerName": "nm", "InvoiceDate": ymd("od", "%d-%m-%Y"), "DueDate": ymd("od + 30"),
    "Subtotal": money("sub"), "TotalTax": money("tax"), "InvoiceTotal": money("total"),
}, "1.0::double", "k % 13 <> 0")  # a NULL label is no label
_pen = "(CASE agreement WHEN 'ocr_near_match' THEN 0.95::double WHEN 'ocr!=vision' THEN 0.90::double ELSE 1.0::double END)"
_use_a = "(value_b IS NULL OR (value_a IS NOT NULL AND conf_a >= conf_b))"
_conf = f"(CASE WHEN {_use_a} THEN conf_a ELSE conf_b END)"


def joined(a: str, b: str, name: str, page: bool = False) -> str:
    """Both paths side by side with agreement, value and native confidence, as name."""
    keys = ["document_id", *(["page"] if page else []), "field_name"]
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""{name}0 AS MATERIALIZED (SELECT {', '.join(f'coalesce(a.{c}, b.{c}) {c}' for c in keys)}, a.value value_a, a.conf conf_a, b.value value_b, b.conf conf_b FROM {a} a FULL JOIN {b} b ON {on}),
{name}k AS MATERIALIZED (SELECT *, {kind('field_name')} kind FROM {name}0),
{name}1 AS MATERIALIZED (SELECT *, {read('value_a', 'kind', 'a')}, {read('value_b', 'kind', 'b')} FROM {name}k),
{name}2 AS MATERIALIZED (SELECT *, {agreement('a', 'b', 'kind')} agreement FROM {name}1),
{name} AS MATERIALIZED (SELECT {', '.join(keys)}, value_a, conf_a, value_b, conf_b, agreement, CASE WHEN {_use_a} THEN value_a ELSE value_b END AS value,
  CASE WHEN agreement = 'single_source' THEN {_conf} ELSE {half_up(f'{_conf} * {_pen}', 3)} END native FROM {name}2)"""


J = joined("a", "b", "j")
# readings of two pages; the last page of a field counts
PAGES = f"""pa AS (SELECT *, 1 page FROM a UNION ALL SELECT k, 'InvoiceTotal', {money('total + 500')}, 0.9::double, 2 FROM o WHERE k % 37 = 0 AND total IS NOT NULL),
pb AS (SELECT *, 1 page FROM b),
{joined('pa', 'pb', 'q', True)},
f AS MATERIALIZED (SELECT *, CASE WHEN value_a IS NOT NULL THEN {half_up("(1 + CASE WHEN page = 2 THEN 0 ELSE (CASE WHEN document_id % 9 = 0 THEN CASE WHEN lower(trim(value_a)) = '?' THEN 1 ELSE 0 END ELSE 1 END + CASE WHEN document_id % 6 = 0 THEN 0 ELSE 1 END) END) / 3.0::double", 3)} END consistency
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY page DESC) rn FROM q) WHERE rn = 1)"""
_w = ", ".join(f"max(CASE WHEN field_name = '{n}' THEN value END) {c}" for n, c in (("Subtotal", "s"), ("TotalTax", "x"), ("InvoiceTotal", "g"), ("InvoiceDate", "i"), ("DueDate", "u"), ("InvoiceId", "id")))
CHECKS = f"""w0 AS (SELECT document_id, {_w} FROM f GROUP BY 1),
w1 AS MATERIALIZED (SELECT *, {number('s', False)} ns, {number('x', False)} nx, {number('g', False)} ng, {date('i', VALIDATION_DATES)} di, {date('u', VALIDATION_DATES)} du,
  (CASE WHEN document_id % 41 = 0 THEN sub + 100 ELSE sub END) / 100.0::double ls FROM w0 JOIN o ON o.k = document_id),
w AS MATERIALIZED (SELECT *, abs({half_up('ns + nx', 2)} - ng) <= 0.02 ok, CASE WHEN ls IS NOT NULL AND ns IS NOT NULL THEN CASE WHEN abs({half_up('ls', 2)} - ns) <= 0.02 THEN 'LINE_SUM_OK' ELSE 'LINE_SUM_FAIL' END END lf,
  di < du dok, regexp_matches(trim(id), '^[A-Z]{{2,6}}-\\d{{4}}-[A-Za-z0-9]+$') iok FROM w1),
chk AS MATERIALIZED (
  SELECT document_id, fn field_name, concat_ws(',', lf, CASE WHEN ok THEN 'TAX_TOTAL_OK' WHEN NOT ok THEN 'TAX_TOTAL_FAIL' END, CASE WHEN ok THEN 'ARITHMETIC_OK' END) flags, coalesce(ok, true) passed, CASE WHEN NOT ok THEN 0.50::double END cap
  FROM w, (VALUES ('Subtotal'), ('TotalTax'), ('InvoiceTotal')) v(fn)
  UNION ALL SELECT document_id, fn, concat_ws(',', CASE WHEN bad THEN 'DATE_UNPARSEABLE' END, CASE WHEN dok THEN 'DATE_LOGIC_OK' WHEN NOT dok THEN 'DATE_LOGIC_FAIL' END), NOT bad AND coalesce(dok, true), CASE WHEN bad THEN 0.40::double WHEN NOT dok THEN 0.45::double END
  FROM (SELECT document_id, 'InvoiceDate' fn, di IS NULL bad, dok FROM w WHERE i IS NOT NULL UNION ALL SELECT document_id, 'DueDate', du IS NULL, dok FROM w WHERE u IS NOT NULL)
  UNION ALL SELECT document_id, 'InvoiceId', CASE WHEN iok THEN 'ID_FORMAT_OK' ELSE 'ID_FORMAT_FAIL' END, iok, CASE WHEN NOT iok THEN 0.55::double END FROM w WHERE id IS NOT NULL)"""
SCORED = f"""sc0 AS MATERIALIZED (SELECT f.document_id, f.field_name, f.page, value_a, value_b, agreement, value, native, consistency, coalesce(flags, 'NO_VALIDATOR_APPLIED') flags, coalesce(passed, true) passed, cap,
  CASE WHEN NOT ok THEN 'ARITHMETIC_INCONSISTENCY' END s1, CASE WHEN NOT dok THEN 'DATE_ORDER_VIOLATION' END s2 FROM f JOIN w USING (document_id) LEFT JOIN chk ON chk.document_id = f.document_id AND chk.field_name = f.field_name),
sc AS MATERIALIZED (SELECT *, {fused('native', 'agreement', 'consistency', 'passed', 'cap')} final, {fused('native', 'agreement', '1.0::double', 'passed', 'cap')} best FROM sc0)"""
CHAIN = ",\n".join([ORDERS, A, B, PAGES, CHECKS, SCORED])
_q = """CASE WHEN contains(value, chr(39)) THEN '"' || value || '"' ELSE chr(39) || value || chr(39) END"""
TRIAGE = f"""WITH {CHAIN}, why AS (
  SELECT document_id, field_name, 1 ord, 'Field ' || chr(39) || field_name || chr(39) || ': final confidence ' || printf('%.3f', final) || ' < threshold 0.90' why FROM sc WHERE final < 0.90
  UNION ALL SELECT document_id, field_name, 2, 'Field ' || chr(39) || field_name || chr(39) || ': ocr!=vision disagreement (Path A=' || {_q} || ' selected; paths diverged)' FROM sc WHERE agreement = 'ocr!=vision'
  UNION ALL SELECT DISTINCT document_id, '', 0, 'Arithmetic inconsistency: Subtotal + TotalTax != InvoiceTotal' FROM sc WHERE s1 IS NOT NULL),
r AS (SELECT document_id, string_agg(why, '; ' ORDER BY field_name, ord) reasons FROM why GROUP BY 1),
d AS (SELECT document_id, min(final) min_conf, count(*) n_fields, concat_ws(',', 'VALIDATION:' || max(s1), 'VALIDATION:' || max(s2)) authenticity_flags FROM sc GROUP BY 1)
SELECT document_id, coalesce(reasons, '') reasons, authenticity_flags, min_conf, n_fields, CASE WHEN reasons IS NULL THEN 'OK' ELSE 'NEEDS_REVIEW' END status FROM d LEFT JOIN r USING (document_id)"""
STEADY = f"""cons AS (SELECT document_id, field_name, {half_up("(1 + CASE WHEN document_id % 9 = 0 THEN 0 ELSE 1 END + CASE WHEN document_id % 6 = 0 THEN 0 ELSE 1 END) / 3.0::double", 3)} consistency FROM a)"""


def bundle() -> str:
    inv = [("InvoiceNumber", "'INV-' || k"), ("SupplierName", "nm"), ("InvoiceDate", ymd("od")), ("GrandTotal", money("total"))]
    po = [
        ("InvoiceRef", "CASE WHEN k % 7 = 1 THEN 'INV-9' || k ELSE 'INV-' || k END"), ("VendorName", "CASE WHEN k % 7 = 2 THEN 'Other Trading ' || k ELSE upper(nm) END"),
        ("OrderDate", f"CASE WHEN k % 7 = 3 THEN {ymd('od + 3')} ELSE {ymd('od', '%m/%d/%Y')} END"),
        ("OrderAmount", f"CASE WHEN k % 7 = 4 THEN {money('total + 700')} WHEN k % 7 = 5 THEN '  ' ELSE '$' || {money('total')} END"),
    ]
    rows = [f"SELECT k bundle_id, '{p}' || k document_id, {d} doc_seq, {i} claim_seq, '{n}' field_name, {v} AS value FROM o" for d, (p, xs) in enumerate((("inv-", inv), ("po-", po))) for i, (n, v) in enumerate(xs)]
    return f"cl0 AS ({' UNION ALL '.join(rows)}),\ncl AS (SELECT *, {entity('field_name')} entity_key FROM cl0 WHERE trim(value) <> '')"
