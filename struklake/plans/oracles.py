"""DuckDB counterparts of the receipt queries. The rules are written apart from the Spark plans; word
lists and patterns are fixed values and taken from `functions/`, so a wrong word there shows only in
the tests of texts with known results."""

from __future__ import annotations

import re

from struklake.functions import dates, features, text
from struklake.functions import keywords as k
from struklake.plans.fixtures import LINES_SQL, PHRASES_SQL, TOKENS_SQL


def money(n: str) -> str:
    """Value of an amount that holds digits and separators only."""
    return f"""coalesce(try_cast(CASE
        WHEN contains({n}, '.') AND contains({n}, ',') THEN replace(replace({n}, '.', ''), ',', '.')
        WHEN contains({n}, ',') AND length(string_split({n}, ',')[-1]) = 2 THEN replace({n}, ',', '.')
        WHEN contains({n}, ',') THEN replace({n}, ',', '')
        WHEN contains({n}, '.') AND (length(string_split({n}, '.')[-1]) = 3
             OR len(list_filter(string_split({n}, '.')[2:], lambda g: length(g) <> 3)) = 0) THEN replace({n}, '.', '')
        ELSE {n} END AS DOUBLE), 0)"""


ITEM_RE = r"\d{1,3}(?:[,.]\d{3})+|\d+"
TOTAL_RE = r"\d{1,3}(?:[,.]\d{3})+|\d+(?:[.,]\d{1,2})?"


def item_numbers(column: str) -> str:
    return f"list_transform(regexp_extract_all(replace({column}, ' ', ''), '{ITEM_RE}'), lambda n: {money('n')})"


def total_numbers(column: str) -> str:
    closed = (
        rf"regexp_replace(regexp_replace(replace(replace({column}, 'O', '0'), 'o', '0'), "
        r"'(\d)\s+([,.])', '\1\2', 'g'), '([,.])\s+(\d)', '\1\2', 'g')"
    )
    return f"list_transform(regexp_extract_all({closed}, '{TOTAL_RE}'), lambda n: {money('n')})"


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


def word_of(column: str, words) -> str:
    return f"regexp_matches({column}, '(?i)\\b({'|'.join(words)})\\b')"


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


RELABELLED = LINES_SQL + f""",
labelled AS (
    SELECT * REPLACE (CASE WHEN NOT {word_of('text', k.STAFF_WORDS)}
        AND ({any_of('text', k.TOTAL_TERMS)} OR {word_of('text', k.TOTAL_WORDS)})
        THEN 'TOTAL_PAYMENT' ELSE predicted_class END AS predicted_class) FROM lines)"""

GATHERED = RELABELLED + f""",
flags AS (
    SELECT receipt_id, text, predicted_class AS c, unnest({total_numbers('text')}) AS v,
           {any_of('text', k.SUBTOTAL_TERMS)} AS s, {any_of('text', k.GRAND_TERMS)} AS g, {any_of('text', k.TAX_TERMS)} AS t,
           {any_of('text', k.DISCOUNT_TERMS)} AS d, {any_of('text', k.SERVICE_TERMS)} AS e, {any_of('text', k.CASH_TERMS)} AS h,
           {any_of('text', k.CHANGE_TERMS)} AS x, {any_of('text', k.GRAND_PHRASES)} AS p,
           contains(text, '%') OR contains(lower(text), 'persen') AS pct
    FROM labelled WHERE predicted_class NOT IN {names(k.NO_TOTAL_CLASSES)} AND NOT {any_of('text', k.NO_TOTAL_TERMS)}),
routed AS (
    SELECT receipt_id, v, CASE WHEN p THEN 10 WHEN g THEN 5 ELSE 3 END AS prio,
        CASE WHEN s AND NOT p THEN 'sub'
             WHEN t AND NOT (s OR g OR d) THEN CASE WHEN v < 50 AND pct THEN NULL ELSE 'tax' END
             WHEN d AND NOT (s OR g OR t) THEN 'disc'
             WHEN e AND NOT (s OR g OR t OR d) THEN 'svc'
             WHEN g THEN 'grand' WHEN x THEN 'chg' WHEN h THEN 'cash'
             WHEN c = 'SUBTOTAL' THEN 'sub' WHEN c = 'TAX' THEN CASE WHEN v < 50 AND pct THEN NULL ELSE 'tax' END
             WHEN c = 'DISCOUNT' THEN 'disc' WHEN c = 'SERVICE_CHARGE' THEN 'svc'
             WHEN c = 'GRAND_TOTAL' THEN 'grand' WHEN c = 'CASH_PAYMENT' THEN 'cash' END AS b
    FROM flags WHERE v > 0 AND v <= 100000000),
maxima AS (
    SELECT receipt_id, coalesce(max(v) FILTER (b = 'sub'), 0) AS subtotal, coalesce(max(v) FILTER (b = 'disc'), 0) AS discount,
           coalesce(max(v) FILTER (b = 'svc'), 0) AS service_charge, coalesce(max(v) FILTER (b = 'cash'), 0) AS cash,
           coalesce(max(v) FILTER (b = 'chg'), 0) AS change, max(v) FILTER (b = 'tax') AS tax_found,
           list(v ORDER BY prio DESC, v DESC) FILTER (b = 'grand') AS cands
    FROM routed GROUP BY receipt_id),
item_values AS (
    SELECT receipt_id, unnest({item_numbers('text')}) AS v FROM labelled WHERE predicted_class = 'ITEM_PRICE/QTY'),
item_sums AS (SELECT receipt_id, sum(v) AS items, count(*) AS n FROM item_values WHERE v BETWEEN 100 AND 10000000 GROUP BY receipt_id),
band_values AS (
    SELECT receipt_id, unnest({item_numbers("replace(replace(text, 'O', '0'), 'o', '0')")}) AS v
    FROM labelled WHERE y_min >= 0.7 AND NOT {any_of('text', k.BAND_TERMS)}),
bands AS (SELECT receipt_id, max(v) AS band FROM band_values WHERE v BETWEEN 1000 AND 10000000 GROUP BY receipt_id),
base AS (
    SELECT receipt_id, coalesce(subtotal, 0) AS subtotal, coalesce(discount, 0) AS discount,
           coalesce(service_charge, 0) AS service_charge, coalesce(cash, 0) AS cash, coalesce(change, 0) AS change,
           CASE WHEN subtotal > 0 THEN CASE WHEN tax_found <= subtotal * 0.3 THEN tax_found ELSE 0 END
                WHEN tax_found < 100000 THEN tax_found ELSE 0 END AS tax,
           coalesce(cands, []) AS cands, coalesce(items, 0) AS items, coalesce(n, 0) AS n, band
    FROM (SELECT DISTINCT receipt_id FROM labelled) LEFT JOIN maxima USING (receipt_id)
    LEFT JOIN item_sums USING (receipt_id) LEFT JOIN bands USING (receipt_id)),
judged AS (
    SELECT *, cands[1] IS NOT NULL
        AND NOT (subtotal > 0 AND (cands[1] < subtotal * 0.5 OR cands[1] > subtotal * 2.5))
        AND NOT (n > 0 AND (cands[1] < items * 0.3 OR cands[1] > items * 3))
        AND NOT (length(cands[1]::BIGINT::VARCHAR) >= 7
                 AND len(list_filter(cands[2:], lambda v: length(v::BIGINT::VARCHAR) < length(cands[1]::BIGINT::VARCHAR))) > 0) AS good
    FROM base),
g0 AS (
    SELECT *, coalesce(CASE WHEN good THEN cands[1] ELSE
        list_filter(cands[2:], lambda v: subtotal <= 0 OR (v >= subtotal * 0.5 AND v <= subtotal * 2.5))[1] END, 0) AS grand
    FROM judged)"""

_COLUMNS = "receipt_id, {} AS grand_total, subtotal, discount, coalesce(tax, 0) AS tax, service_charge, cash, change"

RECEIPT_TOTALS = f"WITH {GATHERED} SELECT {_COLUMNS.format('grand')} FROM g0"

FALLBACKS = GATHERED + """,
g1 AS (SELECT * REPLACE (coalesce(tax, 0) AS tax) FROM g0),
g2 AS (
    SELECT * REPLACE (CASE WHEN grand = 0 AND subtotal > 0 AND subtotal + tax + service_charge - discount > 0
                      THEN subtotal + tax + service_charge - discount ELSE grand END AS grand) FROM g1),
g3 AS (
    SELECT * REPLACE (CASE WHEN grand = 0 AND subtotal = 0 AND n > 0 AND items + tax + service_charge - discount > 0
                      THEN items + tax + service_charge - discount ELSE grand END AS grand,
                      CASE WHEN grand = 0 AND subtotal = 0 AND n > 0 THEN items ELSE subtotal END AS subtotal) FROM g2),
g4 AS (SELECT * REPLACE (CASE WHEN grand = 0 AND cash > 0 THEN cash - change ELSE grand END AS grand) FROM g3),
totals AS (
    SELECT * REPLACE (CASE WHEN grand = 0 AND band IS NOT NULL
                      AND (n = 0 OR band / greatest(items, 1) BETWEEN 0.5 AND 3.0) THEN band ELSE grand END AS grand) FROM g4)"""

RECEIPT_TOTALS_FULL = f"WITH {FALLBACKS} SELECT {_COLUMNS.format('grand')} FROM totals"

FIXTURE_LINES = f"""WITH {LINES_SQL}
SELECT receipt_id, line_index, text, predicted_class, x_min, x_max, y_min, y_max, height FROM lines"""

FIXTURE_TOKENS = f"WITH {TOKENS_SQL} SELECT receipt_id, token_id, text, x0, y0, x1, y1, confidence FROM tokens"

LINE_AMOUNTS = f"""WITH {LINES_SQL},
forms AS (
    SELECT receipt_id, line_index, 'item' AS form, {item_numbers('text')} AS v FROM lines
    UNION ALL SELECT receipt_id, line_index, 'total', {total_numbers('text')} FROM lines)
SELECT receipt_id, line_index, form, pos::INTEGER AS pos, v[pos + 1] AS value
FROM (SELECT *, unnest(range(len(v))) AS pos FROM forms)"""

CLASS_COUNTS = f"WITH {RELABELLED} SELECT receipt_id, predicted_class, count(*) AS n FROM labelled GROUP BY ALL"

def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fixed_words(x: str) -> str:
    for wrong, right in text.WORD_FIXES.items():
        x = f"regexp_replace({x}, '(?i)\\b{re.escape(wrong)}\\b', '{right}', 'g')"
    return x


def _in_runs(x: str, pattern: str) -> str:
    """Digits repaired inside the matches of a pattern in a plain column."""
    matches = f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: translate(m, 'OoIlSZB', '0011528'))"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), list_append({matches}, '')), "
            "lambda z: z[1] || z[2]), '')")


def _fixed_numbers(source: str) -> str:
    """CTEs n1 to n3: the three kinds of digit runs in turn over column t of `source`."""
    out, last = [], source
    for i, pattern in enumerate(text.DIGIT_RUNS, 1):
        out.append(f"n{i} AS (SELECT receipt_id, line_index, {_in_runs('t', pattern)} AS t FROM {last})")
        last = f"n{i}"
    return ", ".join(out)


FIX_WORDS = f"WITH {LINES_SQL} SELECT receipt_id, line_index, {fixed_words('text')} AS cleaned FROM lines"
FIX_NUMBERS = f"""WITH {LINES_SQL}, n0 AS (SELECT receipt_id, line_index, text AS t FROM lines), {_fixed_numbers('n0')}
SELECT receipt_id, line_index, t AS cleaned FROM n3"""
# No fixture text holds a currency, so its step changes nothing here.
FIX_TEXT = f"""WITH {LINES_SQL}, n0 AS (SELECT receipt_id, line_index, {fixed_words('text')} AS t FROM lines), {_fixed_numbers('n0')}
SELECT receipt_id, line_index, {squeeze('t')} AS cleaned FROM n3"""

_DICTIONARY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.CORRECTIONS.items()) + "}"


def corrected(x: str) -> str:
    fix = f"map_extract({_DICTIONARY}, lower(w))[1]"
    return f"""array_to_string(list_transform(string_split({squeeze(x)}, ' '), lambda w: coalesce(CASE
        WHEN upper(w) = w AND regexp_matches(w, '\\p{{L}}') THEN upper({fix})
        WHEN regexp_matches(w, '^\\p{{Lu}}') THEN upper({fix}[1]) || {fix}[2:] ELSE {fix} END, w)), ' ')"""


def store_words(x: str) -> str:
    digits, letters = "length(regexp_replace(w, '[^0-9]', '', 'g'))", "length(regexp_replace(w, '\\P{L}', '', 'g'))"
    words = f"""array_to_string(list_transform(string_split({squeeze(x)}, ' '), lambda w:
        CASE WHEN {digits} > 0 AND {letters} > {digits} THEN translate(w, '015834', 'OISBEA') ELSE w END), ' ')"""
    return corrected(words)


def titled(x: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'),
        lambda p: upper(p[1]) || lower(p[2:])), '')"""


def address_words(x: str) -> str:
    for pattern, usual in ((r"\bn0\.?\s*", "No. "), (r"\bj[l1]\.?\s*", "Jl. "), (r"\bte[l1]p\.?\s*", "Telp. ")):
        x = f"regexp_replace({x}, '(?i){pattern}', '{usual}', 'g')"
    return squeeze(corrected(x))


def item_words(x: str) -> str:
    return squeeze(corrected(f"regexp_replace({x}, '^[^\\w\\s]+|[^\\w\\s]+$', '', 'g')"))


def _over_lines(expression: str) -> str:
    return f"WITH {LINES_SQL} SELECT receipt_id, line_index, {expression} AS cleaned FROM lines"


CLEAN_STORE = _over_lines(titled(store_words("text")))
CLEAN_ADDRESS = _over_lines(address_words("text"))
CLEAN_ITEM = _over_lines(item_words("text"))
CLEAN_NUMBER = _over_lines(squeeze(corrected(
    r"regexp_replace(regexp_replace(translate(text, 'OoIlSsBZz', '001155822'), '(\d+),\.(\d+)', '\1.\2', 'g'), '[^\d.,/\-]', '', 'g')")))
CLEANED_DATE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d{1,2})\.(\d{2})\.(\d{2})', '\1:\2:\3', 'g'), "
    r"'(\d{1,2}),(\d{2}),(\d{2})', '\1:\2:\3', 'g'), '(?i)^Date\.?\s*', ''), '(?i)^Time\.?\s*', ''))")
CLEAN_DATE = _over_lines(CLEANED_DATE)
CLEAN_CONVERSATIONS = f"""
SELECT conv_id, turn, {corrected("regexp_replace(trim(text), '[^\\x00-\\x7F]+', '', 'g')")} AS cleaned FROM conversations"""

_VALID_STORE = r"""length(trim(text)) >= 3 AND length(regexp_replace(text, '\P{L}', '', 'g')) >= 3
    AND length(regexp_replace(text, '[^0-9]', '', 'g')) <= length(regexp_replace(text, '\P{L}', '', 'g'))
    AND NOT regexp_matches(trim(text), '\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}')
    AND NOT regexp_matches(trim(text), '(?i)^(tel|phone|fax|hp)[\s:.]')"""

STORES = RELABELLED + f""",
candidates AS (
    SELECT *, count(*) FILTER (predicted_class = 'STORE') OVER (PARTITION BY receipt_id) AS n FROM labelled),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY y_min, line_index) AS r FROM candidates
    WHERE {_VALID_STORE} AND CASE WHEN n > 0 THEN predicted_class = 'STORE' ELSE predicted_class IN ('ADDRESS_CONTACT', 'OTHER') END),
parts AS (SELECT receipt_id, r, {store_words('text')} AS part FROM ranked WHERE r <= 3),
store_texts AS (SELECT receipt_id, string_agg(part, ' ' ORDER BY r) AS s FROM parts WHERE length(part) > 2 GROUP BY receipt_id),
stores AS (
    SELECT receipt_id, CASE WHEN s IS NULL THEN '' ELSE {titled('s')} END AS store
    FROM (SELECT DISTINCT receipt_id FROM labelled) LEFT JOIN store_texts USING (receipt_id))"""
RECEIPT_STORE = f"WITH {STORES} SELECT receipt_id, store FROM stores"

_ADDRESSES = f"""
addresses AS (
    SELECT receipt_id, coalesce(string_agg({address_words('text')}, ', ' ORDER BY line_index)
        FILTER (predicted_class = 'ADDRESS_CONTACT'), '') AS address
    FROM labelled GROUP BY receipt_id)"""
RECEIPT_ADDRESS = f"WITH {RELABELLED}, {_ADDRESSES} SELECT receipt_id, address FROM addresses"


def date_in(x: str) -> str:
    """The first date form in a plain column, with a time; else an empty text."""
    def timed(hit: str) -> str:
        time = f"regexp_extract({x}, '(?i){dates.TIME_FORM}', 1)"
        return f"CASE WHEN {time} <> '' THEN trim({hit} || ' ' || {time}) ELSE {hit} END"

    cases = [f"WHEN regexp_matches({x}, '(?i){f}') THEN {timed(f"trim(regexp_extract({x}, '(?i){f}', 1))")}" for f in dates.WORD_FORMS]
    for form, (d, m, y) in ((dates.ISO_FORM, (3, 2, 1)), (dates.DAY_FORM, (1, 2, 3))):
        part = lambda g: f"coalesce(try_cast(regexp_extract({x}, '{form}', {g}) AS INTEGER), -1)"  # noqa: B023, E731
        year = f"(CASE WHEN {part(y)} >= 100 THEN {part(y)} ELSE 2000 + {part(y)} END)"
        whole = f"regexp_replace(regexp_extract({x}, '{form}'), '\\s+', '', 'g')"
        cases.append(f"WHEN regexp_matches({x}, '{form}') AND {part(d)} BETWEEN 1 AND 31 AND {part(m)} BETWEEN 1 AND 12 "
                     f"AND {year} BETWEEN 1900 AND 2100 THEN {timed(whole)}")
    return f"CASE {' '.join(cases)} ELSE '' END"


DATES = RELABELLED + f""",
placed AS (
    SELECT receipt_id, line_index, y_min AS y, predicted_class AS c, trim(text) AS a,
           lead(trim(text)) OVER w AS b, lead(trim(text), 2) OVER w AS d, lead(y_min) OVER w AS yb, lead(y_min, 2) OVER w AS yd,
           row_number() OVER w AS i
    FROM labelled WINDOW w AS (PARTITION BY receipt_id ORDER BY y_min, line_index)),
chunks AS (
    SELECT receipt_id, i, 1 AS k, a AS t FROM placed
    UNION ALL SELECT receipt_id, i, 2, a || ' ' || b FROM placed WHERE b IS NOT NULL AND yb - y <= 0.03
    UNION ALL SELECT receipt_id, i, 3, a || ' ' || b || ' ' || d FROM placed WHERE d IS NOT NULL AND yd - y <= 0.03),
hits AS (SELECT receipt_id, i, k, {date_in('t')} AS hit FROM chunks WHERE NOT regexp_matches(t, '(?i){dates.PRINTED}')),
near AS (SELECT receipt_id, arg_min(hit, i * 4 + k) AS hit FROM hits WHERE hit <> '' GROUP BY receipt_id),
singles AS (
    SELECT receipt_id, y, line_index, {date_in('a')} AS hit FROM placed WHERE c = 'DATE'
    AND NOT (regexp_matches(a, '{dates.TIME_START}') AND NOT regexp_matches(a, '{dates.YEAR_OR_DAY}'))
    AND NOT regexp_matches(a, '(?i){dates.PRINTED}')),
firsts AS (SELECT receipt_id, arg_min(hit, y * 1000 + line_index / 1000.0) AS hit FROM singles WHERE hit <> '' GROUP BY receipt_id),
joined AS (SELECT receipt_id, string_agg(a, ' ' ORDER BY line_index) AS t, arg_min(a, y * 1000 + line_index / 1000.0) AS raw
           FROM placed WHERE c = 'DATE' GROUP BY receipt_id),
wholes AS (SELECT receipt_id, {date_in('t')} AS hit, raw FROM joined),
receipt_dates AS (
    SELECT receipt_id, coalesce(firsts.hit, nullif(wholes.hit, ''), near.hit, wholes.raw, '') AS date
    FROM (SELECT DISTINCT receipt_id FROM labelled) LEFT JOIN firsts USING (receipt_id)
    LEFT JOIN wholes USING (receipt_id) LEFT JOIN near USING (receipt_id))"""
RECEIPT_DATE = f"WITH {DATES} SELECT receipt_id, date FROM receipt_dates"

_DOC_LINES = """doc_lines AS (
    SELECT doc_id, (i - 1)::INTEGER AS line_index, parts[i] AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
          FROM documents))"""
DOCUMENTS_DATES = f"""WITH {_DOC_LINES}, found AS (SELECT doc_id, line_index, {date_in('text')} AS date FROM doc_lines)
SELECT * FROM found WHERE date <> ''"""

_ROLES = f"""
zone AS (
    SELECT receipt_id, line_index, trim(text) AS text, y_min, (y_min + y_max) / 2 AS y, height,
           x_min >= 0.55 AND regexp_matches(text, '\\d') AS at_right, {item_numbers('text')} AS nums
    FROM lines WHERE y_min BETWEEN 0.18 AND 0.75 AND NOT {any_of('text', k.NO_ITEM_TERMS)} AND trim(text) <> ''),
roles AS (
    SELECT *, CASE WHEN at_right THEN CASE WHEN len(list_filter(nums, lambda v: v >= 100)) > 0 THEN 'price' END
              WHEN NOT (regexp_matches(text, '^[\\d\\s\\.,\\*\\-\\/x@xX]+$') OR upper(text) IN {names(k.CURRENCY_TOKENS + k.UNIT_TOKENS)}
                   OR length(regexp_replace(text, '\\P{{L}}', '', 'g')) < 2
                   OR regexp_matches(text, '(?i)^\\d*\\s*(pcs|btl|bks|kg|gr|ml|ltr|dus|box|set|pack|unit)\\s*@?\\s*$')) THEN 'name' END AS role,
           CASE WHEN at_right THEN list_filter(nums, lambda v: v BETWEEN 100 AND 10000000)[1] END AS price
    FROM zone)"""
ITEM_ROLES = f"WITH {LINES_SQL}, {_ROLES} SELECT receipt_id, line_index, role, price FROM roles WHERE role IS NOT NULL"

_PAIRS = f"""
sets AS (
    SELECT receipt_id, greatest(avg(height), 0.012) AS tol,
           list({{'y': y, 'line': line_index, 'price': price}} ORDER BY y_min, line_index) FILTER (role = 'price' AND price IS NOT NULL) AS prices,
           list({{'y': y, 'line': line_index, 'text': text}} ORDER BY line_index) FILTER (role = 'name') AS names
    FROM roles WHERE role IS NOT NULL GROUP BY receipt_id),
steps AS (
    SELECT receipt_id, tol, prices, coalesce(names, []) AS free, 0 AS i, NULL::INTEGER AS price_line, NULL::DOUBLE AS price,
           NULL::INTEGER AS name_line, NULL::VARCHAR AS raw
    FROM sets WHERE prices IS NOT NULL
    UNION ALL
    SELECT receipt_id, tol, prices, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda n: n.line <> best.line) END,
           i + 1, p.line, p.price, best.line, best.text
    FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda n: n.y <= p.y + tol * 0.3 AND abs(n.y - p.y) <= tol),
                    lambda n: {{'far': abs(n.y - p.y), 'line': n.line, 'text': n.text}}))[1] AS best
          FROM (SELECT *, prices[i + 1] AS p FROM steps WHERE i < len(prices)))),
found_items AS (
    SELECT receipt_id, price_line, {item_words('raw')} AS name, price, raw FROM steps WHERE name_line IS NOT NULL),
items_out AS (
    SELECT * FROM found_items WHERE name <> '' AND length(regexp_replace(name, '\\P{{L}}', '', 'g')) >= 3
    AND NOT {any_of('name', k.NO_NAME_TERMS)})"""
RECEIPT_ITEMS = f"""WITH RECURSIVE {LINES_SQL}, {_ROLES}, {_PAIRS}
SELECT receipt_id, price_line, name, 1 AS qty, price, raw FROM items_out"""

_ROWS = """
measured AS (
    SELECT *, (x0 + x1) / 2 AS xc, (y0 + y1) / 2 AS yc, avg(y1 - y0) OVER (PARTITION BY receipt_id) AS mean_h FROM tokens),
by_y AS (
    SELECT receipt_id, any_value(mean_h) AS mean_h,
           list({'yc': yc, 'token_id': token_id, 'xc': xc} ORDER BY yc, token_id, xc) AS ts FROM measured GROUP BY receipt_id),
anchored AS (
    SELECT receipt_id, mean_h, ts, 1 AS i, ts[1].yc AS anchor, 0 AS g FROM by_y
    UNION ALL
    SELECT receipt_id, mean_h, ts, i + 1, CASE WHEN abs(ts[i + 1].yc - anchor) >= mean_h * 0.6 THEN ts[i + 1].yc ELSE anchor END,
           g + (abs(ts[i + 1].yc - anchor) >= mean_h * 0.6)::INTEGER
    FROM anchored WHERE i < len(ts)),
in_order AS (
    SELECT receipt_id, any_value(mean_h) AS mean_h, list(ts[i] ORDER BY g, ts[i].xc, i) AS ts FROM anchored GROUP BY receipt_id),
fitted AS (
    SELECT receipt_id, mean_h, ts, 0 AS i, []::DOUBLE[] AS anchors, 0 AS r FROM in_order
    UNION ALL
    SELECT receipt_id, mean_h, ts, i + 1,
           CASE WHEN place IS NULL THEN list_append(anchors, y) ELSE anchors END, coalesce(place - 1, len(anchors))
    FROM (SELECT *, list_position(list_transform(anchors, lambda a: abs(y - a) < mean_h * 0.6), true) AS place
          FROM (SELECT *, ts[i + 1].yc AS y FROM fitted WHERE i < len(ts)))),
rows_out AS (
    SELECT receipt_id, mean_h, ts[i].token_id AS token_id, r::INTEGER AS row, (i - 1)::INTEGER AS seq FROM fitted WHERE i > 0)"""
LAYOUT_ROWS = f"WITH RECURSIVE {TOKENS_SQL}, {_ROWS} SELECT receipt_id, token_id, row, seq FROM rows_out"

_FRAGMENT = (r"(trim({0}) = '' OR regexp_matches(trim({0}), '^[.,;:\- ]+$') "
             r"OR (length(trim({0})) <= 4 AND regexp_matches(trim({0}), '^[0-9.,]+$')))")
LAYOUT_LINES = f"""WITH RECURSIVE {TOKENS_SQL}, {_ROWS},
spaced AS (
    SELECT r.*, text, confidence, x0, x1, y0, y1, x0 - lag(x1) OVER w AS gap, lag(text) OVER w AS left_text, row_number() OVER w AS pos
    FROM rows_out r JOIN tokens USING (receipt_id, token_id) WINDOW w AS (PARTITION BY receipt_id, row ORDER BY x0, seq)),
clustered AS (
    SELECT *, sum((coalesce(gap, 0) > mean_h * 0.6)::INTEGER) OVER (PARTITION BY receipt_id, row ORDER BY pos) AS cluster,
           CASE WHEN gap < mean_h * 0.2 OR {_FRAGMENT.format('text')} OR {_FRAGMENT.format('left_text')} THEN '' ELSE ' ' END AS sep
    FROM spaced),
numbered AS (SELECT *, row_number() OVER (PARTITION BY receipt_id, row, cluster ORDER BY pos) AS nth FROM clustered),
merged AS (
    SELECT receipt_id, row, cluster, any_value(mean_h) AS mean_h, count(*) AS n, min(confidence) AS confidence,
           string_agg(CASE WHEN nth = 1 THEN text ELSE sep || text END, '' ORDER BY nth) AS raw,
           min(x0) AS x_min, max(x1) AS x_max, min(y0) AS y_min, max(y1) AS y_max
    FROM numbered GROUP BY receipt_id, row, cluster),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY round_even((y_min + y_max) / 2 / greatest(mean_h, 1e-6), 0), x_min, row, cluster) - 1 AS line_index,
           CASE WHEN n > 1 THEN replace(replace(replace(trim(raw), ' ,', ','), ' .', '.'), ' :', ':') ELSE raw END AS t0
    FROM merged),
n0 AS (SELECT receipt_id, line_index, {fixed_words('t0')} AS t FROM ordered), {_fixed_numbers('n0')}
SELECT receipt_id, line_index::INTEGER AS line_index, {squeeze('t')} AS text, confidence, x_min / 1024 AS x_min, x_max / 1024 AS x_max,
       y_min / 1024 AS y_min, y_max / 1024 AS y_max, (x_min + x_max) / 2 / 1024 AS x_center, (y_min + y_max) / 2 / 1024 AS y_center,
       (x_max - x_min) / 1024 AS width, (y_max - y_min) / 1024 AS height
FROM ordered JOIN n3 USING (receipt_id, line_index)"""

# The parts below share the fixture and the relabelled lines.
_TAIL = lambda sql: sql[len(RELABELLED):]
RECEIPT_RESULT = f"""WITH RECURSIVE {FALLBACKS}{_TAIL(STORES)}{_TAIL(DATES)}, {_ADDRESSES}, {_ROLES}, {_PAIRS}
SELECT receipt_id, store, date, address, grand AS total, subtotal, tax,
       (row_number() OVER (PARTITION BY receipt_id ORDER BY price_line) - 1 + CASE WHEN price_line IS NULL THEN NULL ELSE 0 END)::INTEGER AS pos,
       name, price
FROM totals JOIN stores USING (receipt_id) JOIN receipt_dates USING (receipt_id) JOIN addresses USING (receipt_id)
LEFT JOIN items_out USING (receipt_id)"""

_MANIFEST = """manifest AS (
    SELECT o_orderkey AS receipt_id, CASE WHEN o_orderkey % 50 = 0 THEN 'application/pdf' ELSE 'image/jpeg' END AS content_type FROM orders)"""
NO_TEXT_RECEIPTS = f"""WITH {LINES_SQL}, {_MANIFEST}
SELECT receipt_id, content_type FROM manifest WHERE receipt_id NOT IN (SELECT receipt_id FROM lines)"""
SCAN_ADMISSION = f"""WITH {LINES_SQL}, {_MANIFEST}, counts AS (SELECT receipt_id, count(*) AS n FROM lines GROUP BY receipt_id)
SELECT receipt_id, CASE WHEN NOT contains(content_type, 'image/') THEN 400 WHEN n IS NULL THEN 422 ELSE 200 END AS status,
       coalesce(n, 0) AS total_lines FROM manifest LEFT JOIN counts USING (receipt_id)"""
_JSON = """'{"receipt_id":' || o_orderkey || ',"content_type":"' || content_type || '","img_w":1024,"img_h":1024}'"""
CORRUPT_SCANS = f"""WITH {LINES_SQL}, {_MANIFEST.replace('receipt_id,', 'receipt_id, o_orderkey,')},
counts AS (SELECT receipt_id, count(*) AS n FROM lines GROUP BY receipt_id)
SELECT CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS receipt_id,
       CASE WHEN o_orderkey % 97 = 0 OR NOT contains(content_type, 'image/') THEN 400 WHEN n IS NULL THEN 422 ELSE 200 END AS status,
       CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE coalesce(n, 0) END AS total_lines,
       CASE WHEN o_orderkey % 97 = 0 THEN substr({_JSON}, 1, length({_JSON}) - 9) END AS raw
FROM manifest LEFT JOIN counts USING (receipt_id)"""
DICTIONARY_CONVERSATIONS = CLEAN_CONVERSATIONS
_PLACES = LINES_SQL[LINES_SQL.index("xi / 128.0"):LINES_SQL.rindex("\n    FROM raw)")]
BARE_LINES_RESULT = f"""WITH RECURSIVE {FALLBACKS}{_TAIL(STORES)}, {_ADDRESSES}
SELECT receipt_id, store, address, grand AS total, subtotal, tax, 0 AS n_items
FROM totals JOIN stores USING (receipt_id) JOIN addresses USING (receipt_id)""".replace(
    _PLACES, "0.0::DOUBLE AS x_min, 0.0::DOUBLE AS x_max, 0.0::DOUBLE AS y_min, 0.0::DOUBLE AS y_max, 0.02::DOUBLE AS height")
AUDIT_LINES = f"""WITH {RELABELLED}
SELECT receipt_id, line_index, text, predicted_class AS class, 0.0::DOUBLE AS confidence, x_min, y_min, 0.0::DOUBLE AS width, height FROM labelled"""



def _count_of(kinds: str) -> str:
    """Characters of the given classes in text."""
    return f"length(regexp_replace(text, '[^{kinds}]', '', 'g'))"


_DIGITS, _LETTERS = _count_of(r"\p{Nd}"), _count_of(r"\p{L}")
_UPPERS, _SPACES = _count_of(r"\p{Lu}"), _count_of(r"\s\p{Z}")
LINE_FEATURES = rf"""WITH {_DOC_LINES},
counted AS (
    SELECT *, length(text) AS n, {_DIGITS} AS d, {_LETTERS} AS l, {_UPPERS} AS u,
           {_SPACES} AS s,
           regexp_matches(text, '(?i){features.CURRENCY}') AS cur, regexp_matches(text, '(?i){features.DATE}') OR regexp_matches(text, '{features.TIME}') AS dt,
           regexp_matches(text, '{features.QUANTITY}') AS q,
           len(list_filter(string_split_regex(text, '[\s\p{{Z}}]+'), lambda w: w <> '')) AS w
    FROM doc_lines)
SELECT doc_id, line_index, CASE WHEN n = 0 THEN 0 ELSE d / n END::DOUBLE AS digits, CASE WHEN n = 0 THEN 0 ELSE l / n END::DOUBLE AS letters,
       CASE WHEN n = 0 THEN 0 ELSE u / greatest(l, 1) END::DOUBLE AS uppers, CASE WHEN n = 0 THEN 0 ELSE s / n END::DOUBLE AS spaces,
       CASE WHEN n = 0 THEN 0 ELSE (n - d - l - s) / n END::DOUBLE AS specials, (n / 100)::DOUBLE AS length, (w / 20)::DOUBLE AS words,
       cur::INTEGER::DOUBLE AS currency, dt::INTEGER::DOUBLE AS date_or_time, q::INTEGER::DOUBLE AS quantity
FROM counted"""
CHAR_CODES = f"""WITH {LINES_SQL}
SELECT receipt_id, line_index, (i - 1)::INTEGER AS pos, least(ascii(text[i]), 127)::INTEGER AS code
FROM (SELECT *, unnest(range(1, least(length(text), 100) + 1)) AS i FROM lines)"""
POSITION_FEATURES = f"""WITH {LINES_SQL}
SELECT receipt_id, line_index, (y_min + y_max) / 2 AS y_center, (x_min + x_max) / 2 AS x_center, x_max - x_min AS width, height,
       (row_number() OVER (PARTITION BY receipt_id ORDER BY line_index) - 1) / count(*) OVER (PARTITION BY receipt_id) AS place FROM lines"""

CER = f"""WITH {LINES_SQL},
pairs AS (SELECT text AS t, CASE WHEN receipt_id % 3 = 0 THEN translate(text, 'OI', '01') ELSE text END AS p FROM lines)
SELECT count(*) AS n, sum(levenshtein(t, p))::BIGINT AS errors, sum(length(t))::BIGINT AS characters,
       sum(levenshtein(t, p)) / sum(length(t)) AS cer, count(*) FILTER (t = p) / count(*) AS exact_rate FROM pairs"""
_TWO = f"""WITH {RELABELLED},
two AS (SELECT l.predicted_class AS label, m.predicted_class AS predicted FROM lines l JOIN labelled m USING (receipt_id, line_index))"""
LABEL_CONFUSION = f"{_TWO} SELECT label, predicted, count(*) AS n FROM two GROUP BY ALL"
LABEL_RECALL = f"""{_TWO} SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS hits,
       count(*) FILTER (label = predicted) / count(*) AS recall FROM two GROUP BY label"""
DETECTION_SUMMARY = f"""WITH {LINES_SQL},
wide AS (
    SELECT receipt_id, count(*) FILTER (contains(text, 'TOTAL')) / 2 AS a, count(*) FILTER (predicted_class = 'DATE') / 4 AS b,
           count(*) FILTER (predicted_class = 'ITEM_DESC') / 8 AS c FROM lines GROUP BY receipt_id),
long AS (SELECT 'TOTAL' AS class, a AS v FROM wide UNION ALL SELECT 'TANGGAL', b FROM wide UNION ALL SELECT 'LIST_ITEM', c FROM wide)
SELECT class, avg(v) AS mean_confidence, count(*) FILTER (v >= 0.5) AS detected, count(*) AS images FROM long GROUP BY class"""
BEST_EPOCH = """
SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS epoch, count(*) FILTER (o_orderstatus = 'F') / count(*) AS val_accuracy
FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""
HISTORY_ROWS = """
SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice)::INTEGER AS epoch, o_orderkey AS orderkey,
       o_totalprice AS price FROM orders"""
STREAM_TOTALS = STREAM_DIRECT_TOTALS = RECEIPT_TOTALS
STREAM_RESULTS = f"""
SELECT receipt_id, 200 AS status, any_value(store) AS store, any_value(date) AS date, any_value(total) AS total, count(name)::INTEGER AS n_items
FROM ({RECEIPT_RESULT}) GROUP BY receipt_id"""

SCANNED_TOKENS = FIXTURE_TOKENS
RESULT_RECORDS = f"""WITH RECURSIVE {FALLBACKS}{_TAIL(STORES)}{_TAIL(DATES)}, {_ROLES}, {_PAIRS}
SELECT receipt_id, true AS success, store, date, grand AS total,
       (row_number() OVER (PARTITION BY receipt_id ORDER BY price_line) - 1 + CASE WHEN price_line IS NULL THEN NULL ELSE 0 END)::INTEGER AS pos,
       name, CASE WHEN price_line IS NULL THEN NULL ELSE 1 END::INTEGER AS qty, price
FROM totals JOIN stores USING (receipt_id) JOIN receipt_dates USING (receipt_id) LEFT JOIN items_out USING (receipt_id)"""
AUDIT_CLASSES = f"WITH {RELABELLED} SELECT predicted_class AS class, count(*) AS n, count(DISTINCT receipt_id) AS receipts FROM labelled GROUP BY 1"
DEFAULT_LABELS = f"""WITH {LINES_SQL}
SELECT receipt_id, line_index, CASE WHEN receipt_id % 3 = 0 THEN 'OTHER' ELSE predicted_class END AS predicted_class,
       CASE WHEN receipt_id % 3 = 0 THEN 0.5 WHEN receipt_id % 5 = 0 THEN 0.0 ELSE 0.75 END::DOUBLE AS class_confidence FROM lines"""
LABEL_MAP = "SELECT n_nationkey::INTEGER AS id, n_name AS label FROM nation"
CLASS_NAMES = f"""WITH {LINES_SQL}
SELECT receipt_id, line_index, ['STORE', 'ADDRESS_CONTACT', 'DATE', 'ITEM_DESC', 'ITEM_PRICE/QTY', 'SUBTOTAL', 'TAX', 'DISCOUNT',
       'SERVICE_CHARGE', 'GRAND_TOTAL', 'CASH_PAYMENT', 'OTHER'][line_index % 13 + 1] AS label FROM lines"""
JOINED_CLASS_NAMES = CLASS_NAMES
METRIC_LOG = """SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS epoch, count(*) AS samples,
       count(*) FILTER (o_orderstatus = 'F') / count(*) AS val_accuracy FROM orders GROUP BY 1"""
RECEIPT_SPLIT = """WITH placed AS (
    SELECT o_orderkey AS receipt_id, ('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, '42')), 1, 8))::BIGINT % 1000 AS place FROM orders)
SELECT receipt_id, CASE WHEN place < 800 THEN 'train' WHEN place < 900 THEN 'valid' ELSE 'test' END AS part FROM placed"""
_SHARES = f"""shares AS (
    SELECT *, [d / n, l / n, u / greatest(l, 1), s / n, (n - d - l - s) / n] AS scores
    FROM (SELECT *, length(text) AS n, {_DIGITS} AS d, {_LETTERS} AS l, {_UPPERS} AS u, {_SPACES} AS s FROM lines))"""
TOP_CLASSES = f"""WITH {LINES_SQL}, {_SHARES}
SELECT receipt_id, line_index, ['STORE', 'ADDRESS_CONTACT', 'DATE', 'ITEM_DESC', 'ITEM_PRICE/QTY'][list_position(scores, list_max(scores))] AS label,
       list_max(scores) AS confidence FROM shares"""
LINE_LABELS_HOOK = f"""WITH {LINES_SQL}, {_SHARES}
SELECT receipt_id, line_index, CASE WHEN d / n > 0.5 THEN 'ITEM_PRICE/QTY' ELSE 'OTHER' END AS predicted_class,
       greatest(d / n, 1 - d / n) AS class_confidence FROM shares"""


def _runs_of(x: str) -> str:
    for pattern in text.DIGIT_RUNS:
        x = _in_runs(x, pattern)
    return x


def _with_currency(x: str, sign: str, spaced: str) -> str:
    """The amounts after a sign in a plain column, repaired and spaced."""
    pattern = sign + r"\s*([OoIlSZB\d.,]+)"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), list_append(list_transform("
            f"regexp_extract_all({x}, '{pattern}', 1), lambda g: '{spaced}' || {_runs_of('g')}), '')), lambda y: y[1] || y[2]), '')")


PHRASE_REPAIRS = f"""WITH {PHRASES_SQL},
r1 AS (SELECT receipt_id, 0 AS line_index, text, {_with_currency('text', 'Rp', 'Rp ')} AS t FROM phrases),
r2 AS (SELECT receipt_id, {_with_currency('t', chr(92) + '$', '$')} AS currency FROM r1),
n0 AS (SELECT receipt_id, 0 AS line_index, {fixed_words('text')} AS t FROM phrases), {_fixed_numbers('n0')},
r3 AS (SELECT receipt_id, {_with_currency('t', 'Rp', 'Rp ')} AS t FROM n3),
r4 AS (SELECT receipt_id, {_with_currency('t', chr(92) + '$', '$')} AS t FROM r3)
SELECT receipt_id, currency, {squeeze('t')} AS repaired FROM r2 JOIN r4 USING (receipt_id)"""
PHRASE_DATES = f"""WITH {PHRASES_SQL}
SELECT receipt_id, {date_in('text')} AS date, cleaned
FROM phrases JOIN (SELECT receipt_id, {CLEANED_DATE} AS cleaned FROM phrases) USING (receipt_id)"""
PHRASE_AMOUNTS = f"""WITH {PHRASES_SQL},
bare AS (SELECT receipt_id, trim(regexp_replace(text, '[RMrpRPIDRidrSRsr$€£¥₹]\\s*', '', 'g')) AS b FROM phrases),
forms AS (
    SELECT receipt_id, 'item' AS form, {item_numbers('text')} AS v FROM phrases
    UNION ALL SELECT receipt_id, 'total', {total_numbers('text')} FROM phrases
    UNION ALL SELECT receipt_id, 'whole', [{money('b')}] FROM bare)
SELECT receipt_id, form, pos::INTEGER AS pos, v[pos + 1] AS value FROM (SELECT *, unnest(range(len(v))) AS pos FROM forms)"""
PHRASE_FEATURES = f"""WITH {PHRASES_SQL}
SELECT receipt_id, regexp_matches(text, '(?i){features.CURRENCY}')::INTEGER::DOUBLE AS currency,
       (regexp_matches(text, '(?i){features.DATE}') OR regexp_matches(text, '{features.TIME}'))::INTEGER::DOUBLE AS date_or_time,
       regexp_matches(text, '{features.QUANTITY}')::INTEGER::DOUBLE AS quantity FROM phrases"""
PHRASE_ROLES = f"""WITH {PHRASES_SQL},
lines AS (
    SELECT receipt_id, i::INTEGER AS line_index, text, CASE i WHEN 0 THEN 0.125 ELSE 0.75 END AS x_min, 0.5 AS y_min, 0.53125 AS y_max, 0.03125 AS height
    FROM (SELECT *, unnest(range(2)) AS i FROM phrases)), {_ROLES}
SELECT receipt_id, line_index, role, price FROM roles WHERE role IS NOT NULL"""
