"""DuckDB SQL of the queries op11, op12 and op13."""

from __future__ import annotations

from . import personal

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS number, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT number, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
items AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS w FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT item, item_id, unnest(w) AS term FROM items),
tf AS (SELECT number, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT number, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), total),
adds AS (SELECT number, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) AS a FROM tf JOIN sizes USING (number) JOIN weights USING (term), total),
scores AS (SELECT item, any_value(item_id) AS item_id, number, CAST(sum(a) AS BIGINT) AS score FROM wanted JOIN adds USING (term) GROUP BY item, number),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM scores JOIN sizes USING (number) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_HEAD = "(?:^|[^A-Za-z0-9])"
_FILL = "[ :#=.]+"
_IBANS = "|".join(f"{land}(?: ?[0-9A-Z]){{{size - 2}}}" for land, size in personal.IBAN_SIZES.items())
_RULES = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
    "card": "[0-9]([\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "address": "[A-Za-z][A-Za-z0-9+.-]*://[^\\x20\\x09-\\x0D/?#@<>\"''\"]+@[A-Za-z0-9.-]*[A-Za-z0-9](:[0-9]+)?",
    "iban": f"{_HEAD}(?:iban|Iban|IBAN){_FILL}(?:{_IBANS})[A-Za-z0-9]?",
    "ssn": f"{_HEAD}(?:ssn|Ssn|SSN){_FILL}[0-9-]+",
    "number": f"{_HEAD}(?:account|Account|ACCOUNT|acct|Acct|ACCT){_FILL}(?:(?:number|Number|no|No){_FILL})?[0-9](?:-?[0-9])*",
}
_FOUND = " UNION ALL ".join(f"SELECT number, '{kind}' AS rule, regexp_extract_all(text, '{rule}') AS hits, string_split_regex(text, '{rule}') AS pieces FROM d WHERE regexp_matches(text, '{rule}')" for kind, rule in _RULES.items())
_VALUE = f"CASE rule WHEN 'iban' THEN regexp_extract(hit, '({_IBANS})[A-Za-z0-9]?$', 1) WHEN 'ssn' THEN regexp_extract(hit, '[0-9-]+$') WHEN 'number' THEN regexp_extract(hit, '[0-9-]+$') ELSE hit END"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * CAST(reverse({_DIGITS})[i] AS INT) - CASE WHEN CAST(reverse({_DIGITS})[i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(reverse({_DIGITS})[i] AS INT) END)) % 10 = 0"
_PLAIN = "replace(value, ' ', '')"
_MOD97 = f"list_reduce(list_concat([0], list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: (CASE WHEN x > 9 THEN a * 100 ELSE a * 10 END + x) % 97) = 1"
_PLACE = "CASE kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 WHEN 'phone' THEN 3 WHEN 'address' THEN 4 ELSE 5 END"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS number, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (SELECT number, rule, hits[i] AS hit, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS begun FROM each),
valued AS (SELECT number, rule, hit, begun, {_VALUE} AS value FROM placed),
ends AS (SELECT *, CASE WHEN rule = 'iban' THEN begun + length(hit) - length(regexp_extract(hit, '({_IBANS})([A-Za-z0-9]?)$', 2)) ELSE begun + length(hit) END AS stop FROM valued),
kept AS (
    SELECT number, CASE WHEN rule IN ('iban', 'ssn', 'number') THEN 'account' ELSE rule END AS kind, CAST(stop - length(value) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ends WHERE CASE rule
        WHEN 'ip' THEN list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS BIGINT), 999) <= 255))
        WHEN 'card' THEN length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}
        WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15
        WHEN 'iban' THEN stop = begun + length(hit) AND regexp_matches({_PLAIN}[3:4], '^[0-9]{{2}}$') AND {_MOD97}
        WHEN 'ssn' THEN regexp_matches(value, '^[0-8][0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') AND value[1:3] NOT IN ('000', '666') AND value[5:6] <> '00' AND value[8:11] <> '0000'
        WHEN 'number' THEN length({_DIGITS}) BETWEEN 6 AND 17
        ELSE true END
),
base AS (SELECT * FROM kept WHERE kind NOT IN ('address', 'account')),
added AS (SELECT DISTINCT * FROM kept k WHERE kind IN ('address', 'account') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.number = k.number AND b.start <= k.start AND k.stop <= b.stop)),
told AS (SELECT *, kind || ':' || start || ':' || stop AS said, {_PLACE} AS place FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
sums AS (SELECT number, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(said, ',' ORDER BY start, place) FILTER (place < 4) AS base, string_agg(said, ',' ORDER BY start, place) AS spans FROM told GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums USING (number)
"""

_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce(list_concat([xor(r, b)], [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"


def _and(path: str, cost: str, edits: str) -> str:
    """A path, its cost in nine digits before its edits, with more edits."""
    return f"lpad(CAST(CAST(substr({path}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{edits}'"


# Paths to the states 0 (no role yet), 1 (system), 2 (user), 3 (assistant): after a row, and then after rows that are put in.
_KEEP = lambda path, initial: f"CASE WHEN may AND first = '{initial}' THEN {_and(path, 'more', 'K')} END"
_ROLE = lambda path: f"CASE WHEN may THEN {_and(path, 'more + 1', 'R')} END"
_STEP = (
    f"{_and('p0', '2', 'D')} AS q0, least({_and('p1', '2', 'D')}, {_KEEP('p0', 's')}) AS q1, "
    f"least({_and('p2', '2', 'D')}, {', '.join(f'{_KEEP(p, "u")}, {_ROLE(p)}' for p in ('p0', 'p1', 'p3'))}) AS q2, "
    f"least({_and('p3', '2', 'D')}, {_KEEP('p2', 'a')}, {_ROLE('p2')}) AS q3"
)
_PUT = f"q0 AS p0, q1 AS p1, least(q2, {', '.join(_and(q, '5', 'I') for q in ('q0', 'q1', 'q3'))}) AS p2, least(q3, {_and('q2', '5', 'I')}, {_and('q0', '10', 'II')}, {_and('q1', '10', 'II')}) AS p3"

OP13_SQL = f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM keyed),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)
),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS (
    SELECT *, role[1] AS first, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_
),
coded AS (SELECT *, NOT blank AND NOT again AS may, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS more FROM faults),
paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, '000000005I' AS p2, '000000010II' AS p3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT conv_id, i, {_PUT} FROM (SELECT c.conv_id, c.i, {_STEP} FROM paths p JOIN coded c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = p.i + 1)
),
ended AS (SELECT conv_id, least(arg_max(p0, i), arg_max(p3, i)) AS best FROM paths GROUP BY 1),
audits AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS k FROM audits WHERE audit <> ''),
counted AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS j FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
joined AS (SELECT c.*, r.role, r.text FROM counted c LEFT JOIN rows_ r ON c.edit <> 'I' AND c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.i = r.i WHERE edit <> 'D'),
begun AS (SELECT *, max(CASE WHEN j = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM joined),
said AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM begun GROUP BY 1),
sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (cut AND may) AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM audits a LEFT JOIN sums s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN said t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""
