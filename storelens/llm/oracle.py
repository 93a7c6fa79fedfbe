"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, p, n, item FROM dw JOIN bw USING (n, win)),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)
"""

#: kind, pattern, words nearby; the checks are in the query.
PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "mail|contact|write"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"\bip\b|address|host|server"),
    ("card", "[0-9](?:[ -]?[0-9])+", "card|credit|visa|pay"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"phone|call|\btel|mobile|fax"),
    ("iban", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "iban|bank|account"),
    ("iban_spaced", r"\b[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?\b", "iban|bank|account"),
    ("phone_local", r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}\b", r"phone|call|\btel|mobile|fax"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "ssn|social|security"),
    ("secret", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x22'']? *[:=] *[\x22'']?[A-Za-z0-9_+/=-]{16,}",
     "auth|login|credential|config"),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----", "key|secret|auth"),
)
_found = "\n  UNION ALL\n  ".join(
    f"SELECT r, {k} AS k, '{name}' AS kind, '{context}' AS context, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d"
    for k, (name, pattern, context) in enumerate(PII_KINDS, 1))
_counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name, _, _ in PII_KINDS)
_columns = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in PII_KINDS)

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {_found}),
placed AS (
  SELECT r, k, kind, context, m[i] AS s, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
         substr(replace(m[i], ' ', ''), 5) || substr(m[i], 1, 4) AS moved, regexp_extract(m[i], '[A-Za-z0-9_+/=-]+$') AS val,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT r, k, kind, context, m, p, unnest(range(1, len(m) + 1)) AS i FROM found)),
ok AS (
  SELECT r, k, kind, context, a, a + length(s) AS z, s FROM placed
  WHERE CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(s, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 1000))) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT)
             ELSE (2 * CAST(reverse(digits)[i] AS INT)) // 10 + (2 * CAST(reverse(digits)[i] AS INT)) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ssn' THEN digits[1:3] NOT IN ('000', '666') AND digits[1] <> '9' AND digits[4:5] <> '00' AND digits[6:9] <> '0000'
    WHEN 'secret' THEN regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 8
    WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(range(1, length(moved) + 1), lambda i:
        CASE WHEN moved[i] BETWEEN '0' AND '9' THEN CAST(ascii(moved[i]) - 48 AS BIGINT) ELSE CAST(ascii(moved[i]) - 55 AS BIGINT) END)),
        lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
    WHEN 'iban_spaced' THEN list_reduce(list_prepend(0, list_transform(range(1, length(moved) + 1), lambda i:
        CASE WHEN moved[i] BETWEEN '0' AND '9' THEN CAST(ascii(moved[i]) - 48 AS BIGINT) ELSE CAST(ascii(moved[i]) - 55 AS BIGINT) END)),
        lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
    ELSE TRUE END),
agg AS (
  SELECT r, {_counts},
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (k < 5) AS base,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS spans,
         count(*) FILTER (regexp_matches(substr(t, greatest(a - 40, 0) + 1, a - greatest(a - 40, 0)), '(?i)' || context)) AS n_context
  FROM ok JOIN d USING (r) GROUP BY r)
SELECT doc_id, {_columns}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_context, 0) AS n_context
FROM d LEFT JOIN agg USING (r)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (
          SELECT r, unnest(range(p, p + 3)) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1) GROUP BY r),
m0 AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(rep.n, 0) AS n_repeat_words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
m AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m0),
rates AS (
  SELECT r, lang, source, 'word_length' AS rate, word_chars * 100 // n_words AS v, 50 AS least FROM m WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'symbols', n_symbols * 1000 // n_words, 50 FROM m WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'repeated_lines', n_dup_lines * 1000 // n_lines, 200 FROM m WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'repeated_words', n_repeat_words * 1000 // n_words, 120 FROM m WHERE n_words > 0),
cells AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS cell FROM rates),
own AS (SELECT lang, source, rate, count(*) AS docs, list(cell ORDER BY cell) AS l FROM cells GROUP BY ALL),
by_lang AS (SELECT lang, rate, count(*) AS docs, list(cell ORDER BY cell) AS l FROM cells GROUP BY ALL),
every AS (SELECT rate, list(cell ORDER BY cell) AS l FROM cells GROUP BY ALL),
chosen AS (
  SELECT o.lang, o.source, rate, CASE WHEN o.docs >= 30 THEN o.l WHEN b.docs >= 30 THEN b.l ELSE every.l END AS l
  FROM own o JOIN by_lang b USING (rate) JOIN every USING (rate) WHERE o.lang IS NOT DISTINCT FROM b.lang),
lim AS (SELECT lang, source, rate, l[(len(l) + 3) // 4] AS lo, l[(3 * len(l) + 3) // 4] AS hi FROM chosen),
out AS (
  SELECT c.r, string_agg(c.rate, ',' ORDER BY CASE c.rate WHEN 'word_length' THEN 1 WHEN 'symbols' THEN 2 WHEN 'repeated_lines' THEN 3 ELSE 4 END) AS s
  FROM cells c JOIN lim l ON c.rate = l.rate AND c.lang IS NOT DISTINCT FROM l.lang AND c.source IS NOT DISTINCT FROM l.source
  WHERE c.v > hi + 3 * greatest(hi - lo, least) OR c.rate = 'word_length' AND c.v < lo - 3 * greatest(hi - lo, least) GROUP BY c.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND s IS NULL AS kept, coalesce(s, '') AS out_of_line
FROM m LEFT JOIN out USING (r)
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all({text}, '.'), lambda c: CAST(ascii(c) AS BIGINT))), "
            "lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)")


def _field(column: str) -> str:
    s = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({s}) || ':' || {s} END"


OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head,
         {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS tamper
  FROM documents),
h AS (
  SELECT r, doc_id, source, sha256(head || {_field("text")}) AS leaf,
         CASE WHEN tamper AND text IS NOT NULL THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE sha256(head || {_field("text")}) END AS given
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM h),
tree AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM tree WHERE len(nodes) > 1),
tops AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM tree WHERE len(nodes) = 1),
over_tree AS (
  SELECT 0 AS lvl, list(subroot ORDER BY sid) AS nodes FROM tops
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM over_tree WHERE len(nodes) > 1),
steps AS (
  SELECT r, 0 AS part, lvl, pos // CAST(3 ** lvl AS BIGINT) AS k, nodes FROM p JOIN tree ON p.source IS NOT DISTINCT FROM tree.source WHERE len(nodes) > 1
  UNION ALL
  SELECT r, 1, lvl, sid // CAST(3 ** lvl AS BIGINT), nodes FROM p JOIN tops ON p.source IS NOT DISTINCT FROM tops.source JOIN over_tree ON len(nodes) > 1),
sides AS (
  SELECT r, part, lvl, array_to_string(nodes[k - k % 3 + 1 : k], '') AS lft, array_to_string(nodes[k + 2 : k - k % 3 + 3], '') AS rgt FROM steps),
proofs AS (SELECT r, string_agg(lft || rgt, '' ORDER BY part, lvl) AS proof, list(lft || ':' || rgt ORDER BY part, lvl) AS way FROM sides GROUP BY r)
SELECT doc_id, leaf, subroot, whole.nodes[1] AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       list_reduce(list_prepend(given, coalesce(way, [])), lambda a, x: sha256(split_part(x, ':', 1) || a || split_part(x, ':', 2))) AS folded_root,
       folded_root = whole.nodes[1] AS verified
FROM p JOIN tops ON p.source IS NOT DISTINCT FROM tops.source JOIN over_tree whole ON len(whole.nodes) = 1 LEFT JOIN proofs USING (r)
"""

OP13 = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM d WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS pos FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS i FROM placed),
c AS (SELECT conv_id, pos, role, text, fault, i, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS e FROM marked),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS n,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM marked) GROUP BY conv_id),
back AS (  -- costs from nothing, system, user, assistant before row i
  SELECT conv_id, n AS i, [0, 4, 2, 0] AS v FROM counts
  UNION ALL
  SELECT conv_id, i, [least(a, 2 + least(u, 2 + z)), least(s, 2 + least(u, 2 + z)), least(u, 2 + z), least(z, 2 + u)]
  FROM (
    SELECT b.conv_id, b.i - 1 AS i,
           least(3 + v[1], CASE WHEN stays THEN 2 + e + v[3] ELSE 999999999 END, CASE WHEN stays AND c.i = 's' THEN e + v[2] WHEN stays AND c.i = 'u' THEN e + v[3] ELSE 999999999 END) AS a,
           least(3 + v[2], CASE WHEN stays THEN 2 + e + v[3] ELSE 999999999 END, CASE WHEN stays AND c.i = 'u' THEN e + v[3] ELSE 999999999 END) AS s,
           least(3 + v[3], CASE WHEN stays THEN 2 + e + v[4] ELSE 999999999 END, CASE WHEN stays AND c.i = 'a' THEN e + v[4] ELSE 999999999 END) AS u,
           least(3 + v[4], CASE WHEN stays THEN 2 + e + v[3] ELSE 999999999 END, CASE WHEN stays AND c.i = 'u' THEN e + v[3] ELSE 999999999 END) AS z
    FROM back b JOIN c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND c.pos = b.i - 1)),
turns AS (SELECT 1 AS s, 3 AS t, 'user' AS name UNION ALL SELECT 2, 3, 'user' UNION ALL SELECT 3, 4, 'assistant' UNION ALL SELECT 4, 3, 'user'),
kept AS (SELECT 's' AS i, 1 AS s, 2 AS t UNION ALL SELECT 'u', 1, 3 UNION ALL SELECT 'u', 2, 3 UNION ALL SELECT 'u', 4, 3 UNION ALL SELECT 'a', 3, 4),
step AS (  -- the least edit that is tight, for each row and state
  SELECT b.conv_id, b.i, t.s, CASE
           WHEN c.pos IS NOT NULL AND b.v[t.s] = 3 + n.v[t.s] THEN 'D'
           WHEN b.v[t.s] = 2 + b.v[t.t] THEN 'I'
           WHEN c.pos IS NULL THEN '.'
           WHEN stays AND k.t IS NOT NULL AND b.v[t.s] = e + n.v[k.t] THEN 'K' ELSE 'R' END AS edit,
         t.t AS turned, k.t AS kept, t.name, c.role, c.text
  FROM back b CROSS JOIN turns t LEFT JOIN back n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.i = b.i + 1
  LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.pos = b.i LEFT JOIN kept k ON k.i = c.i AND k.s = t.s),
walk AS (
  SELECT conv_id, 0 AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS rows FROM counts
  UNION ALL
  SELECT w.conv_id, CASE edit WHEN 'I' THEN w.i ELSE w.i + 1 END, CASE edit WHEN 'D' THEN w.s WHEN 'K' THEN kept ELSE turned END, audit || edit,
         CASE edit WHEN 'D' THEN rows WHEN 'K' THEN list_append(rows, role || ':' || text) WHEN 'R' THEN list_append(rows, name || ':' || text)
              ELSE list_append(rows, name || ':') END
  FROM walk w JOIN step t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i AND w.s = t.s WHERE edit <> '.'),
ended AS (SELECT w.* FROM walk w JOIN step t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i AND w.s = t.s WHERE edit = '.'),
given AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM given g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN back b ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 0 LEFT JOIN ended x ON g.conv_id IS NOT DISTINCT FROM x.conv_id
"""
