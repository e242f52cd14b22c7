"""DuckDB SQL of the queries that SQL can express.

Written against the raw tables.  Compression, boosted trees, tokenisers,
suffix trees and HTML parsing have no SQL; those queries are tested against
brute-force versions and held-out accuracy instead.
"""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _words(t: str) -> str:
    return _WORDS.replace("{t}", t)


LLM_ORACLE["op2_rule_ledger"] = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_words('text')} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT r, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram,
         unnest(range(1, len(ws) - 3)) AS pos FROM w WHERE len(ws) >= 5),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN rep ON rep.r = w.r),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_capitals, fail_bits
FROM b"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Kind, pattern, tested group, fewest characters -- in reporting order.
_KINDS = [
    ("assign", "(" + _either_case("password|passwd|secret|token|api_?key")
     + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 24),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
]
_HITS = " UNION ALL ".join(f"""
  SELECT r, {k} AS k, '{kind}' AS kind,
         unnest(range(len(m))) AS i, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap,
         unnest(list_transform(m, lambda x: length(x))) AS n,
         unnest(list_transform(part, lambda x: length(x) >= {least})) AS ok
  FROM (SELECT r, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS part,
               string_split_regex(text, '{p}') AS gaps FROM t) WHERE len(m) > 0"""
                           for k, (kind, p, group, least) in enumerate(_KINDS))
LLM_ORACLE["op3_blob_ledger"] = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
hits AS ({_HITS}),
placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM hits),
found AS (
  SELECT r, k, CAST(stop - n AS BIGINT) AS start,
         kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE ok),
s AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
         string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
         string_agg(span, ',' ORDER BY start, k) AS spans
  FROM found GROUP BY r)
SELECT t.doc_id, coalesce(s.a, 0) AS n_assign, coalesce(s.b, 0) AS n_access, coalesce(s.c, 0) AS n_hex,
       sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM t LEFT JOIN s ON s.r = t.r"""

LLM_ORACLE["op4_hyperminhash"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) > 1
           THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
           ELSE ws END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM e a JOIN e b ON b.g = a.g AND b.doc_id < a.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS x, a AS y FROM pairs UNION SELECT reach.x, pairs.b FROM reach JOIN pairs ON pairs.a = reach.y),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.low, s.doc_id) AS component_id,
       coalesce(c.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.x = s.doc_id"""

_CLEAN = (r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')")
_GRAMS = "list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))"
LLM_ORACLE["op8_simhash_decon"] = f"""
WITH d0 AS (SELECT doc_id, row_number() OVER () AS r, {_CLEAN} AS ws FROM documents),
i0 AS (SELECT item_id, {_CLEAN} AS ws FROM benchmark),
d AS (SELECT doc_id, r, len(ws) AS n, {_GRAMS} AS gs FROM d0 WHERE len(ws) >= 5),
it AS (SELECT item_id, len(ws) AS n, {_GRAMS} AS gs FROM i0 WHERE len(ws) >= 5),
dg AS (SELECT r, n, unnest(gs) AS g, unnest(range(len(gs))) AS pos FROM d),
ig AS (SELECT item_id, n, unnest(gs) AS g, unnest(range(len(gs))) AS pos FROM it),
win AS (
  SELECT DISTINCT dg.r, greatest(0, least(dg.pos - ig.pos, dg.n - ig.n)) AS start, ig.n AS size
  FROM dg JOIN ig ON ig.g = dg.g),
wg AS (SELECT win.r, win.start, win.size, unnest(d.gs[win.start + 1:win.start + win.size - 4]) AS g
       FROM win JOIN d ON d.r = win.r),
wc0 AS (SELECT r, start, size, g, count(*) AS c FROM wg GROUP BY ALL),
ic0 AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
wc AS (SELECT *, sum(c) OVER (PARTITION BY r, start, size) AS len FROM wc0),
ic AS (SELECT *, sum(c) OVER (PARTITION BY item_id) AS len FROM ic0),
m AS (
  SELECT wc.r, ic.item_id, wc.start, wc.size, CAST(sum(least(wc.c, ic.c)) AS BIGINT) AS shared,
         CAST(any_value(wc.len) + any_value(ic.len) - sum(least(wc.c, ic.c)) AS BIGINT) AS total
  FROM wc JOIN ic ON ic.n = wc.size AND ic.g = wc.g GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY shared / total DESC, start) AS rk
  FROM m WHERE 100 * shared >= 80 * total)
SELECT d.doc_id, b.item_id, CAST(b.start AS INTEGER) AS start, CAST(b.size AS INTEGER) AS n_words, b.shared, b.total,
       round(b.shared / b.total, 6) AS similarity
FROM best b JOIN d ON d.r = b.r WHERE rk = 1"""

_RECORD = ("'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || {u} || crlf || "
           "'Content-Length: ' || strlen({p}) || crlf || crlf || {p} || crlf || crlf")


def _record(u: str, p: str) -> str:
    return _RECORD.replace("{u}", u).replace("{p}", p)


LLM_ORACLE["op10_merkle_fixity"] = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS crlf,
                  coalesce(CAST(page_id AS VARCHAR), 'null') AS id FROM pages),
r AS (SELECT *, sha256({_record('url', 'html')}) AS sha, strlen({_record('url', 'html')}) AS length,
             substr(sha256('drill ' || id), 1, 2) AS fate FROM p),
h AS (
  SELECT DISTINCT page_id, sha256(id || ' ' || url || ' ' || sha) AS spot, length, sha,
         CASE WHEN fate = '01' THEN 'missing'
              WHEN fate = '00' AND sha256({_record('url', "('?' || substr(html, 2))")}) <> sha THEN 'changed'
              WHEN fate = '02' AND sha256({_record('url', "substr(html, 1, length(html) // 2)")}) <> sha THEN 'changed'
              ELSE 'ok' END AS status FROM r),
f AS (SELECT *, CAST(('0x' || substr(spot, 1, 12))::BIGINT
                     % greatest(1, (SELECT (count(*) + 1023) // 1024 FROM h)) AS INTEGER) AS warc_file FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY warc_file ORDER BY spot) - 1 AS record_no,
             CAST(sum(length) OVER (PARTITION BY warc_file ORDER BY spot) AS BIGINT) AS end_offset FROM f)
SELECT page_id, warc_file, record_no, end_offset - length AS start_offset, end_offset, sha AS record_sha256, status
FROM o"""


LLM_ORACLE["op11_phrase_graph"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM ws, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
parts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (
  SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.first JOIN f r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE m = 3
         UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE m = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
       a, l, r, n.n, score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE h.f IS NULL OR 100 * h.f < 50 * a
QUALIFY rank <= 2000"""


# The control strings, and the characters that each turn's markers take.
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<END>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>"
_ESCAPED = f"(length({{t}}) + len(regexp_extract_all({{t}}, '\\\\')) + len(regexp_extract_all({{t}}, '{_CONTROL}')))"
LLM_ORACLE["op12_template_compiler"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 22 + {_ESCAPED.replace('{t}', 'role')} END
            + {_ESCAPED.replace('{t}', 'text')} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


# crc32 bit by bit (a byte, then eight shifts), and the edits of one row: state before, state after,
# initial of a kept role (or * for any), cost, label, role of the inserted turn, role given to the row.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({k}, ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""
_EDITS = """(VALUES
  (0, 1, 's', 0, 'K', NULL, NULL), (0, 2, 'u', 0, 'K', NULL, NULL), (1, 2, 'u', 0, 'K', NULL, NULL),
  (2, 3, 'a', 0, 'K', NULL, NULL), (3, 2, 'u', 0, 'K', NULL, NULL),
  (0, 3, 'a', 2, 'IK', 'user', NULL), (1, 3, 'a', 2, 'IK', 'user', NULL), (3, 3, 'a', 2, 'IK', 'user', NULL),
  (2, 2, 'u', 2, 'IK', 'assistant', NULL),
  (0, 2, '*', 2, 'R', NULL, 'user'), (1, 2, '*', 2, 'R', NULL, 'user'), (3, 2, '*', 2, 'R', NULL, 'user'),
  (2, 3, '*', 2, 'R', NULL, 'assistant'),
  (0, 3, '*', 4, 'IR', 'user', 'assistant'), (1, 3, '*', 4, 'IR', 'user', 'assistant'),
  (3, 3, '*', 4, 'IR', 'user', 'assistant'), (2, 2, '*', 4, 'IR', 'assistant', 'user'),
  (0, 0, '-', 3, 'D', NULL, NULL), (1, 1, '-', 3, 'D', NULL, NULL), (2, 2, '-', 3, 'D', NULL, NULL),
  (3, 3, '-', 3, 'D', NULL, NULL)) AS e(a, b, initial, cost, label, put, given)"""
LLM_ORACLE["op13_audit_repair"] = rf"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.replace('{k}', "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM told),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
faults AS (
  SELECT conv_id, turn, role, text, i, before, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM conversations
  UNION ALL
  SELECT d.conv_id, f.i, e.b, d.cost + e.cost + (CASE WHEN f.fault = 'truncated' AND e.label <> 'D' THEN 1 ELSE 0 END),
         d.audit || e.label,
         CASE WHEN e.label = 'D' THEN d.lines
              WHEN e.put IS NULL THEN list_append(d.lines, coalesce(e.given, f.role) || ':' || f.text)
              ELSE list_append(list_append(d.lines, e.put || ':'), coalesce(e.given, f.role) || ':' || f.text) END
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1
       JOIN {_EDITS} ON e.a = d.s AND (e.label = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND e.initial IN ('*', f.initial)))
  QUALIFY row_number() OVER (PARTITION BY d.conv_id, e.b ORDER BY d.cost + e.cost + (CASE WHEN f.fault = 'truncated' AND e.label <> 'D' THEN 1 ELSE 0 END), d.audit || e.label) = 1),
size AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
best AS (
  SELECT d.conv_id, d.cost + 2 * len(p.puts) AS cost, d.audit || repeat('I', len(p.puts)) AS audit, list_concat(d.lines, p.puts) AS lines
  FROM dp d JOIN size z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.n = d.i
       JOIN (VALUES (0, CAST([] AS VARCHAR[])), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, CAST([] AS VARCHAR[]))) AS p(s, puts) ON p.s = d.s
  QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost + 2 * len(p.puts), d.audit || repeat('I', len(p.puts))) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""
