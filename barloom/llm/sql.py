"""SQL of the queries whose results SQL can express."""

from __future__ import annotations


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees of leaves (g, lvl, pos, n, h), level by level."""
    return f"""
{name} AS (
  {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 3, CAST(ceil(any_value(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3)"""


MERKLE = f"""
WITH RECURSIVE doc AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS g,
    ~list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) & 1 = 0 AS tampered
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS leaf2 FROM documents) t),
{_levels("node", "SELECT g, 0 AS lvl, pos, n, leaf AS h FROM doc")},
sub AS (SELECT g, h FROM node WHERE n = 1),
{_levels("top", "SELECT 0 AS g, 0 AS lvl, g AS pos, count(*) OVER () AS n, h FROM sub")},
run AS (SELECT 0 AS tree, g, lvl, pos, h FROM node WHERE n > 1 UNION ALL SELECT 1, 0, lvl, pos, h FROM top WHERE n > 1),
step AS (SELECT a.tree, a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM run a JOIN run b ON a.tree = b.tree AND a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 GROUP BY ALL),
rid AS (SELECT *, row_number() OVER () AS id FROM doc),
path AS (
  SELECT id, list({{'l': l, 'r': r}} ORDER BY tree, lvl) AS p FROM (
    SELECT id, s.* FROM rid, range(30) k(k) JOIN step s ON s.tree = 0 AND s.g = rid.g AND s.lvl = k AND s.pos = rid.pos // CAST(3 ** k AS BIGINT)
    UNION ALL SELECT id, s.* FROM rid, range(30) k(k) JOIN step s ON s.tree = 1 AND s.lvl = k AND s.pos = rid.g // CAST(3 ** k AS BIGINT)) t GROUP BY id),
proof AS (SELECT rid.*, coalesce(p, []) AS p FROM rid LEFT JOIN path USING (id)),
fold(id, k, h, p) AS (
  SELECT id, 0, CASE WHEN tampered THEN leaf2 ELSE leaf END, p FROM proof
  UNION ALL SELECT id, k + 1, sha256(p[k + 1].l || h || p[k + 1].r), p FROM fold WHERE k < len(p))
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = top.h AS verified
FROM proof JOIN sub USING (g) JOIN (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id) f USING (id), (SELECT h FROM top WHERE n = 1) top"""


def _bits(half: str) -> str:
    """The bits of 64 for which over half of the terms vote, as one number."""
    votes = (f"((CASE WHEN 2 * sum(({half} >> {b}) & 1) > count(term) THEN 1 ELSE 0 END)::UHUGEINT << {b})" for b in range(64))
    return f"CAST(({' + '.join(votes)}) AS UBIGINT)"


_WORDS = r"regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rid, count(*) OVER () AS n FROM documents),
e AS (SELECT a.rid, a.doc_id, b.rid AS nxt, a.t, length(a.t) AS n_chars, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS e
  FROM d a JOIN d b ON b.rid = a.rid % a.n + 1),
w AS (SELECT rid, kind, {_WORDS} AS w FROM (SELECT rid, 0 AS kind, t FROM e UNION ALL SELECT rid, 1, e FROM e) u),
term AS (SELECT rid, kind, md5(term) AS m, term FROM (
  SELECT rid, kind, unnest(CASE WHEN len(w) = 0 THEN [NULL] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS term FROM w) u),
h AS (SELECT rid, kind, term, CAST('0x' || m[:16] AS UBIGINT) AS hi, CAST('0x' || m[17:] AS UBIGINT) AS lo FROM term),
f AS (SELECT rid, kind, {_bits("hi")} AS hi, {_bits("lo")} AS lo FROM h GROUP BY rid, kind),
q AS (SELECT a.rid, count(*) - 1 AS n_near FROM (SELECT f.* FROM f JOIN d USING (rid) WHERE kind = 0 AND doc_id % 50 = 0) a
  JOIN (SELECT * FROM f WHERE kind = 0) b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3 GROUP BY a.rid)
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, printf('%016x%016x', o.hi, o.lo) AS fingerprint, printf('%016x%016x', c.hi, c.lo) AS edited_fingerprint,
  1 - (bit_count(xor(o.hi, c.hi)) + bit_count(xor(o.lo, c.lo))) / 128.0 AS near_edited,
  1 - (bit_count(xor(o.hi, x.hi)) + bit_count(xor(o.lo, x.lo))) / 128.0 AS near_next, coalesce(n_near, -1) AS n_near
FROM e JOIN f o ON o.rid = e.rid AND o.kind = 0 JOIN f c ON c.rid = e.rid AND c.kind = 1 JOIN f x ON x.rid = e.nxt AND x.kind = 0 LEFT JOIN q ON q.rid = e.rid"""

RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, w[i : i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d) u),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS n FROM win) u WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) u GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS upper,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END AS base,
  CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * upper > 3 * n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 32 ELSE 0 END + CASE WHEN 10 * letters < 7 * n_words THEN 64 ELSE 0 END AS rest FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base > 0 AS base_failed, base + rest = 0 AS kept, CAST(base + rest AS BIGINT) AS fail_bits FROM b"""
