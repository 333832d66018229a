"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import CHAR_CLASSES, QualityLimits

WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, k, j, array_to_string(w[j : j + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
),
hit AS (SELECT doc_id, j, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

#: The character classes as expressions of one class each; a character counts for the first that has it.
_CLASSES = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": r"[\x20\x09\x0B-\x0D]",
    "newline": r"\x0A",
    "stop": "[,.:;!?]",
    "quote": r"[\x22\x27-]",
    "bracket": r"[()\[\]{}]",
    "symbol": r"[#$%&*+/<=>@\\^_`|~]",
    "non_ascii": r"[^\x00-\x7F]",
    "control": r"[\x00-\x08\x0E-\x1F\x7F]",
}


def quality_sql(limits: QualityLimits = QualityLimits()) -> str:
    counts = ", ".join(f"CAST(len(regexp_extract_all(t, '{_CLASSES[c]}')) AS BIGINT)" for c in CHAR_CLASSES)
    half = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    both = half.format(p="p", q="q") + " + " + half.format(p="q", q="p")
    spaced = r"[^\x20\x09-\x0D]+"
    classes = len(CHAR_CLASSES) + 1
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{spaced}') AS w, [{counts}] AS h,
  regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x80-\\x{{10FFFF}}]+') AS c FROM t),
win AS (SELECT doc_id, j, array_to_string(w[j : j + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS j FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM win) WHERE k > 1) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{spaced}') GROUP BY doc_id),
m AS (SELECT w.*, len(w.w) AS nw, coalesce(rep.n, 0) AS nr, coalesce(lin.n, 0) AS nl,
  len(w.w) < {limits.min_words} OR 100 * coalesce(rep.n, 0) > {limits.max_repeat_percent} * len(w.w) AS failed FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
tot AS (SELECT * FROM (SELECT lang, sum(len(c)) AS total FROM m WHERE NOT failed GROUP BY lang) WHERE total > 0 AND total * {limits.language_one_in} >= (SELECT sum(len(c)) FROM m WHERE NOT failed)),
cnt AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(c) AS x FROM m WHERE NOT failed) GROUP BY lang, x),
com AS (SELECT lang, x, n, CAST(floor(log2(row_number() OVER (PARTITION BY lang ORDER BY n DESC, x))) AS BIGINT) AS k FROM cnt JOIN tot USING (lang) WHERE n * {limits.common_one_in} >= total),
bins AS (SELECT lang, coalesce(max(k), -1) + 2 AS bins, coalesce(sum(n), 0) AS listed FROM tot LEFT JOIN com USING (lang) GROUP BY lang),
rw AS (SELECT lang, k, sum(n) / CAST(any_value(total) AS DOUBLE) AS q FROM com JOIN tot USING (lang) GROUP BY lang, k
  UNION ALL SELECT lang, bins - 1 AS k, (total - listed) / CAST(total AS DOUBLE) AS q FROM bins JOIN tot USING (lang)),
dk AS (SELECT doc_id, lang, k, count(*) AS n FROM (SELECT doc_id, lang, unnest(c) AS x FROM m) JOIN com USING (lang, x) GROUP BY doc_id, lang, k),
dall AS (SELECT doc_id, lang, k, n FROM dk UNION ALL SELECT m.doc_id, m.lang, any_value(bins) - 1 AS k, any_value(len(c)) - coalesce(sum(dk.n), 0) AS n FROM m JOIN bins ON m.lang = bins.lang LEFT JOIN dk ON m.doc_id = dk.doc_id GROUP BY m.doc_id, m.lang),
dw AS (SELECT m.doc_id, rw.k, q, coalesce(dall.n, 0) / CAST(greatest(1, len(c)) AS DOUBLE) AS p FROM m JOIN rw ON m.lang = rw.lang LEFT JOIN dall ON m.doc_id = dall.doc_id AND rw.k = dall.k),
wd AS (SELECT doc_id, greatest(0, sum({both}) / 2) AS d FROM dw GROUP BY doc_id),
rc AS (SELECT lang, k, sum(h[k]) / CAST(sum(sum(h[k])) OVER (PARTITION BY lang) AS DOUBLE) AS q FROM (SELECT lang, h, unnest(range(1, {classes})) AS k FROM m WHERE NOT failed) GROUP BY lang, k),
dc AS (SELECT doc_id, lang, k, h[k] / CAST(greatest(1, list_sum(h)) AS DOUBLE) AS p FROM (SELECT doc_id, lang, h, unnest(range(1, {classes})) AS k FROM m)),
cd AS (SELECT doc_id, sqrt(greatest(0, sum({both}) / 2)) AS d FROM dc JOIN rc USING (lang, k) GROUP BY doc_id),
j AS (SELECT m.*, coalesce({limits.reference_times} * len(c) <= total, FALSE) AS sure, cd.d AS chars, sqrt(greatest(0, wd.d - (bins - 1) / (8 * ln(2) * greatest(1, len(c))))) AS words
  FROM m LEFT JOIN tot USING (lang) LEFT JOIN bins USING (lang) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  nl AS n_dup_lines, nr AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (sure AND (
    (length(t) >= {limits.min_chars_judged} AND coalesce(chars, 0) > {limits.max_char_distance}) OR (len(c) >= {limits.min_words_judged} AND coalesce(words, 0) > {limits.max_word_distance}))) AS kept
FROM j
"""
