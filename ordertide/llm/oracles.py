"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Sequence

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
  FROM documents),
lines AS (
  SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (
  SELECT rid, source, text, line,
         translate(trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'),
                   '[\x20\x09-\x0D]+', ' ', 'g')), '123456789', '000000000') AS plain,
         len(regexp_extract_all(line, '{WORD}')) AS n
  FROM lines WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY rid),
bad AS (SELECT source, plain FROM worded GROUP BY source, plain HAVING count(DISTINCT text) > 8),
removed AS (
  SELECT w.rid, sum(w.n) AS n_removed
  FROM worded w JOIN bad b ON b.source IS NOT DISTINCT FROM w.source AND b.plain = w.plain
  GROUP BY w.rid),
starts AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM starts) WHERE n > 1),
repeats AS (
  SELECT rid, sum(least(8, i - coalesce(before, -8))) AS n_repeat_words
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
figures AS (
  SELECT d.doc_id, len(d.words) AS n_words,
         length(array_to_string(d.words, '')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed, 0) AS n_removed
  FROM docs d LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_removed <= 0.5 * n_words AS kept,
       CAST(n_removed AS BIGINT) AS n_removed
FROM figures
"""

DECONTAMINATE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, least(10, len(words)) AS size,
               unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, sizes WHERE len(words) >= size)),
found AS (
  SELECT d.rid, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w USING (size, win)),
spans AS (
  SELECT rid, i, max(i + size) AS upto FROM found GROUP BY rid, i),
hit AS (
  SELECT rid, sum(greatest(0, upto - greatest(i, coalesce(before, 0)))) AS n_hit
  FROM (SELECT rid, i, upto, max(upto) OVER (PARTITION BY rid ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans)
  GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

URL_FILTER = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS host FROM rests),
parts AS (
  SELECT row_number() OVER () AS rid, page_id, translate(host, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT p.rid, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts p JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (rid)
"""

SPELLING = rf"""
WITH RECURSIVE
crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
        FROM range(256) r(i))),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                   '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY id, run),
letters AS (
  SELECT run, n, list_transform(string_split(id || ':' || run, ''), lambda ch: ord(ch)) AS points FROM runs),
bytes AS (
  SELECT run, n, flatten(list_transform(points,
           lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END)) AS bytes FROM letters),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(bytes,
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h
  FROM bytes, crc),
spelt AS (
  SELECT CASE WHEN h % 199 = 0
              THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
              ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6
  GROUP BY word HAVING sum(n) >= 5),
dropped AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT d.word, d.n, w.word, w.n FROM dropped d JOIN words w ON d.rest = w.word
  UNION
  SELECT w.word, w.n, d.word, d.n FROM dropped d JOIN words w ON d.rest = w.word),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
  FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
walk AS (
  SELECT word, word AS at, form FROM forms
  UNION ALL
  SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.form)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, k.at AS root
FROM forms f JOIN walk k ON k.word = f.word AND k.form IS NULL
"""


def _pattern(wording: str) -> str:
    """A license template as a regular expression over words that each follow a blank."""
    pattern = ""
    for part in re.split(r"(<<[^>]*>>)", wording):
        if part == "<<optional>>":
            pattern += "(?:"
        elif part == "<<end>>":
            pattern += ")?"
        elif part.startswith("<<any:"):
            pattern += f"(?: [^ ]+){{0,{part[6:-2]}}}"
        else:
            pattern += "".join(f" {word}" for word in re.findall("[a-z0-9]+", part.lower()))
    return f"{pattern} "


def licenses(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> str:
    wanted = ", ".join(f"('{phrase}', {phrase.count(' ') + 1}, '{label}')" for phrase, label in phrases)
    patterns = ", ".join(f"('{label}', '{_pattern(wording)}')" for label, wording in templates)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
phrases(phrase, size, label) AS (VALUES {wanted}),
templates(label, pattern) AS (VALUES {patterns}),
starts AS (
  SELECT rid, words, i FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM docs)
  WHERE words[i] IN (SELECT split_part(phrase, ' ', 1) FROM phrases)),
places AS (
  SELECT rid, i - 1 AS start, label
  FROM starts JOIN phrases ON array_to_string(words[i:i + size - 1], ' ') = phrase),
base AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY rid),
whole AS (
  SELECT DISTINCT rid, label
  FROM docs, templates
  WHERE regexp_matches(' ' || array_to_string(words, ' ') || ' ', pattern)),
every AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM whole) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
       CASE WHEN d.rid IN (SELECT rid FROM whole) THEN CAST(1 AS DOUBLE)
            WHEN n_base > 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score
FROM docs d LEFT JOIN base b USING (rid) LEFT JOIN every e USING (rid)
"""


HARD_NEGATIVES = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.rid <> b.rid
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s
  ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other_id, s.other)
QUALIFY row_number() OVER w <= 5
"""
