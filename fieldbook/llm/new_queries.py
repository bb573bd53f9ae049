"""Spelling variants, license scans and the audit of filters: a query each, with its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import interaction, licenses, spelling
from fieldbook.llm.common import read_table


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def _nibble_table() -> list[int]:
    """CRC-32 of each half byte, by its polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
u AS (SELECT d, run, count(*) AS c, hex(encode(d || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY d, run),
h AS (
  SELECT run, c, xor(list_reduce([4294967295] || list_transform(range(length(x)), lambda k: instr('0123456789ABCDEF', x[xor(k, 1) + 1]) - 1),
    lambda s, v: xor(s >> 4, {_nibble_table()}[(xor(s, v) & 15) + 1])), 4294967295) AS h
  FROM u),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS y, max(n) AS m FROM near JOIN v ON y = v.word GROUP BY x),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best ON word = x),
walk AS (
  SELECT word, coalesce(form, word) AS root FROM f
  UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = interaction.failures(read_table(spark, sf_dir, "documents"))
    return interaction.audit(interaction.mask_counts(failed, read_table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6))::INT AS step FROM o),
r AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS letter,
    sum(n) FILTER (NOT list_has_any(fails, o[1:step])) AS kept,
    sum(n) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS removed,
    sum(n) FILTER (list_contains(fails, o[step]) AND list_has_any(fails, o[1:step - 1])) AS redundant,
    sum(n) FILTER (fails = [o[step]]) AS unique_fails,
    sum(good) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS good_lost,
    sum(toxic) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])) AS toxic_lost
  FROM m, s GROUP BY part, o, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM r
"""

def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Phrases by lists of words, templates as regular expressions over the words joined by spaces."""
    places, wordings = [], []
    for phrase, label in licenses.PHRASES.items():
        words = licenses.words_in(phrase)
        places.append(f"SELECT doc_id, i, '{label}' AS label FROM p WHERE w[i + 1:i + {len(words)}] = {words}")
        wordings.append((label, words))
    wordings += [(label, licenses.parse(t)) for label, t in licenses.TEMPLATES]
    tests = [f"CASE WHEN regexp_matches(t, ' {licenses.as_regex(x)}') THEN {{'label': '{label}', 'm': {licenses.mandatory(x)}}} END" for label, x in wordings]
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
b AS (
  SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM ({" UNION ALL ".join(places)}) GROUP BY doc_id),
h AS (
  SELECT doc_id, list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL) AS hits
  FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d))
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first AS first_word, last AS last_word, coalesce(labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ',') AS labels,
  coalesce(list_max(list_transform(hits, lambda x: x.m)) / (list_max(list_transform(hits, lambda x: x.m)) + 4.0)::DOUBLE, 0)::DOUBLE AS score
FROM d JOIN h USING (doc_id) LEFT JOIN b USING (doc_id)
"""


QUERIES = {"op12_license_scan": op12_license_scan, "op11_spelling_variants": op11_spelling_variants, "op13_filter_interaction": op13_filter_interaction}
ORACLE_SQL = {"op12_license_scan": _license_sql(), "op11_spelling_variants": OP11_SQL, "op13_filter_interaction": OP13_SQL}
