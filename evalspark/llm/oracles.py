"""SQL for DuckDB that gives the rows of those queries which SQL can express."""

from __future__ import annotations

from evalspark.llm.licenses import ANCHORS, NOT_WORD, PHRASES
from evalspark.llm.quality_rules import (
    CLASSES,
    COMMON_WORDS,
    MAX_CHAR_DISTANCE,
    MAX_REPEATED,
    MAX_WORD_DISTANCE,
    MIN_CHARS,
    MIN_COMMON,
    MIN_WORDS,
)

_BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan() -> str:
    phrases = ", ".join(
        f"({i}, '{p.label}', {str(p.base).lower()}, {_list(p.words)})" for i, p in enumerate(PHRASES)
    )
    return f"""
WITH phrases(p, label, base, ws) AS (VALUES {phrases}),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    lower(replace(coalesce(text, ''), chr(8490), chr(65533))), '{NOT_WORD}'), lambda x: x <> '') AS words
  FROM documents),
vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM phrases),
seen AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS w FROM docs)
         WHERE w IN (SELECT w FROM vocabulary) GROUP BY w),
weights AS (SELECT v.w, ln(((SELECT count(*) FROM docs) + 1.0) / (coalesce(df, 0) + 1.0)) + 1e-9 AS x
            FROM vocabulary v LEFT JOIN seen USING (w)),
spelled AS (SELECT p, label, base, unnest(ws) AS w, unnest(range(len(ws))) AS k, len(ws) AS n FROM phrases),
weighed AS (SELECT s.*, x, sum(x) OVER (PARTITION BY p) AS whole,
                   row_number() OVER (PARTITION BY p ORDER BY x DESC, k) AS rarity FROM spelled s JOIN weights USING (w)),
places AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
starts AS (SELECT DISTINCT doc_id, p, i - k AS start FROM places JOIN weighed USING (w)),
judged AS (
  SELECT doc_id, p, start, any_value(label) AS label, bool_or(base) AS base,
         coalesce(sum(CASE WHEN l.w = g.w THEN x END), 0) / any_value(whole) AS share,
         count(CASE WHEN l.w = g.w THEN 1 END) = any_value(n) AS stands,
         count(CASE WHEN l.w = g.w AND rarity <= {ANCHORS} THEN 1 END) > 0 AS rare
  FROM starts JOIN weighed g USING (p) LEFT JOIN places l USING (doc_id)
  WHERE l.i = start + k GROUP BY doc_id, p, start),
found AS (
  SELECT doc_id, count(*) FILTER (stands AND base) AS n_base, min(start) FILTER (stands AND base) AS first_word,
         max(start) FILTER (stands AND base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands AND base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands) AS labels, max(share) FILTER (rare) AS score
  FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0.0), 9) AS score
FROM docs LEFT JOIN found USING (doc_id)"""


def embedding_dedup() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
           ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM linked WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a) USING (vec_id)"""


def quality_rules() -> str:
    steps = "docs0 AS (SELECT *, chars AS c0 FROM docs)"
    quoted = [p.replace("'", "''") for p in CLASSES.values()]
    for k, pattern in enumerate(quoted):
        steps += f",\ndocs{k + 1} AS (SELECT *, regexp_replace(c{k}, '{pattern}', '', 'g') AS c{k + 1} FROM docs{k})"
    last = len(quoted)
    bins = [f"{{'b': '{k}', 'n': length(c{k}) - length(c{k + 1})}}" for k in range(last)]
    histogram = ", ".join([*bins, f"{{'b': 'other', 'n': length(c{last})}}"])

    def distance(bins: str) -> str:
        return f"""
  SELECT doc_id, sqrt(greatest(sum(
      (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
       + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS d
  FROM (SELECT d.doc_id, coalesce(b.n, 0) / d.n_all AS p, r.n / r.n_all AS q
        FROM (SELECT doc_id, lang, sum(n) AS n_all FROM {bins} GROUP BY ALL HAVING sum(n) > 0) d
        JOIN (SELECT lang, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS n_all FROM {bins} GROUP BY lang, b) r
          ON r.lang = d.lang
        LEFT JOIN {bins} b ON b.doc_id = d.doc_id AND b.b = r.b)
  GROUP BY doc_id"""

    common = _list(sorted(set(COMMON_WORDS)))
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS words,
         regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g') AS chars
  FROM documents),
{steps},
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (
    SELECT doc_id, unnest(range(greatest(len(words) - 2, 0))) AS i,
           unnest(list_transform(range(greatest(len(words) - 2, 0)), lambda k: words[k + 1:k + 3])) AS w FROM docs)),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT d.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(chars) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANKS}', '', 'g') <> '') AS ls
        FROM docs{last}) d LEFT JOIN repeated USING (doc_id)),
char_bins AS (SELECT doc_id, lang, h.b AS b, CAST(h.n AS DOUBLE) AS n FROM (
    SELECT doc_id, lang, unnest([{histogram}]) AS h FROM counted)),
word_bins AS (
  SELECT doc_id, lang, b, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT doc_id, lang, CASE WHEN list_contains({common}, lower(w)) THEN lower(w) ELSE '*' END AS b
    FROM (SELECT doc_id, lang, unnest(words) AS w FROM docs)) GROUP BY ALL),
char_distance AS ({distance('char_bins')}),
word_distance AS ({distance('word_bins')}),
judged AS (
  SELECT c.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
         CASE WHEN word_chars >= {MIN_CHARS} THEN round(h.d, 9) END AS char_distance,
         CASE WHEN n_words >= {MIN_COMMON} THEN round(w.d, 9) END AS word_distance
  FROM counted c LEFT JOIN char_distance h USING (doc_id) LEFT JOIN word_distance w USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance <= {MAX_CHAR_DISTANCE}, true)
         AND coalesce(word_distance <= {MAX_WORD_DISTANCE}, true) AS kept, char_distance, word_distance
FROM judged"""


def prefix_trie() -> str:
    """CRC-32 by its table, a byte at a time; nodes by lists of whole turns."""
    return rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(length(r) || ':' || r || x), 1, 32)) AS pos, {{'role': r, 'text': x}} AS said
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce("text", '') AS x FROM conversations)
  WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos) AS said FROM turns GROUP BY conv_id),
shares AS (
  SELECT conv_id, said, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc_table),
rebuilt AS (
  SELECT s.conv_id, coalesce(f.said[:s.h], []) || s.said[s.h + 1:] AS said
  FROM shares s LEFT JOIN own f ON f.conv_id = s.conv_id - s.conv_id % 20),
members AS (SELECT conv_id, said, len(said) AS n, unnest(range(len(said) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, said[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
family AS (
  SELECT p.*, (SELECT count(*) FROM nodes c WHERE c.depth = p.depth + 1 AND c.path[:p.depth] = p.path) AS n_children,
         CASE WHEN depth = 0 THEN 0
              ELSE len(regexp_extract_all(path[depth]['text'], '{_WORDS}')) * (n_convs - 1) END AS saved
  FROM nodes p)
SELECT p.conv_id, p.depth,
       (SELECT u.conv_id FROM nodes u WHERE u.depth = p.depth - 1 AND u.path = p.path[:p.depth - 1]) AS parent_conv_id,
       p.n_convs, p.n_children, CAST(sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum(s.saved) AS BIGINT) AS saved_tokens, p.ends_sha256
FROM family p JOIN family s ON s.depth >= p.depth AND s.path[:p.depth] = p.path
GROUP BY ALL"""


def fill_in_middle() -> str:
    return """
WITH docs AS (
  SELECT doc_id, coalesce("text", '') AS x, length(coalesce("text", '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
drawn AS (
  SELECT *, ('0x' || hex[1:8])::BIGINT % (n + 1) AS a, ('0x' || hex[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || hex[17:24])::BIGINT % 100 AS c, ('0x' || hex[25:32])::BIGINT % 100 AS d FROM docs),
formed AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR c >= 90 THEN 'plain'
              WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, '<P>' || substring(x, 1, low) AS p, '<S>' || substring(x, high + 1, n - high) AS s,
         '<M>' || substring(x, low + 1, high - low) AS m FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM cut"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan(),
        "op4_embedding_dedup": embedding_dedup(),
        "op10_quality_rules": quality_rules(),
        "op11_prefix_trie": prefix_trie(),
        "op13_fill_in_middle": fill_in_middle(),
    }
