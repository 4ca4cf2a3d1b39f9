"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from salescast.llm.license_scan import TEMPLATES

_WORDS = r"string_split_regex(regexp_replace(regexp_replace({text}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '[\x20\x09-\x0D]+')"


def words(text: str) -> str:
    """List of the words of a text column; empty for null and for texts without words."""
    split = _WORDS.format(text=text)
    return f"CASE WHEN regexp_matches(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]') THEN {split} ELSE [] END"


def lowered(text: str) -> str:
    """A to Z only."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles(list_column: str) -> str:
    """Distinct 5-word shingles of a list of words; a shorter list is one shingle."""
    return f"""CASE WHEN len({list_column}) = 0 THEN []
        WHEN len({list_column}) < 5 THEN [array_to_string({list_column}, ' ')]
        ELSE list_distinct(list_transform(range(1, len({list_column}) - 3),
             lambda i: array_to_string({list_column}[i:i+4], ' '))) END"""


OP8 = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, {words(lowered('text'))} AS w FROM documents
), sets AS (
  SELECT doc_id, {shingles('w')} AS s FROM tokens
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT l.doc_id AS a, r.doc_id AS b
  FROM each l JOIN each r ON l.shingle = r.shingle AND l.doc_id <> r.doc_id
  GROUP BY l.doc_id, r.doc_id, l.n, r.n
  HAVING 100 * count(*) >= 75 * (l.n + r.n - count(*))
), reach(doc_id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce(o.other, s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(o.other, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN least o ON s.doc_id = o.doc_id
"""

OP1 = f"""
WITH docs AS (
  SELECT doc_id, {words(lowered('text'))} AS w FROM documents
), items AS (
  SELECT item_id, {words(lowered('text'))} AS w FROM benchmark
), doc_shingles AS (
  SELECT doc_id, unnest({shingles('w')}) AS shingle FROM docs
), item_sets AS (
  SELECT item_id, {shingles('w')} AS s FROM items
), item_shingles AS (
  SELECT item_id, len(s) AS n, unnest(s) AS shingle FROM item_sets
)
SELECT d.doc_id, i.item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(i.n AS BIGINT) AS n_item_shingles
FROM doc_shingles d JOIN item_shingles i ON d.shingle = i.shingle
GROUP BY d.doc_id, i.item_id, i.n
HAVING 100 * count(*) >= 75 * i.n
"""


def _covered(width: int) -> str:
    """Words in windows of ``width`` words that are found twice or more in the document."""
    return f"""SELECT doc_id, count(DISTINCT place + step) AS words
  FROM (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, gram) AS times
        FROM (SELECT doc_id, unnest(range(1, len(w) - {width} + 2)) AS place,
                     unnest(list_transform(range(1, len(w) - {width} + 2),
                            lambda i: array_to_string(w[i:i+{width - 1}], ' '))) AS gram
              FROM tokens WHERE len(w) >= {width})), range({width}) AS steps(step)
  WHERE times > 1 GROUP BY doc_id"""


OP2 = f"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, {words('text')} AS w FROM documents
), windows AS ({_covered(3)}
), repeats AS ({_covered(8)}
), long_repeats AS ({_covered(101)}
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tokens)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(x.words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(r.words, 0) AS BIGINT) AS covered_words,
         y.words IS NOT NULL AS too_long
  FROM tokens t LEFT JOIN windows x USING (doc_id) LEFT JOIN repeats r USING (doc_id)
  LEFT JOIN long_repeats y USING (doc_id) LEFT JOIN lines l USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT too_long AND 100 * covered_words <= 40 * n_words AS kept, covered_words
FROM judged
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES.items()))
_TERMS = "regexp_extract_all({text}, '[a-z0-9]+(?:[.-][a-z0-9]+)*')"


def _weighted(side: str, by: str) -> str:
    """Terms of ``side`` with TF-IDF weights of unit length per ``by``."""
    return f"""SELECT *, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {by})) AS unit
  FROM (SELECT s.*, (1 + ln(s.tf)) * (ln((1 + (SELECT count(*) FROM lines)) / (1 + coalesce(df, 0))) + 1) AS weight
        FROM {side} s LEFT JOIN known USING (term))"""


OP6 = f"""
WITH files AS (
  SELECT *, concat_ws('/', coalesce(source, '-'), doc_id // 1000, hundreds) AS directory,
         concat_ws('/', coalesce(source, '-'), doc_id // 1000, hundreds, doc_id) AS path
  FROM (SELECT doc_id, text, source, CASE WHEN doc_id % 100 >= 20 THEN doc_id // 100 END AS hundreds FROM documents)
), lines AS (
  SELECT doc_id, array_to_string({_TERMS.format(text=lowered("line"))}, ' ') AS notice
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files)
  WHERE regexp_matches(line, '(?i)licen[cs]e|copyright|public domain|creative commons')
), whole AS (
  SELECT doc_id, {_TERMS.format(text=lowered("text"))} AS all_terms FROM files WHERE doc_id IN (SELECT doc_id FROM lines)
), notices AS (
  SELECT notice, sum(times) AS times
  FROM (SELECT notice, 1 AS times FROM lines UNION ALL SELECT array_to_string(all_terms, ' '), 0 FROM whole) GROUP BY notice
), words AS (
  SELECT notice, times, term, count(*) AS tf
  FROM (SELECT notice, times, unnest(string_split(notice, ' ')) AS term FROM notices) GROUP BY ALL
), known AS (
  SELECT term, sum(times) AS df FROM words GROUP BY term
), templates(place, license, text) AS (VALUES {_TEMPLATE_ROWS}
), template_words AS (
  SELECT place, license, term, count(*) AS tf
  FROM (SELECT place, license, unnest({_TERMS.format(text=lowered("text"))}) AS term FROM templates) GROUP BY ALL
), l AS ({_weighted("words", "notice")}
), t AS ({_weighted("template_words", "place")}
), cosines AS (
  SELECT notice, place, license, round(sum(l.unit * t.unit), 6) AS cosine
  FROM l JOIN t USING (term) GROUP BY notice, place, license
), told AS (
  SELECT doc_id, license, cosine, place, len(string_split(notice, ' ')) AS length
  FROM (FROM lines UNION ALL SELECT doc_id, array_to_string(all_terms, ' ') FROM whole) JOIN cosines USING (notice)
  WHERE cosine >= 0.7
), own AS (
  SELECT doc_id, arg_max(license, (cosine, -place)) AS own_license, max(cosine) AS own_cosine,
         max(length) >= 0.5 * any_value(len(all_terms)) AS speaks
  FROM told JOIN whole USING (doc_id) GROUP BY doc_id
), found AS (
  SELECT * FROM files LEFT JOIN own USING (doc_id)
), granted AS (
  SELECT directory, arg_min(own_license, (-own_cosine, path)) AS granted
  FROM found WHERE speaks AND own_license IS NOT NULL GROUP BY directory
), above AS (
  SELECT directory, unnest(list_distinct([directory, regexp_replace(directory, '/[^/]*$', ''),
                                          regexp_replace(directory, '/[^/]*/[^/]*$', '')])) AS name
  FROM (SELECT DISTINCT directory FROM files)
), inherited AS (
  SELECT a.directory, arg_max(g.granted, length(a.name)) AS granted, arg_max(a.name, length(a.name)) AS origin
  FROM above a JOIN granted g ON a.name = g.directory GROUP BY a.directory
)
SELECT doc_id, path, own_license, own_cosine, coalesce(own_license, granted) AS license,
       CASE WHEN own_license IS NULL THEN origin END AS license_directory
FROM found LEFT JOIN inherited USING (directory)
"""

_FIELDS = ["doc_id", "source", "lang", "n_chars", "{text}"]


def _leaf(text: str) -> str:
    """Digest of a row's fields."""
    fields = [f"CAST({f.format(text=text)} AS VARCHAR)" for f in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# CRC-32 of a decimal number, one bit at a time: the ASCII code of each digit, then eight shifts.
_CRC32 = """xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [1000 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))]),
  lambda crc, step: CASE WHEN step >= 1000 THEN xor(crc, step - 1000)
                         WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, place, digest, size of the level) of all levels of the trees over ``leaves``."""
    return f"""{name}(tree, level, place, digest, size) AS (
  SELECT tree, 0, place, digest, size FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), any_value(size + 2) // 3
  FROM {name} WHERE size > 1 GROUP BY tree, level, place // 3
)"""


OP11 = f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN ({_CRC32}) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS size
  FROM hashed
), leaves AS (SELECT tree, place, leaf AS digest, size FROM placed
), {_tree("nodes", "leaves")}, subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1
), top_leaves AS (SELECT '' AS tree, place, subroot AS digest, size FROM subroots
), {_tree("top_nodes", "top_leaves")}, steps AS (
  SELECT tree AS tree, level, place, digest, 0 AS part FROM nodes WHERE size > 1
  UNION ALL SELECT '', level, place, digest, 1 FROM top_nodes WHERE size > 1
), siblings AS (
  SELECT n.tree, n.level, n.part, n.place, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < n.place), '') AS before,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > n.place), '') AS behind
  FROM steps n JOIN steps s ON n.tree = s.tree AND n.level = s.level AND n.part = s.part AND n.place // 3 = s.place // 3
  GROUP BY ALL
), depths AS (
  SELECT tree, max(level) AS depth FROM nodes GROUP BY tree
), climb(row_no, tree, top_place, level, place, part, digest, proof, depth) AS (
  SELECT row_no, p.tree, s.place, 0, p.place, 0, changed, '', depth
  FROM placed p JOIN subroots s ON p.tree = s.tree JOIN depths d ON p.tree = d.tree
  UNION ALL
  SELECT row_no, tree, top_place, next_level, next_place, next_part, next_digest, next_proof, depth FROM (
    SELECT c.*, CASE WHEN s.tree IS NULL THEN 0 ELSE c.level + 1 END AS next_level,
           CASE WHEN s.tree IS NULL THEN c.top_place ELSE c.place // 3 END AS next_place,
           CASE WHEN s.tree IS NULL THEN c.part + 1 ELSE c.part END AS next_part,
           CASE WHEN s.tree IS NULL THEN c.digest ELSE sha256(s.before || c.digest || s.behind) END AS next_digest,
           c.proof || coalesce(s.before || s.behind, '') AS next_proof
    FROM climb c LEFT JOIN siblings s
      ON s.part = c.part AND s.level = c.level AND s.place = c.place AND s.tree = CASE WHEN c.part = 0 THEN c.tree ELSE '' END
    WHERE c.part < 2)
)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root,
       c.digest = r.digest AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree JOIN climb c ON p.row_no = c.row_no AND c.part = 2
CROSS JOIN (SELECT digest FROM top_nodes WHERE size = 1) r
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1,
    "op2_quality_repeats": OP2,
    "op6_license_scan": OP6,
    "op8_near_dedup": OP8,
    "op11_merkle_manifest": OP11,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
