"""DuckDB twins of the queries that SQL can express."""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (
  SELECT body, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY body
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN m.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.body = m.body AND p.n >= 1000
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS said
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (
  SELECT s.doc_id, s.i, s.n, win.item_id
  FROM starts s JOIN win ON win.n = s.n AND win.said = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')
),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS said
  FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
),
low AS (SELECT said, min(doc_id) AS low FROM s GROUP BY said),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM s JOIN low USING (said) WHERE doc_id > low
),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n, "text"))) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""
#: The next level of a list of nodes, and what stands beside a slot in a level.
PAIRS = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
BESIDE = "coalesce(CASE WHEN (slot >> level) & 1 = 1 THEN 'L' ELSE 'R' END || nodes[xor(slot >> level, CAST(1 AS BIGINT)) + 1], 'A')"

MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('+' || lang, '') AS grp, {_leaf("n_chars")} AS leaf,
         CASE WHEN {CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS start FROM documents
), p AS (
  SELECT doc_id, grp, leaf, start, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM d
), own AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY slot) AS nodes FROM p GROUP BY grp
  UNION ALL SELECT grp, level + 1, {PAIRS} FROM own WHERE len(nodes) > 1
), sub AS (
  SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS slot FROM own WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY slot) AS nodes FROM sub
  UNION ALL SELECT level + 1, {PAIRS} FROM tops WHERE len(nodes) > 1
), over_ AS (
  SELECT grp, list({BESIDE} ORDER BY level) FILTER (len(nodes) > 1) AS rest FROM sub, tops GROUP BY grp
), path AS (
  SELECT grp, slot, list({BESIDE} ORDER BY level) FILTER (len(nodes) > 1) AS path FROM p JOIN own USING (grp) GROUP BY grp, slot
), found AS (
  SELECT doc_id, leaf, start, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(path, []), coalesce(rest, [])) AS path
  FROM p JOIN path USING (grp, slot) JOIN over_ USING (grp) JOIN (SELECT grp, subroot FROM sub) USING (grp)
), folded AS (
  SELECT doc_id, leaf, subroot, root, array_to_string(list_transform(list_filter(path, lambda x: x <> 'A'), lambda x: x[2:]), '') AS siblings,
         list_reduce(list_prepend(start, path),
           lambda x, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || x) WHEN 'R' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS folded_root
  FROM found
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

SQL = {
    "op3_warc": WARC,
    "op4_decontamination": DECONTAMINATION,
    "op10_substring_dedup": SUBSTRING,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_merkle_manifest": MANIFEST,
}
