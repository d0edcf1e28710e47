"""DuckDB SQL for the queries of this subpackage that SQL can express (the others are tested against brute force)."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS bound
  FROM totals),
prefix AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
    sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM weighted),
level AS (
  SELECT arg_min(rest, bound / weight) AS rest, arg_min(rest_weight, bound / weight) AS rest_weight
  FROM prefix WHERE bound * rest_weight > rest * weight),
targets AS (
  SELECT p.source, p.source_size,
    CASE WHEN p.bound * p.rest_weight <= p.rest * p.weight THEN p.bound ELSE least(p.bound, p.weight * l.rest / l.rest_weight) END AS target
  FROM prefix p CROSS JOIN level l),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), md5(coalesce(s.text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""

LINES = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split),
wide AS (SELECT doc_id, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM numbered WHERE i + 2 <= len(l)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM wide),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
kept AS (
  SELECT n.doc_id, string_agg(n.l[n.i], chr(10) ORDER BY n.i) AS text, count(*) AS n
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT s.doc_id, CAST(coalesce(len(s.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(s.l), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN s.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '<(/turn|/role|turn|image|audio|document)>', '<\\\1>', 'g')"

CHAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
form AS (SELECT *, '<turn>' || """ + _ESCAPED.format("role") + " || '</role>' || " + _ESCAPED.format("text") + r""" || '</turn>' || chr(10) AS formatted FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM form GROUP BY conv_id
"""

#: crc32 by its rule: 256 remainders of the reflected polynomial, then a fold over the digits of the id.
TRIE = """
WITH remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k,
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, length(coalesce(text, '')) AS chars FROM conversations),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: xor(r.t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations) c, remainders r),
drawn AS (
  SELECT c.conv_id, t.k, 0 AS part, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, 1, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
placed AS (SELECT *, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path FROM drawn WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
paths AS (
  SELECT conv_id, depth, md5(path) AS node, chars FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
tops AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN tops t ON p.conv_id = t.conv_id AND p.depth = t.depth GROUP BY p.node),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY node, depth),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM linked n LEFT JOIN kids k ON n.node = k.node),
sums AS (
  SELECT p.node, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON n.node = s.node LEFT JOIN nodes u ON n.parent = u.node LEFT JOIN ends e ON n.node = e.node
"""


def _clustering(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """Every distance of every vector, a pair of CTEs a round."""
    near = """(SELECT vec_id, row, v, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
    SELECT x.vec_id, x.row, x.v, c.number, list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v x, c{0} c) GROUP BY vec_id, row, v)"""
    ctes = [f"""v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1 AS INTEGER) AS number, v AS c FROM v
  ORDER BY sha256(concat('2:', vec_id)), v LIMIT {k})"""]
    for r in range(rounds):
        ctes.append(f"""m{r} AS (
  SELECT number, list(mean ORDER BY i) AS c FROM (
    SELECT a.number, i, CAST((sum(a.v[i]) - ((sum(a.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
    FROM {near.format(r)} a, range(1, {dims + 1}) t(i) GROUP BY a.number, i) GROUP BY number)""")
        ctes.append(f"c{r + 1} AS (SELECT c.number, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON c.number = m.number)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, a.number AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM {near.format(rounds)} a JOIN c{rounds} c ON a.number = c.number
"""


ORACLES = {"op11_prefix_trie": TRIE, "op13_centroid_clustering": _clustering(), "op10_chat_formatting": CHAT, "op7_mtree_topk": TOP_K, "op6_source_mixing": MIXING, "op8_line_dedup": LINES}
