"""SQL twins, in DuckDB's dialect, of the manifest and the prefix trie."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    byte = f"lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(name: str, levels: int) -> tuple[list[str], str, str]:
    """(CTEs of a tree's levels and siblings, its tops, the joins of a leaf ``x`` to its siblings)."""
    ctes, joins = [], []
    for k in range(1, levels + 1):
        own = "PARTITION BY tree, rank // 16 ORDER BY rank ROWS BETWEEN"
        ctes.append(f"""
{name}{k} AS (
  SELECT tree, n, rank // 16 AS rank, sha256(string_agg(d, '' ORDER BY rank)) AS d
  FROM {name}{k - 1} WHERE n > {16 ** (k - 1)} GROUP BY tree, n, rank // 16),
{name}_beside{k} AS (
  SELECT tree, rank,
         coalesce(string_agg(d, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k - 1} WHERE n > {16 ** (k - 1)})""")
        joins.append(
            f"LEFT JOIN {name}_beside{k} {name}_b{k} ON {name}_b{k}.tree = x.{name}_tree AND {name}_b{k}.rank = x.{name}_rank // {16 ** (k - 1)}"
        )
    tops = " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n <= {16**k}" for k in range(levels + 1))
    return ctes, tops, "\n".join(joins)


def _manifest() -> str:
    """Trees of up to 16^5 rows a source and up to 16^3 sources."""
    in_source, of_sources = 5, 3
    own, own_tops, own_joins = _levels("t", in_source)
    top, top_tops, top_joins = _levels("s", of_sources)
    names = [f"t_b{k}" for k in range(1, in_source + 1)] + [f"s_b{k}" for k in range(1, of_sources + 1)]
    steps, previous = [], "altered"
    for k, b in enumerate(names):
        steps.append(f"CASE WHEN {b}.l IS NULL THEN {previous} ELSE sha256({b}.l || {previous} || {b}.r) END AS f{k}")
        previous = f"f{k}"
    beside = " || ".join(f"coalesce({b}.l || {b}.r, '')" for b in names)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{upper}', '{lower}')")} AS low,
         {crc32_sql("doc_id::VARCHAR")} AS crc
  FROM documents),
placed AS (
  SELECT *, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS altered,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM hashed),
t0 AS (SELECT tree, n, rank, leaf AS d FROM placed),{",".join(own)},
subroots AS ({own_tops}),
s0 AS (SELECT 0 AS tree, count(*) OVER () AS n, tree AS rank, d FROM subroots),{",".join(top)},
roots AS ({top_tops}),
x AS (SELECT *, tree AS t_tree, rank AS t_rank, 0 AS s_tree, tree AS s_rank FROM placed),
folds AS (
  SELECT doc_id, leaf, u.d AS subroot, z.d AS root, sha256({beside}) AS proof_sha256, {", ".join(steps)}
  FROM x JOIN subroots u ON u.tree = x.tree CROSS JOIN roots z
  {own_joins}
  {top_joins})
SELECT doc_id, leaf, subroot, root, proof_sha256, {previous} AS folded_root, {previous} = root AS verified FROM folds"""


MANIFEST = _manifest()

TRIE = f"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
         strlen(coalesce(text, '')) AS size, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS place FROM t),
n AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM n),
r AS (
  SELECT c.conv_id, place, mark, size FROM c JOIN own ON own.conv_id = base AND place < h
  UNION ALL
  SELECT c.conv_id, place - h + least(h, coalesce(n.n, 0)), mark, size
  FROM c JOIN own ON own.conv_id = c.conv_id AND place >= h LEFT JOIN n ON n.conv_id = base),
p AS (
  SELECT conv_id, place + 1 AS depth, size,
         sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS node
  FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
nodes AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size FROM p GROUP BY node),
under AS (
  SELECT DISTINCT a.node AS top, b.node, b.depth - a.depth AS steps FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
kids AS (SELECT top AS node, count(*) AS n FROM under WHERE steps = 1 GROUP BY top),
sums AS (
  SELECT top AS node, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((m.n - 1) * m.size) AS saved
  FROM under JOIN nodes m ON m.node = under.node LEFT JOIN kids ON kids.node = m.node GROUP BY top),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ids
  FROM p WHERE (conv_id, depth) IN (SELECT conv_id, max(depth) FROM p GROUP BY conv_id) GROUP BY node)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.ids, sha256('')) AS ends_sha256
FROM nodes m JOIN sums ON sums.node = m.node LEFT JOIN kids ON kids.node = m.node LEFT JOIN ends ON ends.node = m.node
LEFT JOIN under u ON u.node = m.node AND u.steps = 1 LEFT JOIN nodes up ON up.node = u.top"""
