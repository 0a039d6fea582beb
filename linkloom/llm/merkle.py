"""Merkle manifest of a data set: per group a binary hash tree over its rows, and one over the groups.

A level of an aligned block of 256 nodes is kept as one hex string. Parents hash fixed-width substrings
of two digests of it; the last parent may have one digest only. A node's sibling is the flanking
substring, so the siblings of a node within its block are one substring per level. The tops of blocks
are the nodes of the next layer (``tree``) until one is left: the group's subroot. The subroots, by group,
are the nodes of one more tree, whose top is the root.

Leaves take their places by a range sort over all partitions, so a group of any size is never gathered
in one task; blocks have 256 nodes whatever the input.

A leaf hashes its columns, each ``-`` if null, else its byte count, ``:`` and its value; null ids come
first, a null group is a group of its own before all others, empty values differ from nulls. Rows with
the same id stand by leaf digest; equal rows are interchangeable leaves, each kept. A row without
siblings up to the root (a table of one row) has the hash of nothing as its proof. An empty table gives
no rows. Columns other than those of the leaf are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import in_order, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 8
BLOCK = 1 << BLOCK_LEVELS
DIGEST = 64  # hex digits


def digest(columns: list[Column]) -> Column:
    """The leaf of a row: sha256 in hex over its columns' values."""
    texts = [c.cast("string") for c in columns]
    marked = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(m, F.lit("-")) for m in marked)), 256)


def leaves(docs: DataFrame, columns: tuple = COLUMNS, group: str = "lang", order: str = "doc_id", changes: dict | None = None) -> DataFrame:
    """``_g, _pos, _n, _row``: each row's group, place in it, the group's size, and its digests and id, written.

    ``_row.changed`` is the leaf with the columns of ``changes`` in place of the stored ones.
    """
    changes = changes or {}
    name = F.col(group).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("_g"),  # sorts like the group, null first
        F.col(order).alias("_id"),
        digest([F.col(c) for c in columns]).alias("node"),
        digest([changes.get(c, F.col(c)) for c in columns]).alias("changed"),
    )
    placed = in_order(written(rows, "merkle-leaves"), ["_g", "_id", "node"], "merkle-sorted")
    # One row per partition and group in it: the group's first row there, its rows before and its size.
    parts = placed.groupBy("_part", "_g").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    before = "sum(_rows) OVER (PARTITION BY _g ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = parts.select(
        "_part",
        "_g",
        (F.coalesce(F.expr(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.expr("sum(_rows) OVER (PARTITION BY _g)").alias("_n"),
    )
    parts = written(parts, "merkle-parts")
    return placed.join(parts, ["_part", "_g"]).select(
        "_g", (F.col("_row") + F.col("_shift")).alias("_pos"), "_n", F.struct("node", "_id", "changed").alias("_row")
    )


# A level as the bytes of its hex digits, so that a substring is a plain slice.
_PARENTS = f"""cast(array_join(transform(sequence(0, (octet_length(s) - 1) div {2 * DIGEST}),
  i -> sha2(substring(s, i * {2 * DIGEST} + 1, {2 * DIGEST}), 256)), '') as binary)"""
_LEVELS = f"""aggregate(filter(sequence(0, _height), i -> i > 0),
  cast(array(cast(array_join(transform(_rows, r -> r._row.node), '') as binary)) as array<binary>),
  (a, i) -> array_append(a, transform(array(element_at(a, -1)), s -> {_PARENTS})[0]))"""
# The siblings of the o-th node of a block, from its own level up; each marked by its side, '' where there is none.
_SIBLINGS = f"""transform(filter(sequence(1, _height + 1), l -> l <= _height), l -> transform(array(struct(
    cast(substring(_levels[l - 1], {DIGEST} * (shiftright(o, l - 1) ^ 1) + 1, {DIGEST}) as string) AS d,
    CASE WHEN shiftright(o, l - 1) & 1 = 1 THEN 'l' ELSE 'r' END AS side)),
  x -> CASE WHEN x.d = '' THEN '' ELSE concat(x.side, x.d) END)[0])"""
_FOLD = """aggregate({siblings}, {leaf}, (h, s) -> CASE WHEN s = '' THEN sha2(h, 256)
  WHEN startswith(s, 'l') THEN sha2(concat(substr(s, 2), h), 256) ELSE sha2(concat(h, substr(s, 2)), 256) END)"""


def _blocks(nodes: DataFrame) -> DataFrame:
    """``_g, _block, _n, _height, _rows, _levels`` of ``nodes(_g, _pos, _n, _row)``, whose ``_row`` has ``node``."""
    keyed = nodes.withColumn("_block", F.shiftright("_pos", BLOCK_LEVELS))
    rows = keyed.groupBy("_g", "_block").agg(
        F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_pos", "_row"))).alias("_rows")
    )
    # The levels above the block's own: all of them, or as many as leave the whole group one node.
    height = F.least(F.lit(BLOCK_LEVELS), F.when(F.col("_n") > 1, F.length(F.bin(F.col("_n") - 1))).otherwise(0))
    return rows.withColumn("_height", height).withColumn("_levels", F.expr(_LEVELS))


def tree(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The written layers of blocks, and ``_g, node, _last``: each group's top and the layer it came from."""
    layers, tops = [], None
    while True:
        layers.append(written(_blocks(nodes), f"merkle-{label}"))
        top = layers[-1].select(
            "_g",
            F.col("_block").alias("_pos"),
            F.ceil(F.col("_n") / BLOCK).alias("_n"),
            F.element_at("_levels", -1).cast("string").alias("node"),
        )
        done = top.where("_n = 1").select("_g", "node", F.lit(len(layers)).alias("_last"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = top.where("_n > 1").select("_g", "_pos", "_n", F.struct("node").alias("_row"))
        if nodes.isEmpty():
            return layers, tops


def paths(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``_row, _siblings, _top`` of each node of the first layer: its siblings up to and through ``above``.

    ``above(_g, _last, _siblings, _top)`` has the siblings of each group's own top.
    """
    out = None
    for k in range(len(layers), 0, -1):
        up = above.where(F.col("_last") == k).select("_g", F.lit(0).cast("long").alias("_block"), "_siblings", "_top")
        if out is not None:
            up = up.unionByName(out.select("_g", F.col("_pos").alias("_block"), "_siblings", "_top"))
        own = F.expr(f"transform(_rows, (r, o) -> struct(r._pos AS _pos, r._row AS _row, {_SIBLINGS} AS _own))")
        rows = layers[k - 1].join(up, ["_g", "_block"]).select("_g", "_siblings", "_top", F.inline(own))
        out = rows.select("_g", "_pos", "_row", F.concat("_own", "_siblings").alias("_siblings"), "_top")
    return out


def proofs(docs: DataFrame, changes: dict | None = None) -> DataFrame:
    """``doc_id, leaf, changed, subroot, root, siblings`` per row.

    ``siblings`` has one entry per level up to the root: ``l`` or ``r`` for the side it stands on and its
    digest, or ``''`` where the node is hashed alone. ``changes`` as in ``leaves``.
    """
    spark = docs.sparkSession
    layers, subroots = tree(leaves(docs, changes=changes), "rows")
    ranked = in_order(subroots, ["_g"], "merkle-subroots", 1)  # one row per group
    groups = ranked.select(
        F.lit("").alias("_g"), F.col("_row").alias("_pos"), F.lit(ranked.count()).cast("long").alias("_n"),
        F.struct("node", F.col("_g").alias("group"), "_last").alias("_row"),
    )
    upper, top = tree(groups, "groups")
    found = top.first()
    root = found.node if found else None
    none = F.expr("cast(array() as array<string>)")
    start = spark.range(1).select(F.lit("").alias("_g"), F.lit(len(upper)).alias("_last"), none.alias("_siblings"), F.lit(root).alias("_top"))
    of_groups = paths(upper, start).select(
        F.col("_row.group").alias("_g"), F.col("_row._last").alias("_last"), "_siblings", F.col("_row.node").alias("_top")
    )
    return paths(layers, written(of_groups, "merkle-paths")).select(
        F.col("_row._id").alias("doc_id"),
        F.col("_row.node").alias("leaf"),
        F.col("_row.changed").alias("changed"),
        F.col("_top").alias("subroot"),
        F.lit(root).alias("root"),
        F.col("_siblings").alias("siblings"),
    )


def folded(leaf: str, siblings: str = "siblings") -> Column:
    """The root that a leaf and its siblings give."""
    return F.expr(_FOLD.format(leaf=leaf, siblings=siblings))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest's proofs, tried on rows of which some are tampered with.

    Where 7 divides the checksum of the id, ``n_chars`` counts one more (a null stays, so the row still
    verifies; a null id is never tampered with).
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    rows = proofs(docs, {"n_chars": F.when(hit, more).otherwise(F.col("n_chars").cast("string"))})
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("siblings", lambda s: F.substr(s, F.lit(2))), ""), 256).alias("proof_sha256"),
        folded("changed").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The query's result as SQL, level by level over all nodes."""
    marked = ", ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS
    )
    changed = marked.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + CAST(hit AS INT) AS VARCHAR)")
    # The checksum byte by byte, each byte's division by the polynomial bit by bit.
    step = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {step}), 4294967295)"
    return f"""
WITH RECURSIVE tried AS (SELECT *, coalesce({crc} % 7 = 0, false) AS hit FROM documents),
hashed AS (SELECT doc_id, lang, sha256(concat({marked})) AS leaf, sha256(concat({changed})) AS changed FROM tried),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '-') AS g FROM hashed),
nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2),
subroots AS (SELECT g, h, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT h, level AS height FROM uppers WHERE n = 1),
steps AS (
  SELECT l.g, l.pos, l.leaf, k.level, (l.pos >> k.level) & 1 AS odd, s.h AS sibling
  FROM leaves l JOIN subroots r ON r.g = l.g JOIN (SELECT CAST(range AS INT) AS level FROM range(64)) k ON k.level < r.height
  LEFT JOIN nodes s ON s.g = l.g AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1)
  UNION ALL
  SELECT l.g, l.pos, l.leaf, r.height + k.level, (r.pos >> k.level) & 1, s.h
  FROM leaves l JOIN subroots r ON r.g = l.g JOIN (SELECT CAST(range AS INT) AS level FROM range(64)) k ON k.level < (SELECT height FROM root)
  LEFT JOIN uppers s ON s.level = k.level AND s.pos = xor(r.pos >> k.level, 1)),
proofs AS (SELECT g, pos, sha256(string_agg(sibling, '' ORDER BY level)) AS proof FROM steps WHERE sibling IS NOT NULL GROUP BY g, pos),
folds AS (
  SELECT g, pos, 0 AS level, changed AS h FROM leaves
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.odd = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
  FROM folds f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.level = f.level)
SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM root) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = (SELECT h FROM root) AS verified
FROM leaves l JOIN subroots r ON r.g = l.g LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
JOIN folds f ON f.g = l.g AND f.pos = l.pos AND f.level = r.height + (SELECT height FROM root)"""
