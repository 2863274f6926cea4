"""Queries over the succession of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.hierarchy import Hierarchy
from quillspan.runtime import load


def valid_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entry of greatest ``entry_ord`` of each document."""
    return load(spark, d, "rfc_index").where(F.col("rfc_number")
        .isNotNull()).groupBy("rfc_number").agg(F.max_by(F.struct("obsoletes", "updated_by"), F.coalesce("entry_ord", F.lit(-1)))
            .alias("e")).select("rfc_number", "e.*")


def succession(spark: SparkSession, d: str) -> DataFrame:
    """``kind, child, parent``: direct successors by 'obsoletes' and by 'updates'."""
    v = valid_entries(spark, d)
    a = v.select(F.lit("obsoletes").alias("kind"), F.explode("obsoletes").alias("child"), F.col("rfc_number").alias("parent"))
    b = load(spark, d, "lineage_nodes").select(F.lit("obsoletes").alias("kind"), F.col("rfc_number").alias("child"), F.explode("obsoleted_by").alias("parent"))
    c = v.select(F.lit("updates").alias("kind"), F.col("rfc_number").alias("child"), F.explode("updated_by").alias("parent"))
    return a.unionByName(b).unionByName(c).where("child > 0 and parent > 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = Hierarchy(succession(spark, d))
    h.forest  # noqa: B018  with sizes at once, since cycles want ranges
    rows = h.roots().select("kind", "node", "root", "depth").unionByName(h.cycles.select("kind", "node", F.col("cycle")
        .alias("root"), F.lit(-1).cast("long").alias("depth")))
    return rows.select("kind", F.col("node").cast("int").alias("rfc_number"), F.col("root").cast("int").alias("root_number"),
        F.col("depth").cast("int").alias("depth"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All documents that each document has replaced or updated, over any of several successors and over cycles."""
    out = Hierarchy(succession(spark, d)).descendants()
    return out.select("kind", F.col("node").cast("int").alias("rfc_number"), F.col("descendant").cast("int")
        .alias("descendant_number"), F.col("depth").cast("int").alias("depth"))


def p2_tree(spark: SparkSession, d: str) -> DataFrame:
    """The forest: path, depth and nested-set range of each document. ``n_descendants`` counts over all links, so it can exceed what the range holds."""
    h = Hierarchy(succession(spark, d))
    below = h.descendants().groupBy("kind", "node").agg(F.count(F.lit(1)).alias("below"))
    out = h.forest.join(h.paths(), ["kind", "node"]).join(h.cycles, ["kind", "node"], "left").join(below, ["kind", "node"], "left")
    return out.select(
        "kind", F.col("node").cast("int").alias("rfc_number"), F.col("top").cast("int").alias("top_number"), F.col("depth")
            .cast("int").alias("depth"), F.coalesce("below", F.lit(0)).cast("long").alias("n_descendants"),
        F.col("pre").cast("long").alias("range_start"), (F.col("pre") + F.col("size") - 1).cast("long").alias("range_end"),
            F.array_join(F.col("path").cast("array<string>"), " > ").alias("path"), F.col("cycle").cast("int").alias("cycle"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_tree)}

_EDGES = """
valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rfc_number ORDER BY entry_ord DESC) AS rn FROM rfc_index) WHERE rn = 1),
edge AS (
  SELECT DISTINCT kind, child, parent FROM (
    SELECT 'obsoletes' AS kind, unnest(obsoletes) AS child, rfc_number AS parent FROM valid
    UNION ALL SELECT 'obsoletes', rfc_number, unnest(obsoleted_by) FROM lineage_nodes
    UNION ALL SELECT 'updates', rfc_number, unnest(updated_by) FROM valid)
  WHERE child > 0 AND parent > 0)"""

ORACLE = {
    "p2_descendants": f"""
WITH RECURSIVE {_EDGES},
reach(kind, node, up, depth) AS (
  SELECT kind, child, parent, 1 FROM edge
  UNION
  SELECT r.kind, r.node, e.parent, r.depth + 1 FROM reach r JOIN edge e ON e.kind = r.kind AND e.child = r.up WHERE r.depth < (SELECT count(*) FROM edge))
SELECT kind, up AS rfc_number, node AS descendant_number, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY ALL""",
    "p2_found": f"""
WITH RECURSIVE {_EDGES},
reach(kind, node, up, depth) AS (
  SELECT kind, child, parent, 1 FROM edge
  UNION
  SELECT r.kind, r.node, e.parent, r.depth + 1 FROM reach r JOIN edge e ON e.kind = r.kind AND e.child = r.up WHERE r.depth < (SELECT count(*) FROM edge)),
near AS (SELECT kind, node, up, min(depth) AS depth FROM reach GROUP BY ALL)
SELECT n.kind, n.node AS rfc_number, n.up AS root_number, CAST(n.depth AS INTEGER) AS depth FROM near n
WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.kind = n.kind AND e.child = n.up)
UNION ALL
SELECT a.kind, a.node, min(b.up), -1 FROM near a JOIN near b ON b.kind = a.kind AND b.node = a.node
JOIN near c ON c.kind = a.kind AND c.node = b.up AND c.up = a.node WHERE a.up = a.node GROUP BY a.kind, a.node""",
    "p2_tree": f"""
WITH RECURSIVE {_EDGES},
reach(kind, node, up, depth) AS (
  SELECT kind, child, parent, 1 FROM edge
  UNION
  SELECT r.kind, r.node, e.parent, r.depth + 1 FROM reach r JOIN edge e ON e.kind = r.kind AND e.child = r.up WHERE r.depth < (SELECT count(*) FROM edge)),
near AS (SELECT kind, node, up, min(depth) AS depth FROM reach GROUP BY ALL),
below AS (SELECT kind, up AS node, count(*) AS n FROM near GROUP BY ALL),
loops AS (
  SELECT a.kind, a.node, min(b.up) AS cycle FROM near a JOIN near b ON b.kind = a.kind AND b.node = a.node
  JOIN near c ON c.kind = a.kind AND c.node = b.up AND c.up = a.node WHERE a.up = a.node GROUP BY a.kind, a.node),
least AS (SELECT kind, child AS node, min(parent) AS parent FROM edge GROUP BY ALL),
chase(kind, node, cur, depth) AS (
  SELECT kind, node, parent, 1 FROM least
  UNION
  SELECT c.kind, c.node, l.parent, c.depth + 1 FROM chase c JOIN least l ON l.kind = c.kind AND l.node = c.cur WHERE c.depth < (SELECT count(*) FROM edge)),
tied AS (SELECT DISTINCT kind, node FROM chase WHERE node = cur),
hung AS (SELECT * FROM least ANTI JOIN tied USING (kind, node)),
nodes AS (SELECT kind, child AS node FROM edge UNION SELECT kind, parent FROM edge),
walk(kind, node, cur, path) AS (
  SELECT kind, node, node, CAST([] AS BIGINT[]) FROM nodes
  UNION ALL
  SELECT w.kind, w.node, h.parent, list_append(path, h.parent) FROM walk w JOIN hung h ON h.kind = w.kind AND h.node = w.cur),
tree AS (
  SELECT kind, node, cur AS top, path, list_append(list_reverse(path), node) AS way FROM walk w
  WHERE NOT EXISTS (SELECT 1 FROM hung h WHERE h.kind = w.kind AND h.node = w.cur)),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind, top ORDER BY way) - 1 AS pre FROM tree),
sized AS (SELECT a.kind, a.node, count(*) AS size FROM tree a JOIN tree b ON b.kind = a.kind AND b.top = a.top AND b.way[1:len(a.way)] = a.way GROUP BY ALL)
SELECT kind, CAST(node AS INTEGER) AS rfc_number, CAST(top AS INTEGER) AS top_number, CAST(len(path) AS INTEGER) AS depth, coalesce(n, 0) AS n_descendants, pre AS range_start, pre + size - 1 AS range_end,
  array_to_string(path, ' > ') AS path, CAST(cycle AS INTEGER) AS cycle
FROM placed JOIN sized USING (kind, node) LEFT JOIN below USING (kind, node) LEFT JOIN loops USING (kind, node)""",
}
