"""Succession between documents: edges in both directions, active successors, warnings."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.operators.hierarchy import Hierarchy
from quillspan.runtime import exists, stage
from quillspan.sources.readers import read_metadata_map

log = logging.getLogger(__name__)


def node_edges(nodes: DataFrame) -> DataFrame:
    """``src, dst, kind`` from ``rfc_number, obsoletes, updates, updated_by``: src obsoletes or updates dst. Declared updated_by counts as well; zero, null and repeated numbers don't."""
    down = lambda c, kind: nodes.select(F.col("rfc_number").alias("src"), F.explode(c).alias("dst"), F.lit(kind).alias("kind"))
    back = nodes.select(F.explode("updated_by").alias("src"), F.col("rfc_number").alias("dst"), F.lit("updates").alias("kind"))
    return down("obsoletes", "obsoletes").unionByName(down("updates", "updates")).unionByName(back).where("src > 0 and dst > 0").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    """``rfc_number, obsoleted_by, updated_by`` of every node that an edge leads to, as sorted arrays."""
    side = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("src"))))
    return edges.groupBy(F.col("dst").alias("rfc_number")).agg(side("obsoletes").alias("obsoleted_by"), side("updates").alias("updated_by"))


def active_successors(edges: DataFrame) -> DataFrame:
    """``rfc_number, active``: what obsoleted documents lead to, each node that nothing obsoletes. A document that nothing obsoletes leads to itself; one that only leads into a cycle isn't listed."""
    links = edges.where("kind = 'obsoletes'").select("kind", F.col("dst").alias("child"), F.col("src").alias("parent"))
    h = Hierarchy(links)
    up = h.roots().select(F.col("node").cast("int").alias("rfc_number"), F.col("root").cast("int").alias("active"))
    every = edges.select(F.col("src").alias("rfc_number")).unionByName(edges.select(F.col("dst").alias("rfc_number"))).distinct()
    own = every.join(links.select(F.col("child").alias("rfc_number")).distinct(), "rfc_number", "left_anti")
    return up.unionByName(own.select("rfc_number", F.col("rfc_number").alias("active")))


def numbers(c: Column) -> Column:
    """'RFC 1, RFC 2' of a sorted array of numbers."""
    return F.array_join(F.transform(F.array_sort(c), lambda n: F.concat(F.lit("RFC "), n.cast("string"))), ", ")


def warnings(edges: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``rfc_number, is_obsolete, is_updated, warning``: one row per document that is obsolete or updated. Being obsolete takes precedence; active successors are named where they differ from the direct ones."""
    rev = reverse_edges(edges)
    act = (active if active is not None else active_successors(edges)).groupBy("rfc_number").agg(F.array_sort(F.collect_set("active")).alias("active"))
    j = rev.join(act, "rfc_number", "left")
    n = F.col("rfc_number").cast("string")
    obsolete, updated = F.size("obsoleted_by") > 0, F.size("updated_by") > 0
    more = F.when(F.col("active").isNotNull() & (F.col("active") != F.col("obsoleted_by")),
        F.concat(F.lit(" The current active standard(s) resolving this lineage are "), numbers(F.col("active")), F.lit("."))).otherwise("")
    # The wording of both notes.
    gone = F.concat(F.lit("[TEMPORAL WARNING: This chunk is from RFC "), n, F.lit(", which is OBSOLETE. It was superseded by "),
        numbers(F.col("obsoleted_by")), F.lit("."), more, F.lit(" Evaluate this text with historical caution.]"))
    changed = F.concat(F.lit("[TEMPORAL NOTICE: This chunk is from RFC "), n, F.lit(", which is active but has been UPDATED by "),
        numbers(F.col("updated_by")), F.lit(". Please consider these later modifications.]"))
    return j.select("rfc_number", obsolete.alias("is_obsolete"), updated.alias("is_updated"), F.when(obsolete, gone)
        .when(updated, changed).alias("warning")).where("warning is not null")


class LineageGraph:
    """Succession of a metadata file, loaded at first use. A missing file disables it: nothing is found, nothing fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._edges = self._nodes = None

    def reload(self) -> None:
        """Forgets what was read; the next question reads the file again."""
        self._edges = self._nodes = None

    @property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            if exists(self.spark, self.path):
                self._nodes = read_metadata_map(self.spark, self.path)
            else:
                log.warning("no metadata at %s", self.path)
                self._nodes = self.spark.createDataFrame([], S.INDEX_ENTRY)
        return self._nodes

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = stage(node_edges(self.nodes), "lineage")
        return self._edges

    def lookup(self, numbers: DataFrame) -> DataFrame:
        """``rfc_number, title, status, obsoletes, updates, obsoleted_by, updated_by`` of ``numbers(rfc_number)``, with both directions of every relation; unknown numbers give no row."""
        rev = reverse_edges(self.edges)
        empty = F.array().cast("array<int>")
        known = self.nodes.select("rfc_number", "title", "status", "obsoletes", "updates")
        j = numbers.select("rfc_number").distinct().join(known.join(rev, "rfc_number", "full"), "rfc_number")
        return j.select(
            "rfc_number", F.coalesce("title", F.concat(F.lit("RFC "), F.col("rfc_number"))).alias("title"),
                F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
            *[F.coalesce(c, empty).alias(c) for c in ("obsoletes", "updates", "obsoleted_by", "updated_by")],
        )
