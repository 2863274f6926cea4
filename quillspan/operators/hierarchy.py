"""Parent-child links to full hierarchies: nested-set ranges over a spanning forest, links beside it, and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ranking import WINDOW_ROWS, hot_groups, spread_positions
from quillspan.runtime import maybe_broadcast, small_enough, stage, stage_counted, unstage

_KEY = ["kind", "node"]
#: Doublings that are planned together before their result is written; each reads its input twice, so more would multiply the plan.
CHAIN = 2


def _swap(old: DataFrame | None, new: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    out, seen = stage_counted(new, label, **counts)
    if old is not None:
        unstage(old)
    return out, seen


def pointer_cycles(pointers: DataFrame) -> DataFrame:
    """``kind, node`` of the nodes on cycles of ``kind, node, parent`` with one parent per node, by pointer doubling.

    A round doubles the distance that every node looks up. Nodes that look past a top drop out; when nobody drops out any
    more, only cycles and what hangs below them is left, and when the least nodes seen no longer change and the ancestors
    no longer become fewer, they are the cycles.
    """
    marks = {"n": F.count(F.lit(1)), "ends": F.count_distinct("kind", "jump"), "lows": F.sum(F.col("low").cast("decimal(38,0)"))}
    now = pointers.select(*_KEY, F.col("parent").alias("jump"), F.col("node").alias("low"))
    old = mark = None
    while True:
        new = now
        for _ in range(CHAIN):
            up = new.select("kind", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"))
            new = new.join(up, ["kind", "jump"]).select(*_KEY, F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"))
        now, seen = _swap(old, new, "pointers", n=marks["n"])
        old = now
        if not seen["n"]:
            return now.select("kind", F.col("jump").alias("node"))
        seen = now.agg(*[c.alias(k) for k, c in marks.items()]).first()
        if seen == mark:
            return now.select("kind", F.col("jump").alias("node")).distinct()
        mark = seen


def closure(hops: DataFrame) -> DataFrame:
    """``kind, node, to, cost``: the least cost from each node to each node that it reaches, over ``hops`` of the same columns.

    Min-plus squaring: a round doubles the hops of the ways at hand, so rounds grow with the logarithm of the longest
    shortest way. Rows are the pairs that reach each other.
    """
    marks = {"n": F.count(F.lit(1)), "s": F.coalesce(F.sum("cost"), F.lit(0))}
    least = lambda d: d.groupBy("kind", "node", "to").agg(F.min("cost").alias("cost"))
    now, mark = _swap(None, least(hops), "closure", **marks)
    while mark["n"]:
        new = now
        for _ in range(CHAIN):
            on = new.select("kind", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("cost").alias("_cost"))
            more = new.join(on, ["kind", "to"]).select("kind", "node", F.col("_to").alias("to"), (F.col("cost") + F.col("_cost")).alias("cost"))
            new = least(new.unionByName(more))
        now, seen = _swap(now, new, "closure", **marks)
        if seen == mark:
            break
        mark = seen
    return now


class Hierarchy:
    """Ancestors and descendants of nodes under links ``kind, child, parent``; each kind is a hierarchy of its own.

    Null ends are dropped and repeated links count once. Every node hangs on the least of its parents, unless it would
    hang on itself that way; these links form a forest. Over the forest, subtree sizes are summed upward and sibling
    ranges are allocated downward by prefix sums, both by doubling, so the number of rounds grows with the logarithm of
    the depth. Links beside the forest are followed between the nodes that have them, by squaring the ways between those;
    the nodes of the forest in between are told by their ranges. ``roots``, ``cycles`` and ``descendants`` follow all
    links; ``size``, ranges and ``paths`` are those of the forest.
    """

    def __init__(self, links: DataFrame, window_rows: int = WINDOW_ROWS):
        ends = [F.col(c).cast("long").alias(c) for c in ("child", "parent")]
        clean = links.select("kind", *ends).where("kind is not null and child is not null and parent is not null").distinct()
        self.edges = stage(clean, "links")
        self.window_rows = window_rows
        self._base = self._up = self._forest = self._arcs = self._hops = self._cycles = None

    def _doubled(self, start: DataFrame, more: dict[str, object], counted: bool = False) -> DataFrame:
        """Pointer doubling over ``kind, node, jump, dist, top`` plus columns ``more``, each combined by its function of (own, next).

        With ``counted``, ``size`` collects the nodes below each node. Many nodes may look at one; their rows are split by
        adaptive execution, and sizes are combined before they are shuffled.
        """
        live = F.count_if(F.col("jump").isNotNull())
        now, old, seen = start, None, {"live": 1}
        while seen["live"]:
            new = now
            for _ in range(1 if counted else CHAIN):
                new = self._doubled_once(new, more, counted)
            now, seen = _swap(old, new, "double", live=live)
            old = now
        return now

    @staticmethod
    def _doubled_once(now: DataFrame, more: dict[str, object], counted: bool) -> DataFrame:
        names = {c: f"_{c}" for c in ("jump", "dist", "top", *more)}
        nxt = now.select("kind", F.col("node").alias("_at"), *[F.col(c).alias(n) for c, n in names.items()])
        if counted:
            sent = now.where("jump is not null").groupBy("kind", F.col("jump").alias("node")).agg(F.sum("size").alias("_sent"))
            now = now.join(sent, _KEY, "left").withColumn("size", F.col("size") + F.coalesce("_sent", F.lit(0))).drop("_sent")
        met = now.withColumnRenamed("kind", "_kind").join(nxt, (F.col("_kind") == F.col("kind")) & (F.col("jump") == F.col("_at")), "left")
        open_ = F.col("jump").isNotNull()
        pick = lambda new, old: F.when(open_, new).otherwise(F.col(old)).alias(old)
        return met.select(
            F.col("_kind").alias("kind"), "node", F.col("_jump").alias("jump"), pick(F.col("dist") + F.col("_dist"), "dist"), pick(F.col("_top"), "top"),
            *(["size"] if counted else []), *[pick(f(F.col(c), F.col(f"_{c}")), c) for c, f in more.items()],
        )

    @property
    def base(self) -> DataFrame:
        """``kind, node, parent, ups, has_links``: every node with its link of the forest, its number of parents, and whether it has links beside the forest."""
        if self._base is None:
            e = self.edges
            nodes = e.select("kind", F.col("child").alias("node")).unionByName(e.select("kind", F.col("parent").alias("node"))).distinct()
            least = stage(e.groupBy("kind", F.col("child").alias("node")).agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("ups")), "least")
            loops = pointer_cycles(least).withColumn("_loop", F.lit(True))
            b = nodes.join(least, _KEY, "left").join(loops, _KEY, "left").withColumn("parent", F.when(F.col("_loop").isNull(), F.col("parent")))
            ups = F.coalesce("ups", F.lit(0))
            self._base = stage(b.select(*_KEY, "parent", ups.alias("ups"), (ups > F.col("parent").isNotNull().cast("int")).alias("has_links")), "base")
        return self._base

    def _start(self, *more: Column) -> DataFrame:
        held = F.col("parent").isNotNull().cast("long")
        return self.base.select(*_KEY, F.col("parent").alias("jump"), held.alias("dist"), F.when(F.col("parent").isNull(), F.col("node")).alias("top"), *more)

    def up(self, counted: bool = False) -> DataFrame:
        """``kind, node, parent, ups, has_links, top, depth, is_root, near, near_dist``, with ``counted`` also ``size``.

        ``is_root`` says whether a node's top has no parent at all; ``near`` is the closest node upward, itself included,
        with links beside the forest.
        """
        if self._up is None or counted and "size" not in self._up.columns:
            here = F.when(F.col("has_links"), F.struct(F.col("node").alias("at"), F.lit(0).cast("long").alias("far")))
            pack = F.struct(F.col("parent").isNotNull().cast("long").alias("step"), here.alias("near"))

            def join(a: Column, b: Column) -> Column:
                further = F.struct(b["near"]["at"].alias("at"), (b["near"]["far"] + a["step"]).alias("far"))
                return F.struct((a["step"] + b["step"]).alias("step"), F.coalesce(a["near"], F.when(b["near"].isNotNull(), further)).alias("near"))

            size = [F.lit(1).cast("long").alias("size")] if counted else []
            done = self._doubled(self._start(*size, pack.alias("both")), {"both": join}, counted)
            out = self.base.join(done.select(*_KEY, "top", F.col("dist").alias("depth"), *(["size"] if counted else []), "both.near"), _KEY)
            tops = self.base.where("parent is null").select("kind", F.col("node").alias("top"), (F.col("ups") == 0).alias("is_root"))
            out = out.join(tops, ["kind", "top"]).withColumn("near_dist", F.col("near.far")).withColumn("near", F.col("near.at"))
            self._up = stage(out, "up")
        return self._up

    @property
    def forest(self) -> DataFrame:
        """:meth:`up` with ``size`` and ``pre``: a node's nested-set range in its tree is ``pre .. pre + size - 1``."""
        if self._forest is None:
            tree = self.up(counted=True)
            kids = tree.where("parent is not null").select(*_KEY, "parent", "size")
            hot = hot_groups(kids, ["kind", "parent"], self.window_rows)
            w = Window.partitionBy("kind", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
            if small_enough(hot, 0):
                upto = kids.withColumn("_upto", F.sum("size").over(w))
            else:
                hot = maybe_broadcast(stage(hot, "hot"))
                spread = spread_positions(kids.join(hot, ["kind", "parent"], "left_semi"), ["kind", "parent"], [F.col("node").asc()], "_upto", weight="size")
                upto = kids.join(hot, ["kind", "parent"], "left_anti").withColumn("_upto", F.sum("size").over(w)).unionByName(spread)
            offs = self._start().join(upto.select(*_KEY, (F.col("_upto") - F.col("size") + 1).alias("pre")), _KEY, "left")
            offs = stage(offs.withColumn("pre", F.coalesce("pre", F.lit(0)).cast("long")), "offsets")
            ranged = self._doubled(offs, {"pre": lambda a, b: a + b})
            self._forest = stage(tree.join(ranged.select(*_KEY, "pre"), _KEY), "forest")
        return self._forest

    @property
    def arcs(self) -> DataFrame:
        """``kind, node, via, link, to, cost, root, root_cost, top``: the ways up from a node with links.

        ``via`` is the end of a link beside the forest (``link``) or the node's parent; ``to`` the next node with links
        from there, null if there is none; a link leads to the ``root`` of a tree as well, if that has no parent.
        """
        if self._arcs is None:
            f = self.up()
            src = f.where("has_links").select("kind", F.col("node").alias("child"), F.col("parent").alias("_own"))
            src = maybe_broadcast(src)
            beside = self.edges.join(src, ["kind", "child"]).where("_own is null or parent <> _own").select("kind", F.col("child")
                .alias("node"), F.col("parent").alias("via"), F.lit(True).alias("link"))
            above = f.where("has_links and parent is not null").select(*_KEY, F.col("parent").alias("via"), F.lit(False).alias("link"))
            at = f.select("kind", F.col("node").alias("via"), "top", "depth", "is_root", "near", "near_dist")
            ways = maybe_broadcast(beside.unionByName(above)).join(at, ["kind", "via"])
            rooted = F.col("link") & F.col("is_root")
            self._arcs = stage(
                ways.select(
                    *_KEY, "via", "link", F.col("near").alias("to"), (F.col("near_dist") + 1).alias("cost"), F.when(rooted, F.col("top")).alias("root"),
                    (F.col("depth") + 1).alias("root_cost"), "top",
                ), "arcs",
            )
        return self._arcs

    @property
    def hops(self) -> DataFrame:
        """``kind, node, to, cost``: ways between nodes with links, over any number of them."""
        if self._hops is None:
            self._hops = closure(self.arcs.where("to is not null").select(*_KEY, "to", "cost"))
        return self._hops

    @property
    def cycles(self) -> DataFrame:
        """``kind, node, cycle``: every node that can reach itself, with the least node among those it reaches that reach it.

        A cycle holds a link beside the forest, so it leads through nodes with links, which come back to themselves; the
        nodes of the forest between two of them are told by ranges.
        """
        if self._cycles is None:
            h = self.hops
            back = h.select("kind", F.col("to").alias("node"), F.col("node").alias("to"))
            both = h.join(h.where("node = to").select(*_KEY), _KEY, "left_semi").join(back, ["kind", "node", "to"], "left_semi")
            found, seen = stage_counted(both.groupBy(*_KEY).agg(F.min("to").alias("part")), "parts", n=F.count(F.lit(1)))
            if not seen["n"]:
                self._cycles = found.select(*_KEY, F.col("part").alias("cycle"))
                return self._cycles
            a, b = found.select(*_KEY, F.col("part").alias("_a")), found.select("kind", F.col("node").alias("to"), F.col("part").alias("_b"))
            inner = self.arcs.join(maybe_broadcast(a), _KEY).join(maybe_broadcast(b), ["kind", "to"]).where("_a = _b")
            inner = inner.select("kind", "via", F.col("to").alias("near"), F.col("_a").alias("part"))
            f = self.forest
            at = f.join(maybe_broadcast(inner.select("kind", F.col("via").alias("node")).distinct()), _KEY,
                "left_semi").select("kind", F.col("node").alias("via"), F.col("pre").alias("_at"), F.col("top").alias("_top"))
            inner = inner.join(at, ["kind", "via"])
            # nodes of the forest on the way: ancestors of "via" below the next node with links
            way = f.join(maybe_broadcast(inner), ["kind", "near"]).where("top = _top and pre <= _at and _at < pre + size").select(*_KEY, "part")
            every = stage(way.unionByName(found.select(*_KEY, "part")).distinct(), "cyclic")
            self._cycles = stage(every.join(every.groupBy("kind", "part").agg(F.min("node").alias("cycle")), ["kind", "part"]).select(*_KEY, "cycle"), "cycles")
        return self._cycles

    def roots(self) -> DataFrame:
        """``kind, node, root, depth``: every root (a node without parents) that a node reaches, with the fewest steps, at least 1."""
        f = self.up()
        direct = self.arcs.where("root is not null").groupBy("kind", "node", "root").agg(F.min("root_cost").alias("far"))
        passed = self.hops.join(direct.withColumnRenamed("node", "to"), ["kind", "to"]).select("kind", "node", "root",
            (F.col("cost") + F.col("far")).alias("far"))
        through = direct.unionByName(passed).groupBy("kind", "node", "root").agg(F.min("far").alias("far"))
        own = f.where("is_root and depth > 0").select(*_KEY, F.col("top").alias("root"), "depth")
        far = f.where("near is not null").select(*_KEY, "near", "near_dist").join(through.withColumnRenamed("node", "near"), ["kind", "near"])
        far = far.select(*_KEY, "root", (F.col("near_dist") + F.col("far")).alias("depth"))
        return own.unionByName(far).groupBy("kind", "node", "root").agg(F.min("depth").alias("depth"))

    def paths(self) -> DataFrame:
        """``kind, node, path``: nodes of the forest from a node's parent up to its top; empty for a top."""
        first = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>"))
        return self._doubled(self._start(first.alias("path")), {"path": lambda a, b: F.concat(a, b)}).select(*_KEY, "path")

    def _inside(self, points: DataFrame) -> DataFrame:
        """``points(kind, top, at, ...)`` with the ``above`` and ``above_depth`` of every node of the forest whose range holds ``at``.

        Ranges are cut into dyadic pieces, and a point lies in one piece of each length, so both sides meet by equality:
        rows grow with the logarithm of a tree's size, and no tree's nodes are compared with each other.
        """
        f = self.forest
        levels = F.ceil(F.log2(F.col("_most").cast("double") + 1)).cast("int")
        trees = f.where("parent is null").select("kind", "top", F.col("size").alias("_most"))
        level = lambda c: F.sequence(F.lit(0), levels)
        shift = lambda c, n: F.expr(f"shiftright({c}, {n})")
        p = points.join(trees, ["kind", "top"]).withColumn("_level", F.explode(level("_most"))).withColumn("_piece", shift("at", "_level"))
        r = f.join(trees, ["kind", "top"]).select("kind", "top", F.col("node").alias("above"), F.col("depth").alias("above_depth"),
            F.col("pre").alias("_lo"), (F.col("pre") + F.col("size")).alias("_hi"), F.explode(level("_most")).alias("_level"))
        # of each length at most two pieces belong to the cut: those within the range whose double isn't
        lo, hi = F.expr("shiftright(_lo + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_hi, _level)")
        wide_lo, wide_hi = F.expr("2 * shiftright(_lo + shiftleft(1L, _level + 1) - 1, _level + 1)"), F.expr("2 * shiftright(_hi, _level + 1)")
        r = r.withColumns({"_a": lo, "_b": hi, "_wa": wide_lo, "_wb": wide_hi})
        ends = F.array(F.when((F.col("_a") < F.col("_b")) & ((F.col("_wa") >= F.col("_wb")) | (F.col("_a") < F.col("_wa"))), F.col("_a")),
                       F.when((F.col("_a") < F.col("_b")) & ((F.col("_wa") >= F.col("_wb")) | (F.col("_b") > F.col("_wb"))), F.col("_b") - 1))
        r = r.select("kind", "top", "above", "above_depth", "_level", F.explode(F.array_distinct(F.filter(ends, lambda x: x.isNotNull()))).alias("_piece"))
        return p.join(r, ["kind", "top", "_level", "_piece"]).drop("_level", "_piece", "_most")

    def descendants(self) -> DataFrame:
        """``kind, node, descendant, depth``: every node that reaches ``node`` over the links, forest or not, with the fewest steps, at least 1; a node on a cycle is its own descendant.

        Within the forest by ranges; over links beside it from the closest node with links, through the ways between such
        nodes, to the end of a link and by ranges to what lies above that.
        """
        f = self.forest
        own = self._inside(f.select("kind", "top", F.col("pre").alias("at"), F.col("node").alias("down"), "depth"))
        own = own.select("kind", "down", F.col("above").alias("up"), (F.col("depth") - F.col("above_depth")).alias("dist"))
        at = f.select("kind", F.col("node").alias("via"), F.col("pre").alias("at"), "top", "depth")
        beside = self.arcs.where("link").select(*_KEY, "via").join(at, ["kind", "via"])
        over = self._inside(beside).select(*_KEY, F.col("above").alias("up"), (F.col("depth") - F.col("above_depth") + 1).alias("dist"))
        over = stage(over.groupBy(*_KEY, "up").agg(F.min("dist").alias("dist")), "over")
        passed = self.hops.join(over.withColumnRenamed("node", "to"), ["kind", "to"]).select(*_KEY, "up", (F.col("cost") + F.col("dist")).alias("dist"))
        every = over.unionByName(passed).groupBy(*_KEY, "up").agg(F.min("dist").alias("dist")).withColumnRenamed("node", "near")
        far = f.where("near is not null").select("kind", F.col("node").alias("down"), "near", "near_dist").join(every, ["kind", "near"])
        far = far.select("kind", "down", "up", (F.col("near_dist") + F.col("dist")).alias("dist"))
        both = own.where("dist > 0").unionByName(far).groupBy("kind", "down", "up").agg(F.min("dist").alias("depth"))
        return both.select("kind", F.col("up").alias("node"), F.col("down").alias("descendant"), "depth")
