"""Long exact spans shared between records: seeds, collinear chaining with a Fenwick tree, alignment of the chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.kernels import code_points, common_run, minimizers, window_hashes
from quillspan.operators.skew import heavy_keys
from quillspan.runtime import maybe_broadcast, small_enough, stage

#: Occurrences of one seed that are joined to pairs for verbatim spans; a seed of more is handled exactly by hashes of whole spans.
HOT_SEED = 64
#: Classes of one seed that one task joins to pairs; those of a seed of more are joined block against block.
BLOCK = 1024
#: Matches of two classes from which their chains are sought in arrays, if these have at most ``FILL`` cells per match.
MANY, FILL = 4096, 256
#: Rows of one seed or span hash from which they are kept out of windows; they are found beforehand.
HEAVY = 4096
#: Cost per character of gap between two seeds of a chain, and the longest gap that is aligned character by character.
GAP_COST, ALIGN_GAP = 0.02, 400


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, item: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if self.best[i] < item:
                self.best[i] = item
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(anchors: Sequence[tuple[int, int]], k: int, gap_cost: float = GAP_COST) -> list[tuple[float, list[tuple[int, int]]]]:
    """Disjoint collinear chains of matches (place in a, place in b), best first.

    The score is k per match less the gap cost per character between matches on both sides; a chain that would gain
    nothing by going on ends.
    """
    return list(_each_chain(anchors, k, gap_cost))


def _each_chain(anchors: Sequence[tuple[int, int]], k: int, gap_cost: float = GAP_COST) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    if len(anchors) >= MANY:
        places = np.unique(np.asarray(anchors, np.int64) @ np.array([1 << 32, 1]))
        p, q = places >> 32, places & 0xFFFFFFFF
        if len(np.unique(p)) * len(np.unique(q)) <= FILL * len(places):
            return _paths(p, q, *_best_in_rows(p, q, k, gap_cost))
    anchors = sorted({(int(p), int(q)) for p, q in anchors})
    if len(anchors) == 1 or len({p - q for p, q in anchors}) == 1 and gap_cost * 2 * max(x[0] - y[0] for x, y in zip(anchors[1:], anchors)) < k:
        return iter([(k * len(anchors) - gap_cost * 2 * (anchors[-1][0] - anchors[0][0]), anchors)])
    column = {q: i for i, q in enumerate(sorted({q for _, q in anchors}))}
    tree, score, came = Fenwick(len(column)), [0.0] * len(anchors), [-1] * len(anchors)
    at = 0
    while at < len(anchors):
        end = at
        while end < len(anchors) and anchors[end][0] == anchors[at][0]:
            p, q = anchors[end]
            value, j = tree.upto(column[q])
            gain = value - gap_cost * (p + q)
            score[end], came[end] = (k + gain, j) if gain > 0 else (float(k), -1)
            end += 1
        for i in range(at, end):  # matches at one place of a can't follow each other
            p, q = anchors[i]
            tree.put(column[q], (score[i] + gap_cost * (p + q), i))
        at = end
    return _paths(*zip(*anchors), score, came)


def _best_in_rows(p: np.ndarray, q: np.ndarray, k: int, gap_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and predecessor of each match, as the Fenwick tree gives them, by prefix maxima over all columns for one place of a after the other; for seeds that both texts repeat."""
    n = len(p)
    columns, c = np.unique(q, return_inverse=True)
    value, index = np.full(len(columns) + 1, -np.inf), np.full(len(columns) + 1, -1)  # the first is before all columns
    score, came = np.empty(n), np.empty(n, np.int64)
    ends = [*(np.flatnonzero(np.diff(p)) + 1).tolist(), n]
    for at, end in zip([0, *ends], ends):
        top = np.maximum.accumulate(value)
        level = np.concatenate(([0], np.cumsum(top[1:] > top[:-1]))) * (n + 1)
        last = np.maximum.accumulate(level + np.where(value == top, index, -1) + 1) - level - 1  # of equal values the last match
        here, far = c[at:end], gap_cost * (p[at:end] + q[at:end])
        gain = top[here] - far
        score[at:end] = np.where(gain > 0, k + gain, float(k))
        came[at:end] = np.where(gain > 0, last[here], -1)
        new = score[at:end] + far
        up = new >= value[here + 1]
        value[here[up] + 1], index[here[up] + 1] = new[up], np.arange(at, end)[up]
    return score, came


def _paths(p: Sequence[int], q: Sequence[int], score: Sequence[float], came: Sequence[int]) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """Chains from the best end backwards; each match is in one of them."""
    used = bytearray(len(p))
    for i in np.argsort(-np.asarray(score), kind="stable"):
        if used[i]:
            continue
        path, j = [], i
        while j != -1 and not used[j]:
            used[j] = 1
            path.append((int(p[j]), int(q[j])))
            j = came[j]
        yield float(score[i] - (score[j] if j != -1 else 0)), path[::-1]


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Sequence[tuple[int, int]]]]:
    """Matches of one (kind, a, b) from sorted batches of places of a and of b that have one seed; those of a pair may cross batches."""

    def matches(run: list[tuple[list[int], list[int]]]) -> Sequence[tuple[int, int]]:
        if sum(len(ps) * len(qs) for ps, qs in run) < MANY:
            return [(i, j) for ps, qs in run for i in ps for j in qs]
        return np.concatenate([np.stack([np.repeat(np.array(ps, np.int32), len(qs)), np.tile(np.array(qs, np.int32), len(ps))], 1) for ps, qs in run])

    key, run = None, []
    for b in batches:
        kind, x, y, p, q = (b.column(i).to_pylist() for i in range(5))
        for k2, i, j in zip(zip(kind, x, y), p, q):
            if k2 != key:
                if run:
                    yield key, matches(run)
                key, run = k2, []
            run.append((i, j))
    if run:
        yield key, matches(run)


class SharedSpans:
    """Passages of at least ``span`` characters that stand verbatim in more than one record of a kind.

    ``records`` has ``kind, record_id, body``. Records of one text form a class and are compared once. Seeds are k-grams
    chosen so that every shared span of ``span`` characters holds one or more at the same places (k + w - 1 <= span); they are joined, chained per pair
    of records and aligned on the texts. For verbatim spans, seeds that occur over ``HOT_SEED`` times aren't paired: all spans
    through them are hashed as a whole and counted, which is exact and linear. Fuzzy passages pair all seeds. Null ids, null and blank texts take no part, an id that
    is repeated counts once and never pairs with itself (its texts, should they differ, are separate classes of one
    record); other columns are ignored.
    """

    def __init__(self, records: DataFrame, span: int = 300, k: int = 64, w: int = 120, hot_seed: int = HOT_SEED, heavy: int = HEAVY):
        if k + w - 1 > span:
            raise ValueError("k + w - 1 must not exceed span")
        self.span, self.k, self.w, self.hot_seed, self.heavy = span, k, w, hot_seed, heavy
        r = records.where(F.col("record_id").isNotNull() & (F.length("body") >= span) & F.col("body").rlike(r"\S"))
        self.source = r.select("kind", F.col("record_id").cast("string").alias("record_id"), F.col("body"), F.xxhash64("kind", "body").alias("rid"))
        self._intervals = self._members = self._seeds = self._texts = None

    @property
    def members(self) -> DataFrame:
        """``kind, record_id, rid, n_chars, copies``: the class of each record, and how many records share its whole text."""
        if self._members is None:
            m = self.source.select("kind", "record_id", "rid", F.length("body").alias("n_chars")).distinct()
            sizes = m.groupBy("kind", "rid").agg(F.count(F.lit(1)).alias("copies"))
            self._members = stage(m.join(sizes, ["kind", "rid"]).select("kind", "record_id", "rid", "n_chars", "copies"), "members")
        return self._members

    @property
    def seeds(self) -> DataFrame:
        """``kind, seed, rid, pos, m``: seeds of two or more classes, ``m`` the occurrences of the seed."""
        if self._seeds is None:
            k, w = self.k, self.w

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                seen: set[int] = set()  # copies within a task give their seeds once, so a hot text isn't shuffled for each of them
                for b in batches:
                    fresh = []
                    for i, r in enumerate(b.column(1).to_pylist()):
                        if r not in seen:
                            seen.add(r)
                            fresh.append(i)
                    b = b.take(pa.array(fresh, pa.int64()))
                    own, at, val = minimizers(b.column(2).to_pylist(), k, w)
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(val.view(np.int64)), b.column(1).take(own),
                        pa.array(at, pa.int32())], ["kind", "seed", "rid", "pos"])

            found = self.source.select("kind", "rid", "body").mapInArrow(run, "kind string, seed long, rid long, pos int")
            found = stage(found.select("kind", F.xxhash64("kind", "seed").alias("seed"), "rid", "pos"), "found")
            self._seeds = stage(_in_several(found, "seed", self.heavy), "seeds")
        return self._seeds

    def _paired(self, most: int | None) -> DataFrame:
        """``kind, a, b, ps, qs``: the places of each seed of up to ``most`` occurrences (all without it) that two classes have, a < b."""
        s = self.seeds if most is None else self.seeds.where(F.col("m") <= most)
        on = ["kind", "seed"]
        if most is None or most > BLOCK:
            places = s.groupBy(*on, "rid").agg(F.array_sort(F.collect_set("pos")).alias("ps"))  # at most a record's length
            sizes = s.where(F.col("m") > BLOCK).select(*on, "rid").distinct().groupBy(on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
            places = places.join(maybe_broadcast(sizes), on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            own, each = F.pmod(F.xxhash64("rid"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            x, y = (places.withColumn(c, own).withColumn(d, each) for c, d in (("i", "j"), ("j", "i")))
            on += ["i", "j"]
        else:
            x = y = s.withColumn("ps", F.array("pos"))
        x, y = x.select(*on, F.col("rid").alias("a"), "ps"), y.select(*on, F.col("rid").alias("b"), F.col("ps").alias("qs"))
        return x.join(y, on).where("a < b").select("kind", "a", "b", "ps", "qs")

    def chained(self, most: int | None = None, least: float = float("-inf")) -> DataFrame:
        """``kind, a, b, score, anchors``: chains of matches between two classes, a < b, with a score of ``least`` or more, of seeds of up to ``most`` occurrences or of all."""
        k = self.k
        schema = "kind string, a long, b long, score double, anchors array<struct<p:int,q:int>>"
        kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                c = list(zip(*rows))
                rows.clear()
                return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()),
                    pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64()), pa.array(c[4], kind)], ["kind", "a", "b", "score", "anchors"])

            held = 0
            for key, found in _by_pair(batches):
                for score, path in _each_chain(found, k):
                    if score < least:
                        continue
                    rows.append((*key, score, [{"p": p, "q": q} for p, q in path]))
                    held += len(path)
                    if len(rows) >= 5000 or held >= 1 << 18:
                        yield flush()
                        held = 0
            if rows:
                yield flush()

        return self._paired(most).repartition("kind", "a", "b").sortWithinPartitions("kind", "a", "b").mapInArrow(run, schema)

    def _bodies(self, need: DataFrame) -> DataFrame:
        return self.source.join(maybe_broadcast(need), ["kind", "rid"], "left_semi").groupBy("kind", "rid").agg(F.first("body").alias("body"))

    def _aligned(self, most: int | None = None, least: float = float("-inf")) -> DataFrame:
        """Chains with the texts of both classes."""
        c = stage(self.chained(most, least), "chains")
        need = c.select("kind", F.col("a").alias("rid")).unionByName(c.select("kind", F.col("b").alias("rid"))).distinct()
        texts = stage(self._bodies(need), "bodies")
        return c.join(texts.select("kind", F.col("rid").alias("a"), F.col("body").alias("ta")),
            ["kind", "a"]).join(texts.select("kind", F.col("rid").alias("b"), F.col("body").alias("tb")),
                ["kind", "b"]).select("kind", "a", "b", "score", "anchors", "ta", "tb")

    def intervals(self) -> DataFrame:
        """``kind, rid, start, stop``: verbatim spans of at least ``span`` characters that another class has too, by alignment of the chains and, for hot seeds, by hashes of spans."""
        if self._intervals is None:
            k, span = self.k, self.span

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    rows = []
                    for kind, x, y, path, ta, tb in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                        done: dict[int, int] = {}
                        for p, q in {_run_ends(ta, tb, m["p"], m["q"], k) for m in path} - {None}:  # their seeds may be at other places of both runs
                            s, n = common_run(ta, tb, p, q, k)
                            if n >= span:
                                rows += [(kind, x, *_over_runs(ta, s, s + n, span)), (kind, y, *_over_runs(tb, s - p + q, s - p + q + n, span))]
                        for m in path:
                            p, q = m["p"], m["q"]
                            if p <= done.get(p - q, -1):
                                continue
                            s, n = common_run(ta, tb, p, q, k)
                            done[p - q] = s + n - k
                            if n >= span:
                                rows += [(kind, x, *_over_runs(ta, s, s + n, span)), (kind, y, *_over_runs(tb, s - p + q, s - p + q + n, span))]
                    c = list(zip(*rows)) if rows else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()),
                        pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], ["kind", "rid", "start", "stop"])

            found = self._aligned(self.hot_seed).mapInArrow(run, "kind string, rid long, start int, stop int").distinct()
            hot = self.seeds.where(F.col("m") > self.hot_seed)
            if not small_enough(hot, 0):
                found = found.unionByName(self._hot_spans(hot))
            self._intervals = stage(found, "intervals")
        return self._intervals

    def _hot_spans(self, hot: DataFrame) -> DataFrame:
        places = hot.groupBy("kind", "rid").agg(F.array_sort(F.collect_set("pos")).alias("ps"))  # at most a record's length
        texts = self._bodies(places.select("kind", "rid"))
        k, span = self.k, self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for kind, rid, ps, body in zip(*(c.to_pylist() for c in b.columns)):
                    codes = code_points(body)
                    h = window_hashes(codes, span)
                    ps = np.asarray(ps)
                    marks = np.zeros(len(h) + 1, np.int32)
                    np.add.at(marks, np.clip(ps + k - span, 0, len(h)), 1)
                    np.add.at(marks, np.clip(ps + 1, 0, len(h)), -1)
                    turns = np.concatenate(([0], np.cumsum(codes[1:] != codes[:-1])))  # seeds within a run of one character are left out, so its spans are added
                    starts = np.flatnonzero((np.cumsum(marks[:-1]) > 0) | (turns[span - 1 :] == turns[: len(h)]))
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(np.full(n, rid)),
                        pa.array(starts, pa.int32()), pa.array(h[starts].view(np.int64))], ["kind", "rid", "start", "hash"])

        spans = places.join(texts, ["kind", "rid"]).mapInArrow(run, "kind string, rid long, start int, hash long")
        spans = stage(spans.select("kind", "rid", "start", F.xxhash64("kind", "hash").alias("hash")), "hot-spans")
        both = _in_several(spans, "hash", self.heavy)
        return _merged(both.select("kind", "rid", "start", (F.col("start") + span).alias("stop")))

    def spans(self) -> DataFrame:
        """``kind, record_id, start, stop``: what of each record stands in another one, overlapping spans merged; the whole text where another record has the same."""
        m = self.members
        whole = m.where("copies > 1").select("kind", "record_id", F.lit(0).alias("start"), F.col("n_chars").alias("stop"))
        part = m.where("copies = 1").join(_merged(self.intervals()), ["kind", "rid"]).select("kind", "record_id", "start", "stop")
        return whole.unionByName(part)

    def coverage(self) -> DataFrame:
        """``kind, record_id, n_chars, shared_chars, shared_share``, one row per record that shares a span; the whole text counts where another record has the same."""
        m = self.members
        part = _merged(self.intervals()).groupBy("kind", "rid").agg(F.sum(F.col("stop") - F.col("start")).alias("chars"))
        out = m.join(part, ["kind", "rid"], "left").where((F.col("copies") > 1) | F.col("chars").isNotNull())
        out = out.withColumn("shared_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("chars")).cast("long"))
        out = out.groupBy("kind", "record_id").agg(F.max(F.struct("shared_chars", "n_chars")).alias("x"))  # an id of several texts
        return out.select("kind", "record_id", F.col("x.n_chars").cast("long").alias("n_chars"), "x.shared_chars",
            (F.col("x.shared_chars") / F.col("x.n_chars")).alias("shared_share"))

    def passages(self, min_score: float = 100.0) -> DataFrame:
        """``kind, a, b, a_start, a_stop, b_start, b_stop, score, identity``: fuzzy passages, each a chain aligned from its first to its last match; ``identity`` is the share of the longer side that agrees.

        ``a`` and ``b`` are the least records of their texts. Chains are made of all seeds, however frequent, so a passage
        that n texts have gives n (n - 1) / 2 rows.
        """
        names = self.members.groupBy("kind", "rid").agg(F.min("record_id").alias("name"))
        k = self.k
        schema = "kind string, a long, b long, a_start int, a_stop int, b_start int, b_stop int, score double, identity double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for kind, x, y, score, path, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                    a0, b0 = a1, b1 = path[0]["p"], path[0]["q"]
                    same, done = 0, {}
                    for m in path:
                        if m["p"] <= done.get(m["p"] - m["q"], -1):
                            continue
                        s, n = common_run(ta, tb, m["p"], m["q"], k)
                        done[m["p"] - m["q"]] = s + n - k
                        e, f = s + n, s + n - m["p"] + m["q"]
                        if not same:
                            a0, b0, a1, b1, same = s, s - m["p"] + m["q"], e, f, n
                        elif e > a1 and f > b1:
                            s2 = max(s, a1, b1 + m["p"] - m["q"])
                            ga, gb = ta[a1:s2], tb[b1 : s2 - m["p"] + m["q"]]
                            if ga and gb and max(len(ga), len(gb)) <= ALIGN_GAP:
                                same += sum(z.size for z in SequenceMatcher(None, ga, gb, autojunk=False).get_matching_blocks())
                            same += max(0, e - s2)
                            a1, b1 = e, f
                    rows.append((kind, x, y, a0, a1, b0, b1, score, min(1.0, same / max(a1 - a0, b1 - b0, 1))))
                c = list(zip(*rows)) if rows else [[]] * 9
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], [z.split()[0] for z in schema.split(", ")])

        found = stage(self._aligned(least=min_score).mapInArrow(run, schema), "passages")
        side = lambda c: names.select("kind", F.col("rid").alias(c), F.col("name").alias(f"_{c}"))
        found = found.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"])
        swap = F.col("_a") > F.col("_b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        ends = [pick(f"{x}_{e}", f"{y}_{e}").alias(f"{x}_{e}") for x, y in ("ab", "ba") for e in ("start", "stop")]
        return found.select("kind", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *ends, "score", "identity")


def _run_ends(a: str, b: str, i: int, j: int, k: int) -> tuple[int, int] | None:
    """The last ``k`` characters of both runs, if the match at (i, j) lies in runs of one character: a span that leaves them begins to differ from them at both ends alike."""
    if a[i] != a[i + k - 1] or a[i : i + k] != a[i] * k or b[j : j + k] != a[i] * k:
        return None
    return len(a) - len(a[i:].lstrip(a[i])) - k, len(b) - len(b[j:].lstrip(a[i])) - k


def _over_runs(text: str, start: int, stop: int, span: int) -> tuple[int, int]:
    """A shared interval that begins or ends with ``span`` times one character, taken on over the rest of that run: every span within the run is shared as well."""
    if text[start : start + span] == text[start] * span:
        while start and text[start - 1] == text[start]:
            start -= 1
    if text[stop - span : stop] == text[stop - 1] * span:
        while stop < len(text) and text[stop] == text[stop - 1]:
            stop += 1
    return start, stop


def _in_several(rows: DataFrame, key: str, heavy: int) -> DataFrame:
    """Distinct rows whose ``key`` stands in two or more texts (``rid``), with the occurrences ``m`` of the key.

    Keys of very many rows are found beforehand; their texts are compared by a least and a greatest, combined before the
    shuffle, so no task holds all rows of such a key. All others meet in windows of bounded size. ``rows`` is read twice.
    """
    hot = heavy_keys(rows, key, heavy)
    by = Window.partitionBy(key)
    cool, some = rows, not small_enough(hot, 0)
    if some:
        names = hot.select(F.col("key").alias(key), F.col("n").alias("m"))
        cool = rows.join(maybe_broadcast(names.select(key)), key, "left_anti")
    met = cool.withColumn("lo", F.min("rid").over(by)).withColumn("hi", F.max("rid").over(by)).where("lo <> hi")
    out = met.select(*rows.columns).distinct().withColumn("m", F.count(F.lit(1)).over(by))
    if some:
        warm = rows.join(maybe_broadcast(names), key)
        ends = stage(warm.groupBy(key).agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select(key), "hot-keys")
        out = out.unionByName(warm.join(maybe_broadcast(ends), key, "left_semi").select(*rows.columns, "m").distinct())
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """Union of overlapping intervals per record."""
    w = Window.partitionBy("kind", "rid").orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("fresh", F.when(F.coalesce(F.col("start") > seen, F.lit(True)), 1).otherwise(0))
    return marked.withColumn("island", F.sum("fresh").over(w)).groupBy("kind", "rid", "island").agg(F.min("start").alias("start"),
        F.max("stop").alias("stop")).drop("island")
