"""Near-duplicate texts: many universal hash minima with banding, verification, connected components."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.kernels import mix64
from quillspan.operators.components import connected_components
from quillspan.operators.ranking import positions
from quillspan.operators.skew import heavy_keys
from quillspan.runtime import maybe_broadcast, small_enough, stage

#: Minima per band and bands. A pair of similarity 0.8 by the longer text has a Jaccard similarity of 2/3 or more: bands find it
#: with 0.947 at 2/3, 0.99 at 0.72, 0.9999 at 0.8.
ROWS, BANDS = 6, 32
#: Two bits of each minimum make a sketch. First bits that a bucket's rows carry and how many must agree; then minima of which both
#: bits must agree. At a Jaccard similarity of 2/3, 90 +- 4 of 108 and 144 +- 6 of 192 do.
BUCKET_BITS, BUCKET_AGREE, ALL_AGREE = 108, 80, 127
#: Words of the sketch: the first bits of 192 minima, then their second bits.
_SKETCH = ("w1", "w2", "w3", "w4", "w5", "w6")
_MASK = (1 << (BUCKET_BITS - 64)) - 1
#: Rows of one band key from which its bucket is compared block by block, and rows of a block.
BUCKET, BLOCK = 512, 2048
#: Copies of one text that are paired with each copy, those next to it by id, and that stand for the text before other texts (one more).
NEXT_COPIES = 32
#: Texts of a class per block when its pairs are listed.
LIST_BLOCK = 256
_WORD = re.compile(r"[^\W_]+")
_TO_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if chr(i).isalnum() and i < 128 else 32 for i in range(256))


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    if text.isascii():
        return text.encode("ascii").translate(_TO_WORDS).decode("ascii").split()
    return _WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def features(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit feature per word and repetition of it, text by text, and where each text starts; no text may be empty."""
    n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    get = _hashes.__getitem__
    tokens = np.fromiter((get(w) for t in texts for w in t), np.uint64, int(n.sum()))
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
        keyed = mix64(tokens) + owner * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keyed, kind="stable")
        ranked = keyed[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        at = np.arange(len(ranked))
        times = np.empty(len(ranked), np.uint64)
        times[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
        return mix64(mix64(tokens) + times * np.uint64(0xD6E8FEB86659FD93)), starts


def signatures(texts: list[list[str]], rows: int = ROWS, bands: int = BANDS) -> dict[str, np.ndarray]:
    """Class hashes, band keys and sketches of texts given as word lists."""
    f, starts = features(texts)
    a, b = _coefficients(rows * bands)
    with np.errstate(over="ignore"):
        out = {
            "c1": mix64(np.add.reduceat(mix64(f), starts)),
            "c2": mix64(np.add.reduceat(mix64(f ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)),
        }
        keys = np.empty((len(texts), bands), np.uint64)
        half = -(-rows * bands // 64)
        bits = np.zeros((2 * half, len(texts)), np.uint64)
        for band in range(bands):
            acc = np.full(len(texts), band + 1, np.uint64)
            for row in range(rows):
                i = band * rows + row
                least = np.minimum.reduceat(f * a[i] + b[i], starts)
                acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + least)
                part, place = divmod(i, 64)
                mixed = mix64(least)
                bits[part] |= (mixed & np.uint64(1)) << np.uint64(place)
                bits[half + part] |= ((mixed >> np.uint64(1)) & np.uint64(1)) << np.uint64(place)
            keys[:, band] = acc
    return out | {"keys": keys, "bits": bits}


def _signed(df: DataFrame, item: str, text: str, min_words: int) -> DataFrame:
    schema = "item string, c1 long, c2 long, same long, n int, " + "".join(f"{w} long, " for w in _SKETCH) + "keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                kept, texts, same = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    w = words(t)
                    if len(w) >= min_words and w:
                        kept.append(i)
                        texts.append(w)
                        same.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63))
                if not texts:
                    continue
                s = signatures(texts)
                long = lambda x: pa.array(x.view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS, dtype=np.int32)), long(s["keys"].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(kept)), long(s["c1"]), long(s["c2"]), pa.array(same, pa.int64()),
                        pa.array([len(t) for t in texts], pa.int32()), *(long(x) for x in s["bits"]), keys],
                    ["item", "c1", "c2", "same", "n", *_SKETCH, "keys"],
                )

    return df.mapInArrow(run, schema)


def _near(n, m, threshold: float):
    return F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9


def _alike(threshold: float):
    """Whether rows x and y of a bucket may be linked, by their lengths and the bits they carry (the length stands above the bits of s2)."""
    agree = BUCKET_BITS - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) - F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")).bitwiseAND(F.lit(_MASK)))
    n, m = F.shiftright("x.s2", BUCKET_BITS - 64), F.shiftright("y.s2", BUCKET_BITS - 64)
    return _near(n, m, threshold) & (agree >= BUCKET_AGREE)


def _block_pairs(hot: DataFrame, threshold: float) -> DataFrame:
    """Candidates of buckets too large for a direct join, block against block: for ``m`` rows of a key m * m / 2 comparisons of bits, of which few come out."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = hot.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "s1", "s2")

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        cid, s1, s2 = (table.column(c).to_numpy() for c in ("cid", "s1", "s2"))
        n, low = s2 >> (BUCKET_BITS - 64), s2 & _MASK
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in left:
            apart = np.bitwise_count((s1[right] ^ s1[x]).view(np.uint64)).astype(np.int16) + np.bitwise_count((low[right] ^ low[x]).view(np.uint64))
            hit = right[(apart <= BUCKET_BITS - BUCKET_AGREE) & (np.minimum(n[right], n[x]) >= np.maximum(n[right], n[x]) * threshold - 1e-9)]
            hit = hit[hit > x] if i == j else hit
            a.append(np.minimum(cid[hit], cid[x]))
            b.append(np.maximum(cid[hit], cid[x]))
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _overlap(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share, cache = [], {}
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                counts = []
                for t in (x, y):
                    if t not in cache:
                        if len(cache) > 500:
                            cache.clear()
                        cache[t] = Counter(words(t))
                    counts.append(cache[t])
                p, q = counts
                most = max(p.total(), q.total())
                share.append(sum(min(c, q[w]) for w, c in p.items() if w in q) / most if most else 0.0)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], ["a", "b", "overlap"])
            yield out.filter(pa.array([s >= threshold - 1e-12 for s in share], pa.bool_()))

    return pairs.mapInArrow(run, "a string, b string, overlap double")


class NearDuplicates:
    """Texts whose words agree but for small edits, in any order.

    Two texts are linked if both have ``min_words`` words or more and at least ``threshold`` of the longer one's words are
    common to both, repeated words counting as often as both have them. Null ids and texts take no part; shorter and
    blank texts neither; an id with several texts keeps the class of least hash; other columns are ignored.

    ``members`` has ``item, rep, copies, same``: texts of the same words form a class of ``copies`` items, named by its
    least item; they need not be the same text, and ``same`` tells which are. ``links`` has ``a, b, overlap`` between class
    names. Candidates come from banded minima, so a link at the very threshold meets with probability 0.947 (see
    ``ROWS``); of these the sketch cuts lose some 0.4 %, and every candidate that passes them is verified on the texts. No
    bucket is cut: those of very many rows are found beforehand and compared block by block.
    """

    def __init__(self, df: DataFrame, item: str, text: str, threshold: float = 0.8, min_words: int = 20, bucket: int = BUCKET):
        given = df.where(F.col(item).isNotNull() & F.col(text).isNotNull())
        self.source = given.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
        self.threshold, self.bucket = threshold, bucket
        self._signed = stage(_signed(self.source, "item", "text", min_words), "signed")
        self._members = self._links = self._classes_ = None

    @property
    def _classes(self) -> DataFrame:
        """One row per class: ``cid``, a 64-bit hash of its words and their counts, with its sketches."""
        if self._classes_ is None:
            first = [F.first(c).alias(c) for c in ("n", "w1", "w2", "keys")]
            self._classes_ = stage(self._signed.groupBy("c1", "c2").agg(*first).select(F.xxhash64("c1", "c2").alias("cid"), "n", "w1", "w2", "keys"), "classes")
        return self._classes_

    @property
    def members(self) -> DataFrame:
        if self._members is None:
            own = self._signed.groupBy("item").agg(F.min(F.struct("c1", "c2", "same")).alias("c")).select("item", "c.*")
            size = own.groupBy("c1", "c2").agg(F.min("item").alias("rep"), F.count(F.lit(1)).alias("copies"))
            many = own.join(maybe_broadcast(size.where("copies > 1")), ["c1", "c2"]).select("item", "rep", "copies", "same")
            one = own.join(maybe_broadcast(size.where("copies > 1")), ["c1", "c2"], "left_anti")
            self._members = stage(many.unionByName(one.select("item", F.col("item").alias("rep"), F.lit(1).cast("long").alias("copies"), "same")), "members")
        return self._members

    def _candidates(self) -> DataFrame:
        c = self._classes
        packed = F.col("w2").bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftleft(F.least("n", F.lit((1 << 19) - 1)).cast("long"), BUCKET_BITS - 64))
        rows = c.select("cid", F.col("w1").alias("s1"), packed.alias("s2"), F.explode("keys").alias("key"))
        # a key carries its band; a bucket holds the classes of one key
        heavy = heavy_keys(c, "keys", self.bucket)
        some = not small_enough(heavy, 0)
        direct = rows.join(maybe_broadcast(heavy.select("key")), "key", "left_anti") if some else rows
        x, y = direct.alias("x"), direct.alias("y")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & _alike(self.threshold)
        found = x.join(y, met).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        if some:
            hot = rows.join(maybe_broadcast(heavy.withColumnRenamed("n", "m")), "key")
            found = found.unionByName(_block_pairs(hot, self.threshold))
        found = stage(found.distinct(), "candidates")
        near = self._signed.groupBy(F.xxhash64("c1", "c2").alias("cid")).agg(F.min("item").alias("rep"), *[F.first(w).alias(w) for w in ("n", *_SKETCH)])
        side = lambda p: near.select(F.col("cid").alias(p), *[F.col(w).alias(f"{p}_{w}") for w in ("rep", "n", *_SKETCH)])
        both = found.join(side("a"), "a").join(side("b"), "b")
        differ = lambda w: F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))
        apart = sum((F.bit_count(differ(v).bitwiseOR(differ(w))) for v, w in zip(_SKETCH[:3], _SKETCH[3:])), F.lit(0))
        both = both.where((ROWS * BANDS - apart >= ALL_AGREE) & _near(F.col("a_n"), F.col("b_n"), self.threshold))
        return stage(both.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")), "checked")

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            pairs = self._candidates()
            need = pairs.select(F.col("a").alias("item")).unionByName(pairs.select(F.col("b").alias("item"))).distinct()
            texts = stage(self.source.join(maybe_broadcast(need), "item", "left_semi").groupBy("item").agg(F.min("text").alias("text")), "texts")
            both = pairs.join(texts.select(F.col("item").alias("a"), F.col("text").alias("ta")), "a")
            both = both.join(texts.select(F.col("item").alias("b"), F.col("text").alias("tb")), "b")
            self._links = stage(_overlap(both.select("a", "b", "ta", "tb"), self.threshold), "links")
        return self._links

    def pairs(self, next_copies: int = NEXT_COPIES) -> DataFrame:
        """``a, b`` item pairs, a < b, by one rule for every size.

        Items of one text are its copies; by id each is paired with the ``next_copies`` copies after it. Before every
        other text of its class and of linked classes, the first ``next_copies`` + 1 copies stand for a text. So every link
        between different texts is listed, and rows grow with the items, not with the square of the copies.

        Texts of a class are cut into blocks, and pairs are listed block against block, so no task holds a large class.
        """
        m, links = self.members, self.links.select("a", "b")
        linked = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).distinct()
        many = positions(m.where("copies > 1").select("item", "rep", "same"), ["rep", "same"], [F.col("item").asc()], "nth")
        many = stage(many, "copies")
        # copies of one text: each meets the copies of its own stretch of ids and of the next one
        stretch = F.floor((F.col("nth") - 1) / next_copies)
        p = many.select("rep", "same", stretch.alias("at"), F.col("item").alias("a"), F.col("nth").alias("i"))
        q = many.select("rep", "same", F.explode(F.array(stretch, stretch - 1)).alias("at"), F.col("item").alias("b"), F.col("nth").alias("j"))
        twins = p.join(q, ["rep", "same", "at"]).where((F.col("i") < F.col("j")) & (F.col("j") <= F.col("i") + next_copies)).select("a", "b")
        # different texts
        single = m.where("copies = 1").join(maybe_broadcast(linked), "rep", "left_semi").select("item", "rep", "same")
        units = stage(many.where(F.col("nth") <= next_copies + 1).select("item", "rep", "same").unionByName(single), "units")
        sizes = units.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"), F.count_distinct("same").alias("texts"))
        sizes = stage(sizes, "sizes")
        member = F.struct("item", "same")
        blocks = units.join(sizes, "rep").groupBy("rep", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
            .alias("block")).agg(F.collect_list(member).alias("items"))
        size = lambda c: sizes.select(F.col("rep").alias(c), F.sequence(F.lit(0), F.col("blocks") - 1).alias(f"{c}_blocks"))
        own = sizes.where("texts > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        met = links.unionByName(own).join(size("a"), "a").join(size("b"), "b").withColumn("i", F.explode("a_blocks")).withColumn("j", F.explode("b_blocks"))
        met = met.where("a <> b or i <= j")
        side = lambda c, at, out: blocks.select(F.col("rep").alias(c), F.col("block").alias(at), F.col("items").alias(out))
        met = met.join(side("a", "i", "ps"), ["a", "i"]).join(side("b", "j", "qs"), ["b", "j"])
        every = met.select((F.col("a") == F.col("b")).alias("_own"), (F.col("i") == F.col("j")).alias("_block"), F.explode("ps").alias("p"), "qs")
        every = every.select("_own", "_block", "p", F.explode("qs").alias("q"))
        every = every.where("not _own or (p.same <> q.same and (not _block or p.item < q.item))")
        return every.select(F.least("p.item", "q.item").alias("a"), F.greatest("p.item", "q.item").alias("b")).unionByName(twins)

    def groups(self) -> DataFrame:
        """``item, group_id, links``: one row per item that has a near-duplicate; the group is a connected component, named by its least item, and ``links`` counts the classes linked directly plus the other items of the own class."""
        links = self.links.select("a", "b")
        degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("near"))
        part = connected_components(links).select(F.col("node").alias("rep"), "component")
        about = maybe_broadcast(part.join(degree, "rep"))
        out = self.members.join(about, "rep", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
        return out.select("item", F.coalesce("component", "rep").alias("group_id"),
            (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"))
