"""Most similar vectors for every vector: block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.topk import DECIMALS, Heaps
from quillspan.runtime import maybe_broadcast, read_file_rows, shared_root, small_enough, stage

#: Vectors of one block on average at most. A tile task holds two blocks and one product in memory, about 100 MB.
BLOCK_ROWS = 16_384
#: Rows and columns of one product held in memory.
_ROWS, _COLS = 1024, 8192
#: What float32 products may add to a bound.
_EPS = 2e-6
#: Items of one class from which its members are joined to its list by broadcast.
HOT_CLASS = 100_000


def _unit(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, given float32 and float64 unit vectors of the usable rows: ``dim`` finite numbers, none null, not all zero."""
    col = batch.column(1)
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(lengths, nan=-1) == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32), np.empty((0, dim))
    parts = col.take(pa.array(rows)).flatten()
    given = parts.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # a null part comes out as NaN
    ok = np.isfinite(given).all(axis=1) & (given != 0).any(axis=1)
    return rows[ok], given[ok], _scaled(given[ok])


def _scaled(given: np.ndarray) -> np.ndarray:
    v = given.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True, initial=0)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _class_hash(u: np.ndarray) -> list[bytes]:
    """Equal for vectors of one direction (to six decimals)."""
    import xxhash

    rounded = np.round(u * 1e6).astype(np.int32)
    return [xxhash.xxh3_128_digest(r.tobytes()) for r in rounded]


def _classed(df: DataFrame, dim: int, floats: bool) -> DataFrame:
    """``item, class`` of the usable rows, with their vectors as float32 bytes if wanted."""
    schema = "item string, class binary" + (", floats binary" if floats else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, given, u = _unit(b, dim)
            if len(rows):
                cols = [b.column(0).take(pa.array(rows)), pa.array(_class_hash(u), pa.binary())]
                cols += [pa.array([r.tobytes() for r in given], pa.binary())] if floats else []
                yield pa.RecordBatch.from_arrays(cols, ["item", "class", "floats"][: len(cols)])

    return df.mapInArrow(run, schema)


def _once_a_task(df: DataFrame) -> DataFrame:
    """``item, class, floats`` with the vector of a class once per task, and its item again only where it is the least so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, str] = {}
        for b in batches:
            kept, bare = [], []
            for n, (item, cls) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if cls not in least or item < least[cls]:
                    kept.append(n)
                    bare.append(cls in least)
                    least[cls] = item
            out = b.take(pa.array(kept, pa.int64()))
            vectors = pa.array([None if x else v for x, v in zip(bare, out.column(2).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), vectors], ["item", "class", "floats"])

    return df.mapInArrow(run, "item string, class binary, floats binary")


class _Block:
    """One block as a tile needs it: items, unit vectors, int8 codes with scales, and the norms of what rounding took away."""

    def __init__(self, place: str, number: int, dim: int):
        table = read_file_rows(f"{place}/block={number}", ["item", "floats"])
        self.items = np.asarray(table.column("item").to_pylist(), dtype=str) if table.num_rows else np.empty(0, "U1")
        self.unit = _scaled(np.frombuffer(b"".join(table.column("floats").to_pylist()), np.float32).reshape(-1, dim)).astype(np.float64)
        self.scale = np.abs(self.unit).max(axis=1, initial=0) / 127
        self.codes = np.round(self.unit / self.scale[:, None]).astype(np.int8)
        self.err = np.linalg.norm(self.unit - self.codes * self.scale[:, None], axis=1)

    def __len__(self) -> int:
        return len(self.items)

    def left(self, rows: slice, sign: int = 1) -> np.ndarray:
        """Factors whose product with :meth:`right` is a bound of the cosine: code product + sign * (e + f + e * f)."""
        e = self.err[rows]
        ends = np.stack([sign * e, sign * (1 + e)], axis=1)
        return np.concatenate([self.codes[rows] * self.scale[rows, None], ends], axis=1, dtype=np.float32, casting="unsafe")

    def right(self, rows: slice) -> np.ndarray:
        f = self.err[rows]
        ends = np.stack([np.ones(len(f)), f], axis=1)
        return np.concatenate([self.codes[rows] * self.scale[rows, None], ends], axis=1, dtype=np.float32, casting="unsafe").T


def _tile(a: _Block, b: _Block, same: bool, heaps: Heaps) -> None:
    """Puts what block ``b`` has for the rows of block ``a`` on their heaps: products of codes bound every cosine; only pairs that may still be among a row's best are recomputed."""
    k = heaps.k
    for s in range(0, len(b), _COLS):
        cols = slice(s, min(s + _COLS, len(b)))
        rhs = b.right(cols)
        for t in range(0, len(a), _ROWS):
            rows = slice(t, min(t + _ROWS, len(a)))
            high = a.left(rows) @ rhs
            own = np.arange(max(t, s), min(rows.stop, cols.stop)) if same else ()
            if len(own):
                high[own - t, own - s] = -9
            bar = heaps.bar(rows)
            fresh = np.isneginf(heaps.score[rows, -1])
            if fresh.any() and high.shape[1] > k:  # lists that aren't full: at least the k-th lower bound will be reached
                low = a.left(rows, -1)[fresh] @ rhs
                if len(own):
                    low[(high == -9)[fresh]] = -9
                bar[fresh] = np.maximum(bar[fresh], np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] - _EPS)
            r, c = np.nonzero(high >= (bar - _EPS)[:, None].astype(np.float32))
            for at in range(0, len(r), 1 << 14):
                x, y = r[at : at + (1 << 14)] + t, c[at : at + (1 << 14)] + s
                ok = (x != y) if same else np.ones(len(x), bool)
                x, y = x[ok], y[ok]
                heaps.push(x, np.einsum("ij,ij->i", a.unit[x], b.unit[y]), b.items[y])


def _tiles(source: DataFrame, place: str, blocks: int, runs: int, k: int, dim: int, floor: float) -> DataFrame:
    """``a, b, cosine``: the k best of every row in each run of blocks. A task holds one block and reads the blocks of its run one after the other."""
    step = -(-blocks // runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                i, first = number % blocks, number // blocks * step
                a = _Block(place, i, dim)
                heaps = Heaps(len(a), k, floor)
                for j in range(first, min(first + step, blocks)):
                    _tile(a, a if i == j else _Block(place, j, dim), i == j, heaps)
                row, item, cosine = heaps.rows()
                for s in range(0, len(row), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.items[row[part]], pa.string()), pa.array(item[part], pa.string()), pa.array(cosine[part])], ["a", "b", "cosine"]
                    )

    work = source.sparkSession.range(0, blocks * -(-blocks // step), 1, blocks * -(-blocks // step))
    return work.mapInArrow(run, "a string, b string, cosine double")


def _blocks_of(source: DataFrame, chosen: DataFrame, dim: int, blocks: int, mixed: bool) -> str:
    """Writes the vectors, one per class under its least item, to a folder ``block=<n>`` per block in the shared folder."""
    rows = _classed(source, dim, True)
    if mixed:  # ids with several vectors: only the chosen one of each counts
        other = rows.select("item", "class").distinct().join(chosen, ["item", "class"], "left_anti")
        rows = rows.join(maybe_broadcast(stage(other, "other")), ["item", "class"], "left_anti")
    rows = _once_a_task(rows).withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
    rows = rows.repartition(2 * blocks, "block").groupBy("block", "class").agg(F.min("item").alias("item"), F.max("floats").alias("floats"))
    place = f"{shared_root(source.sparkSession)}/vectors-{uuid.uuid4().hex[:12]}"
    rows.select("block", "item", "floats").write.option("compression", "zstd").partitionBy("block").parquet(place)
    return place


def nearest_vectors(
    df: DataFrame, item: str, vector: str, k: int = 10, dim: int = 256, min_cosine: float = -1.0, block_rows: int = BLOCK_ROWS, min_blocks: int | None = None
) -> DataFrame:
    """``item, neighbor, cosine, rank``: for every item the ``k`` others of greatest cosine, at least ``min_cosine``.

    Vectors are cut into blocks by hash and written once to the shared folder. A tile task reads two blocks, quantises
    them to int8 with the norms of the rounding errors, and its products bound every cosine from above, pair by pair.
    Pairs whose bound reaches the k-th best cosine of their row so far (and ``min_cosine``) are recomputed in float64
    from the given values and put on the row's heap of k, so a task emits at most k rows per vector whatever the data,
    and the result equals brute force up to rounding. Cosines that agree to seven decimals count as equal and are ordered by item.

    Every pair of blocks is a tile, so time grows with the square of the vectors; what is shuffled are the vectors once
    and k rows per vector and run of blocks. Executors read the block files through pyarrow (file, hdfs, s3, gs).

    Vectors of other length than ``dim``, with null, NaN or infinite parts, or all zero take no part; null ids neither. A
    repeated id counts once (of several vectors the one of least class hash). Items of one direction form a class that is
    compared once, whatever its size, and stands with its first k + 1 items, all that any list can need; so copies never
    multiply. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    source = df.where(F.col(item).isNotNull() & F.col(vector).isNotNull())
    source = source.select(F.col(item).cast("string").alias("item"), F.col(vector).cast("array<float>").alias("vector"))
    once = _classed(source, dim, False).groupBy("item").agg(F.min("class").alias("class"), F.max("class").alias("_most"))
    once = stage(once, "classed")
    mixed = not small_enough(once.where(F.col("class") != F.col("_most")), 0)
    members = once.select("item", "class")
    sizes = members.groupBy("class").agg(F.min("item").alias("head"), F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes, "classes")
    total, cores = sizes.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-total // block_rows), min_blocks or (cores if total > 2000 else 1))
    runs = min(blocks, max(1, -(-2 * cores // blocks)))
    near = _tiles(source, _blocks_of(source, members, dim, blocks, mixed), blocks, runs, k, dim, min_cosine)

    copies = stage(members.join(maybe_broadcast(sizes.where("n > 1")), "class").select("item", "head", "n"), "copies")
    first = copies.withColumn("_n", F.row_number().over(Window.partitionBy("head").orderBy("item"))).where(F.col("_n") <= k + 1)
    first = stage(first.groupBy("head").agg(F.array_sort(F.collect_list("item")).alias("items")), "first")
    far = near.join(maybe_broadcast(first.select(F.col("head").alias("b"), "items")), "b", "left")
    far = far.select("a", "cosine", F.explode(F.coalesce("items", F.array("b"))).alias("neighbor"))
    own = first.select(F.col("head").alias("a"), F.lit(1.0).alias("cosine"), F.explode("items").alias("neighbor"))
    lists = far.unionByName(own).withColumn("n", F.row_number().over(Window.partitionBy("a")
        .orderBy(F.desc(F.round("cosine", DECIMALS)), "neighbor"))).where(F.col("n") <= k + 1)
    lists = stage(lists.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "neighbor", "cosine"))).alias("list")), "lists")
    more = copies.where("item <> head").select("item", F.col("head").alias("a"), "n")
    hot = lists.join(more.where(F.col("n") > HOT_CLASS).select("a").distinct(), "a", "left_semi")
    rest = more.where(F.col("n") <= HOT_CLASS).join(lists, "a").unionByName(more.where(F.col("n") > HOT_CLASS).join(maybe_broadcast(hot), "a"))
    every = lists.select(F.col("a").alias("item"), "list").unionByName(rest.select("item", "list"))
    every = every.select("item", F.slice(F.filter("list", lambda x: x["neighbor"] != F.col("item")), 1, k).alias("list"))
    every = every.select("item", F.posexplode("list").alias("at", "x"))
    return every.select("item", F.col("x.neighbor").alias("neighbor"), F.col("x.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))
