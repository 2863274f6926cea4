"""Vector and keyword search: encoders, dense, BM25 and hybrid top-k, with routes and filters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.operators.topk import DECIMALS, Heaps
from quillspan.runtime import parallelism, read_file_rows, shared_root, stage, stage_counted, unstage

#: BM25 saturation and length weight, and the constant of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60
#: More places than an index block has chunks.
BLOCK_SPAN = 1 << 32
#: Rows that are multiplied with a block of queries at once.
STEP = 4096
#: Norms below this are taken as this.
NORM_FLOOR = 1e-12
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "


class Encoder(Protocol):
    """A text encoder; loaded once per Python worker."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Stand-in without a model: signed feature hashing of words and word pairs. Deterministic, and not a language model."""

    def __init__(self, dim: int = S.VECTOR_DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            words = text.lower().split()
            for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(gram)
                out[row, h % self.dim] += 1 if h >> 63 else -1
        return out


def embed(df: DataFrame, text: str, encoder: Encoder | None = None, prefix: str = DOCUMENT_PREFIX, out: str = "vector") -> DataFrame:
    """Adds the vector of a text, cut to the model's width and scaled to length 1. Null texts count as empty."""
    model = encoder or HashingEncoder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = model.encode([prefix + (t or "") for t in s]).astype(np.float64)
            yield pd.Series(list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), NORM_FLOOR)).astype(np.float32)))

    return df.withColumn(out, run(F.col(text)))


def unit(v: Column, dim: int) -> Column:
    """The first ``dim`` numbers of a vector, scaled to length 1."""
    head = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x)), F.lit(NORM_FLOOR))
    return F.transform(head, lambda x: x / norm)


def sound(vector: str, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, none null or NaN, not all zero."""
    v = F.col(vector)
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def dense_topk(
    rows: DataFrame, queries: DataFrame, k: int, row_id: str = "id", query_id: str = "query_id", dim: int | None = None,
        block: int = 1024, part: str | None = None,
    questions_a_pass: int = 100_000,
) -> DataFrame:
    """``query_id, id, score, rank``: the k rows of greatest cosine per query, exactly; ``rows(id, vector)``, ``queries(query_id, vector)``.

    A stated query set against all rows, in blocks: the queries are written once in blocks of ``block`` to the shared
    folder, and each task reads them against its own rows as matrix products, keeping a heap of k per query. So no pair is
    materialised and the rows aren't shuffled; a task emits k rows per query, and the final ranks are taken over those. There
    are as many tasks as cores, at most.
    Query sets of more than ``questions_a_pass`` are taken in several passes, which bounds the heaps of a task. With
    ``part`` (a bigint column of both sides) only rows and queries of the same part meet, and ``part`` comes out as well; a
    query may stand in several. Ties, to seven decimals, go to the lesser id; vectors of another length than ``dim``, with
    null or NaN parts, and zero vectors take no part; an empty side gives no rows.
    """
    dim = dim or S.VECTOR_DIM
    spark = rows.sparkSession
    own = F.col(part).cast("long") if part else F.lit(0).cast("long")
    q = queries.where(sound("vector", dim)).select(F.col(query_id).alias("q"), own.alias("part"), F.col("vector").cast("array<double>").alias("v"))
    q = stage(q, "questions")
    blocks = max(1, -(-q.count() // block))
    place = f"{shared_root(spark)}/questions-{uuid.uuid4().hex[:12]}"
    # queries of one part lie together, so a block holds few parts
    q.repartitionByRange(blocks, "part", "q").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(place)
    r = rows.where(sound("vector", dim)).select(F.col(row_id).alias("id"), own.alias("part"), F.col("vector").cast("array<double>").alias("v"))
    r = r.coalesce(spark.sparkContext.defaultParallelism)  # a task emits k rows per query, so what is shuffled must not grow with the files
    id_type, q_type = rows.schema[row_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    near, step = None, max(1, questions_a_pass // block)
    for first in range(0, blocks, step):
        found = r.mapInArrow(_dense_pass(place, range(first, min(first + step, blocks)), k, dim), f"query_id {q_type}, part long, id {id_type}, score double")
        near = found if near is None else near.unionByName(found)
    keys = ["query_id", "part"] if part else ["query_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", DECIMALS)), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "id", "score", "rank")


def _dense_pass(place: str, blocks: range, k: int, dim: int):
    def matrix(column) -> np.ndarray:
        v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        u = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return u / np.linalg.norm(u, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for n in blocks:
            t = read_file_rows(f"{place}/block={n}", ["q", "part", "v"])
            if t.num_rows:
                asked.append((t.column("q"), t.column("part").to_numpy(), matrix(t.column("v")), Heaps(t.num_rows, k)))
        kind = None
        for b in batches:
            kind = b.column(0).type
            ids, parts, u = np.asarray(b.column(0).to_pylist()), b.column(1).to_numpy(), matrix(b.column(2)) if b.num_rows else None
            for _, own, v, heaps in asked:
                mine = np.flatnonzero(np.isin(parts, own)) if b.num_rows else np.empty(0, int)
                for some in (mine[i : i + STEP] for i in range(0, len(mine), STEP)):
                    cos = v @ u[some].T
                    cos[own[:, None] != parts[some][None, :]] = -np.inf
                    bar = heaps.bar(slice(None))
                    if len(some) > k:
                        bar = np.maximum(bar, np.partition(cos, len(some) - k, axis=1)[:, len(some) - k])
                    i, j = np.nonzero((cos >= (bar - 10.0**-DECIMALS)[:, None]) & np.isfinite(cos))
                    heaps.push(i, cos[i, j], ids[some][j])
        for q, own, _, heaps in asked:
            i, item, score = heaps.rows()
            if len(i):
                yield pa.RecordBatch.from_arrays([q.combine_chunks().take(pa.array(i)), pa.array(own[i]),
                    pa.array(item.tolist(), kind), pa.array(score)], ["query_id", "part", "id", "score"])

    return run


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def bm25_topk(
    chunks: DataFrame, queries: DataFrame, k: int | Column, item: str = "chunk_id", text: str = "text_payload", query_id: str = "query_id",
        query: str = "query_text", group: str | None = None, wanted: Column | None = None, within: tuple[str, Column] | None = None,
    block: int = 16_384, questions_a_block: int = 512,
) -> DataFrame:
    """``query_id, item, score`` of the k chunks that each query's words fit best, by BM25 to five decimals; equal scores go to the lesser item.

    ``chunks`` has distinct items; repeated query words count once. With ``group`` (a string column of the chunks) there are k
    chunks for each query and group, and the group comes out as well: of the groups in ``wanted``, an array of the queries, or
    of all. ``within`` names a column of numbers of the chunks and a number of the query; a query that has one meets only
    the chunks of that number. ``k`` may differ from query to query.

    The words of the queries that a chunk holds are counted where its text is read, and this index is written once to the
    shared folder, in blocks of ``block`` chunks by item. Each task takes a block of queries through the index and holds k
    chunks for each query and group, so neither the postings nor the pairs that share a word are shuffled. Only where there
    are fewer blocks of queries than shuffle partitions is the index shared among several tasks, whose bests are merged.
    """
    spark = chunks.sparkSession
    place = f"{shared_root(spark)}/keywords-{uuid.uuid4().hex[:12]}"
    asks = (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k")
    groups = (F.lit(None) if wanted is None else wanted).cast("array<string>").alias("g")
    number = (F.lit(None) if within is None else within[1]).cast("long").alias("d")
    words = queries.select(F.col(query_id).alias("q"), tokens(F.col(query)).alias("t"), F.struct(asks, groups, number).alias("x"))
    words = words.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), F.max("x").alias("x")).select("q", "t", "x.*")
    words, asked = stage_counted(words.where("size(t) > 0 and k > 0"), "questions", n=F.count(F.lit(1)))
    terms = words.select(F.explode("t").alias("term")).distinct()
    terms.write.parquet(f"{place}/terms")
    question_blocks = max(1, -(-asked["n"] // questions_a_block))
    words.repartitionByRange(question_blocks, "q").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{place}/questions")

    own = (F.col(group) if group else F.lit("")).cast("string").alias("g")
    at = (F.col(within[0]) if within else F.lit(None)).cast("long").alias("d")
    kind = chunks.schema[item].dataType.simpleString()
    held = chunks.select(F.col(item).alias("item"), own, at, tokens(F.col(text)).alias("t"))
    held = held.mapInArrow(_index_words(f"{place}/terms"), f"item {kind}, g string, d long, dl int, term array<int>, tf array<int>")
    held, seen = stage_counted(held, "index", n=F.count(F.lit(1)), dl=F.avg("dl"))
    found = held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found.write.parquet(f"{place}/df")
    blocks = max(1, -(-seen["n"] // block))
    some = held.where(F.size("term") > 0).repartitionByRange(blocks, "item").withColumn("block", F.spark_partition_id())
    some.sortWithinPartitions("block", "item").write.option("compression", "zstd").partitionBy("block").parquet(f"{place}/index")
    unstage(held)

    shares = min(blocks, -(-parallelism(spark) // question_blocks))
    tasks = question_blocks * shares
    q_type = queries.schema[query_id].dataType.simpleString()
    best = spark.range(0, tasks, 1, tasks).mapInArrow(_keyword_pass(place, shares, blocks, seen["n"], seen["dl"] or 1.0, bool(group)),
        f"query_id {q_type}, g string, item {kind}, score double, k int")
    best = best.withColumn("score", F.round("score", 5))
    if shares > 1:
        w = Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "item")
        best = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("k"))
    return best.select("query_id", *([F.col("g").alias(group)] if group else []), "item", "score")


def _index_words(folder: str):
    """Rows ``item, g, d, t`` with the words of ``folder`` that they hold and how often, in place of ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(folder)
        size = max(1, len(known))
        for b in batches:
            t = b.column(3)
            ids = pc.index_in(t.flatten(), value_set=known)
            key = pc.list_parent_indices(t).to_numpy(zero_copy_only=False).astype(np.int64) * size + pc.fill_null(ids, -1).to_numpy(zero_copy_only=False)
            key, tf = np.unique(key[pc.is_valid(ids).to_numpy(zero_copy_only=False)], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=b.num_rows)))).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % size, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pc.list_value_length(t).cast(pa.int32()), *made],
                ["item", "g", "d", "dl", "term", "tf"])

    return run


def _words(folder: str) -> pa.Array:
    """The words in a folder, of which each has its place in this list as its number."""
    c = read_file_rows(folder, ["term"]).column("term")
    return pa.concat_arrays(c.chunks).cast(pa.string()) if c.num_chunks else pa.array([], pa.string())


def _keyword_pass(place: str, shares: int, blocks: int, n: int, avgdl: float, grouped: bool):
    """Of task i the queries of block i // shares, taken through every index block whose number leaves i % shares."""

    def whole(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                yield from one(*divmod(task, shares))

    def one(questions: int, share: int) -> Iterator[pa.RecordBatch]:
        asked = read_file_rows(f"{place}/questions/block={questions}", ["q", "t", "k", "g", "d"])
        if not asked.num_rows:
            return
        known = _words(f"{place}/terms")
        idf = np.zeros(len(known))
        counted = read_file_rows(f"{place}/df", ["term", "df"])
        if counted.num_rows:
            df = counted.column("df").to_numpy()
            idf[counted.column("term").to_numpy()] = np.log(1 + (n - df + 0.5) / (df + 0.5))
        t = whole(asked.column("t"))
        ids, ends = pc.index_in(t.flatten(), value_set=known).to_numpy(), np.cumsum(pc.list_value_length(t).to_numpy())
        words = [w.tolist() for w in np.split(ids, ends[:-1])]
        most, wanted, number = (asked.column(c).to_pylist() for c in ("k", "g", "d"))
        best: list[dict] = [{} for _ in words]  # of each query and group the scores held, from the greatest, and the places of their chunks
        for block in range(share, blocks, shares):
            x = read_file_rows(f"{place}/index/block={block}", ["g", "d", "dl", "term", "tf"])
            size = x.num_rows
            if not size:
                continue
            term, tf = (whole(x.column(c)) for c in ("term", "tf"))
            row = pc.list_parent_indices(term).to_numpy()
            term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
            order = np.argsort(term.astype(np.uint16) if len(known) < 1 << 16 else term, kind="stable")  # of 16 bits without comparisons
            term, tf, row = term[order], tf[order], row[order].astype(np.int64)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * x.column("dl").to_numpy()[row] / avgdl))
            start = np.searchsorted(term, np.arange(len(known) + 1))
            common = np.flatnonzero(np.diff(start) > size // 16)  # cheaper to add as whole columns
            columns = {w: np.bincount(row[start[w] : start[w + 1]], weight[start[w] : start[w + 1]], size) for w in common.tolist()}
            codes = whole(x.column("g")).dictionary_encode()
            code = pc.fill_null(codes.indices, -1).to_numpy()
            names = dict(enumerate(codes.dictionary.to_pylist())) | ({-1: None} if codes.null_count else {})
            rows_of = {name: np.flatnonzero(code == c) for c, name in names.items()} if grouped else {"": None}
            d = whole(x.column("d"))
            by_number = np.flatnonzero(pc.is_valid(d).to_numpy(zero_copy_only=False))
            by_number = by_number[np.argsort(numbers := d.drop_null().to_numpy(), kind="stable")]
            numbers = np.sort(numbers)
            sums = np.zeros(size)
            for i, own in enumerate(words):
                only = None
                if number[i] is not None:
                    only = by_number[slice(*np.searchsorted(numbers, [number[i], number[i] + 1]))]
                    if not len(only):
                        continue
                sums[:] = 0
                for w in own:
                    if (column := columns.get(w)) is not None:
                        sums += column
                    else:
                        sums[row[start[w] : start[w + 1]]] += weight[start[w] : start[w + 1]]
                for name in rows_of if wanted[i] is None else wanted[i]:
                    if name not in rows_of:
                        continue
                    rows = rows_of[name]
                    if only is not None:
                        rows = only if rows is None else only[np.isin(code[only], code[rows[:1]])]
                    _keep(best[i], name, most[i], sums if rows is None else sums[rows], rows, block * BLOCK_SPAN)
        yield from named(asked.column("q"), most, best, range(share, blocks, shares))

    def named(q, most: list[int], best: list[dict], mine: range) -> Iterator[pa.RecordBatch]:
        lanes = [(i, name, score, at) for i, b in enumerate(best) for name, (score, at) in b.items()]
        if not lanes:
            return
        sizes = [len(x[2]) for x in lanes]
        i, at = np.repeat([x[0] for x in lanes], sizes), np.concatenate([x[3] for x in lanes])
        g = pa.array([x[1] for x in lanes], pa.string()).take(pa.array(np.repeat(np.arange(len(lanes)), sizes)))
        score = pa.array(np.concatenate([x[2] for x in lanes]))
        own, k, q = at // BLOCK_SPAN, np.asarray(most, np.int32), whole(q)
        for block in mine:
            here = np.flatnonzero(own == block)
            if len(here):
                items = whole(read_file_rows(f"{place}/index/block={block}", ["item"]).column("item"))
                take = pa.array(here)
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i[here])), g.take(take), items.take(pa.array(at[here] % BLOCK_SPAN)),
                    score.take(take), pa.array(k[i[here]])], ["query_id", "g", "item", "score", "k"])

    return run


def _keep(best: dict, name: str | None, k: int, sums: np.ndarray, rows: np.ndarray | None, first: int) -> None:
    """Adds a block's sums to the k best of a group. Blocks, and rows in a block, come by item, so what comes later gives way among equals."""
    score, at = best.get(name, (np.empty(0), np.empty(0, np.int64)))
    bar = score[-1] if len(score) >= k else -1.0
    hit = np.flatnonzero(sums > max(0.0, bar - 1e-5))
    new = np.round(sums[hit], 5)
    hit, new = hit[new > bar], new[new > bar]
    if len(hit):
        score, at = np.concatenate([score, new]), np.concatenate([at, first + (hit if rows is None else rows[hit])])
        top = np.argsort(-score, kind="stable")[:k]
        best[name] = score[top], at[top]


def fuse_ranks(lists: list[DataFrame], k: int, constant: int = RRF, depth: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of several ``query_id, item, score`` lists: sum of 1 / (constant + rank), k best per query (and ``group``).

    Of each list the first ``depth`` items take part; they are cut before anything is fused, so a list may be as long as the table.
    """
    keys = ["query_id", *(group or [])]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "item")
    cut = lambda x: x.where(F.col("r") <= depth) if depth else x
    parts = [cut(x.withColumn("r", F.row_number().over(w))).select(*keys, "item", (1 / (F.lit(constant) + F.col("r"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(*keys, "item").agg(F.sum("s").alias("score"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def per_route(hits: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The ``limit`` best rows of each query and route."""
    w = Window.partitionBy("query_id", "table_route").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def ann_partitions(rows: int, threshold: int = 50_000) -> int:
    """Cells of an inverted-file index for a table of ``rows`` vectors; 0 up to ``threshold``, where a scan is exact and fast."""
    return 0 if rows <= threshold else max(16, rows // 4096)


def fit_cells(rows: DataFrame, cells: int, row_id: str = "id", dim: int | None = None, sample: int = 65_536, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``cells`` cells by spherical k-means over at most ``sample`` vectors (those of least hash of their id); fewer centres where there are fewer vectors."""
    dim = dim or S.VECTOR_DIM
    picked = rows.where(sound("vector", dim)).select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64(row_id).alias("h")).orderBy("h").limit(sample)
    v = np.asarray([r["v"] for r in picked.select("v").collect()]).reshape(-1, dim)  # bounded by ``sample``
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), NORM_FLOOR)
    centres = v[np.random.default_rng(11).permutation(len(v))[:cells]]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1) if len(v) else np.empty(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > NORM_FLOOR, sums / np.maximum(norms, NORM_FLOOR), centres)
    return centres


def with_cells(df: DataFrame, centres: np.ndarray, probes: int = 1, out: str = "cell") -> DataFrame:
    """Rows with their ``probes`` nearest cells, one row per cell."""

    @F.pandas_udf("array<bigint>")
    def near(vectors: pd.Series) -> pd.Series:
        v = np.stack(vectors.to_list()) if len(vectors) else np.empty((0, centres.shape[1]))
        cos = v @ centres.T
        n = min(probes, cos.shape[1])
        return pd.Series(list(np.argpartition(-cos, n - 1, axis=1)[:, :n].astype(np.int64))) if n else pd.Series([[]] * len(v), dtype=object)

    return df.withColumn(out, F.explode(near(F.col("vector").cast("array<double>"))))


def ann_topk(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "id", query_id: str = "query_id", dim: int | None = None,
    cells: int | None = None, probes: int | None = None) -> DataFrame:
    """``query_id, id, score, rank`` by an inverted-file index: every row lies in its nearest cell, a query is compared with the rows of its ``probes`` nearest cells.

    Centres are fitted on a bounded sample (:func:`fit_cells`), all rows are indexed. ``cells`` is by default what
    :func:`ann_partitions` gives, where 0 means an exact search; ``probes`` is by default 40 % of the cells, at least 8.
    """
    dim = dim or S.VECTOR_DIM
    cells = ann_partitions(rows.count()) if cells is None else cells
    if not cells:
        return dense_topk(rows, queries, k, row_id, query_id, dim)
    usable = rows.where(sound("vector", dim))
    centres = fit_cells(usable, cells, row_id, dim)
    if not len(centres):
        return dense_topk(rows, queries, k, row_id, query_id, dim)
    probes = probes or max(8, -(-2 * len(centres) // 5))
    found = dense_topk(with_cells(usable, centres), with_cells(queries.where(sound("vector", dim)), centres, probes), k, row_id, query_id, dim, part="cell")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DECIMALS)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("cell", "part")
