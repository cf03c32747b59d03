"""Exact vector search: ranking, pre-filters, relevance band, interleaved scopes, index tables.

Queries are a stated set: up to ``BLOCK`` of them are sent to all executors and multiplied with batches of vectors; beyond
that both sides are dealt into blocks, and each block of queries meets each block of vectors in a task. Batches and blocks
pass on their best ``k`` only. Filters belong before the search: a filter after it would not be the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.operators.vector_index import current, rebuild
from talus.store import stored

#: Queries that are sent to all executors, or stand in one block; vectors in one block, or gathered before they are multiplied.
BLOCK, VECTORS = 4096, 32_768
#: Distances that a kernel gets at once: some queries against a block's vectors, so that memory does not grow with the blocks.
CELLS = 1 << 18
#: Vectors that stay in the cache while all queries of a block are multiplied with them, for kernels that give a row a query.
TILE = 4096
#: Of the vectors, one in so many is a query.
EVERY = 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def probe_set(emb: DataFrame, every: int = EVERY, *extra: str) -> DataFrame:
    """A stated query set, which grows with the table: the vectors whose id is divisible by ``every``."""
    return emb.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), *extra)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def _unit(m: np.ndarray, rows: int = 1024) -> np.ndarray:
    """``m`` itself, its rows divided by their norms, ``rows`` at a time: no second matrix is made."""
    for i in range(0, len(m), rows):
        part = m[i : i + rows]
        n = np.sqrt((part * part).sum(axis=1, keepdims=True))
        part /= np.where(n == 0, 1.0, n)
    return m


def _distance(product: np.ndarray) -> np.ndarray:
    """Cosine distances to six decimals, in place of the products of unit vectors; no negative zero."""
    return np.abs(np.round(np.subtract(1.0, product, out=product), 6, out=product), out=product)


#: A model: texts to their vectors, as lists or as a matrix.
Embedder = Callable[[list[str]], list[list[float]] | np.ndarray]

#: What a search does with a block: (queries, vectors) as tables of arrays, and their distances, to the rows it gives.
Kernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _arrays(rows: pa.Table | pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {n: rows.column(n).to_numpy() if isinstance(rows, pa.Table) else rows.column(n).to_numpy(zero_copy_only=False) for n in names}


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``rows`` rows, none empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def search(probes: DataFrame, emb: DataFrame, kernel: Kernel, schema: str, of_query: tuple[str, ...] = (), of_vector: tuple[str, ...] = (), tile: int = VECTORS) -> DataFrame:
    """``kernel`` over all pairs of ``probes`` (query_id, query_vec, ...) and ``emb`` (vec_id, embedding, ...), block by block.

    With a ``tile`` below ``VECTORS`` a block's vectors are taken so many at a time, which is faster but gives more rows. Distances are cosine distances to six decimals, a zero norm counting as 1.
    """
    names_q, names_v = ["query_id", *of_query], ["vec_id", *of_vector]
    probes, emb = probes.select(*names_q, "query_vec"), emb.select(*names_v, "embedding")

    def meet(q: dict[str, np.ndarray], queries: np.ndarray, v: dict[str, np.ndarray], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = min(len(vectors), tile) if tile < VECTORS else len(vectors)
        few = max(1, CELLS // max(1, size))
        for j in range(0, max(1, len(vectors)), max(1, size)):
            some, of_some = vectors[j : j + size].T, {k: x[j : j + size] for k, x in v.items()}
            for i in range(0, max(1, len(queries)), few):
                distance = _distance(queries[i : i + few] @ some)
                found = kernel({k: x[i : i + few] for k, x in q.items()}, of_some, distance)
                yield pa.record_batch({k: pa.array(x) for k, x in found.items()})

    few = probes.limit(BLOCK + 1).toArrow()
    if len(few) <= BLOCK:
        q, queries = _arrays(few, names_q), _unit(_matrix(few.column("query_vec").combine_chunks(), len(few)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _gathered(batches, VECTORS):
                if len(queries):
                    yield from meet(q, queries, _arrays(part, names_v), _unit(_matrix(part.column("embedding").combine_chunks(), len(part))))

        return emb.mapInArrow(run, schema)
    rows, columns = -(-probes.count() // BLOCK), max(1, -(-emb.count() // VECTORS))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = probes.select(place("query_id", rows).alias("i"), spread(columns).alias("j"), F.lit(True).alias("asks"), *names_q, F.col("query_vec").alias("x"))
    right = emb.select(spread(rows).alias("i"), place("vec_id", columns).alias("j"), F.lit(False).alias("asks"), *names_v, F.col("embedding").alias("x"))

    def side(table: pa.Table, names: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return _arrays(table, names), _unit(_matrix(table.column("x").combine_chunks(), len(table)))

    def both(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        (q, queries), (v, vectors) = side(table.filter(asks), names_q), side(table.filter(pc.invert(asks)), names_v)
        if not len(queries) or not len(vectors):
            queries, vectors = np.zeros((len(queries), 1)), np.zeros((len(vectors), 1))
        return pa.Table.from_batches(meet(q, queries, v, vectors))

    return left.unionByName(right, allowMissingColumns=True).groupBy("i", "j").applyInArrow(both, schema)


def _best(k: int) -> Kernel:
    def kernel(q: dict[str, np.ndarray], v: dict[str, np.ndarray], distance: np.ndarray) -> dict[str, np.ndarray]:
        near = np.ones(distance.shape, bool)
        if distance.shape[1] > k:  # only what is as near as the k-th is sorted
            near = ~(distance > np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
        rows, at = np.nonzero(near)
        order = np.lexsort((v["vec_id"][at], distance[rows, at], rows))
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        rows, at = rows[order], at[order]
        return {"query_id": q["query_id"][rows], "vec_id": v["vec_id"][at], "distance": distance[rows, at]}

    return kernel


def distances(probes: DataFrame, emb: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance) of at least the best ``k`` of each query."""
    return search(probes, emb, _best(k), "query_id bigint, vec_id bigint, distance double", tile=TILE if k == 1 else VECTORS)


def _before(q: dict[str, np.ndarray], v: dict[str, np.ndarray], distance: np.ndarray) -> dict[str, np.ndarray]:
    """How many vectors stand before the one with distance ``d`` and ``id``, which does not stand before itself."""
    d = q["d"][:, None]
    n = np.count_nonzero(distance < d, axis=1)
    rows, at = np.divmod(np.flatnonzero(distance == d), max(1, distance.shape[1]))
    n += np.bincount(rows[v["vec_id"][at] < q["id"][rows]], minlength=len(n))
    # the one itself may be nearer here by the last of six decimals
    order = np.argsort(v["vec_id"])
    place = np.minimum(np.searchsorted(v["vec_id"], q["id"], sorter=order), len(order) - 1)
    at = order[place] if len(order) else place
    itself = (v["vec_id"][at] == q["id"]) & (distance[np.arange(len(n)), at] < q["d"]) if len(order) else False
    return {"query_id": q["query_id"], "n": n - itself}


def rank_of(probes: DataFrame, emb: DataFrame) -> DataFrame:
    """(query_id, rank) of the vector ``sought`` of ``probes(query_id, query_vec, sought)`` over the whole ranking: what stands before it is counted."""

    def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (_unit(_matrix(b.column(x), b.num_rows)) for x in ("query_vec", "embedding"))
            yield b.select(["query_id", "query_vec", "id"]).append_column("d", pa.array(_distance(np.einsum("ij,ij->i", a, c))))

    both = probes.join(emb.select(F.col("vec_id").alias("sought"), "embedding"), "sought").select("query_id", "query_vec", F.col("sought").alias("id"), "embedding")
    asked = stored(both.mapInArrow(apart, "query_id bigint, query_vec array<float>, id bigint, d double"), "sought")
    return search(asked, emb, _before, "query_id bigint, n bigint", ("d", "id"), tile=TILE).groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def first_relevant(probes: DataFrame, emb: DataFrame, relevant: str = "label", itself: bool = True) -> DataFrame:
    """(query_id, rank) of the first vector with the query's ``relevant`` value, over the whole ranking; queries without any have no row.

    First the nearest such vector is found and stored, then the vectors before it are counted: nothing is ranked as a whole, and neither
    search runs twice. Without ``itself`` the query's own vector is not relevant, but keeps its place in the ranking.
    """

    def nearest(q: dict[str, np.ndarray], v: dict[str, np.ndarray], distance: np.ndarray) -> dict[str, np.ndarray]:
        same = q["_of"][:, None] == v[relevant][None, :]
        if not itself:
            same &= q["query_id"][:, None] != v["vec_id"][None, :]
        masked = np.where(same, distance, np.inf)
        least = np.fmin.reduce(masked, axis=1, initial=np.inf)
        ids = np.where(masked == least[:, None], v["vec_id"], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        some = same.any(axis=1)
        return {"query_id": q["query_id"][some], "d": least[some], "id": ids[some]}

    def before(q: dict[str, np.ndarray], v: dict[str, np.ndarray], distance: np.ndarray) -> dict[str, np.ndarray]:
        ahead = (distance < q["d"][:, None]) | ((distance == q["d"][:, None]) & (v["vec_id"][None, :] < q["id"][:, None]))
        return {"query_id": q["query_id"], "n": ahead.sum(axis=1)}

    asked = probes.join(emb.select(F.col("vec_id").alias("query_id"), F.col(relevant).alias("_of")), "query_id")
    found = search(asked, emb, nearest, "query_id bigint, d double, id bigint", ("_of",), (relevant,))
    best = found.groupBy("query_id").agg(F.min(F.struct("d", "id")).alias("b")).select("query_id", "b.d", "b.id")
    counted = search(probes.join(stored(best, "nearest"), "query_id"), emb, before, "query_id bigint, n bigint", ("d", "id"))
    return counted.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def rank(found: DataFrame, k: int) -> DataFrame:
    """With ``rank`` by distance, ties by id; the best ``k``."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.where(F.col("rank") <= k)


def top_k(probes: DataFrame, emb: DataFrame, k: int = X.K_DEFAULT) -> DataFrame:
    return rank(distances(probes, emb, k), k)


def prefilter(chunks: DataFrame, degrees: list[str] | None = None, year: str | None = None, kind: str | None = None) -> DataFrame:
    """Chunks of any of the degrees (whole elements), of a year (prefix) and of a kind."""
    if degrees:
        chunks = chunks.where(F.arrays_overlap("degrees", F.array(*map(F.lit, degrees))))
    if year:
        chunks = chunks.where(F.startswith(F.lower("year"), F.lit(year.lower())))
    return chunks.where(F.col("kind") == kind) if kind else chunks


def band(ranked: DataFrame, floor: float = X.FLOOR, factor: float = X.CUT_FACTOR, least: int = X.K_LEAST, most: int = X.K_MOST, key: str | list[str] = "query_id") -> DataFrame:
    """Nothing if the best is beyond ``floor``; else what is within ``factor`` of it, ``least`` to ``most`` rows."""
    w = Window.partitionBy(key)
    best = F.min("distance").over(w)
    near = ranked.withColumn("_best", best).withColumn("_near", F.count_if(F.col("distance") <= F.col("_best") * F.lit(factor)).over(w))
    keep = F.greatest(F.lit(least), F.least(F.col("_near"), F.lit(most)))
    return near.where((F.col("_best") <= floor) & (F.col("rank") <= keep)).drop("_best", "_near")


def retrieve(questions: DataFrame, chunks: DataFrame, fallback: DataFrame | None = None, floor: float = X.FLOOR) -> DataFrame:
    """(query_id, vec_id, distance, rank, way) of ``questions(query_id, query_vec, advice)`` among ``chunks``.

    Way ``advice``: the best ones without a band, for a question that asks for advice. ``own``: the band of any other. ``fallback``:
    the band of the vector that ``fallback(query_id, query_vec)`` has for a question whose own band is empty, if it has one.
    """
    found = top_k(questions, chunks, X.K_MOST).join(questions.select("query_id", "advice"), "query_id")
    columns = ["query_id", "vec_id", "distance", "rank", "way"]
    advice = found.where("advice").withColumn("way", F.lit("advice")).select(columns)
    own = band(found.where("not advice"), floor).withColumn("way", F.lit("own")).select(columns)
    out = advice.unionByName(own)
    if fallback is None:
        return out
    empty = questions.where("not advice").join(own.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    again = band(top_k(fallback.join(empty, "query_id"), chunks, X.K_MOST), floor).withColumn("way", F.lit("fallback"))
    return out.unionByName(again.select(columns))


def incomplete_guides(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, name) of the guides that a question names as whole words and of which ``context`` lacks parts.

    ``questions(query_id, question)``; ``context(query_id, origin, name, degrees, chunk_index, total_chunks)``. A unit is a name with
    its degrees. Questions for data that every part's header has are left out.
    """
    from talus.functions.text import normalize, strings, tokens
    from talus.operators.contain import bounded

    part = context.where("origin = 'guia'").groupBy("query_id", "name", "degrees").agg(F.count_distinct("chunk_index").alias("got"), F.max("total_chunks").alias("of"))
    asked = questions.where(~F.arrays_overlap(tokens(F.col("question")), strings(X.PLAN_WORDS))).select("query_id", normalize(F.col("question")).alias("_said"))
    return part.where("got < of").join(asked, "query_id").where(bounded(F.col("_said"), normalize(F.col("name")))).select("query_id", "name").distinct()


def prompts(questions: DataFrame, context: DataFrame, instructions: str) -> DataFrame:
    """(query_id, prompt): instructions, catalogue, scope, last questions, context and question; what is empty is left out.

    ``questions(query_id, question, catalogue, scope, earlier)``, the last three being arrays or null; ``context(query_id, place, name,
    degrees, text)``, a few rows a question.
    """
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    under = lambda heading, a: F.concat(F.lit(heading + "\n"), listed(a), F.lit("\n\n"))
    part = F.struct("place", F.concat("name", F.lit(" — "), F.array_join("degrees", ", "), F.lit("\n"), "text").alias("t"))
    found = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("_context"))
    scope = F.when(F.size("scope") == 1, F.concat(F.lit(X.ONE_SCOPE), F.col("scope")[0], F.lit(".\n\n"))).otherwise(under(X.SCOPES_HEADING, F.col("scope")))
    last = F.slice("earlier", F.greatest(F.size("earlier") - (X.REMEMBERED - 1), F.lit(1)), X.REMEMBERED)
    prompt = F.concat(
        F.lit(instructions + "\n\n"),
        F.when(some("catalogue"), under(X.CATALOGUE_HEADING, F.col("catalogue"))).otherwise(""),
        F.when(some("scope"), scope).otherwise(""),
        F.when(some("earlier"), under(X.EARLIER_HEADING, last)).otherwise(""),
        F.lit("CONTEXTO:\n"), F.coalesce("_context", F.lit(X.NO_CONTEXT)),
        F.lit("\n\nPREGUNTA: "), F.coalesce("question", F.lit("")), F.lit("\n\nRESPUESTA:"),
    )
    return questions.join(found, "query_id", "left").select("query_id", prompt.alias("prompt"))


def interleave(scoped: DataFrame, keys: list[str], most: int = X.K_MOST) -> DataFrame:
    """Round robin by rank over scopes, each chunk once, at most ``most`` a query."""
    w = Window.partitionBy("query_id", *keys).orderBy("rank", "scope")
    once = scoped.withColumn("_seen", F.row_number().over(w)).where("_seen = 1").drop("_seen")
    v = Window.partitionBy("query_id").orderBy("rank", "scope")
    return once.withColumn("position", F.row_number().over(v)).where(F.col("position") <= most)


def resolve_names(wanted: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """(wanted, name) by exact normalised name, else by every name that contains it; a name that is in none raises, unless not ``strict``."""
    from talus.functions.text import normalize

    from talus.operators.contain import hits

    left = wanted.select("wanted", normalize(F.col("wanted")).alias("_w"))
    right = catalogue.select("name", normalize(F.col("name")).alias("_n"))
    exact = left.join(right, F.col("_w") == F.col("_n"))
    other = left.join(exact.select("_w").distinct(), "_w", "left_anti")
    held = hits(right.select(F.col("_n").alias("text")), other.select(F.col("_w").alias("name"))).toDF("_n", "_w", "_times")
    found = exact.select("wanted", "name").union(other.join(held, "_w").join(right, "_n").select("wanted", "name"))
    if not strict:
        return found
    return wanted.select("wanted").join(found, "wanted", "left").select("wanted", F.coalesce("name", F.raise_error(F.concat(F.lit("not in the catalogue: "), "wanted")).cast("string")).alias("name"))


def fidelity(exact: DataFrame, got: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were got, by query."""
    hit = exact.select("query_id", "vec_id").join(got.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("fidelity"))


def norm_check(emb: DataFrame) -> DataFrame:
    """Least and largest norm and whether the vectors are normalised."""
    n = emb.select(norm(F.col("embedding")).alias("n"))
    return n.agg(F.round(F.min("n"), 6).alias("least"), F.round(F.max("n"), 6).alias("largest"), ((F.stddev_pop("n") < 1e-5) & (F.abs(F.avg("n") - 1) < 1e-5)).alias("normalised"))


def hash_embedder(texts: list[str], dims: int = 64) -> np.ndarray:
    """A stand-in for a model: the words' hashed directions, summed. Any function of this shape can be given to ``embed``."""
    words = [t.split() for t in texts]
    hashes = np.fromiter((_word_hash(w) for ws in words for w in ws), np.int64, sum(map(len, words)))
    cell = np.repeat(np.arange(len(texts)), np.array([len(ws) for ws in words], np.int64)) * dims + hashes % dims
    out = np.bincount(cell, np.where(hashes & (1 << 20), 1.0, -1.0), len(texts) * dims)
    return _unit(out.reshape(len(texts), dims))


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def embed(df: DataFrame, text: str = "text", embedder: Embedder = hash_embedder, prefix: str = X.PASSAGE_PREFIX, batch: int = 64) -> DataFrame:
    """``df`` with ``embedding``, the embedder being called for ``batch`` texts at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = np.asarray(embedder([prefix + (t or "") for t in part.column(text).to_pylist()]), np.float32)
                ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield part.append_column("embedding", pa.ListArray.from_arrays(ends, vectors.ravel()))

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def write_index(chunks: DataFrame, path: str, model: str, prefix: str = X.PASSAGE_PREFIX, metric: str = "cosine") -> None:
    """Rebuild an index; readers see the old one until the new one is written and checked (``vector_index``)."""
    rebuild(chunks, path, model, prefix, metric)


def read_index(spark, path: str, model: str, prefix: str = X.PASSAGE_PREFIX) -> DataFrame:
    """The vectors of an index; raises if it was made with another model or prefix, accepts a plain table that does not say."""
    found = current(spark, path)
    if found is None:
        return spark.read.parquet(path)
    about, vectors = found
    if (about["model"], about["prefix"]) != (model, prefix):
        raise ValueError(f"the index was made with {about['model']} and {about['prefix']!r}, not {model} and {prefix!r}")
    return vectors
