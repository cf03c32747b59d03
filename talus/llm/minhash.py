"""MinHash near-deduplication with one-permutation hashing.

A document's shingles are hashed once and dealt over ``BINS`` bins, of which the least hash is kept; empty
bins take the value of a bin drawn by hashing until one is full (optimal densification). ``BANDS`` bands of four
bins give buckets. Documents with equal shingle sets are one class. In each bucket candidates form a star
around one class, drawn at random; candidates are confirmed on full sets. Buckets that still
hold several components get stars around other classes, and what is then left is compared
completely: pair by pair in small buckets, in blocks that output confirmed links only in large ones. So no link between classes
that share a bucket is lost; at similarity 0.8 two classes share none with probability (1 - 0.8**4)**32 < 1e-7.

Null texts and texts without words are empty sets, linked with nothing. Rows with equal ids are one
node and stand or fall together; rows without an id are not compared, and dropping duplicates keeps them. Of linked documents the smallest
id stays, so ties do not arise. A very long text is one set: memory grows with its length. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import buffers, fresh, lower, materialize, mix, prefix_hash, signed, slices, small, span_hash, word_bounds, word_hashes
from talus.llm.components import components

BINS, BANDS = 128, 32
PERCENT = 80
STARS = 2
#: Cross-component pairs of buckets up to this size are listed: at most half as many a member.
LISTED = 12
BLOCK_FEW, BLOCK_MANY = 128, 256
#: Shingles of the two sides of a block, on average: blocks are smaller where sets are large.
FEW_SHINGLES, MANY_SHINGLES = 300_000, 1_000_000
#: Ids that are sent to all executors to pick texts; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000
_TRIES = 4096
_SIGNATURE = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"


def _draws() -> np.ndarray:
    """For each bin the bins it asks in turn when it is empty."""
    i = np.arange(BINS * _TRIES, dtype=np.uint64).reshape(BINS, _TRIES)
    return (mix(i * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) >> np.uint64(57)).astype(np.uint8)


_ASKS = _draws()
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_COEFF = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than ``size``, of all its words."""
    data, offs = buffers(column)
    starts, ends, first = word_bounds(lower(data), offs)
    prefix = prefix_hash(word_hashes(lower(data), starts, ends))
    count = np.diff(first)
    out = []
    full = span_hash(prefix, np.arange(max(0, len(starts) - size + 1)), np.arange(max(0, len(starts) - size + 1)) + size)
    for f, n in zip(first.tolist(), count.tolist(), strict=False):
        if n >= size:
            out.append(np.unique(full[f : f + n - size + 1]))
        elif n:
            out.append(span_hash(prefix, np.array([f]), np.array([f + n])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value a bin from sorted distinct hashes, densified."""
    at = np.searchsorted(shingles, _EDGES)
    upto = np.append(at[1:], len(shingles))
    full = at < upto
    take = np.where(full, at, 0)
    out = shingles[take]
    empty = np.flatnonzero(~full)
    for tries in (16, _TRIES):
        if not len(empty):
            break
        hit = full[_ASKS[empty, :tries]]
        found = hit.any(axis=1)
        first = hit.argmax(axis=1)
        out[empty[found]] = shingles[at[_ASKS[empty[found], first[found]]]]
        empty = empty[~found]
    for i in empty.tolist():  # not met in practice: the next full bin
        out[i] = shingles[at[np.flatnonzero(full)[0]]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A bucket for each band; the band's number is part of the hash."""
    rows = sig.reshape(BANDS, BINS // BANDS)
    return mix((rows * _COEFF).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, 128-bit set hash and buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, s1, s2, bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                s1.append(s.sum(dtype=np.uint64))
                s2.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                bands.append(signed(band_keys(signature(s))) if len(s) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(np.array(s1, np.uint64))), pa.array(signed(np.array(s2, np.uint64))), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "bands"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, _SIGNATURE)


def sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(rep, set) of the classes in ``classes(rep)``, from one text each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([signed(s) for s in shingle_sets(batch.column("text"), size)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("rep"), sets], ["rep", "set"])

    wanted = F.broadcast(classes) if small(classes, BROADCAST_IDS) else classes
    texts = docs.selectExpr("cast(doc_id as bigint) rep", "text").join(wanted, "rep", "left_semi")
    return texts.mapInArrow(run, "rep bigint, set array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _sized(percent: int, a: str = "n", b: str = "hub_n"):
    """Sizes that alone rule out enough likeness."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _star(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidates (a, b): in each bucket one class, drawn by ``turn``, with those of other components."""
    # written first, so that the join below is not bound to the aggregate's partitions and a large bucket can be split
    hub = materialize(members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "root")).alias("hub")), "hubs")
    pairs = members.join(hub, "bucket").where(F.col("hub.root") != F.col("root"))
    pairs = pairs.select(F.col("hub.rep").alias("h"), "rep", "n", F.col("hub.n").alias("hub_n")).where(_sized(percent))
    return pairs.select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct()


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their roots."""
    roots = components(links)
    now = members.select("bucket", "rep", "n").join(roots.select(F.col("a").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = now.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1").select("bucket", "size")
    return materialize(now.join(materialize(mixed, "buckets"), "bucket"), "mixed")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in large buckets: all but the commonest component's classes, in blocks, against all classes of the bucket."""
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root", "s")).alias("m"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    blocks = lambda k, most, s, shingles: F.greatest(F.lit(1), F.ceil(k / most), F.ceil(s / shingles)).cast("int")
    few = blocks(F.col("k") - F.col("m.k"), BLOCK_FEW, F.col("s") - F.col("m.s"), FEW_SHINGLES).alias("few")
    # written first, so that a large bucket can be split in the join below
    main = materialize(main.select("bucket", F.col("m.root").alias("main"), few, blocks(F.col("k"), BLOCK_MANY, F.col("s"), MANY_SHINGLES).alias("many")), "blocks")
    all_ = members.select("bucket", "rep", "root").join(main, "bucket").join(sets, "rep")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = all_.where("root <> main").select("bucket", place("few").alias("i"), span("many").alias("j"), F.lit(True).alias("few"), "rep", "root", "set")
    many = all_.select("bucket", place("many").alias("j"), span("few").alias("i"), F.lit(False).alias("few"), "rep", "root", "set")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["few"]].reset_index(drop=True), rows[~rows["few"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        of = np.concatenate([np.asarray(s, np.int64) for s in a["set"]])
        vocabulary, code = np.unique(of, return_inverse=True)
        held = np.zeros((len(vocabulary), len(a)), np.uint8)
        held[code, np.repeat(np.arange(len(a)), [len(s) for s in a["set"]])] = 1
        n, roots, out = held.sum(axis=0, dtype=np.int64), a["root"].to_numpy(), []
        for rep, root, s in zip(b["rep"], b["root"], b["set"], strict=True):
            s = np.asarray(s, np.int64)
            at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
            both = held[at[vocabulary[at] == s]].sum(axis=0, dtype=np.int64)
            out += [(min(rep, int(x)), max(rep, int(x))) for x in a["rep"].to_numpy()[(100 * both >= percent * (n + len(s) - both)) & (roots != root)]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    both = few.select("bucket", "i", "j", "few", "rep", "root", "set").union(many.select("bucket", "i", "j", "few", "rep", "root", "set"))
    return both.groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def link_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """(a, root) of every class with a link; ``classes`` has rep, n and bands."""
    exploded = classes.where("n > 0").select("rep", "n", F.explode("bands").alias("bucket"))
    held = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialize(exploded.join(held.select("bucket"), "bucket").select("bucket", "rep", "n", F.col("rep").alias("root")), "members")
    sets = materialize(sets_of(docs, members.select("rep").distinct(), size), "sets")
    links = materialize(_confirm(_star(members, 0, percent), sets, percent), "confirmed")
    mixed = _rooted(members, links)
    for turn in range(1, STARS + 1):
        links = materialize(links.union(_confirm(_star(mixed, turn, percent), sets, percent)).distinct(), "confirmed")
        mixed = _rooted(mixed, links)
    few, many = mixed.where(F.col("size") <= LISTED), mixed.where(F.col("size") > LISTED)
    left, right = few.select("bucket", F.col("rep").alias("a"), "n", F.col("root").alias("ra")), few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("hub_n"), F.col("root").alias("rb"))
    rest = left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sized(percent)).select("a", "b").distinct()
    links = links.union(_confirm(rest, sets, percent))
    if not many.isEmpty():
        links = links.union(_blocks(many, sets, percent))
    return components(links)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    signed_ = materialize(signatures(docs, size), "signatures")
    full = signed_.where("n > 0")
    classes = materialize(full.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("n", "s1", "s2", F.col("x.doc_id").alias("rep"), F.col("x.bands").alias("bands")), "classes")
    roots = link_classes(docs, classes, size, percent)
    named = classes.select("n", "s1", "s2", "rep").join(roots.withColumnRenamed("a", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    out = signed_.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns."""
    key = fresh("_gone", docs.columns)
    gone = materialize(near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    gone = F.broadcast(gone) if small(gone, BROADCAST_IDS) else gone
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
