"""Segments that share an anchor: how equal windows of different documents meet without a global sort.

A window is ``window`` consecutive symbols. Its anchor is the gram of ``gram`` symbols in it with the least
hash, the rightmost of equals, so equal windows have equal anchors wherever they stand. Consecutive windows whose
anchor stands at one place are a run of at most window - gram + 1; its symbols are a segment, in which no window
repeats. Windows are then compared only among segments of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import _BYTES, buffers, materialize, partitions, prefix_hash, release, settle, signed, slices, sliding_min, small, span_hash, word_bounds, word_hashes

#: Ids that are sent to all executors to pick texts; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000

_LOW = np.uint64(0xFFFFFFFF)
#: Anchors with more contents than this are dealt over shards of their own.
HOT_CLASSES = 1000
#: Slots of the bitmap of repeated anchors: at least sixteen an anchor, from 128 kB to 32 MB; beyond, more segments pass than need to.
LEAST_BITS, MOST_BITS = 20, 28
RUN = "anchor bigint, s1 bigint, doc_id bigint, start bigint, n bigint"


class Runs:
    """The runs of a batch of documents: document number, start, number of windows, anchor, segment hash."""

    def __init__(self, values: np.ndarray, first: np.ndarray, window: int, gram: int) -> None:
        empty = np.zeros(0, np.int64)
        self.window, self.gram = window, gram
        if len(values) < window:
            self.doc = self.at = self.start = self.n = empty
            self.anchor = np.zeros(0, np.uint64)
            return
        self.p1 = prefix_hash(values)
        i = np.arange(len(values) - gram + 1)
        h = span_hash(self.p1, i, i + gram)
        key = (h & ~_LOW) | (_LOW - i.astype(np.uint64))  # the later of equals is the smaller
        least = (_LOW - (sliding_min(key, window - gram + 1) & _LOW)).astype(np.int64)  # place of the anchor, one a window start
        begin, end = first[:-1], np.minimum(first[1:] - window + 1, len(least))
        inside = np.zeros(len(least) + 1, np.int8)
        some = begin < end
        np.add.at(inside, begin[some], 1)
        np.add.at(inside, end[some], -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        new[begin[some]] = True
        self.at = np.flatnonzero(new)
        self.doc = np.searchsorted(first, self.at, "right") - 1
        stop = np.minimum(np.append(self.at[1:], len(least)), end[self.doc])
        self.n = stop - self.at
        self.start = self.at - first[self.doc]
        self.anchor = h[least[self.at]]

    def slot(self, slots: int) -> np.ndarray:
        """From the low bits: the high ones are small in every anchor."""
        return (self.anchor & np.uint64(slots - 1)).astype(np.int64)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("doc", "at", "start", "n", "anchor"):
            setattr(self, name, getattr(self, name)[mask])

    def hashes(self) -> np.ndarray:
        """A hash of each segment's content: with the anchor's, 128 bits tell contents apart."""
        if not len(self.at):
            return self.at
        return signed(span_hash(self.p1, self.at, self.at + self.n + self.window - 1))


def bitmap(spark: SparkSession, repeated: DataFrame):
    """A broadcast bitmap with a slot set for every anchor of ``repeated(anchor)``: of bounded size, and without misses."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(repeated.count()).bit_length() + 4))
    slot = F.col("anchor").bitwiseAND((1 << bits) - 1) + 1  # Spark's bitmaps count from 1
    rows = repeated.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.k - 1) * 4096
        out[at : at + len(part)] = part
    return spark.sparkContext.broadcast(out)


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def symbols(column, words: bool):
    """(values, first symbol of each document, bytes) of a string column."""
    data, offs = buffers(column)
    if not words:
        return _BYTES[data], offs, data
    starts, ends, first = word_bounds(data, offs)
    return word_hashes(data, starts, ends), first, data


def _batch(arrays, names) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in arrays], names)


def anchor_rows(docs: DataFrame, words: bool, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id) of every run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            values, first, _ = symbols(batch.column("text"), words)
            r = Runs(values, first, window, gram)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield _batch([signed(r.anchor), ids[r.doc]], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint")


def run_rows(docs: DataFrame, words: bool, window: int, gram: int, bits) -> DataFrame:
    """The runs whose anchor is marked in ``bits``, with their segments' hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            values, first, _ = symbols(batch.column("text"), words)
            r = Runs(values, first, window, gram)
            if len(r.at):
                r.keep(marked(bits.value, r.slot(8 * len(bits.value))))
            s1 = r.hashes()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield _batch([signed(r.anchor), s1, ids[r.doc], r.start, r.n], ["anchor", "s1", "doc_id", "start", "n"])

    return docs.mapInArrow(run, RUN)


def repeated_segments(docs: DataFrame, words: bool, window: int, gram: int, across: bool) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes) of the segments whose anchor stands more than once.

    ``occurrences`` has RUN's columns; a class is one content, with its first place (rep_doc, rep_start) and
    count ``c``. With ``across``, only anchors of two documents or more count; otherwise also such as
    stand twice in one document.
    """
    spark = docs.sparkSession
    rows = anchor_rows(docs, words, window, gram)
    if across:
        repeated = rows.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 <> d1")
    else:
        repeated = rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    repeated = materialize(repeated.select("anchor"), "anchors")
    del rows
    bits = bitmap(spark, repeated)
    settle(spark)
    occurrences = materialize(run_rows(docs, words, window, gram, bits), "runs")
    classes = occurrences.groupBy("anchor", "s1", "n").agg(F.min(F.struct("doc_id", "start")).alias("rep"), F.count("*").alias("c"))
    classes = classes.join(repeated, "anchor", "left_semi")
    classes = classes.select("anchor", "s1", "n", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.start").alias("rep_start"), "c")
    classes = materialize(classes, "segments")
    release(repeated)
    settle(spark)
    return occurrences, classes


def with_shards(classes: DataFrame, windows: int) -> tuple[DataFrame, int]:
    """(``classes`` with ``shard``, the number of ordinary shards), each of about ``windows`` windows.

    An anchor's classes meet in one shard, unless there are very many: these are salted over further shards, numbered
    after the ordinary ones, whose results have to be united by window.
    """
    spark = classes.sparkSession
    hot = materialize(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where(F.col("k") > HOT_CLASSES), "hot")
    total, many = classes.agg(F.sum("n")).first()[0] or 0, hot.agg(F.sum("w")).first()[0] or 0
    shards = max(partitions(spark), -(-total // windows))
    salted = max(partitions(spark), -(-many // windows))
    flag = hot.select("anchor", F.lit(True).alias("_hot"))
    both = classes.join(F.broadcast(flag) if small(hot) else flag, "anchor", "left")
    shard = F.when(F.col("_hot"), F.lit(shards) + F.pmod(F.xxhash64("anchor", "s1"), F.lit(salted))).otherwise(F.pmod("anchor", F.lit(shards)))
    return both.withColumn("shard", shard.cast("bigint")).drop("_hot"), shards


def with_content(docs: DataFrame, classes: DataFrame, words: bool, window: int) -> DataFrame:
    """``classes`` (with ``shard``) with their content: bytes, or the words' 64-bit hashes as bytes."""
    names = ["shard", "anchor", "s1", "n", "rep_start", "c"]
    wanted = classes.groupBy("rep_doc").agg(F.collect_list(F.struct(*names)).alias("segments"))
    ids = classes.select(F.col("rep_doc").alias("doc_id")).distinct()
    here = docs.join(F.broadcast(ids), "doc_id", "left_semi") if small(ids, BROADCAST_IDS) else docs
    here = here.join(wanted, F.col("doc_id") == F.col("rep_doc")).select("doc_id", "text", "segments")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            values, first, data = symbols(batch.column("text"), words)
            whole = values if words else data
            lists = batch.column("segments")
            flat = lists.flatten()
            cols = {c: flat.field(c).to_numpy() for c in names}
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            ids = batch.column("doc_id").to_numpy()
            at = first[doc] + cols["rep_start"]
            content = [whole[a:b].tobytes() for a, b in zip(at.tolist(), (at + cols["n"] + window - 1).tolist(), strict=True)]
            yield pa.record_batch([*[pa.array(cols[c]) for c in names], pa.array(ids[doc]), pa.array(content, pa.binary())], [*names, "rep_doc", "content"])

    return here.mapInArrow(run, "shard bigint, anchor bigint, s1 bigint, n bigint, rep_start bigint, c bigint, rep_doc bigint, content binary")


def once(rows: pa.Table) -> pa.Table:
    """Each class once: rows of one document that stand in the input twice bring its classes twice."""
    keys = np.stack([rows.column(c).to_numpy() for c in ("anchor", "s1", "n")], axis=1)
    return rows.take(np.unique(keys, axis=0, return_index=True)[1])


def window_hashes(values: np.ndarray, second: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at ``at``."""
    return signed(span_hash(prefix_hash(values), at, at + window)), signed(span_hash(prefix_hash(second, 1), at, at + window, 1))


def ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches(*values: np.ndarray) -> np.ndarray:
    """Where each run begins in which all of ``values`` stay the same."""
    new = np.zeros(len(values[0]), bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def removal(docs: DataFrame, spans: DataFrame, run, schema: str) -> DataFrame:
    """Every row of ``docs`` with the spans of its document, through ``run``."""
    lists = spans.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(lists, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def covered(spans: pa.ListArray, lengths: np.ndarray) -> np.ndarray:
    """A mask over the symbols of a batch, document after document: those that its documents' spans cover."""
    base = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
    flat = spans.flatten()
    edge = np.zeros(int(lengths.sum()) + 1, np.int32)
    for name, step in (("start", 1), ("end", -1)):
        np.add.at(edge, base[doc] + np.minimum(flat.field(name).to_numpy(), lengths[doc]), step)
    return np.cumsum(edge[:-1]) > 0
