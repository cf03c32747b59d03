"""Line deduplication with two Bloom filters.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least ``shortest`` code points that
``documents`` documents hold lose all their lines, except in the document that is kept (the largest or the smallest id).

1. ``line_keys`` hashes each document's distinct long keys to 16 bytes and writes these once; no later step but the last reads texts.
2. ``twice_seen`` builds a filter of keys seen once and one of keys seen twice. Each task fills both for its share and sends the set slots by
   segment of 65,536 slots, as lists of offsets or as bitmaps, whichever is smaller; a segment is folded row by row. What two shares have both
   seen once is seen twice, so a repeated key is never missed.
3. Only keys that the second filter suspects are shuffled, as (key, document); counting distinct documents confirms them exactly, and the
   document to keep is chosen there. Spark sums a key's documents in parts, so a very common line is no hot spot.
4. The commonest confirmed keys, ``MOST_KEYS`` at most, are broadcast; the others, where there are more, are joined to their documents.

The broadcast filter has 16 slots a key up to ``MOST_BITS`` (64 MB). Beyond some 30 million keys more keys are suspected and shuffled than need to
(24 bytes each); results stay the same. Two keys count as equal if their 128-bit BLAKE2b digests are.

A null or empty text is one empty line. Rows without an id lose nothing and count for nothing. Rows of equal id are one document: its lines count
once, and it keeps or loses them in all its rows. Ties do not arise, as one id is the largest. A very long text costs its own length in memory. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import doc_columns, materialize, release, slices

SHORTEST, DOCUMENTS = 40, 5
#: Slots of a filter: sixteen a key, from 8 kB to 64 MB.
LEAST_BITS, MOST_BITS = 16, 29
#: Slots of a segment; its bitmap has 8,192 bytes, and shorter rows are lists of 16-bit offsets.
SEGMENT_BITS = 16
DENSE = 1 << (SEGMENT_BITS - 3)
#: Keys whose slots a task gathers before it sends them, and confirmed keys that are broadcast at most.
SHARE, MOST_KEYS = 1 << 20, 200_000
KEY = 16


def long_key(line: bytes, shortest: int) -> bytes | None:
    """The line's digest, or None if its key is too short."""
    line = line.strip().lower()
    if len(line) < shortest or (len(line) < 4 * shortest and not line.isascii() and len(line.decode("utf-8", "replace")) < shortest):
        return None
    return blake2b(line, digest_size=KEY).digest()


def line_keys(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, keys): the digests of a row's distinct long keys, one after the other. Rows without any are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text is not None and i is not None and len(text) >= shortest:
                    found = {k for line in text.split(b"\n") if len(line) >= shortest and (k := long_key(line, shortest))}
                    if found:
                        ids.append(i)
                        keys.append(b"".join(found))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "keys"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, keys binary")


def _halves(column: pa.Array) -> np.ndarray:
    """The digests of a batch as two 64-bit halves each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Both slots of each key."""
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def _packed(slots: np.ndarray) -> dict[int, bytes]:
    """Sorted slots by segment: 16-bit offsets, or the segment's bitmap where that is smaller."""
    out = {}
    if len(slots):
        segment = slots >> SEGMENT_BITS
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for part in np.split(slots, cuts):
            low = (part & ((1 << SEGMENT_BITS) - 1)).astype(np.uint16)
            out[int(part[0] >> SEGMENT_BITS)] = low.tobytes() if 2 * len(low) < DENSE else _unpacked(low.tobytes()).tobytes()
    return out


def _unpacked(row: bytes) -> np.ndarray:
    """A segment's bitmap."""
    if len(row) == DENSE:
        return np.frombuffer(row, np.uint8)
    flags = np.zeros(1 << SEGMENT_BITS, np.uint8)
    flags[np.frombuffer(row, np.uint16)] = 1
    return np.packbits(flags, bitorder="little")


def _share(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Both filters of some keys by segment."""
    _, first, count = np.unique(keys[:, 0], return_index=True, return_counts=True)
    once = _packed(np.unique(_slots(keys[first], bits)))
    twice = _packed(np.unique(_slots(keys[first[count > 1]], bits)))
    return pa.record_batch([pa.array(list(once), pa.int32()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(s, b"") for s in once], pa.binary())], ["segment", "once", "twice"])


def filter_shares(lines: DataFrame, bits: int) -> DataFrame:
    """(segment, once, twice) of each task's keys, ``SHARE`` keys at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "keys", KEY * SHARE):
            keys = _halves(batch.column("keys"))
            held.append(keys)
            n += len(keys)
            if n >= SHARE:
                yield _share(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield _share(np.concatenate(held), bits)

    return lines.mapInArrow(run, "segment int, once binary, twice binary")


def merged_twice(shares: DataFrame) -> DataFrame:
    """(segment, bits): the filter of keys seen twice, folded over the shares of a segment as they stream by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            some = at is not None and twice.any()
            return pa.record_batch([pa.array([at] if some else [], pa.int32()), pa.array([twice.tobytes()] if some else [], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, o, t in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                if segment != at:
                    yield done()
                    at, once, twice = segment, np.zeros(DENSE, np.uint8), np.zeros(DENSE, np.uint8)
                o = _unpacked(o)
                twice |= once & o
                once |= o
                if t:
                    twice |= _unpacked(t)
        yield done()

    return shares.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits binary")


def twice_seen(lines: DataFrame, most_bits: int = MOST_BITS):
    """(broadcast filter of keys seen twice, its bits): of bounded size."""
    keys = lines.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, (keys // KEY).bit_length() + 4))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in merged_twice(filter_shares(lines, bits)).toLocalIterator():
        out[row.segment * DENSE : (row.segment + 1) * DENSE] = np.frombuffer(bytes(row.bits), np.uint8)
    return lines.sparkSession.sparkContext.broadcast(out), bits


def suspects(lines: DataFrame, seen, bits: int) -> DataFrame:
    """(key, doc_id) of the keys of which both slots were seen twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = seen.value
        for batch in slices(batches, "keys", 1 << 22):
            keys = _halves(batch.column("keys"))
            at = _slots(keys, bits)
            hit = ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            size = pc.binary_length(batch.column("keys")).to_numpy(zero_copy_only=False) // KEY
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), size)[hit]
            found = pa.Array.from_buffers(pa.binary(KEY), len(ids), [None, pa.py_buffer(np.ascontiguousarray(keys[hit]))])
            yield pa.record_batch([found.cast(pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return lines.mapInArrow(run, "key binary, doc_id bigint")


def confirmed_keys(found: DataFrame, documents: int, keep: str) -> DataFrame:
    """(key, keeper, n) of the keys that ``documents`` documents hold at least; exact."""
    once = found.select("key", "doc_id").distinct()
    keeper = (F.max if keep == "last" else F.min)("doc_id").alias("keeper")
    return once.groupBy("key").agg(keeper, F.count("*").alias("n")).where(F.col("n") >= documents)


def rewritten(docs: DataFrame, common, shortest: int) -> DataFrame:
    """The documents without the lines that ``common`` (key -> keeper), or their column ``gone`` if they have one, take from them."""
    listed = "gone" in docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, keepers = common.value
        keeper_of = dict(zip((keys[i : i + KEY] for i in range(0, len(keys), KEY)), keepers.tolist()))
        for batch in slices(batches):
            texts, lines, dropped = [], [], []
            gone = batch.column("gone").to_pylist() if listed else [None] * batch.num_rows
            for i, text, more in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), gone):
                parts, more = (text or b"").split(b"\n"), frozenset(more or ())
                kept = parts
                if i is not None and text and (more or keeper_of):
                    kept = [x for x in parts if len(x) < shortest or (k := long_key(x, shortest)) is None or (keeper_of.get(k, i) == i and k not in more)]
                texts.append(text or b"" if len(kept) == len(parts) else b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return docs.mapInArrow(run, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def line_dedup(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, keep: str = "last", most_keys: int = MOST_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document with its text as it is left."""
    if documents < 2 or most_keys < 1 or keep not in ("first", "last"):
        raise ValueError("a repeated line is in two documents at least; one key is broadcast at least; keep is 'first' or 'last'")
    docs = doc_columns(docs, "doc_id", "text")
    context = docs.sparkSession.sparkContext
    lines = materialize(line_keys(docs, shortest), "line-keys")
    seen, bits = twice_seen(lines, most_bits)
    confirmed = materialize(confirmed_keys(suspects(lines, seen, bits), documents, keep), "lines")
    keys, total = confirmed.agg(F.count("*"), F.sum("n")).first()
    # a bound of rows: fewer than most_keys keys can have more than total / most_keys documents
    hot = F.col("n") > (0 if keys <= most_keys else (total or 0) / most_keys)
    rows = confirmed.where(hot).select("key", "keeper").toArrow()
    common = context.broadcast((b"".join(rows.column("key").to_pylist()), rows.column("keeper").to_numpy()))
    if keys > most_keys:
        rest = suspects(lines, seen, bits).join(confirmed.where(~hot), "key").where("doc_id <> keeper")
        docs = docs.join(rest.groupBy("doc_id").agg(F.collect_set("key").alias("gone")), "doc_id", "left")
    else:
        release(lines)
    return rewritten(docs, common, shortest)
