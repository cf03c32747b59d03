"""Exact substring deduplication with suffix arrays built by two-stage sorting.

Equal strings of ``window`` bytes meet by their anchors (see ``anchors``): a segment's content is kept once, with its
first place. The distinct segments of a shard are sorted as suffixes: only suffixes
smaller than their successors are compared, the others are induced by scanning the buckets of first bytes in order.
Adjacent common prefixes of ``window`` bytes or more show equal strings; every place but the first is removed.
Anchors with very many contents are salted over shards; the windows that these leave are united by hash.
Places are (doc_id, start). Matches never cross documents.

Null texts are empty. Rows that repeat an id are one document; rows without an id have no place in the order and are left out. An empty table gives an empty result.
Extra columns are ignored. Places are a total order, so equal strings leave no tie; equal rows of one id count once. A very long text is hashed whole in one
task, in time and memory in proportion to its length; its segments are sorted in shards like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import anchors
from talus.llm.common import _BYTES, _BYTES2, buffers, materialize, release, settle, slices

WINDOW, GRAM = 100, 24
SHARD_WINDOWS = 250_000
SPANS = "anchor bigint, s1 bigint, n bigint, doc_id bigint, start bigint, end bigint, first bigint, h1 bigint, h2 bigint"


def byte_keys(text: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on, as a number in the order of strings; ``text`` is padded."""
    out = np.zeros(len(text) - 8, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= text[k : k + len(out)]
    return out


def direct_sort(keys: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes that start there, compared over ``depth`` bytes."""
    key = keys[at]
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        # ties stand together: sorting within them keeps the groups in place
        group = np.cumsum(new[where])
        sub = order[where]
        key = keys[sub + k]
        by = np.lexsort((key, group))
        order[where] = sub[by]
        key = key[by]
        new[where[1:]] |= key[1:] != key[:-1]
    return order


def suffix_order(text: np.ndarray, keys: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places (a mask, the last one a zero byte) in suffix order to ``depth`` bytes, by two-stage sorting.

    A suffix is small if it is less than its successor. Places beyond the wanted ones are added up to the next small one,
    since the order of the others follows from their successors.
    """
    n = len(wanted)
    # the type of a place is that of the next place with another byte
    rise, same = text[: n - 1] < text[1:n], text[: n - 1] == text[1:n]
    last = np.where(same, np.int32(n), np.arange(n - 1, dtype=np.int32))
    nxt = np.minimum.accumulate(last[::-1])[::-1] if n > 1 else last
    small = np.zeros(n, bool)
    small[: n - 1] = (nxt < n) & rise[np.minimum(nxt, max(0, n - 2))]
    # the last place, a zero of the padding, ends every chain and stands before all others
    need = wanted.copy()
    chain = np.flatnonzero(wanted & ~small)
    while len(chain):
        chain = chain[chain < n - 1] + 1
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[~small[chain]]
    ordered = direct_sort(keys, np.flatnonzero(need & small), depth)
    first = text[ordered]
    cuts = np.searchsorted(first, np.arange(257))
    larger = need & ~small
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:
        heads[0].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part, own = [], heads[c]
        while own:
            now = np.concatenate(own)
            part.append(now)
            before = now[now > 0] - 1
            own = [before[larger[before] & (text[before] == c)]]
            if not len(own[0]):
                own = []
        part.append(ordered[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(part)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before]]
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        if len(before):
            values, at_ = np.unique(byte, return_index=True)
            for v, piece in zip(values.tolist(), np.split(before, at_[1:]), strict=True):
                heads[v].append(piece)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[wanted[found]]


def common_prefixes(keys: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``order`` whether its suffix agrees with the one before it over ``depth`` bytes or more."""
    agree = np.zeros(len(order), bool)
    agree[1:] = True
    left = np.arange(1, len(order))
    for k in range(0, depth, 8):
        k = min(k, depth - 8)
        left = left[keys[order[left] + k] == keys[order[left - 1] + k]]
        if not len(left):
            break
    agree[:] = False
    agree[left] = True
    return agree


def first_places(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of the contents: document and place at which the window from there first stands, and whether there is one."""
    length = np.array([len(c) for c in contents], np.int64)
    base = np.cumsum(length) - length
    text = np.concatenate([np.frombuffer(b"".join(contents), np.uint8), np.zeros(window + 16, np.uint8)]).astype(np.uint8)
    total = int(length.sum())
    wanted = np.zeros(total + 1, bool)
    edge = np.zeros(total + 2, np.int64)
    edge[base] += 1
    edge[base + length - window + 1] -= 1
    wanted[:] = np.cumsum(edge)[: total + 1] > 0
    keys = byte_keys(text)
    order = suffix_order(text, keys, wanted, window)
    group = np.cumsum(~common_prefixes(keys, order, window)) - 1
    segment = np.searchsorted(base, order, "right") - 1
    # the earliest place of each group of equal strings; one place may stand in two segments only if they are one class
    doc, place = docs[segment], starts[segment] + order - base[segment]
    by = np.lexsort((place, doc, group))
    least = by[anchors.stretches(group[by])] if len(by) else by
    first_doc, first_place = np.zeros(total, np.int64), np.zeros(total, np.int64)
    first_doc[order], first_place[order] = doc[least][group], place[least][group]
    return first_doc, first_place, wanted[:total]


def _shard(window: int, ordinary: int):
    """Removed spans of each class's first place; first places of the windows of classes with other places; of salted shards the windows left.

    Rows of the second kind have the class's key, and ``first`` is where the window at ``start`` first stands, in ``doc_id``.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = anchors.once(rows)
        docs, starts, many = (rows.column(c).to_numpy() for c in ("rep_doc", "rep_start", "c"))
        contents = rows.column("content").to_pylist()
        length = np.array([len(c) for c in contents], np.int64)
        base = np.cumsum(length) - length
        first_doc, first_place, windows = first_places(contents, docs, starts, window)
        of = np.repeat(np.arange(len(length)), length)
        place = starts[of] + np.arange(len(of)) - base[of]
        gone = windows & ((first_doc != docs[of]) | (first_place != place))
        a, b = anchors.ranges(gone)  # the last window of a segment starts before its end, so runs stay inside
        parts = [(None, docs[of[a]], place[a], place[a] + b - a + window - 1, None, None)]
        # windows of classes with other places: stretches whose first places run along
        at = np.flatnonzero(windows & (many[of] > 1))
        head = anchors.stretches(of[at], first_doc[at], first_place[at] - at) if len(at) else at
        size, at = np.diff(np.append(head, len(at))), at[head]
        inside = at - base[of[at]]
        parts.append((of[at], first_doc[at], inside, inside + size + window - 1, first_place[at], None))
        if rows.column("shard")[0].as_py() >= ordinary:
            at = np.flatnonzero(windows & ~gone)
            text = np.frombuffer(b"".join(contents), np.uint8)
            parts.append((None, docs[of[at]], place[at], place[at] + window, None, anchors.window_hashes(_BYTES[text], _BYTES2[text], at, window)))
        tables = []
        for cls, doc, start, end, first, hashes in parts:
            none = pa.nulls(len(doc), pa.int64())
            key = [none] * 3 if cls is None else [rows.column(c).combine_chunks().take(pa.array(cls)) for c in ("anchor", "s1", "n")]
            columns = [*key, pa.array(doc), pa.array(start), pa.array(end), none if first is None else pa.array(first), *([none] * 2 if hashes is None else map(pa.array, hashes))]
            tables.append(pa.table(columns, ["anchor", "s1", "n", "doc_id", "start", "end", "first", "h1", "h2"]))
        return pa.concat_tables(tables)

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Spans (doc_id, start, end) of bytes that repeat an earlier place, as written tables; they may overlap."""
    occurrences, classes = anchors.repeated_segments(docs, False, window, gram, across=False)
    sharded, ordinary = anchors.with_shards(classes, shard_windows)
    made = materialize(anchors.with_content(docs, sharded, False, window).groupBy("shard").applyInArrow(_shard(window, ordinary), SPANS), "spans")
    release(classes)
    settle(docs.sparkSession)
    first, left = made.where("h1 is null and anchor is null").select("doc_id", "start", "end"), made.where("h1 is not null").select("doc_id", "start", "end", "h1", "h2")
    owners = left.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    late = left.join(owners, ["h1", "h2"]).where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "end")
    # places of classes that have several, by the first places that the array gave their windows
    ranked = made.where("anchor is not null").select("anchor", "s1", "n", F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"), "first")
    placed = occurrences.join(ranked, ["anchor", "s1", "n"]).where("d < doc_id or d = doc_id and first < start + a")
    again = materialize(placed.select("doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end")), "spans")
    release(occurrences)
    settle(docs.sparkSession)
    return first.union(late).union(again)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text's length for every row of ``docs``."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    spans = find_repeats(docs, window, gram, shard_windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = buffers(batch.column("text"))
            rows, gone = [], anchors.covered(batch.column("spans"), np.diff(offs))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                mask = gone[a:b]
                removed = int(mask.sum())
                text = data[a:b][~mask] if removed else data[a:b]
                rows.append((doc, b - a, removed, len(anchors.ranges(mask)[0]) if removed else 0, hashlib.sha256(text.tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return anchors.removal(docs, spans, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
