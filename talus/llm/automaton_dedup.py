"""Substring deduplication with suffix automata over words.

The reference is cut into shards by anchors (see ``anchors``), each of bounded size. A shard's distinct segments
make one suffix automaton, whose states know the smallest document that holds their strings. Segments are
streamed through it: with the match kept at ``window`` words, the state tells in which document the window
first stands, and windows that stand in an earlier document are removed.
Anchors with very many contents are salted over shards, and their windows' first documents are united by hash.
Automata of the whole reference would outgrow any broadcast, so segments are sent to the automaton of their shard instead.

Null texts have no words. Rows that repeat an id are one document; rows without an id have no place in the order and are left out. An empty table gives an empty result.
Extra columns are ignored. Of equal windows the smallest id counts, so no tie is left; equal rows of one id count once. A very long text is hashed whole in one
task, in time and memory in proportion to its length; its segments go to shards like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import anchors
from talus.llm.common import buffers, materialize, mix, release, settle, slices

WINDOW, GRAM = 50, 8
SHARD_WINDOWS = 60_000
_CLASS = "anchor bigint, s1 bigint, n bigint, start bigint, end bigint, owner bigint, h1 bigint, h2 bigint, rep_doc bigint"


class SuffixAutomaton:
    """Strings of integers; a state's ``owner`` is the smallest owner of the strings that hold it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 62]

    def _clone(self, p: int, q: int, c: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(1 << 62)
        made = len(self.next) - 1
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def add(self, string: list[int], owner: int) -> None:
        """Insert one string."""
        follow, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in string:
            q = follow[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            else:
                follow.append({})
                length.append(length[last] + 1)
                owners.append(1 << 62)
                link.append(0)
                made, p = len(follow) - 1, last
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = made
                    p = link[p]
                if p >= 0:
                    q = follow[p][c]
                    link[made] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = made
            if owner < owners[last]:
                owners[last] = owner

    def finish(self) -> None:
        """Hand owners down to shorter strings."""
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            p = self.link[v]
            if p >= 0 and self.owner[v] < self.owner[p]:
                self.owner[p] = self.owner[v]

    def first_owners(self, string: list[int], window: int) -> list[int]:
        """Matching statistics of a string: for each of its windows, the smallest owner, or a huge number."""
        follow, link, length, owner = self.next, self.link, self.length, self.owner
        v, n, out = 0, 0, []
        for i, c in enumerate(string):
            while v and c not in follow[v]:
                v = link[v]
                n = length[v]
            if c in follow[v]:
                v = follow[v][c]
                n += 1
            while length[link[v]] >= window:
                v = link[v]
            n = min(n, length[v])
            if i >= window - 1:
                out.append(owner[v] if n >= window else 1 << 62)
        return out


def _shard(window: int, ordinary: int):
    """Parts of each class of a shard with the smallest document that holds their windows; of salted shards also the windows left, with their hashes.

    Parts are told where the class has other places or where that document is another one.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = anchors.once(rows)
        docs, places = rows.column("rep_doc").to_pylist(), rows.column("c").to_pylist()
        whole = np.frombuffer(b"".join(rows.column("content").to_pylist()), np.uint64)
        _, code = np.unique(whole, return_inverse=True)
        ends = np.cumsum(rows.column("n").to_numpy() + window - 1)
        begins = np.append(0, ends[:-1])
        strings = [code[a:b].tolist() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        machine = SuffixAutomaton()
        for s, d in zip(strings, docs, strict=True):
            machine.add(s, d)
        machine.finish()
        salted = rows.column("shard")[0].as_py() >= ordinary
        told, left = [], []
        for i, (s, d, c) in enumerate(zip(strings, docs, places, strict=True)):
            owner = np.array(machine.first_owners(s, window), np.int64)
            a = anchors.stretches(owner)
            b = np.append(a[1:], len(owner))
            use = np.ones(len(a), bool) if c > 1 else owner[a] < d
            told.append((np.full(int(use.sum()), i), a[use], b[use] + window - 1, owner[a[use]]))
            if salted:
                a = np.flatnonzero(owner == d)
                left.append((np.full(len(a), i), a, a + window, np.full(len(a), d)))
        row, start, end, owner = (np.concatenate(x).astype(np.int64) for x in zip(*told, *left, strict=True))
        known = sum(len(x[0]) for x in told)
        h1, h2 = anchors.window_hashes(whole, mix(whole), begins[row[known:]] + start[known:], window)
        none = np.zeros(known, np.int64)
        left_ = np.arange(len(row)) >= known
        hashes = [pa.array(np.concatenate([none, h]), mask=~left_) for h in (h1, h2)]
        keys = [rows.column(c).to_numpy()[row] for c in ("anchor", "s1", "n")]
        return pa.table([*[pa.array(x) for x in (*keys, start, end, owner)], *hashes, pa.array(np.array(docs, np.int64)[row])], ["anchor", "s1", "n", "start", "end", "owner", "h1", "h2", "rep_doc"])

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Spans (doc_id, start, end) of words that repeat an earlier document, as a written table; they may overlap."""
    occurrences, classes = anchors.repeated_segments(docs, True, window, gram, across=True)
    keys = ["anchor", "s1", "n"]
    sharded, ordinary = anchors.with_shards(classes, shard_windows)
    made = materialize(anchors.with_content(docs, sharded, True, window).groupBy("shard").applyInArrow(_shard(window, ordinary), _CLASS), "parts")
    release(classes)
    settle(docs.sparkSession)
    left = made.where("h1 is not null")
    owners = left.groupBy("h1", "h2").agg(F.min("rep_doc").alias("first"))
    late = left.join(owners, ["h1", "h2"]).where("first < rep_doc").select(*keys, "start", "end", F.col("first").alias("owner"))
    found = made.where("h1 is null").select(*keys, "start", "end", "owner").union(late).withColumnsRenamed({"start": "a", "end": "b"})
    # every place of a class, copies and first one alike, by the documents that the automaton gave its windows
    spans = occurrences.join(found, keys).where("owner < doc_id").select("doc_id", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end"))
    spans = materialize(spans, "spans")
    del found, left, late, owners
    release(made)
    release(occurrences)
    settle(docs.sparkSession)
    return spans


def automaton_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    spans = find_repeats(docs, window, gram, shard_windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = buffers(batch.column("text"))
            split = [data[a:b].tobytes().split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            gone, rows, at = anchors.covered(batch.column("spans"), lengths), [], 0
            for doc, words in zip(batch.column("doc_id").to_pylist(), split, strict=True):
                n = len(words)
                mask = gone[at : at + n]
                at += n
                removed = int(mask.sum())
                if removed:
                    words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                rows.append((doc, n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return anchors.removal(docs, spans, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
