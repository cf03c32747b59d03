"""Source divergence audit with dense blocks of group by term.

A term is a maximal run of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. A group is a (lang, source); null text, lang and
source are ''. Each lang keeps the terms that ``least`` of its documents hold. A group's smoothed share of a term is
``p = 1 + floor(10**9 (count + 1) / (N + V))``, N its occurrences of kept terms, V the lang's kept terms; all arithmetic is on integers.

* part ``pair``: for each other source of the lang the sum over all kept terms of ``floor((p - q)**2 / q)``, q being that source's share;
* part ``term``: the ``top`` kept terms that the group holds with p above the lang's share q, by the same fraction.

1. ``counts`` sums each task's occurrences and documents by group and term before the one shuffle, which goes by lang and term, so the commonest
   term or source brings a row a task and group. All groups' counts of a term meet, and terms of too few documents go.
2. ``tiles`` packs up to ``TERMS`` terms of a lang into one row with their counts, as they stream by in order.
3. ``audited`` makes each tile a dense int64 matrix of all sources of the lang by terms and computes all pairs of it by broadcasting, ``CELLS``
   numbers at a time. A task adds up its tiles' pair matrices and keeps a heap of the best terms of each group, and passes on both;
   sums follow, and heaps are merged in two steps. Matrices or heaps that grow too large are passed on at once.

The groups' totals go to all tasks, ``GROUPS`` at once at most: beyond, langs are taken in turns (one lang's sources always go together; the result
holds their pairs anyway). Every row is a document of its own, ids are not read. A group without terms has zero counts. Ties go to the smaller
item by UTF-8 bytes. A very long text is read in pieces of 1 MB. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import doc_columns, materialize, release, slices

LEAST, TOP, UNIT = 3, 200, 10**9
#: Terms of a tile; numbers computed at once; cells of pair matrices and terms of heaps that a task holds; entries of counts that it gathers.
TERMS, CELLS, MATRICES, HEAPS, ENTRIES = 1024, 1 << 20, 1 << 22, 1 << 18, 1 << 18
#: Groups whose totals go to all tasks at once, and bytes of a text that are read at once.
GROUPS, PIECE = 100_000, 1 << 20
#: Parts in which a group's heaps are merged before they meet.
SALTS = 8

#: A-Z lower-cased, what belongs to no term as a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some ``PIECE`` bytes at a time."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of a task's rows. Every group has a row with the term ''."""

    def batch_of(n: dict[tuple, Counter], docs_of: dict[tuple, Counter]) -> pa.RecordBatch:
        langs, sources, words, ns, ds = [], [], [], [], []
        for (lang, source), found in n.items():
            langs += [lang] * (len(found) + 1)
            sources += [source] * (len(found) + 1)
            words += [b"", *found]
            ns += [0, *found.values()]
            held = docs_of[lang, source]
            ds += [0, *(held[t] for t in found)]
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())]
        return pa.record_batch(columns, [x.split()[0] for x in _COUNTS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs_of = {}, {}
        for batch in slices(batches):
            for text, lang, source in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                group = (lang or "", source or "")
                all_, once = n.setdefault(group, Counter()), set()
                for some in terms(text or b""):
                    all_.update(some)
                    once.update(some)
                docs_of.setdefault(group, Counter()).update(once)
            if sum(map(len, n.values())) >= ENTRIES:
                yield batch_of(n, docs_of)
                n, docs_of = {}, {}
        if n:
            yield batch_of(n, docs_of)

    return doc_columns(docs, "text", "lang", "source").mapInArrow(run, _COUNTS)


_TILE = "lang string, terms array<string>, sources array<string>, sums array<bigint>, term_of binary, source_of binary, n binary"


def tiles(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows of up to ``TERMS`` kept terms of a lang with their counts; sources without any are listed too, where their '' row is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, sources, cells = None, {}, {}, []

        def tile() -> pa.RecordBatch:
            t, s, n = np.array(cells, np.int64).reshape(-1, 3).T
            sums = np.zeros(len(sources), np.int64)
            np.add.at(sums, s, n)
            row = [[at], [list(words)], [list(sources)], [sums.tolist()], [t.astype(np.int32).tobytes()], [s.astype(np.int32).tobytes()], [n.tobytes()]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]
            return pa.record_batch([pa.array(c, k) for c, k in zip(row, kinds)], [x.split()[0] for x in _TILE.split(", ")])

        for batch in batches:
            for lang, term, source, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "n"))):
                if at is not None and (lang != at or (len(words) >= TERMS and term not in words)):
                    yield tile()
                    words, sources, cells = {}, {}, []
                at = lang
                s = sources.setdefault(source, len(sources))
                if term:
                    cells.append((words.setdefault(term, len(words)), s, n))
        if at is not None:
            yield tile()

    held = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = held.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where((F.col("docs") >= least) | (F.col("term") == ""))
    return held.select("lang", "term", "source", "n").sortWithinPartitions("lang", "term").mapInArrow(run, _TILE)


class Lang:
    """The sources of a lang, their occurrences of kept terms, the lang's kept terms."""

    def __init__(self, sources: list[str], sums: np.ndarray, kept: int) -> None:
        self.sources, self.sums, self.kept = sources, sums, kept
        self.place = {s: i for i, s in enumerate(sources)}


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """``1 + floor(UNIT (n + 1) / (total + kept))``, exact also where the product leaves 64 bits."""
    n, below = n + 1, np.atleast_1d(total) + kept
    if n.size and n.max() > np.iinfo(np.int64).max // UNIT:
        return (1 + UNIT * n.astype(object) // below.astype(object)).astype(np.int64)
    return 1 + UNIT * n // below


def pair_sums(p: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums over the terms of ``floor((p - q)**2 / q)`` for the rows ``first`` to ``last`` of ``p`` against all its rows."""
    out = np.zeros((last - first, len(p)), np.int64)
    side = max(1, int((CELLS / max(1, p.shape[1])) ** 0.5))
    for i in range(first, last, side):
        for j in range(0, len(p), side):
            q = p[None, j : j + side]
            d = p[i : min(i + side, last), None] - q
            d *= d
            out[i - first : i - first + side, j : j + side] = (d // q).sum(axis=2)
    return out


_FOUND = "lang string, source string, part string, item string, value bigint"


def audited(packed: DataFrame, langs: dict[str, Lang], top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): each task's sums of pairs and its best terms."""
    sent = packed.sparkSession.sparkContext.broadcast(langs)

    def pair_rows(lang: str, sources: list[str], first: int, sums: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(np.arange(first, first + len(sums))[:, None] != np.arange(len(sources)))
        names = pa.array(sources, pa.string())
        return pa.record_batch([pa.array([lang] * len(i), pa.string()), names.take(pa.array(i + first)), pa.array(["pair"] * len(i), pa.string()), names.take(pa.array(j)), pa.array(sums[i, j])], [x.split()[0] for x in _FOUND.split(", ")])

    def term_rows(heaps: dict) -> pa.RecordBatch:
        rows = [(lang, source, "term", t.decode(), -v) for (lang, source), heap in heaps.items() for v, t in nsmallest(top, heap)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.string()) for k in range(5)], [x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[str, np.ndarray] = {}
        heaps: dict[tuple, list] = {}
        for batch in slices(batches, "n", 1 << 22):
            for row in batch.to_pylist():
                lang, words = row["lang"], [t.encode() for t in row["terms"]]
                own = sent.value[lang]
                n = np.zeros((len(own.sources), len(words)), np.int64)
                of = np.array([own.place[s] for s in row["sources"]], np.int64)
                n[of[np.frombuffer(row["source_of"], np.int32)], np.frombuffer(row["term_of"], np.int32)] = np.frombuffer(row["n"], np.int64)
                p = shares(n, own.sums[:, None], own.kept)
                size = len(own.sources)
                if size * size > MATRICES:
                    step = max(1, MATRICES // size)
                    for i in range(0, size, step):
                        yield pair_rows(lang, own.sources, i, pair_sums(p, i, min(i + step, size)))
                else:
                    if lang not in matrices and sum(m.size for m in matrices.values()) + size * size > MATRICES:
                        for k, m in matrices.items():
                            yield pair_rows(k, sent.value[k].sources, 0, m)
                        matrices = {}
                    matrices[lang] = matrices.get(lang, 0) + pair_sums(p, 0, size)
                if words:
                    q = shares(n.sum(axis=0), own.sums.sum(), own.kept)
                    f = np.where((n > 0) & (p > q), (p - q) ** 2 // q, -1)
                    for i in np.flatnonzero((f >= 0).any(axis=1)):
                        heap = heaps.setdefault((lang, own.sources[i]), [])
                        heap += [(-int(f[i, t]), words[t]) for t in np.flatnonzero(f[i] >= (-heap[top - 1][0] if len(heap) == top else 0))]
                        if len(heap) >= top:
                            heap[:] = nsmallest(top, heap)
                    if sum(map(len, heaps.values())) > HEAPS:
                        yield term_rows(heaps)
                        heaps = {}
        for k, m in matrices.items():
            yield pair_rows(k, sent.value[k].sources, 0, m)
        yield term_rows(heaps)

    return packed.mapInArrow(run, _FOUND)


def source_audit(docs: DataFrame, least: int = LEAST, top: int = TOP, most_groups: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank), rank from 1 in each group and part by falling value."""
    packed = materialize(tiles(counts(docs), least), "tiles")
    sums = packed.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    sums = materialize(sums, "groups")
    kept = packed.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    sizes = sums.groupBy("lang").count().join(kept, "lang").orderBy("lang").toArrow().to_pylist()
    turns, room = [], 0
    for lang in sizes:
        if room < lang["count"]:
            turns.append({})
            room = most_groups
        turns[-1][lang["lang"]] = lang["kept"]
        room -= lang["count"]
    parts = []
    for turn in turns:
        chosen = F.col("lang").isin(list(turn)) if len(turns) > 1 else F.lit(True)
        rows = sums.where(chosen).toArrow().sort_by([("lang", "ascending"), ("source", "ascending")])
        names, sources, ns = (rows.column(c).to_pylist() for c in ("lang", "source", "n"))
        langs: dict[str, tuple[list, list]] = {}
        for name, source, n in zip(names, sources, ns):
            for held, x in zip(langs.setdefault(name, ([], [])), (source, n)):
                held.append(x)
        parts.append(audited(packed.where(chosen), {k: Lang(s, np.array(n, np.int64), turn[k]) for k, (s, n) in langs.items()}, top))
    if not parts:
        return docs.sparkSession.createDataFrame([], _FOUND + ", rank int")
    release(sums)
    found = materialize(reduce(DataFrame.union, parts), "audit")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # the heaps of all tasks are merged in SALTS parts first
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", rank("salt")).where(F.col("rank") <= top)
    best = best.select(found.columns).withColumn("rank", rank()).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank()).union(best)
