"""Chunking: pieces, greedy packing, merging of short chunks, windows, semantic cuts, audits.

Splitting and merging depend on what was decided before, so they run per text in Arrow batches; everything
that is a fold or a window over rows is left to the engine.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.operators.vectors import Embedder, hash_embedder

_BLANKS = " \t\n\x0b\f\r"
_BLANK_LINES = re.compile(r"\n{2,}")
_SENTENCE_END = re.compile(r"[.;!?]\s+")


def _paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, _BLANK_LINES.split(text) if "\n\n" in text else [text]) if p]


def _sentences(paragraph: str) -> list[str]:
    """What stands between white space after a sentence's end; the sign stays."""
    out, start = [], 0
    for end in _SENTENCE_END.finditer(paragraph):
        out.append(paragraph[start : end.start() + 1])
        start = end.end()
    return [s for s in map(str.strip, [*out, paragraph[start:]]) if s]


def _bounded(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of at most ``most`` characters, cut at the last space that allows it."""
    start, end = 0, len(text)
    while end - start > most:
        space = text.rfind(" ", start, start + most)
        at = space if space > start else start + most
        yield text[start:at].strip()
        start = at
        while start < end and text[start].isspace():
            start += 1
    if start < end:
        yield text[start:]


def split_pieces(text: str, most: int = X.CHUNK_MAX) -> list[str]:
    """Paragraphs; where one is too long, its sentences; where one of these is, bounded parts."""
    out: list[str] = []
    for paragraph in _paragraphs(text or ""):
        for part in [paragraph] if len(paragraph) <= most else _sentences(paragraph):
            out.extend([part] if len(part) <= most else _bounded(part, most))
    return out


def pack(pieces: list[str], goal: int) -> list[str]:
    """Neighbours joined by line breaks while the goal is not passed."""
    groups: list[list[str]] = []
    room = 0
    for piece in pieces:
        if groups and len(piece) + 1 <= room:
            groups[-1].append(piece)
            room -= len(piece) + 1
        else:
            groups.append([piece])
            room = goal - len(piece)
    return ["\n".join(g).strip() for g in groups]


def merge_short(chunks: list[str], least: int = X.CHUNK_MIN, most: int = X.CHUNK_MAX) -> list[str]:
    """Join chunks below ``least`` with a neighbour, or share their text out evenly; a rest may stay short.

    A zipper over the chunks: what is settled lies left, what is to come right. Each step that leaves fewer
    chunks starts anew, all others move on, so it ends.
    """
    # so many of ``left`` a new start would leave as they are, so it begins behind them; at first all before the first short one
    safe = next((i for i, c in enumerate(chunks) if len(c) < least), len(chunks))
    left = chunks[:safe]
    right = deque(chunks[safe:])
    while right:
        whole = safe == len(left)
        if len(right[0]) >= least or len(left) + len(right) == 1:
            left.append(right.popleft())
            safe += whole
            continue
        first = left.pop() if left else right.popleft()
        second = right.popleft()
        joined = f"{first}\n{second}"
        if len(joined) <= most:
            even = [joined]
        else:
            even = pack(split_pieces(joined, most), min(len(joined) // 2 + 1, most))
        if len(even) > 2 or even == [first, second]:
            left += [first, second]
            safe = len(left) if whole else safe
            continue
        safe = min(safe, len(left))
        if safe == 1 and len(left[0]) < least:
            safe = 0  # a short first chunk is taken together with the next
        if len(even) == 2:
            left += even
        else:
            right.extendleft(reversed([*left[safe:], *even]))
            del left[safe:]
    return left


def _visible(text: str) -> int:
    """Characters but blanks."""
    return len(text) - sum(map(text.count, _BLANKS))


def _under(header: str, bodies: list[str]) -> list[str]:
    return [f"{header}\n{b}" if header else b for b in bodies]


def _room(header: str, most: int) -> int:
    """Characters that a header leaves to the body."""
    return max(1, most - len(header) - 1 if header else most)


def chunk_text(text: str, header: str = "", goal: int = X.CHUNK_MAX, most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> list[str]:
    """The chunks of one unit, each under its header."""
    return structural_text(Pieces(text, hash_embedder), header, goal, most, least)


def structural_text(pieces: Pieces, header: str, goal: int, most: int, least: int) -> list[str]:
    room = _room(header, most)
    return _under(header, merge_short(pack(pieces.split(room), _room(header, goal)), least, room))


def fixed_text(text: str, header: str = "", overlap: float = 0.0, most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> list[str]:
    """Windows of what the header leaves of ``most``, overlapping by a ratio; short tails are merged. A blank text has none."""
    room = _room(header, most)
    step = max(1, room - int(room * overlap))
    bodies = [b for b in (text[i : i + room].strip() for i in range(0, len(text), step)) if b]
    return _under(header, merge_short(bodies, min(least, room), room))


class Pieces:
    """The pieces of one text at several limits; a limit that recurs is cut once, a piece that recurs embedded once."""

    def __init__(self, text: str, embedder: Embedder) -> None:
        self.text, self.embedder = text, embedder
        self.rows: dict[str, int] = {}  # of the pieces in ``vectors``
        self.vectors: np.ndarray | None = None
        self.paragraphs = _paragraphs(text)
        self.sentences: dict[str, list[str]] = {}
        self.parts: dict[int, list[str]] = {}
        self.jumps: dict[int, np.ndarray] = {}

    def split(self, room: int) -> list[str]:
        """As ``split_pieces``; limits that cut alike share one list, and with it the distances."""
        if room not in self.parts:
            found: list[str] = []
            for paragraph in self.paragraphs:
                if len(paragraph) > room and paragraph not in self.sentences:
                    self.sentences[paragraph] = _sentences(paragraph)
                for part in [paragraph] if len(paragraph) <= room else self.sentences[paragraph]:
                    found.extend([part] if len(part) <= room else _bounded(part, room))
            self.parts[room] = next((p for p in self.parts.values() if p == found), found)
        return self.parts[room]

    def distances(self, room: int) -> np.ndarray:
        """The cosine distance of each piece but the first to the one before, to six decimals."""
        pieces = self.split(room)
        if id(pieces) not in self.jumps:
            self.jumps[id(pieces)] = self._jumps(pieces)
        return self.jumps[id(pieces)]

    def _jumps(self, pieces: list[str]) -> np.ndarray:
        if len(pieces) < 2:
            return np.zeros(0)
        new = [p for p in dict.fromkeys(pieces) if p not in self.rows]
        if new:
            made = np.asarray(self.embedder([X.PASSAGE_PREFIX + p for p in new]), dtype=np.float64)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(made)), strict=True))
            self.vectors = made if self.vectors is None else np.concatenate([self.vectors, made])
        m = self.vectors[[self.rows[p] for p in pieces]]
        n = np.sqrt((m * m).sum(axis=1))
        n[n == 0] = 1.0
        return np.abs(np.round(1.0 - (m[1:] * m[:-1]).sum(axis=1) / (n[1:] * n[:-1]), 6))


def semantic_text(pieces: Pieces, threshold: float, header: str = "", most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> list[str]:
    """Pieces joined until the distance to the next reaches the threshold; groups over the limit are packed, short ones merged."""
    room = _room(header, most)
    parts = pieces.split(room)
    starts = [0, *(np.flatnonzero(pieces.distances(room) >= threshold) + 1).tolist(), len(parts)]
    bodies: list[str] = []
    for a, b in pairwise(starts):
        bodies += pack(parts[a:b], room) if b - a != 1 else [parts[a].strip()]  # a group within the limit is one
    return _under(header, merge_short(bodies, min(least, room), room))


def _per_unit(units: DataFrame, cut: Callable[[str, str], list[str]]) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk) of ``units(key, header, text)``; nulls are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, header, text in zip(*(b.column(c).to_pylist() for c in ("key", "header", "text")), strict=True):
                made = cut(text or "", header or "")
                rows += [(key, i, len(made), c) for i, c in enumerate(made)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "chunk_index", "total_chunks", "chunk"])

    return units.select("key", "header", "text").mapInArrow(run, "key bigint, chunk_index int, total_chunks int, chunk string")


def structural_chunks(units: DataFrame, goal: int = X.CHUNK_MAX, most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk) from ``units(key, header, text)``."""
    return _per_unit(units, lambda text, header: chunk_text(text, header, goal, most, least))


def fixed_chunks(units: DataFrame, overlap: float = 0.0, most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> DataFrame:
    """As ``structural_chunks``, by windows."""
    return _per_unit(units, lambda text, header: fixed_text(text, header, overlap, most, least))


def semantic_chunks(units: DataFrame, threshold: float, embedder: Embedder = hash_embedder, most: int = X.CHUNK_MAX, least: int = X.CHUNK_MIN) -> DataFrame:
    """As ``structural_chunks``, cut where neighbouring pieces are far apart."""
    return _per_unit(units, lambda text, header: semantic_text(Pieces(text, embedder), threshold, header, most, least))


def distance_percentiles(units: DataFrame, sizes: list[int], shares: list[float], embedder: Embedder = hash_embedder) -> dict[int, list[float]]:
    """For each limit the percentiles of the distances between neighbouring pieces, none across units.

    Distances have six decimals, so a limit has two million values at most, which come counted by batch; what reaches the
    driver is one row a limit. Without any distance a limit's percentiles are infinite: nothing is cut.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, list[np.ndarray]] = {n: [] for n in sizes}
            for header, text in zip(*(b.column(c).to_pylist() for c in ("header", "text")), strict=True):
                pieces = Pieces(text or "", embedder)
                for n in sizes:
                    seen[n].append(pieces.distances(_room(header or "", n)))
            for n, found in seen.items():
                value, count = np.unique(np.concatenate([np.zeros(0), *found]), return_counts=True)
                yield pa.record_batch({"most": pa.array(np.full(len(value), n, np.int32)), "distance": pa.array(value), "n": pa.array(count.astype(np.int64))})

    counted = units.select("header", "text").mapInArrow(run, "most int, distance double, n bigint").groupBy("most", "distance").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("most").agg(F.percentile("distance", F.array(*map(F.lit, shares)), F.col("n")).alias("p")).collect()  # a row a limit
    return {n: [float("inf")] * len(shares) for n in sizes} | {r.most: list(r.p) for r in rows}


#: What a run of a configuration is judged by.
FIGURES = ("texts", "chunks", "chars", "short", "longest")


def run_grid(units: DataFrame, configurations: list[tuple[int, str, float]], thresholds: dict[tuple[int, float], float], embedder: Embedder = hash_embedder, least: int = X.CHUNK_MIN) -> DataFrame:
    """Chunk every unit under every configuration (limit, strategy, setting), in one pass over the texts.

    Gives a row a configuration: units with chunks, chunks, characters of their bodies without white space, bodies below the
    minimum, length of the longest chunk. ``thresholds`` holds the cut of each (limit, setting) of the semantic strategy.
    """

    def chunks(pieces: Pieces, header: str, most: int, strategy: str, setting: float) -> list[str]:
        if strategy == "structural":
            return structural_text(pieces, header, int(most * setting), most, least)
        if strategy == "fixed":
            return fixed_text(pieces.text, header, setting, most, least)
        return semantic_text(pieces, thresholds[most, setting], header, most, least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros((len(configurations), len(FIGURES)), np.int64)
            for header, text in zip(*(b.column(c).to_pylist() for c in ("header", "text")), strict=True):
                pieces, before, heading = Pieces(text or "", embedder), len(header) + 1 if header else 0, _visible(header or "")
                for row, one in zip(total, configurations, strict=True):
                    made = chunks(pieces, header or "", *one)
                    row[:4] += (bool(made), len(made), _visible("".join(made)) - len(made) * heading, sum(n - before < least for n in map(len, made)))
                    row[4] = max(row[4], max(map(len, made), default=0))
            columns = [pa.array(c, k) for c, k in zip(zip(*configurations, strict=True), (pa.int32(), pa.string(), pa.float64()), strict=True)]
            yield pa.record_batch([*columns, *map(pa.array, total.T)], ["most", "strategy", "setting", *FIGURES])

    parts = units.select("header", "text").mapInArrow(run, "most int, strategy string, setting double, " + ", ".join(f"{f} bigint" for f in FIGURES))
    sums = [F.sum(f).alias(f) for f in FIGURES[:4]]
    return parts.groupBy("most", "strategy", "setting").agg(*sums, F.max("longest").alias("longest"))


def greedy_pack(pieces: Column, goal: int) -> Column:
    """``pack`` as a fold: array<struct<chunk, n>> with each group's text and number of pieces."""
    start = F.array().cast("array<struct<chunk:string,n:int>>")
    first = lambda p: F.struct(p.alias("chunk"), F.lit(1).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.char_length(last["chunk"]) + 1 + F.char_length(p) <= goal
        longer = F.struct(F.concat(last["chunk"], F.lit("\n"), p).alias("chunk"), (last["n"] + 1).alias("n"))
        return (
            F.when(F.size(acc) == 0, F.array(first(p)))
            .when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)))
            .otherwise(F.concat(acc, F.array(first(p))))
        )

    return F.aggregate(pieces, start, step)


def fixed_windows(df: DataFrame, text: str, width: int, overlap: float) -> DataFrame:
    """(…, start, chunk): windows of ``width`` characters that overlap by a ratio, trimmed, none blank."""
    step = width - int(width * overlap)
    starts = F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(step))
    out = df.where(F.char_length(text) > 0).withColumn("start", F.explode(starts))
    return out.withColumn("chunk", F.btrim(F.substring(F.col(text), F.col("start") + 1, F.lit(width)), F.lit(" \n\t\r"))).where("chunk <> ''")


def neighbour_distances(pieces: DataFrame, unit: str, position: str, vector: str = "embedding") -> DataFrame:
    """With the cosine distance to the piece before in the same unit; null for the first."""
    from talus.operators.vectors import dot, norm

    before = F.lag(vector).over(Window.partitionBy(unit).orderBy(position))
    n = norm(F.col(vector)) * norm(F.col("_before"))
    out = pieces.withColumn("_before", before)
    return out.withColumn("distance", F.when(F.col("_before").isNotNull(), F.abs(F.round(1 - dot(F.col(vector), F.col("_before")) / F.when(n == 0, 1.0).otherwise(n), 6)))).drop("_before")


def semantic_groups(pieces: DataFrame, unit: str, position: str, threshold: Column) -> DataFrame:
    """With ``group``: a new one where the distance reaches the threshold."""
    cut = F.when(F.col("distance") >= threshold, 1).otherwise(0)
    return pieces.withColumn("group", F.sum(cut).over(Window.partitionBy(unit).orderBy(position)))


def truncation_audit(df: DataFrame, text: str, window: int) -> DataFrame:
    """Texts over the useful window of a model, and the share of tokens it reads."""
    n = F.size(F.filter(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    sized = df.select(n.alias("n"))
    useful = window - 2
    return sized.agg(F.count("*").alias("texts"), F.count_if(F.col("n") > useful).alias("truncated"), F.round(F.sum(F.least("n", F.lit(useful))) / F.sum("n"), 6).alias("share_read"))
