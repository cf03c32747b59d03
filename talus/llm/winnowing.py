"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of ``w`` hashes the smallest is chosen, the
rightmost of equals; positions are kept. Any common passage of w + k - 1 code points shares a fingerprint,
none shorter than k is seen. A text shorter than k is one gram; shorter than a window, one window.

Null texts are empty and have no fingerprint; two empty fingerprints are alike (1); repeated rows are
documents each, equal ids standing in the order of their texts; rows without an id
have no next document and are left out; an empty table gives an empty result. A very long text and its edited text are hashed in one task, in time and memory in
proportion to their length; rows with one id stand in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import partitions, prefix_hash, sliding_min, slices, span_hash

K, WIDTH = 8, 8
_LOW = np.uint64(0xFFFFFFFF)
PAIRS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    "near_edited double, near_next double, next_doc_id bigint, n_fingerprints int"
)


def _values(points: np.ndarray) -> np.ndarray:
    v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def winnow(text: str, k: int = K, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions) of the chosen k-grams, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, n)
    at = np.arange(n - k + 1)
    h = span_hash(prefix_hash(_values(points)), at, at + k) >> np.uint64(32)
    key = (h << np.uint64(32)) | (_LOW - at.astype(np.uint64))  # the later of equals is the smaller
    chosen = sliding_min(key, min(width, len(key)))
    chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=chosen[:1] ^ np.uint64(1)) != 0)]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits a hash, by position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, hashes and positions, for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [winnow(t or "", k, width) for t in batch.column("text").to_pylist()]
            hashes = pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), hashes, pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, hashes array<bigint>, positions array<bigint>")


def _ranges(docs: DataFrame, count: int) -> tuple[np.ndarray, dict[int, list[int]], DataFrame]:
    """Upper bounds of id ranges, the ranges to which the first document of a range goes as well.

    Only as many ids as there are ranges come to the driver.
    """
    marks = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, marks)) if marks else F.array(F.lit(1.0)), 10_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(found, np.int64))
    if len(bounds):
        cut = F.array(*[F.lit(int(b)) for b in bounds])
        lower_bounds = docs.select("doc_id", F.size(F.filter(cut, lambda b: b < F.col("doc_id"))).alias("r"))
    else:
        lower_bounds = docs.select("doc_id", F.lit(0).alias("r"))
    heads = sorted(((r["r"], r["m"]) for r in lower_bounds.groupBy("r").agg(F.max("doc_id").alias("m")).collect()), reverse=True)
    goes: dict[int, list[int]] = {}
    for i, (r, m) in enumerate(heads):
        goes.setdefault(m, []).append(heads[i - 1][0])  # the first also follows the last
    return bounds, goes


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt by id range, each range closed by its follower (guest = 1): one shuffle of the texts."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text").where("doc_id is not null")
    bounds, goes = _ranges(docs.select("doc_id"), ranges)
    firsts = np.array(sorted(goes), np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.searchsorted(bounds, ids, "left").astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], ["r", "guest", "doc_id", "text"])
            for i in np.flatnonzero(np.isin(ids, firsts)).tolist():
                for r in goes[int(ids[i])]:
                    one = batch.slice(i, 1)
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([1], pa.int32()), *one.columns], ["r", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "r int, guest int, doc_id bigint, text string")
    return dealt.repartition(ranges, "r").sortWithinPartitions("r", "guest", F.col("doc_id").desc(), "text")


def _compare(doc: int, text: str, mine: np.ndarray, after: int, following: str, theirs: np.ndarray, k: int, width: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed, _ = winnow(edited, k, width)
    return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(mine), as_text(changed), likeness(mine, changed), likeness(mine, theirs), after, len(mine))


def compare_edited(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document against itself with its second half taken from the next one, and against the next one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("next_doc_id", pa.int64()), ("n_fingerprints", pa.int32())])
        last: tuple | None = None
        for batch in slices(batches, most=1 << 20):
            rows = []
            for r, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("r", "guest", "doc_id", "text")), strict=True):
                mine = winnow(text, k, width)[0]
                if last and last[0] == r:
                    rows.append(_compare(*last[1:], doc, text, mine, k, width))
                last = None if guest else (r, doc, text, mine)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return with_next(docs, max(1, 2 * partitions(docs.sparkSession))).mapInArrow(run, PAIRS)
