"""Perplexity under a hierarchical Pitman-Yor language model.

One restaurant for all words is the parent of a restaurant for every preceding word (the start of a text among them). Tables of the
children are customers of the parent. Seating is sampled by Gibbs: a customer of each dish is lifted and seated again; table sizes are
summed out, so the chance that the customer sat alone is a ratio of generalised Stirling numbers (beyond ``EXACT`` customers its limit,
discount times tables over customers). Dishes are moved side by side, with the restaurant's tables counted anew between sweeps; one chain
runs over ``ROUNDS`` rounds, between which the parent is seated again, and predictive probabilities are averaged over ``SAMPLES`` states of it.

How it is laid out: texts are read in slices. A slice sends each shard its distinct pairs of (preceding word, word) once; a shard holds
all dishes of its contexts, so that counts, seatings and probabilities of a context meet in one place and never move again. The chain of a
shard follows from its seed and the parent's probabilities: each round runs it anew instead of storing it. In the end a shard answers each
slice's pairs in the order in which they were sent. Contexts that make up more than one in ``SPLIT`` tokens are split over the shards by
word, their tables summed through the driver. Counts and the parent's probabilities of the ``VOCABULARY`` commonest words are broadcast.

Other words are dishes of their own too, in each context and in the parent, and have exact counts in the base score. Each round the shards
send their tables of these words to the words' parts, which answer with the words' customers in the parent. The parent's base is the same for
every word, so words with equally many customers there are alike: their tables are summed out together, by the exact law of the number of tables,
and the driver sees and sends numbers of words by customers only. These words occur less often than each of ``VOCABULARY`` others, so such a list is no
longer than some training tokens / ``VOCABULARY``.

Null texts are empty: their only token is the end. Rows that repeat an id are scored each and counted each; rows without an id are left
out, since the id tells training texts. An empty table gives an empty result. Extra columns are ignored. Nothing is ranked but words for
the vocabulary, where words of equal count stay or go together. A very long text is one slice: memory grows with its length. Scores are
base-10 logarithms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import buffers, lower, materialize, mix, partitions, release, settle, signed, slices, word_bounds, word_hashes

VOCABULARY, SPLIT = 1 << 19, 1024
SLICE_BYTES, SHARD_TOKENS = 4 << 20, 2_500_000
SAMPLES, ROUNDS, MOVES, APART, EXACT = 3, 2, 10, 2, 128
STRENGTH = 1.0
END = np.uint64(0x0123456789ABCDEF)
#: Distinct words a task sums before it passes them on.
FLUSH = 1_000_000
#: Keys of words outside the vocabulary: their hash with this bit set. Others have their rank.
COLD = np.uint64(1 << 63)
#: Parts in which sums over the vocabulary are shuffled.
PARTS = 64
#: Words outside the vocabulary, counted once a shard, that meet in a part.
COLD_WORDS = 500_000


def is_training(doc: int) -> bool:
    return zlib.crc32(str(doc).encode()) % 10 != 0


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end for each document, first token of each document, document ids)."""
    data, offs = buffers(batch.column("text"))
    data = lower(data)
    starts, ends, first = word_bounds(data, offs)
    n = np.diff(first)
    out = np.empty(len(starts) + len(n), np.uint64)
    begin = first[:-1] + np.arange(len(n))
    end = np.zeros(len(out), bool)
    end[begin + n] = True
    out[end] = END
    out[~end] = word_hashes(data, starts, ends)
    return out, np.append(begin, len(out)), batch.column("doc_id").to_numpy(zero_copy_only=False)


def _of_training(tokens: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.repeat(np.fromiter(map(is_training, ids.tolist()), bool, len(ids)), np.diff(begin))


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed bytes, the bytes of one weight together."""
    head, parts = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.uint64, copy=False)
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        head += [len(a), width]
    raw = b"".join(parts)
    return np.array([*head, len(raw)], "<i8").tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * count + 2)[1:]
    raw = np.frombuffer(pa.decompress(data[8 * (2 * count + 2) :], int(head[-1]), "zstd"), np.uint8) if head[-1] else np.zeros(0, np.uint8)
    out, at = [], 0
    for n, width in head[:-1].reshape(-1, 2).tolist():
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(a.reshape(-1).view(np.uint64))
        at += n * width
    return out


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c): training tokens by word, summed in the tasks before the shuffle."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(w)
        first = _runs(w[order])
        return w[order][first], np.add.reduceat(c[order], first) if len(first) else c

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            w, c = summed(held)
            for i in range(0, len(w), 100_000):
                yield pa.record_batch([pa.array(signed(w[i : i + 100_000])), pa.array(c[i : i + 100_000])], ["w", "c"])

        for batch in slices(batches, most=SLICE_BYTES):
            tokens, begin, ids = _tokens(batch)
            held.append(np.unique(tokens[_of_training(tokens, begin, ids)], return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH:
                held = [summed(held)]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The commonest words: sorted hashes, the rank of each, and the count of each rank."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        by = np.lexsort((words, -counts))
        self.counts = counts[by]
        order = np.argsort(words[by])
        self.hashes, self.rank = words[by][order], order.astype(np.uint64)

    def __len__(self) -> int:
        return len(self.counts)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The rank of each word, or its hash with the highest bit set."""
        n = len(self.hashes)
        if not n:
            return tokens | COLD
        at = np.minimum(np.searchsorted(self.hashes, tokens), n - 1)
        return np.where(self.hashes[at] == tokens, self.rank[at], tokens | COLD)


def vocabulary_of(words: DataFrame, most: int) -> Vocabulary:
    """At most ``most`` words come to the driver: all from some count on."""
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(words.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"])
    total, least = 0, 1 << 30
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["l"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = batch.column("w").to_numpy(), batch.column("c").to_numpy()
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (w, c)], ["w", "c"])

    parts = words.where(level >= least).mapInArrow(run, "w binary, c binary").collect()
    w, c = (np.frombuffer(b"".join(bytes(r[x]) for r in parts), np.int64) for x in ("w", "c"))
    return Vocabulary(w.view(np.uint64), c)


SLICES = (
    "slice bigint, shard int, request binary, docs array<bigint>, n_tokens array<bigint>, n_known array<bigint>, base array<double>,"
    "codes binary, cold array<struct<doc:int,w:bigint,n:bigint>>"
)


def shard_of(u: np.ndarray, w: np.ndarray, split: int, shards: int) -> np.ndarray:
    """By context; contexts of a rank below ``split`` by context and word."""
    h = mix(np.where(u < np.uint64(split), mix(w + np.uint64(1)) ^ u, u) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5))
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def slice_rows(docs: DataFrame, sent, split: int, shards: int, below: float) -> DataFrame:
    """For each slice a row with its documents, and a row for each shard with the slice's distinct pairs there.

    ``codes`` are each document's pairs as places in the slice's pairs, which stand by shard, context and word.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = sent.value, TaskContext.get().partitionId() << 32
        base_of = np.append(np.log10((vocabulary.counts + 0.1) / below), 0.0)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
        kinds.append(pa.list_(pa.struct([("doc", pa.int32()), ("w", pa.int64()), ("n", pa.int64())])))
        names = ["slice", "shard", "request", "docs", "n_tokens", "n_known", "base", "codes", "cold"]
        for batch in slices(batches, most=SLICE_BYTES):
            tokens, begin, ids = _tokens(batch)
            m, length = len(ids), np.diff(begin)
            doc = np.repeat(np.arange(m), length)
            train = _of_training(tokens, begin, ids)
            words, at = np.unique(tokens, return_inverse=True)
            keys = vocabulary.keys(words)
            end = np.searchsorted(words, END)
            last = np.empty_like(at)
            last[1:] = at[:-1]
            last[begin[:-1]] = end
            pair, of = np.unique(last * len(words) + at, return_inverse=True)
            u, w = keys[pair // len(words)], keys[pair % len(words)]
            c = np.bincount(of, train, len(pair)).astype(np.int64)
            shard = shard_of(u, w, split, shards)
            order = np.lexsort((w, u, shard))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes = np.sort(doc * np.int64(len(order)) + place[of]) - doc * np.int64(len(order))
            step = np.diff(codes, prepend=0)
            step[begin[:-1]] = codes[begin[:-1]]
            key = keys[at]
            known = key < COLD
            base = np.bincount(doc, base_of[np.where(known, key, np.uint64(len(vocabulary))).astype(np.int64)], m)
            cold = np.flatnonzero(~known)
            cold = cold[np.lexsort((at[cold], doc[cold]))]
            first = np.flatnonzero(np.append(True, (doc[cold][1:] != doc[cold][:-1]) | (at[cold][1:] != at[cold][:-1]))) if len(cold) else cold
            n = np.diff(np.append(first, len(cold)))
            lost = pa.StructArray.from_arrays([pa.array(doc[cold[first]].astype(np.int32)), pa.array(signed(tokens[cold[first]])), pa.array(n)], ["doc", "w", "n"])
            one = [[number], [None], [None], [ids.tolist()], [length.tolist()], [np.bincount(doc, known, m).astype(np.int64).tolist()], [base.tolist()], [pack(step)]]
            arrays = [pa.array(x, k) for x, k in zip(one, kinds, strict=False)]
            yield pa.record_batch([*arrays, pa.ListArray.from_arrays(pa.array([0, len(lost)], pa.int32()), lost)], names)
            u, w, c, shard = u[order], w[order], c[order], shard[order]
            cuts = _runs(shard)
            requests = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                new = _runs(u[a:b])
                requests.append(pack(u[a:b][new], np.diff(np.append(new, b - a)), w[a:b], c[a:b]))
            many = len(requests)
            rows = [pa.array([number] * many, pa.int64()), pa.array(shard[cuts]), pa.array(requests, pa.binary())]
            yield pa.record_batch([*rows, *[pa.nulls(many, k) for k in kinds[3:]]], names)
            number += 1

    return docs.mapInArrow(run, SLICES)


BASE = "shard int, pairs binary, slices array<bigint>, places array<binary>, cold bigint"
#: Messages to and from the parts: sums over the vocabulary and numbers of words by customers have no shard.
MESSAGES = "part int, shard int, data binary"
REPLIES = "array<struct<turn:int,part:int,data:binary>>"


def _build(rows: pa.Table) -> pa.Table:
    """One row for a shard: its distinct pairs with their counts, each slice's pairs as places in them, and how many words outside the vocabulary."""
    rows = rows.sort_by("slice")
    us, ws, cs, lengths = [], [], [], []
    for data in rows.column("request").to_pylist():
        u, n, w, c = unpack(data)
        us.append(np.repeat(u, n.astype(np.int64)))
        ws.append(w)
        cs.append(c)
        lengths.append(len(w))
    u, w, c = np.concatenate(us), np.concatenate(ws), np.concatenate(cs)
    order = np.lexsort((w, u))
    new = np.append(True, (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    u, w, c = u[order][first], w[order][first], np.add.reduceat(c[order], first)
    starts = _runs(u)
    cuts = np.append(0, np.cumsum(lengths)).tolist()
    places = [pack(np.diff(place[a:b], prepend=0)) for a, b in zip(cuts, cuts[1:], strict=False)]  # they rise, as pairs stand in order
    cold = len(np.unique(w[w >= COLD]))
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64()]
    one = [[rows.column("shard")[0].as_py()], [pack(u[starts], np.diff(np.append(starts, len(u))), w, c)], [rows.column("slice").to_pylist()], [places], [cold]]
    return pa.table([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], ["shard", "pairs", "slices", "places", "cold"])


@lru_cache(8)
def alone(discount: float) -> np.ndarray:
    """alone[c, t]: the chance that a customer sits alone, of c at t tables: S(c-1, t-1) / S(c, t)."""
    n = EXACT + 1
    log = np.full((n, n + 1), -np.inf)
    log[0, 0] = 0.0
    out = np.zeros((n, n + 1))
    t = np.arange(1, n + 1)
    for c in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t < c, np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf) + log[c - 1, 1:]
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], stay)
            out[c, 1:] = np.where(t <= c, np.exp(log[c - 1, :-1] - log[c, 1:]), 0.0)
    return np.nan_to_num(out)


def first_seating(c: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers have come one by one, above 64 in groups of a sixteenth."""
    t = np.minimum(c, 1).astype(np.int64)
    active = np.flatnonzero(c > 1)
    k = 1
    while len(active):
        step = max(1, k // 16) if k >= 64 else 1
        come = np.minimum(step, c[active] - k)
        p = mass[active] / (k - discount * t[active] + mass[active])
        t[active] += rng.binomial(come, np.clip(p, 0.0, 1.0))
        k += step
        active = active[c[active] > k]
    return np.minimum(t, c)


def gibbs(c: np.ndarray, t: np.ndarray, p: np.ndarray, discount: float, moves: int, rng: np.random.Generator, total: float | None = None) -> np.ndarray:
    """``moves`` rounds in which each dish lifts a customer and seats them again; ``total``: tables of the whole restaurant, if it is larger."""
    t = t.copy()
    some = np.flatnonzero(c > 1)
    table = alone(discount)
    n, exact = c[some], c[some] <= EXACT
    row = np.minimum(n, EXACT)
    for _ in range(moves):
        have = t[some]
        lonely = np.where(exact, table[row, np.minimum(have, EXACT)], discount * have / n)
        have = have - ((rng.random(len(some)) < lonely) & (have > 1))
        mass = (STRENGTH + discount * (t.sum() if total is None else total)) * p[some]
        t[some] = np.minimum(have + (rng.random(len(some)) < mass / (n - 1 - discount * have + mass)), n)
    return t


def discount_of(n1: float, n2: float) -> float:
    """The discount from the numbers of dishes seen once and twice."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Parameters:
    """What a chain needs besides its pairs: discount, and for each round the parent's probabilities and the split contexts' tables."""

    def __init__(self, counts: np.ndarray, split: int, discount: float, seed: int) -> None:
        self.counts, self.split, self.discount, self.seed = counts, split, discount, seed
        #: Probabilities by rank, at last that of a word that has no customers; the first two entries start the chain.
        self.parent: list[np.ndarray] = []
        #: For each entry of ``parent`` and each state that it averages: probabilities of words outside the vocabulary by customers.
        self.others: list[list[np.ndarray]] = []
        #: Parts in which the shards' words outside the vocabulary meet.
        self.parts = 1
        #: Tables of the split contexts at the start of each round; after the last round for each sample.
        self.tables: list[np.ndarray] = []


class Restaurants:
    """The restaurants of a shard: pairs by context and word, with their training tokens (0 for pairs of held-out texts only)."""

    def __init__(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, parameters: Parameters, shard: int = 0) -> None:
        self.c, self.given, self.shard = c.astype(np.int64), parameters, shard
        starts = _runs(u)
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u))))
        context = u[starts]
        #: Ranks, from there on places in ``cold``.
        self.word = w.astype(np.int64)
        outside = w >= COLD
        self.cold, at = np.unique(w[outside], return_inverse=True)
        self.word[outside] = len(parameters.counts) + at
        #: For each round and state the parent's customers of the words in ``cold``, once they are known.
        self.known: list[list[np.ndarray]] = []
        self.is_split = context < np.uint64(parameters.split)
        self.split_rank = context[self.is_split].astype(np.int64)
        self.customers = np.bincount(self.of, self.c, len(starts))
        # a word's tokens as a dish are its tokens as a context: an end precedes each start
        self.customers[self.is_split] = parameters.counts[self.split_rank]

    @classmethod
    def read(cls, row: dict, parameters: Parameters) -> Restaurants:
        """From a row of the shards with the parts' replies so far."""
        u, n, w, c = unpack(row["pairs"])
        out = cls(np.repeat(u, n.astype(np.int64)), w, c, parameters, row["shard"])
        out._receive(row["replies"] or [])
        return out

    def _by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each part with the places of its words in ``cold``."""
        part = (mix(self.cold) % np.uint64(self.given.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for places in np.split(order, _runs(part[order])[1:]) if len(order) else []:
            yield int(part[places[0]]), places

    def _receive(self, replies: list[dict]) -> None:
        data = {(r["turn"], r["part"]): r["data"] for r in replies}
        for turn, states in enumerate(self.given.others):
            known = [np.zeros(len(self.cold), np.int64) for _ in states]
            for part, places in self._by_part():
                for k, got in zip(known, unpack(data[turn, part]), strict=True):
                    k[places] = got
            self.known.append(known)

    def messages(self, states: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """For each part its words in ``cold``, ascending, and their tables in each state."""
        n = len(self.given.counts)
        at = np.flatnonzero(self.word >= n)
        tables = [np.bincount(self.word[at] - n, t[at], len(self.cold)).astype(np.int64) for t in states]
        for part, places in self._by_part():
            yield part, pack(np.diff(self.cold[places] ^ COLD, prepend=np.uint64(0)), *[t[places] for t in tables])

    def parent(self, turn: int) -> np.ndarray:
        """The parent's probability of each pair's word."""
        p = self.given.parent[turn]
        cold = np.full(len(self.cold), p[-1])
        if self.known:
            cold = sum(by[k] for by, k in zip(self.given.others[turn], self.known[turn], strict=True)) / len(self.known[turn])
        return np.append(p[:-1], cold)[self.word]

    def tables(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, t, len(self.customers))

    def chain(self, rounds: int) -> list[np.ndarray]:
        """Tables of each dish after ``rounds`` rounds; after the last of all rounds ``SAMPLES`` states, some sweeps apart."""
        given, d = self.given, self.given.discount
        t = np.minimum(self.c, 1)
        some = np.flatnonzero(self.c > 1)
        c, of = self.c[some], self.of[some]
        states = []
        for turn in range(rounds):
            rng = np.random.default_rng([given.seed, self.shard, turn])
            p, before = self.parent(turn)[some], self.tables(t)

            def mass() -> np.ndarray:
                now = self.tables(t)
                now[self.is_split] += given.tables[turn][self.split_rank] - before[self.is_split]  # noqa: B023
                return (STRENGTH + d * now)[of] * p  # noqa: B023

            if not turn:
                t[some] = first_seating(c, mass(), d, rng)
            for move in range(MOVES + (SAMPLES - 1) * APART * (turn == ROUNDS - 1)):
                t[some] = gibbs(c, t[some], mass() / STRENGTH, d, 1, rng, 0.0)
                if turn == ROUNDS - 1 and move + 1 >= MOVES and not (move + 1 - MOVES) % APART:
                    states.append(t.copy())
        return states or [t]

    def sums(self, states: list[np.ndarray]) -> np.ndarray:
        """For each state the tables by rank (customers of the parent) and of all other words, then those of the split contexts."""
        n, out = len(self.given.counts) + 1, []
        word = np.minimum(self.word, n - 1)
        for t in states:
            held = np.zeros(self.given.split)
            held[self.split_rank] = self.tables(t)[self.is_split]
            out += [np.bincount(word, t, n), held]
        return np.concatenate(out).astype(np.int64)

    def first(self) -> list[np.ndarray]:
        """The state before the chain: one table for each dish."""
        return [np.minimum(self.c, 1)]

    def first_sums(self) -> np.ndarray:
        """Contexts by word, dishes of the split contexts, and the pairs that occur once and twice."""
        return np.append(self.sums(self.first()), [(self.c == 1).sum(), (self.c == 2).sum()])

    def predictive(self) -> np.ndarray:
        """The probability of each pair's word after its context, averaged over the samples."""
        given, d = self.given, self.given.discount
        out = np.zeros(len(self.c))
        below, parent = STRENGTH + self.customers, self.parent(ROUNDS)
        for s, t in enumerate(self.chain(ROUNDS)):
            tables = self.tables(t)
            tables[self.is_split] = given.tables[ROUNDS][s][self.split_rank]
            left = (STRENGTH + d * tables) / below
            out += (self.c - d * t) / below[self.of] + left[self.of] * parent
        return out / SAMPLES


def mean_tables(most: int, mass: float, discount: float) -> np.ndarray:
    """The mean number of tables of a dish with 0, 1, ... ``most`` customers: t tables of c have weight S(c, t) * mass**t."""
    out, f = np.zeros(most + 1), np.ones(1)
    for c in range(1, most + 1):
        t = np.arange(1, len(f) + 1)
        out[c] = f @ t
        f = np.append((c - discount * t) * f, 0.0) + np.append(0.0, mass * f)
        f /= f.sum()
        f = f[: np.flatnonzero(f > 1e-30)[-1] + 1]  # what is smaller does not show in a mean
    return out


def seat_parent(k: np.ndarray, types: int, discount: float, rng: np.random.Generator, outside: np.ndarray | None = None) -> np.ndarray:
    """Probabilities by rank from the customers ``k`` of each (at last of all other words), then those of other words by customers 0, 1, ...

    ``outside``: how many words outside the vocabulary have so many customers. Their tables are summed out.
    """
    own, base = k[:-1], 1.0 / (types + 1)
    outside = np.zeros(1) if outside is None else outside
    p = np.full(len(own), base)
    t = first_seating(own, (STRENGTH + discount * types) * p, discount, rng)
    total = float(t.sum() + outside[1:].sum())
    for _ in range(MOVES):
        others = mean_tables(len(outside) - 1, (STRENGTH + discount * total) * base, discount)
        t = gibbs(own, t, p, discount, 1, rng, float(t.sum() + outside @ others))
        total = float(t.sum() + outside @ others)
    left = (STRENGTH + discount * total) * base
    got = np.append(own - discount * t, np.arange(len(outside)) - discount * others)
    return (got + left) / (STRENGTH + float(k.sum()))


class Model:
    """The shards (a written table) and what is broadcast: the vocabulary's counts and the chain's parameters."""

    def __init__(self, docs: DataFrame, seed: int = 3) -> None:
        spark = docs.sparkSession
        self.send = spark.sparkContext.broadcast
        self.words = materialize(count_words(docs), "words")
        one = lambda n: F.coalesce(F.sum(F.when(F.col("c") == n, 1)), F.lit(0))
        row = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), one(1), one(2)).first()
        self.train_tokens, self.types = int(row[0]), int(row[1])
        self.root_discount = discount_of(float(row[2]), float(row[3]))
        self.below = self.train_tokens + 0.1 * (self.types + 1)
        settle(spark)
        vocabulary = vocabulary_of(self.words, VOCABULARY)
        least = max(self.train_tokens / SPLIT, SHARD_TOKENS / 8)
        self.split = int((vocabulary.counts > least).sum())
        self.shards = max(partitions(spark), -(-self.train_tokens // SHARD_TOKENS))
        self.vocabulary = self.send(vocabulary)
        made = slice_rows(docs, self.vocabulary, self.split, self.shards, self.below).withColumn("own", F.col("shard").isNull())
        made = materialize(made, "slices", by="own")
        self.base = materialize(made.where("not own").select("slice", "shard", "request").groupBy("shard").applyInArrow(_build, BASE), "shards")
        release(made, "own=false")
        self.slices = made.where("own")
        self.cold = int(self.base.agg(F.coalesce(F.sum("cold"), F.lit(0))).first()[0])
        self.replies: list[DataFrame] = []
        settle(spark)
        self._fit(vocabulary, seed)

    def _shards(self, *columns: str) -> DataFrame:
        """The shards, each with the parts' replies so far."""
        base = self.base.select("shard", "pairs", *columns)
        if not self.replies:
            return base.withColumn("replies", F.lit(None).cast(REPLIES))
        got = reduce(DataFrame.unionAll, self.replies).groupBy("shard").agg(F.collect_list(F.struct("turn", "part", "data")).alias("replies"))
        return base.join(got, "shard", "left")

    def _gather(self, make: Callable[[Restaurants], tuple[np.ndarray, list[np.ndarray]]], given) -> tuple[np.ndarray, list[np.ndarray]]:
        """``make`` gives a shard's sums and states. The sums over all shards, and for each state the number of words outside the vocabulary by customers.

        Sums are added in each task, then in parts, which alone come to the driver. Words outside the vocabulary are added in parts of their own,
        whose replies stay as a table.
        """

        def row(part: int, shard: int | None, data: bytes) -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["part", "shard", "data"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in batch.to_pylist():
                    room = Restaurants.read(x, given.value)
                    found, states = make(room)
                    total = found if total is None else total + found
                    yield from (row(PARTS + part, x["shard"], data) for part, data in room.messages(states))
            if total is not None:
                yield from (row(part, None, pack(x)) for part, x in enumerate(np.array_split(total, PARTS)))

        def add(rows: pa.Table) -> pa.Table:
            part, data = rows.column("part")[0].as_py(), [unpack(x) for x in rows.column("data").to_pylist()]
            if part < PARTS:
                return pa.Table.from_batches([row(part, None, pack(sum(x[0] for x in data)))])
            words, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in data]), return_inverse=True)
            customers = [np.bincount(at, np.concatenate(x), len(words)).astype(np.int64) for x in list(zip(*data, strict=True))[1:]]
            out, end = [row(part, None, pack(*[np.bincount(k[k > 0], minlength=1) for k in customers]))], 0
            for shard, x in zip(rows.column("shard").to_pylist(), data, strict=True):
                end += len(x[0])
                out.append(row(part - PARTS, shard, pack(*[k[at[end - len(x[0]) : end]] for k in customers])))
            return pa.Table.from_batches(out)

        made = self._shards().mapInArrow(run, MESSAGES).groupBy("part").applyInArrow(add, MESSAGES).withColumn("own", F.col("shard").isNotNull())
        made = materialize(made, "replies", by="own")
        settle(self.base.sparkSession)
        parts = sorted(made.where("not own").select("part", "data").collect(), key=lambda r: r["part"])
        if self.cold:
            self.replies.append(made.where("own").select("shard", F.lit(len(self.replies)).alias("turn"), "part", "data"))
        got = [unpack(bytes(r["data"]))[0] for r in parts if r["part"] < PARTS]
        numbers = [unpack(bytes(r["data"])) for r in parts if r["part"] >= PARTS]
        outside = [np.zeros(max(map(len, x)), np.int64) for x in zip(*numbers, strict=True)]
        for x in numbers:
            for total, n in zip(outside, x, strict=True):
                total[: len(n)] += n.astype(np.int64)
        return np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64), outside or [np.zeros(1, np.int64)] * SAMPLES

    def _fit(self, vocabulary: Vocabulary, seed: int) -> None:
        n = len(vocabulary) + 1
        given = Parameters(vocabulary.counts, self.split, 0.5, seed)
        given.parts = max(1, -(-self.cold // COLD_WORDS))
        sent = self.send(given)
        first, outside = self._gather(lambda x: (x.first_sums(), x.first()), sent)
        sent.unpersist()
        first = first if len(first) else np.zeros(n + self.split + 2, np.int64)
        given.discount = discount_of(float(first[-2]), float(first[-1]))
        below = float(first[:n].sum()) + self.types + 1
        given.parent, given.tables = [np.append(first[: n - 1] + 1.0, 1.0) / below], [first[n : n + self.split]]
        given.others = [[(np.arange(len(outside[0])) + 1.0) / below]]
        for turn in range(ROUNDS):
            sent = self.send(given)

            def make(x: Restaurants, rounds: int = turn + 1) -> tuple[np.ndarray, list[np.ndarray]]:
                states = x.chain(rounds)
                return x.sums(states), states

            found, outside = self._gather(make, sent)
            sent.unpersist()
            found = found.reshape(-1, n + self.split) if len(found) else np.zeros((SAMPLES, n + self.split), np.int64)
            rng = np.random.default_rng([seed, turn])
            parents = [seat_parent(x[:n], self.types, self.root_discount, rng, k) for x, k in zip(found, outside, strict=False)]
            given.parent.append(sum(x[:n] for x in parents) / len(parents))
            given.others.append([x[n - 1 :] for x in parents])
            given.tables.append(found[:, n:] if turn == ROUNDS - 1 else found[0, n:])
        self.given = self.send(given)

    def answers(self) -> DataFrame:
        """(slice, shard, logs): base-10 logarithms of the slices' pairs, in their order."""
        given = self.given

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    shard, of, places = x["shard"], x["slices"], x["places"]
                    logs = np.log10(Restaurants.read(x, given.value).predictive()).astype(np.float32).view(np.uint32)
                    for i in range(0, len(of), 256):
                        got = [pack(logs[np.cumsum(unpack(p)[0]).astype(np.int64)]) for p in places[i : i + 256]]
                        yield pa.record_batch([pa.array(of[i : i + 256], pa.int64()), pa.array([shard] * len(got), pa.int32()), pa.array(got, pa.binary())], ["slice", "shard", "logs"])

        return self._shards("slices", "places").mapInArrow(run, "slice bigint, shard int, logs binary")


_SCORES = "slice bigint, doc int, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"


def _score_slice(rows: pa.Table) -> pa.Table:
    """The documents of a slice from the answers of the shards."""
    rows = rows.sort_by([("shard", "ascending")])  # nulls, the slice's own row, come last
    own = rows.slice(len(rows) - 1).to_pylist()[0]
    logs = [unpack(x)[0].astype(np.uint32).view(np.float32) for x in rows.column("logs").to_pylist() if x is not None]
    logs = np.concatenate(logs).astype(np.float64)
    length = np.array(own["n_tokens"], np.int64)
    begin = np.cumsum(length) - length
    step = unpack(own["codes"])[0].astype(np.int64)
    codes = np.cumsum(step)
    codes -= np.repeat(codes[begin] - step[begin], length)  # each document starts anew
    m = len(length)
    score = np.bincount(np.repeat(np.arange(m), length), logs[codes], m)
    columns = [pa.array([own["slice"]] * m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), *[pa.array(own[x], pa.int64()) for x in ("docs", "n_tokens", "n_known")]]
    return pa.table([*columns, pa.array(own["base"], pa.float64()), pa.array(score)], ["slice", "doc", "doc_id", "n_tokens", "n_known", "base", "score"])


def score(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    own = model.slices
    nothing = F.lit(None)
    sent = own.select("slice", F.col("shard"), nothing.cast("binary").alias("logs"), "docs", "n_tokens", "n_known", "base", "codes")
    got = model.answers().select("slice", "shard", "logs", *[nothing.cast(own.schema[x].dataType).alias(x) for x in ("docs", "n_tokens", "n_known", "base", "codes")])
    scored = sent.unionAll(got).groupBy("slice").applyInArrow(_score_slice, _SCORES)
    # words outside the vocabulary: their exact counts
    cold = own.select("slice", F.explode("cold").alias("x")).select("slice", "x.doc", "x.w", "x.n").join(model.words, "w", "left")
    count, n = F.coalesce("c", F.lit(0)), F.col("n")
    zero = F.lit(0).cast("long")
    late = cold.select(
        "slice", "doc", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_tokens"), F.when(count > 0, n).otherwise(zero).alias("n_known"), (n * F.log10((count + F.lit(0.1)) / F.lit(model.below))).alias("base"), F.lit(0.0).alias("score")
    )
    sums = [F.sum(x).alias(y) for x, y in (("n_tokens", "n_tokens"), ("n_known", "n_known"), ("base", "base_score"), ("score", "score"))]
    out = scored.unionAll(late).groupBy("slice", "doc").agg(F.max("doc_id").alias("doc_id"), *sums)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def pitman_yor_scores(docs: DataFrame, seed: int = 3) -> DataFrame:
    """Fit on the training documents and score all."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    return score(Model(docs, seed))
