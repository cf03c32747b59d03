"""Best-fit packing with swap-based local search.

Documents become token ids (with an end id) and pieces of at most ``capacity`` tokens. Pieces are dealt
by hash into shards of bounded size; each shard is packed best-fit decreasing, then a local search
moves pieces, exchanges one for one and two for one between underfull bins whenever the sum of squared
fills grows, until bins empty. The lengths alone ask for less than one sequence a shard more than packing everything at once would.

Null texts are empty (one piece: the end id); repeated rows are packed each, rows without an id too; pieces of equal length stand by
id, piece and place of reading; an empty table gives an empty result; other columns, whatever their names, are ignored. A very long
text is cut into pieces like others; its encoding takes memory in proportion to its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import materialize, slices
from talus.llm.token_counts import load

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SHARD_PIECES = 20_000
#: Words whose ids a task remembers at most.
CACHE_WORDS = 400_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


#: A comma or full stop between a Latin letter and white space is a pre-token of its own. Not after U+0130, whose small form ends in a mark.
_STOP = r"([a-z\x{00DF}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{024F}])([,.])([ \n]|$)"


class WordEncoder:
    """Ids by word, for tokenizers whose pre-tokens never hold ASCII white space, drop it, and part letters from signs.

    Neither normalisation nor pre-tokens reach across such white space, so a text's ids are
    its words' ids in a row. Each distinct word of a batch is looked up once; a task remembers
    ``most`` words, and gives up those that the latest batch did not hold when that is reached.
    """

    def __init__(self, name: str, most: int = CACHE_WORDS) -> None:
        self.tokenizer, self.most, self.known = load(name), most, {}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        self.special = list(special)

    def _learn(self, words: list[str]) -> None:
        """Encode words by fifties, a special token keeping them apart."""
        parts = [words[i : i + 50] for i in range(0, len(words), 50)]
        texts = [self.mark.join(p) for p in parts]
        for part, text, e in zip(parts, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            if sum(map(text.count, self.special)) > len(part) - 1:  # a word holds a special token itself
                for w in part:
                    self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            ids = np.array(e.ids, "<u4")
            cut = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *[c + 4 for c in cut]], [*cut, len(raw)])), strict=True))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The little-endian 32-bit ids of each text."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the normaliser lower-cases all but special tokens
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, _STOP, r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        here = coded.dictionary.to_pylist()
        if len(self.known) + len(here) > self.most:
            self.known = {w: self.known[w] for w in here if w in self.known}
        each = list(map(self.known.get, here))
        if None in each:
            self._learn([w for w, ids in zip(here, each, strict=True) if ids is None])
            each = list(map(self.known.__getitem__, here))
        flat = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int32, len(each)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        code = coded.indices.to_numpy()
        width = size[code]
        end = np.cumsum(width, dtype=np.int32)
        total = int(end[-1]) if len(end) else 0
        ids = flat[np.repeat(first[code] - (end - width), width) + np.arange(total, dtype=np.int32)]
        at = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)  # goes with the task: workers live on and serve other stages
        end, step, salt = np.array([end_id], "<u4").tobytes(), 4 * capacity, 0
        for batch in slices(batches, most=2 << 20):
            rows = []
            texts = pc.fill_null(batch.column("text"), "")
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), salt))
                    salt += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers, best-fit decreasing."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bin numbers by free space
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
            free -= n
        else:
            b, free = len(bins), capacity - n
            bins.append([i])
        if free:
            open_[free].append(b)
            mask |= 1 << free
    return bins


class LocalSearch:
    """Exchanges between underfull bins: each raises the sum of squared fills, so the search ends.

    A bin is filled from another one by one piece for none (a move), one for one, two for one or none, or one for two. Bins are taken from the fullest
    to the emptiest; each gets the exchange that leaves least of its free space, of equals the one that takes from the
    emptiest bin, for as long as there is one that leaves it fuller than its partner was. So free space gathers in few bins until they
    are empty. All underfull bins are partners, and passes go on until one changes nothing or ``least`` bins are left.

    What bins offer is indexed by sum: for each number of tokens the underfull bins that hold a piece, or two pieces, of that many, the emptiest first, in
    heaps whose stale entries go when they come up. A bin's search runs over the gains that some bin's offer makes possible, the
    largest first, and ends at the first that a partner allows; pieces are looked up only for the exchange that is made.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.size, self.capacity = [int(n) for n in lengths], capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        self.alive = sum(map(bool, self.bins))
        self.version = [0] * len(self.bins)
        #: By kind (one piece, two): heaps of (fill, bin, version) by number of tokens, and which numbers are on offer.
        self.heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.offered = [0, 0]
        for k in range(len(self.bins)):
            self._offer(k)

    def _sums(self, k: int) -> tuple[set[int], set[int]]:
        """The sums of one piece and of two pieces of a bin."""
        ones: set[int] = set()
        twos: set[int] = set()
        for i in self.bins[k]:
            n = self.size[i]
            twos.update([n + m for m in ones])
            if n in ones:
                twos.add(2 * n)
            ones.add(n)
        return ones, twos

    def _offer(self, k: int) -> None:
        self.version[k] += 1
        if 0 < self.fill[k] < self.capacity:
            entry = (self.fill[k], k, self.version[k])
            for kind, sums in enumerate(self._sums(k)):
                heaps, bits = self.heaps[kind], 0
                for n in sums:
                    heappush(heaps[n], entry)
                    bits |= 1 << n
                self.offered[kind] |= bits

    def _emptiest(self, kind: int, n: int, y: int) -> tuple[int, int] | None:
        """(fill, bin) of the emptiest bin but ``y`` that offers ``n`` tokens."""
        heap, own = self.heaps[kind][n], None
        while heap and (self.version[heap[0][1]] != heap[0][2] or heap[0][1] == y):
            top = heappop(heap)
            if top[1] == y and self.version[y] == top[2]:
                own = top
        found = heap[0][:2] if heap else None
        if own:
            heappush(heap, own)
        elif not heap:
            self.offered[kind] &= ~(1 << n)
        return found

    def _best(self, y: int) -> tuple[int, int, int, int] | None:
        """(bin, kind, tokens it gives, tokens it gets back) of the exchange that fills bin ``y`` best."""
        fill, free = self.fill[y], self.capacity - self.fill[y]
        ones, twos = self._sums(y)
        room = (2 << free) - 2  # gains of 1 to free
        tries = [(kind, back, (self.offered[kind] >> back) & room) for kind in (0, 1) for back in (0, *ones)]
        tries += [(0, back, (self.offered[0] >> back) & room) for back in twos]
        tries = [t for t in tries if t[2]]
        gains = 0
        for _, _, bits in tries:
            gains |= bits
        while gains:
            gain = gains.bit_length() - 1
            gains ^= 1 << gain
            best = None
            for kind, back, bits in tries:
                if bits >> gain & 1 and (found := self._emptiest(kind, back + gain, y)) and found[0] < fill + gain and (best is None or found[0] < best[0]):
                    best = (found[0], found[1], kind, back + gain, back)
            if best:
                return best[1:]
        return None

    def _pick(self, k: int, kind: int, n: int) -> list[int]:
        """One piece, or two, of ``n`` tokens in a bin."""
        if not kind:
            return [next(i for i in self.bins[k] if self.size[i] == n)]
        seen: dict[int, int] = {}
        for i in self.bins[k]:
            if n - self.size[i] in seen:
                return [seen[n - self.size[i]], i]
            seen[self.size[i]] = i
        raise AssertionError("no such pair")

    def _exchange(self, y: int, x: int, kind: int, n: int, back: int) -> None:
        out = self._pick(x, kind, n)
        # one piece back where one has that many tokens, else two
        given = self._pick(y, int(back not in self._sums(y)[0]), back) if back else []
        for source, target, moved in ((x, y, out), (y, x, given)):
            for i in moved:
                self.bins[source].remove(i)
                self.bins[target].append(i)
        self.fill[x] -= n - back
        self.fill[y] += n - back
        self.alive -= not self.bins[x]
        self._offer(x)
        self._offer(y)

    def run(self, least: int) -> list[list[int]]:
        changed = True
        while changed and self.alive > least:
            changed = False
            for y in sorted(range(len(self.fill)), key=lambda k: (-self.fill[k], k)):
                while 0 < self.fill[y] < self.capacity and self.alive > least and (found := self._best(y)):
                    self._exchange(y, *found)
                    changed = True
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """``bins`` after the exchanges; those that are as few as the lengths allow are left as they are."""
    least = -(-int(lengths.sum()) // capacity)
    return LocalSearch(bins, lengths, capacity).run(least) if len(bins) > least else bins


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Sequence and offset of each piece of one shard."""
    rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    packed = local_search(best_fit(lengths, capacity), lengths, capacity)
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for s, b in enumerate(packed):
        at = 0
        for i in b:
            sequence[i], offset[i] = s, at
            at += int(lengths[i])
    rows["sequence_id"] = (rows["shard"].to_numpy().astype(np.int64) << 32) + sequence
    rows["offset"] = offset
    return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def best_fit_packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each row of ``docs``, with its place in a sequence."""
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)).alias("shard")
    return cut.select("*", shard).groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), PACKED)
