"""Token counts by overlap resynchronisation.

A text of more than one chunk is encoded in chunks of ``chunk`` characters that reach ``overlap`` characters into the next one, each by the library and
with its offsets. Two neighbouring encodings are spliced at the last place of their overlap at which a boundary is proven stable and both have a token that
starts there; where there is none, the later chunk starts earlier, with twice the overlap each time, and at last both are one chunk. Counts are
those of the tokens between splices, so without an overlap nothing could be spliced.

In front of white space that follows another character a boundary is proven: no alternative of the splitting pattern reaches across it, matching
never looks behind, and merges never cross pre-tokens. Where an overlap has no white space, places count at which the class of characters changes, away from the
end and from special strings.

A text of one chunk has nothing to splice. Its pieces between proven boundaries are encoded, each distinct piece of a batch once; a task remembers ``most``
pieces.

Null texts are empty; repeated rows are counted each, in any order, and nothing is ranked, so ties do not arise; rows without an id are counted like others; an
empty table gives an empty result; extra columns are ignored. A very long text costs time in proportion to its length; what is held of it are two chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from talus.llm.common import buffers, slices

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
TOKENIZER = "byte_bpe_50k.json"
#: Characters of a chunk, and by which it reaches into the next.
CHUNK, OVERLAP = 8192, 128
#: Pieces whose counts a task remembers at most, and the longest that it remembers in bytes.
CACHE_PIECES, CACHED_BYTES = 400_000, 64
#: Inside a piece: ASCII letter, digit and sign next to another class (an apostrophe may bind the letters after it), or a space between letters.
_SIGN = r"[!-&(-/:-@\[-`{-~]"
_STABLE = re.compile(rf"(?<=[^\W\d_]) (?=[^\W\d_])|(?<=[A-Za-z])(?=[0-9]|{_SIGN}|')|(?<=[0-9])(?=[A-Za-z]|{_SIGN}|')|(?<={_SIGN})(?=[A-Za-z0-9])")

#: A proven boundary: white space after a character that is none.
_PROVEN = re.compile(r"(?<=[!-~]|[^\W\d_])(?=[\t-\r ])")
#: Characters at the end of a chunk, and around special strings, in which other places do not count.
CLEAR = 32

_LOADED: dict[str, object] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters that are no white space by any definition.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


def load(name: str):
    """The tokenizer of a vocabulary file, once a worker; single-threaded."""
    if name not in _LOADED:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(public_tokenizers.path(name))
        found.no_padding()
        found.no_truncation()
        _LOADED[name] = found
    return _LOADED[name]


def _starts(encoding, at: int) -> int | None:
    """The token that starts at a character of an encoded chunk, if one does."""
    i = encoding.char_to_token(at)
    return i if i is not None and encoding.token_to_chars(i)[0] == at else None


def splice(text: str, left, start: int, end: int, right, low: int, special: list[str]) -> tuple[int, int] | None:
    """(tokens of ``left`` in front of the splice, the token of ``right`` there) of two encodings, of text[start:end] and from ``low`` on."""
    proven = [m.start() for m in _PROVEN.finditer(text, low + 1, end)]
    # the last tokens of a chunk may still change where no white space ends them
    others = [m.start() for m in _STABLE.finditer(text, low + 1, max(low + 1, end - CLEAR))] if not proven else []
    for at in reversed(proven or others):
        if not proven and any(x in text[max(0, at - CLEAR) : at + CLEAR] for x in special):
            continue
        ours, theirs = _starts(left, at - start), _starts(right, at - low)
        if ours is not None and theirs is not None:
            return ours, theirs
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple]:
    """(encoding, first token, one past the last) of each chunk of a text; together these are the tokens of the whole."""
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    start, end, skip = 0, min(len(text), chunk + overlap), 0
    left = encode(start, end)
    while end < len(text):
        width, found = overlap, None
        last = min(len(text), end + chunk)
        while found is None:
            low = max(start, end - width)
            if low == start and width:
                break
            right = encode(low, last)
            found = splice(text, left, start, end, right, low, special)
            width = 2 * width or 1
        if found is None:  # no common boundary however wide: one chunk, twice as long
            end = min(len(text), start + 2 * (end - start))
            left = encode(start, end)
            continue
        yield left, skip, found[0]
        start, end, left, skip = low, last, right, found[1]
    yield left, skip, len(left)


def encode_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text by overlapping chunks, equal to encoding it whole."""
    return [i for e, a, b in spliced(tokenizer, text, chunk, overlap) for i in e.ids[a:b]]


def stable(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a stable boundary stands: white space after another character, both in one chunk; ``first`` has the chunks' starts.

    Of characters beyond ASCII those with a leading byte or first two bytes of Unicode white space do not count.
    """
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(_SPACE[data])
    inside = at - first[np.searchsorted(first, at, "right") - 1]  # bytes of the chunk in front of each place
    at, inside = at[inside > 0], inside[inside > 0]
    one = data[at - 1]
    good = _SOLID[one]
    far = np.flatnonzero((one >= 0x80) & (inside >= 4) & (at >= 4))
    two, three, four = (data[at[far] - k] for k in (2, 3, 4))
    blank = (three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x80, 0x81, 0x9A, 0xA0))
    good[far] = ((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE0) & (two < 0xC0) & ~blank) | ((four >= 0xF0) & (three < 0xC0) & (two < 0xC0))
    out[at[good]] = True
    return out


class PieceCounts:
    """Numbers of tokens by piece, each distinct piece of a call encoded once; remembers ``most`` short pieces."""

    def __init__(self, tokenizer, most: int = CACHE_PIECES, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.tokenizer, self.most, self.chunk, self.overlap, self.known = tokenizer, most, chunk, overlap, {}

    def _encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece data[start:end]; pieces stand in order and do not overlap."""
        if not len(start):
            return np.zeros(0, np.int64)
        size = end - start
        offs = np.append(0, np.cumsum(size)).astype(np.int32)
        if offs[-1] != len(data):  # drop what is in no piece
            data = data[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
        column = pa.StringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        here = coded.dictionary.to_pylist()
        if len(self.known) + len(here) > self.most:
            self.known = {p: self.known[p] for p in here if p in self.known}
        each = list(map(self.known.get, here))
        if None in each:
            new = [p for p, n in zip(here, each, strict=True) if n is None]
            got = dict(zip(new, self._encode(new), strict=True))
            each = [got[p] if n is None else n for p, n in zip(here, each, strict=True)]
            self.known.update((p, n) for p, n in got.items() if len(p) <= CACHED_BYTES)
        return np.array(each, np.int64)[coded.indices.to_numpy()]


def whole_counts(data: np.ndarray, offs: np.ndarray, count: PieceCounts) -> np.ndarray:
    """Numbers of tokens of texts of one chunk, piece by piece between their proven boundaries."""
    head = stable(data, offs[:-1]) if len(data) else np.zeros(0, bool)
    head[offs[:-1][np.diff(offs) > 0]] = True
    begin = np.flatnonzero(head)
    n = count(data, begin, np.append(begin[1:], len(data))[: len(begin)])
    return np.bincount(np.searchsorted(offs, begin, "right") - 1, n, len(offs) - 1).astype(np.int64)


def count_tokens(texts: pa.Array, count: PieceCounts) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, number of splices) of each text."""
    long = pc.greater(pc.utf8_length(texts), count.chunk + count.overlap).to_numpy(zero_copy_only=False).astype(bool)
    n, splices = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    n[~long] = whole_counts(*buffers(texts.filter(pa.array(~long))), count)
    for i in np.flatnonzero(long).tolist():
        for _, a, b in spliced(count.tokenizer, texts[i].as_py(), count.chunk, count.overlap):
            n[i] += b - a
            splices[i] += 1
        splices[i] -= 1
    return n, splices


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounts(load(tokenizer), chunk=chunk, overlap=overlap)  # goes with the task: workers live on and serve other stages
        for batch in slices(batches, most=1 << 20):
            text = pc.fill_null(batch.column("text"), "")
            n = pa.array(count_tokens(text, count)[0])
            yield pa.record_batch([batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
