"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match
satisfies (letters A-Z count as lower case). Each block of documents gets an inverted index of the
trigrams that the rules ask for; a rule's query intersects and unites postings, and only the documents
that remain are searched with the expression itself. Rules without mandatory trigrams search every document.

Null texts are empty; repeated rows are scanned each, rows without an id too; an empty table gives an empty result. Spans that start at one place stand in the
order of their kinds. A very long text is a block of its own, searched whole in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from talus.llm.common import buffers, lower, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, flags, and the least length of ``group``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


#: The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE
#: A set of exact strings larger than this is given up for "anything".
EXACT = 64

#: Queries: True (everything), a trigram, ("and", parts), ("or", parts).


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _grams(words: set[str]):
    """Every one of the strings' trigrams, for one string or another; True if one is too short."""
    if any(len(w) < 3 for w in words):
        return True
    each = []
    for w in sorted(words):
        grams = tuple(dict.fromkeys(w[i : i + 3] for i in range(len(w) - 2)))
        each.append(grams[0] if len(grams) == 1 else ("and", grams))
    return each[0] if len(each) == 1 else ("or", tuple(each))


def _class(items) -> set[str] | None:
    """The lower-case characters of a small class, else None."""
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(the exact strings it can match, or None; a query that holds whenever it matches)."""
    run: set[str] = {""}
    query: object = True
    exact = True
    for op, arg in nodes:
        words, inner = None, True
        if op is sre.LITERAL:
            words = {chr(arg).lower()}
        elif op is sre.IN:
            words = _class(arg)
        elif op is sre.SUBPATTERN:
            words, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(w is not None for w, _ in parts):
                words = set().union(*(w for w, _ in parts))
            else:
                asked = [_both(q, _grams(w) if w is not None else True) for w, q in parts]
                inner = True if any(q is True for q in asked) else ("or", tuple(asked))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            of, q = _walk(sub)
            if high == 1 and low == 0 and of is not None:
                words = of | {""}
            elif low == high and of is not None and len(of) ** low <= EXACT:
                words = {""}
                for _ in range(low):
                    words = {a + b for a in words for b in of}
            elif low:
                inner = _both(q, _grams(of) if of is not None else True)
        elif op is sre.AT:
            words = {""}
        if words is not None and len(run) * len(words) <= EXACT and all(x.isascii() for x in words):
            run = {a + b for a in run for b in words}
        else:
            exact = False
            query = _both(query, _grams(run))
            if words is not None and all(x.isascii() for x in words):
                query = _both(query, inner)
                run = words if len(words) <= EXACT else {""}
            else:
                query, run = _both(query, inner), {""}
    return (run, True) if exact else (None, _both(query, _grams(run)))


@lru_cache(None)
def trigram_query(pattern: str, flags: int = 0):
    """The Boolean trigram query of an expression."""
    words, query = _walk(sre_parse.parse(pattern, flags))
    return _grams(words) if words is not None else query


def _asked(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_asked, query[1]))


class Index:
    """Postings of the wanted trigrams over one block of documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, wanted: np.ndarray, table: np.ndarray) -> None:
        self.n = len(offs) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        small = lower(data).astype(np.uint32)
        code = (small[:-2] << 16) | (small[1:-1] << 8) | small[2:]
        at = np.flatnonzero(table[code])
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[doc + 1]
        code, doc = code[at[inside]], doc[inside]
        for c in wanted:
            self.postings[int(c)] = np.unique(doc[code == c])

    def find(self, query) -> np.ndarray:
        """The documents that satisfy a query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(_code(query), np.zeros(0, np.int64))
        kind, parts = query
        if kind == "or":
            return np.unique(np.concatenate([self.find(p) for p in parts]))
        found = None
        for p in sorted(map(self.find, parts), key=len):
            found = p if found is None else np.intersect1d(found, p, assume_unique=True)
            if not len(found):
                break
        return found


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


class Scanner:
    """Rules with their queries and the lookup table of the trigrams they ask for."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.wanted = np.array(sorted({_code(g) for _, _, q in self.rules for g in _asked(q)}), np.int64)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.wanted] = True

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each secret of each text, in order."""
        data, offs = buffers(column)
        index = Index(data, offs, self.wanted, self.table)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for k, (rule, expression, query) in enumerate(self.rules):
            for d in index.find(query).tolist():
                if d not in texts:
                    texts[d] = data[offs[d] : offs[d + 1]].tobytes().decode()
                for m in expression.finditer(texts[d]):
                    if len(m.group(rule.group)) >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"
DIGEST = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans (kind, start, end in code points), for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.scan(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def digest(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = "transform(filter(spans, s -> s.kind in ('assign', 'access', 'hex')), s -> concat_ws(':', s.kind, s.start, s.end))"
    of = "cast(size(filter(spans, s -> s.kind = '{0}')) as bigint) n_{0}"
    return spans.selectExpr(
        "doc_id", *[of.format(r.kind) for r in BASE],
        f"sha2(array_join({base}, ','), 256) base_sha256",
        "array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',') spans",
        "cast(size(spans) as bigint) n_spans",
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; all rows and columns stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches):
            column = batch.column("text")
            out = column.to_pylist()
            for d, spans in enumerate(scanner.scan(column)):
                if spans:
                    text, parts, at = out[d], [], 0
                    for s, _, e in spans:
                        if e <= at:
                            continue
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = e
                    out[d] = "".join([*parts, text[at:]])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, column.type))

    return docs.mapInArrow(run, docs.schema)
