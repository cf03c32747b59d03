"""Dialogue state: which degrees a conversation is about, and the query a question stands for.

``step`` is a pure function from state and turn to state and query; the batch form applies it to a conversation's
turns in order, the streaming form keeps the state between batches (``talus.streaming.dialogue``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import plain as P
from talus.functions import text as T

#: What a decider returns: a class and degrees; None if it failed.
Decision = tuple[str, list[str]]
Decider = Callable[[str, list[str], tuple[str, str] | None], Decision | None]
FOLLOW, CHANGE, ALL, NONE, FAILED = "SIGUE", "CAMBIA", "TODAS", "NINGUNA", "FALLO"
SHORTEST_PART = 12
EDGES = ".-–—*: "


@dataclass(frozen=True)
class State:
    """What is remembered between turns."""

    questions: list[str] = field(default_factory=list)
    scope: list[str] = field(default_factory=list)
    predicate: str = ""
    last: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Query:
    """What a question is searched as."""

    text: str
    scope: list[str]
    fallback: str
    open: bool
    decision: str


def parse_decision(output: str, catalogue: list[str]) -> Decision:
    """The first line that is not blank: a keyword, or names between semicolons, exact before partial."""
    line = next((x for x in output.splitlines() if x.strip()), "")
    said = P.normalize(line.strip().strip(EDGES))
    for word, kind in (("sigue", FOLLOW), ("todas", ALL), ("ninguna", NONE)):
        if said.startswith(word):
            return kind, []
    keys = {n: P.normalize(n) for n in catalogue}
    meant: set[str] = set()
    for part in filter(None, (P.normalize(x.strip().strip(EDGES)) for x in line.split(";"))):
        exact = {n for n, k in keys.items() if k == part}
        meant |= exact or {n for n, k in keys.items() if len(part) >= SHORTEST_PART and part in k}
    return (CHANGE, [n for n in catalogue if n in meant]) if meant else (NONE, [])


def ask(decide: Callable[[str], str], catalogue: list[str], attempts: int = 2) -> Decider:
    """A decider from a function that answers a request; it is asked again once if it raises."""

    def run(question: str, scope: list[str], last: tuple[str, str] | None) -> Decision | None:
        about = f"Se habla de: {'; '.join(scope)}. " if scope else ""
        for _ in range(attempts):
            try:
                return parse_decision(decide(f"{about}Mensaje: «{question}»"), catalogue)
            except Exception:  # noqa: BLE001 - any failure of the model counts
                continue
        return None

    return run


class Catalogue:
    """Names with what is derived from them once."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.tokens = {n: P.tokens(n) for n in names}
        self.distinctive = P.distinctive(names)
        self.words = set().union(*self.tokens.values())

    def mentioned(self, text: str) -> list[str]:
        said = P.tokens(text) & self.distinctive
        return [n for n in self.names if self.tokens[n] & said]

    def content(self, text: str) -> set[str]:
        return P.tokens(text) - set(X.STOPWORDS) - set(X.ORDINALS) - self.words


def step(state: State, question: str, answer: str, cat: Catalogue, decide: Decider | None = None, remembered: int = X.REMEMBERED) -> tuple[State, Query]:
    """The query of one turn and the state after it.

    A decision goes before what the question mentions, and that before the inherited scope; two full names
    in the question go before everything.
    """
    decision = decide(question, state.scope, tuple(state.last) or None) if decide else None
    kind = decision[0] if decision else FAILED if decide else ""
    kept = {CHANGE: decision[1] if decision else [], ALL: [], NONE: []}.get(kind, state.scope)
    mentioned, full = cat.mentioned(question), P.named_in_full(question, cat.names)
    several = len(full) >= 2
    scope = full if several else kept if decision else (mentioned or kept)
    kept = full if several else kept
    said = P.tokens(question)
    searched = question
    if not cat.content(question) and state.predicate:
        gone = cat.distinctive | (set(X.ORDINALS) if said & set(X.ORDINALS) else set())
        searched = " ".join([*(w for w in state.predicate.split() if not P.tokens(w) & gone), question])
    elif not mentioned and len(scope) == 1:
        searched = f"{question} {scope[0]}"
    retry = state.predicate and state.predicate != question and (decision is None or kind == FOLLOW)
    query = Query(searched.strip(), list(scope), f"{state.predicate} {question}".strip() if retry else "", kind == ALL and not several and not said & set(X.PLURAL_DEMONSTRATIVES), kind)
    if P.fixed_reply(question):  # such a turn leaves no trace
        return replace(state, scope=kept), query
    narrows = any(a in P.normalize(question) for a in X.ANAPHORA)
    after = kept
    if decision is None:
        after = mentioned or P.named_in_full(answer, cat.names) or kept
    questions = [*state.questions, question]
    return State(questions[max(0, len(questions) - remembered):], after, question if cat.content(question) and not narrows else state.predicate, [question, answer]), query


RESULT = "conv_id bigint, turn bigint, text string, scope array<string>, fallback string, open boolean, decision string, remembered array<string>"


def prepare_turns(turns: Iterator[tuple[int, str, str, bool]], state: State, cat: Catalogue, decide: Decider | None) -> tuple[State, list[dict]]:
    """The queries of turns in order; one that resets forgets all and is no question."""
    out = []
    for turn, question, answer, reset in turns:
        if reset:
            state = State()
            continue
        before = state.questions
        state, query = step(state, question, answer, cat, decide)
        out.append({"turn": turn, **asdict(query), "remembered": before})
    return state, out


def prepare(turns: DataFrame, names: list[str], decide: Decider | None = None) -> DataFrame:
    """The queries of ``turns(conv_id, turn, question, answer)``; a conversation is one group, its turns in order. A column ``reset`` may mark turns that forget all before."""
    built: list[Catalogue] = []
    columns = ["conv_id", "turn", "text", "scope", "fallback", "open", "decision", "remembered"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not built:  # once a task, not once a conversation
            built.append(Catalogue(names))
        rows = rows.sort_values("turn")
        resets = rows["reset"].fillna(False).astype(bool) if "reset" in rows else [False] * len(rows)
        _, made = prepare_turns(zip(rows["turn"], rows["question"], rows["answer"], resets, strict=True), State(), built[0], decide)
        return pd.DataFrame([{"conv_id": rows["conv_id"].iloc[0], **m} for m in made], columns=columns)

    return turns.groupBy("conv_id").applyInPandas(run, RESULT)


def turns_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user message with the assistant's that follows it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    after = messages.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w))
    return after.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_r") == "assistant", F.col("_t")).otherwise("").alias("answer"))


def mentions(questions: DataFrame, catalogue: DataFrame, words: DataFrame) -> DataFrame:
    """(conv_id, turn, name): names that share a distinctive word with a question."""
    said = questions.select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("word"))
    of = catalogue.select("name", F.explode(T.tokens(F.col("name"))).alias("word")).join(words.select("word"), "word")
    return said.join(of, "word").select("conv_id", "turn", "name").distinct()


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, not overlapping."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")
