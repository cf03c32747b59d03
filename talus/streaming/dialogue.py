"""Dialogue state and answer checks over streams, by the engine's keyed state with timers.

``prepare_stream`` gives the queries of conversations in the order of their times: turns wait until the watermark has passed them, so a stream cut
into batches in any way gives what the batch form gives; later ones are dropped. A turn that resets forgets a conversation, and so does a time without
turns. ``verify_stream`` gives an answer's events part by part: parts wait for those before them, and what has been said is withdrawn where a part shows it
to be wrong.

The state is kept in RocksDB, which the session is set to unless it has a setting of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from talus.operators import dialogue as D
from talus.operators import verify as V

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "key bigint, seq int, kind string, text string"
#: Times the wait for a part for which an answer that is over is remembered, so that parts that come again say nothing.
REMEMBERED = 24


def _keeps_state(stream: DataFrame) -> None:
    spark = stream.sparkSession
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Conversations(StatefulProcessor):
    """The turns that wait and the state after those that the watermark has passed."""

    def __init__(self, names: list[str], decide: D.Decider | None, idle_ms: int) -> None:
        self.names, self.decide, self.idle_ms = names, decide, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.catalogue = handle, D.Catalogue(self.names)
        self.waiting = handle.getListState("waiting", "at bigint, turn bigint, question string, answer string, reset boolean")
        self.state = handle.getValueState("state", "at bigint, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            at = batch["ts"].astype("datetime64[ms]").astype("int64")
            for x in zip(at, batch["turn"], batch["question"], batch["answer"], batch["reset"].fillna(False), strict=True):
                self.waiting.appendValue((int(x[0]), int(x[1]), x[2], x[3], bool(x[4])))
                due.add(int(x[0]))
        for at in due - set(self.handle.listTimers()):
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        held = self.state.get() if self.state.exists() else None
        if not ready:
            if held is not None and held[0] + self.idle_ms <= until:
                self.state.clear()
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        state, out = D.State(**json.loads(held[1])) if held is not None else D.State(), []
        last = held[0] if held is not None else None
        for at, *turn in ready:
            if last is not None and at - last >= self.idle_ms:
                state = D.State()
            state, made = D.prepare_turns([turn], state, self.catalogue, self.decide)
            out += made
            last = at
        self.state.update((last, json.dumps(asdict(state))))
        self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield pd.DataFrame([{"conv_id": key[0], **m} for m in out], columns=[c.split()[0] for c in D.RESULT.split(", ")])

    def close(self) -> None:
        pass


def prepare_stream(turns: DataFrame, names: list[str], decide: D.Decider | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """As ``dialogue.prepare`` for a stream of (conv_id, turn, question, answer, ts, reset), in the order of ``ts``, then ``turn``.

    A conversation is forgotten by a turn with ``reset``, and where ``idle_ms`` pass between two turns. Turns more than ``late`` behind are dropped.
    """
    _keeps_state(turns)
    rows = turns.select("conv_id", "turn", "question", "answer", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), "reset").withWatermark("ts", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(_Conversations(names, decide, idle_ms), D.RESULT, "append", "eventTime")


class _Answers(StatefulProcessor):
    """The parts that wait for those before them, and the check's state after the last one that did not."""

    def __init__(self, facts: dict[str, dict], names: list[str], instead: str, idle_ms: int) -> None:
        self.facts, self.names, self.instead, self.idle_ms = facts, names, instead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.catalogue = handle, V.Catalogue(self.names)
        self.state = handle.getValueState("answer", "next int, said int, held string, subject string, withdrawn boolean, ended boolean, at bigint")
        self.waiting = handle.getMapState("waiting", "seq int", "text string, last boolean")

    def _check(self) -> tuple[V.AnswerCheck, int, int, bool, int]:
        held = self.state.get() if self.state.exists() else (0, 0, "", None, False, False, 0)
        return V.AnswerCheck(self.facts, self.catalogue, self.instead, held[2], held[3], held[4]), held[0], held[1], held[5], held[6]

    def _keep(self, check: V.AnswerCheck, at: int, said: int, ended: bool, last: int) -> None:
        """The state, and the one timer: at the end of the wait for the next part, or of the time that an answer that is over is remembered."""
        self.state.update((at, said, check.held, check.subject, check.withdrawn, ended, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.idle_ms * (REMEMBERED if ended else 1))

    def _told(self, key: tuple, events: list, said: int) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame({"key": [key[0]] * len(events), "seq": range(said, said + len(events)), "kind": [k for k, _ in events], "text": [t for _, t in events]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        check, at, said, ended, moment = self._check()
        new: dict[int, tuple] = {}
        for batch in rows:
            times = batch["ts"].astype("datetime64[ms]").astype("int64")
            for s, t, last, ms in zip(batch["seq"], batch["text"], batch["last"].fillna(False), times, strict=True):
                new[int(s)] = (t, bool(last))
                moment = max(moment, int(ms))
        if ended:
            return
        events: list = []
        for s, x in new.items():
            if s > at:
                self.waiting.updateValue((s,), x)
        while not ended:
            if at in new:
                text, last = new[at]
            elif self.waiting.containsKey((at,)):
                text, last = self.waiting.getValue((at,))
            else:
                break
            if self.waiting.containsKey((at,)):
                self.waiting.removeKey((at,))
            at += 1
            events += check.feed(text or "")
            ended = last or check.withdrawn
        if ended:
            events += check.end()
            self.waiting.clear()
        self._keep(check, at, said + len(events), ended, moment)
        yield from self._told(key, events, said)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: what is held of the answer is said, and it is over; later it is forgotten."""
        check, at, said, ended, moment = self._check()
        self.waiting.clear()
        if ended:
            self.state.clear()
            return
        events = check.end()
        self._keep(check, at, said + len(events), True, moment)
        yield from self._told(key, events, said)

    def close(self) -> None:
        pass


def verify_stream(parts: DataFrame, facts: dict[str, dict], catalogue: list[str], instead: str, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """As ``verify.verify_streams`` for a stream of (key, seq, text, last, ts): seq counts from 0, ``last`` marks an answer's last part.

    Events carry running numbers; ``retract`` takes back all events of the answer before it. Parts may come in any order and again, ``late`` behind at
    most. An answer whose next part has not come when the watermark is ``idle_ms`` past its parts is over: what is held of it is said, and later
    parts say nothing. It is forgotten after ``REMEMBERED`` times that.
    """
    _keeps_state(parts)
    rows = parts.select(F.col("key").cast("bigint").alias("key"), F.col("seq").cast("int").alias("seq"), "text", "last", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Answers(facts, catalogue, instead, idle_ms), EVENTS, "append", "eventTime")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window, late ones up to ``late``; ``ts`` without a zone counts as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream as JSON lines, each batch in a folder of its own number.

    A batch that is run again replaces what it had written; one that fails is tried again by the engine from its offsets and, if it fails for good, stops the
    query: nothing is doubled and nothing lost. ``read_log`` reads all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_log(spark, path: str, schema: str) -> DataFrame:
    """The lines of a log with the number of their batch; a batch that was not finished has none."""
    return spark.read.schema(f"{schema}, batch bigint").json(path)
