"""Stateful operators on streams: line framing, ordered folds and state that expires.

Each is a small processor per key that keeps what it must and no more; Spark holds the state in RocksDB, partitioned by key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Processors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The processors need RocksDB; a join of streams keeps a partition's four tables in one store of it, and no put first asks
#: for the row it replaces, which serves only a metric.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, for the streams that start within."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class LineFramer(StatefulProcessor):
    """Keeps the rest of a session's last line, and chunks that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "next long, lines long, data binary, early boolean")
        self.early = handle.getListState("early", "at long, data binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # each call of the state store is a message to the JVM, so chunks go and come in one
        came = {int(at): (bytes(data or b""), bool(last)) for batch in rows for at, data, last in zip(batch["at"], batch["data"], batch["last"], strict=True)}
        at, lines, rest, waits = self.rest.get() if self.rest.exists() else (0, 0, b"", False)
        rest, found = bytes(rest), []
        opened = waits and at in came  # only then can chunks that wait come to their turn
        if opened:
            came = {n: (bytes(data), last) for n, data, last in self.early.get()} | came
        while at in came:
            data, last = came.pop(at)
            *whole, rest = (rest + data).split(b"\n")
            if last:
                whole, rest = [*whole, rest], b""
            found += [(lines + k, line) for k, line in enumerate(whole) if line.strip()]
            at, lines = at + 1, lines + len(whole)
        left = [(n, data, last) for n, (data, last) in sorted(came.items()) if n >= at]
        if opened and not left:
            self.early.clear()
        elif left:
            (self.early.put if opened or not waits else self.early.appendList)(left)
        self.rest.update((at, lines, rest, bool(left) or (waits and not opened)))
        if found:
            yield pd.DataFrame({"session": [key[0]] * len(found), "line_no": [n for n, _ in found], "line": [t.decode("utf-8", "replace") for _, t in found]})

    def close(self) -> None:
        pass


def framed_stream(chunks: DataFrame) -> DataFrame:
    """(session, line_no, line) of a stream of (session, at, data, last): lines leave as soon as they are whole.

    Chunks of a session are numbered from 0 and may come in any order; the one marked ``last`` ends its session's last line.
    """
    return chunks.select("session", "at", "data", "last").groupBy("session").transformWithStateInPandas(LineFramer(), "session string, line_no long, line string", "append", "none")


class OrderedState(StatefulProcessor):
    """Holds rows until the watermark has passed them, then gives each the state before it and folds it in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, name string, value double")
        self.state = handle.getMapState("state", "name string", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # each call of the state store is a message to the JVM, so rows go in one
        came = [(int(at), int(i), name, float(value)) for batch in rows for at, i, name, value in zip(batch["at"], batch["id"], batch["name"], batch["value"], strict=True)]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(r[0] for r in came) // 1000 + 1)  # one timer per batch and key: it settles all that is due then
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted({(at, i): (at, i, name, value) for at, i, name, value in self.waiting.get()}.values(), key=lambda r: r[:2])  # of one time and id the last
        due = [r for r in waiting if r[0] // 1000 < passed]
        state = {name: value for (name,), (value,) in self.state.iterator()}
        out, last = [], {}
        for _, i, name, value in due:
            out.append((key[0], i, ",".join(f"{n}={v:.2f}" for n, v in sorted(state.items()))))
            state[name] = last[name] = value
        for name, value in last.items():
            self.state.updateValue((name,), (value,))
        if len(due) < len(waiting):
            self.waiting.put(waiting[len(due) :])
            self.handle.registerTimer(waiting[len(due)][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "before"])

    def close(self) -> None:
        pass


def state_before(events: DataFrame, late: str) -> DataFrame:
    """(key, id, before) of a stream of (key, ts, id, name, value): each event's state of its key just before it.

    Events may come in any order within ``late``; they are folded in the order of time and id once the watermark passes them.
    The state holds each name's last value, given as texts of two decimals in the order of names.
    """
    timed = events.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), "id", "name", "value")
    return timed.groupBy("key").transformWithStateInPandas(OrderedState(), "key long, id long, before string", "append", "eventTime")


class Tokens(StatefulProcessor):
    """Tokens that are valid for a time: an expired one is gone when it is asked for."""

    def __init__(self, valid_ms: int):
        self.valid_ms = valid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.token = handle.getValueState("token", "form string, expires long", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = []
        batch = pd.concat(list(rows)).sort_values(["ts", "form"], na_position="last")
        for at, form in zip(batch["ts"], batch["form"], strict=True):
            now = int(at.timestamp() * 1000)
            if isinstance(form, str):
                self.token.update((form, now + self.valid_ms))
                continue
            held = self.token.get() if self.token.exists() else None
            if held and now > held[1]:
                self.token.clear()
                held = None
            asked.append((key[0], at, held[0] if held else None))
        if asked:
            yield pd.DataFrame(asked, columns=["token", "ts", "form"])

    def close(self) -> None:
        pass


def validated_tokens(requests: DataFrame, valid: int) -> DataFrame:
    """(token, ts, form) of every request in a stream of (token, ts, form): rows with a form make a token, rows without ask for it.

    ``form`` is null in the result where the token is unknown or older than ``valid`` milliseconds; then it is dropped.
    """
    return requests.select("token", "ts", "form").groupBy("token").transformWithStateInPandas(Tokens(valid), "token string, ts timestamp, form string", "append", "none")
