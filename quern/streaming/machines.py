"""Rooms, mailboxes and message machines as stateful stream operators (transformWithStateInPandas).

Each operator orders what a micro-batch brings by event time or sequence number and keeps all it needs in state, so
streams that are cut into batches at any place give the rows of the batch queries in signals. State lives in the
RocksDB store; rocksdb() sets it for the queries started inside. What is kept is bounded by time to live: event-time
timers remove it, or, in processing time, the store's own expiry.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.sources.shared import partitions
from quern.streaming.signals import MESSAGE_TTL, PAGE, PRESENCE_TTL

# Slices of a room; leaves and recipients of a fan at most, beside the recipients that are live at its end; rows that
# are Python objects at once.
SLICES, FAN, STAYS, SLAB = 4, 1024, 8192, 4096

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """The rows of a key in one micro-batch, in order."""
    got = pd.concat(list(frames), ignore_index=True)
    return got.sort_values(order, kind="stable").to_dict("records")


def _frame(out: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    if out:
        yield pd.DataFrame(out, columns=names).astype(object)


class Room(StatefulProcessor):
    """Presence of one cell of a room: what the clients of one slice, when they leave or fall silent, send to those of
    another (or the same) slice. Beats keep a client live for ttl microseconds.

    Before each row all clients whose time ended earlier go, in the order of those ends, so the result does not
    depend on where batches are cut; a timer does the same for a room that has become quiet. A pair's message depends
    on the rows of the two clients alone, so cells give what a whole room would. They hand out fans: up to FAN leaves
    in order, and for each recipient the numbers of the leaves it gets, from lo to below hi.
    """

    NAMES = ["room", "from_clients", "expired", "ats", "to_clients", "los", "his"]
    SENDS, GETS = 1, 2

    def __init__(self, ttl: int, client: str) -> None:
        self.ttl, self.client = ttl, client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", f"client {self.client}, at long, side long")

    def _open(self, room) -> None:
        self.room, self.fan = room, ([], [], [], [], [], [])
        held = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        self.live, self.side = {c: t for c, t, _ in held}, {c: s for c, _, s in held}
        self.ends = [(t + self.ttl, c) for c, t in self.live.items()]
        heapq.heapify(self.ends)
        self.since = {c: 0 for c, s in self.side.items() if s & self.GETS}

    def _flush(self) -> Iterator[pd.DataFrame]:
        """The fan so far; recipients that stay live begin again at the first leave of the next one."""
        froms, _, _, tos, los, his = self.fan
        for c, lo in self.since.items():
            if lo < len(froms):
                tos.append(c), los.append(lo), his.append(len(froms))
        self.since = dict.fromkeys(self.since, 0)
        if froms:
            yield from _frame([(self.room, *self.fan)], self.NAMES)
        self.fan = ([], [], [], [], [], [])

    def _gone(self, client, expired: bool, at: int) -> Iterator[pd.DataFrame]:
        froms, kinds, ats, tos, los, his = self.fan
        del self.live[client]
        side = self.side.pop(client)
        if side & self.GETS:
            lo = self.since.pop(client)
            if lo < len(froms):
                tos.append(client), los.append(lo), his.append(len(froms))
        if side & self.SENDS and self.since:
            froms.append(client), kinds.append(expired), ats.append(at)
        if len(froms) >= FAN or len(tos) >= STAYS:
            yield from self._flush()

    def _expire(self, upto: int) -> Iterator[pd.DataFrame]:
        """Clients whose time ended before upto go. Of a client's ends in the heap only the one of its last beat counts."""
        while self.ends and self.ends[0][0] < upto:
            end, c = heapq.heappop(self.ends)
            if c in self.live and self.live[c] + self.ttl == end:
                yield from self._gone(c, True, end)

    def _beat(self, client, side: int, at: int) -> None:
        before = self.live.get(client)
        if before is None:
            self.side[client] = side
            if side & self.GETS:
                self.since[client] = len(self.fan[0])
        if before is None or at > before:
            self.live[client] = at
            heapq.heappush(self.ends, (at + self.ttl, client))

    def _close(self) -> Iterator[pd.DataFrame]:
        yield from self._flush()
        if self.live:
            self.last.put([(c, t, self.side[c]) for c, t in self.live.items()])
        else:
            self.last.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.live:
            self.handle.registerTimer((min(self.live.values()) + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open(key[0])
        got = pd.concat([f[["client", "at", "seq", "leave", "side"]] for f in rows], ignore_index=True)
        got = got.sort_values(["at", "seq"], kind="stable", ignore_index=True)
        for i in range(0, len(got), SLAB):
            slab = got.iloc[i : i + SLAB]
            for client, at, leave, side in zip(*(slab[c].tolist() for c in ("client", "at", "leave", "side")), strict=True):
                yield from self._expire(at)
                if not leave:
                    self._beat(client, side, at)
                elif client in self.live:
                    yield from self._gone(client, False, at)
        yield from self._close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open(key[0])
        yield from self._expire(timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self._close()

    def close(self) -> None:
        pass


class Packed(Room):
    """Room over packs: a row holds beats of one slice in arrays, as Spark hands rows to Python one by one."""

    COLUMNS = ["client", "at", "seq", "leave"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, map(self._beats, rows), timerValues)

    def _beats(self, packs: pd.DataFrame) -> pd.DataFrame:
        columns = {c: np.concatenate(packs[c].tolist()) for c in self.COLUMNS}
        return pd.DataFrame(columns | {"side": np.repeat(packs["side"].to_numpy(), packs["client"].map(len))})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch by room and slice: one row of arrays for each, and the newest ts."""
    for b in batches:
        lists = pa.Table.from_batches([b]).group_by(["room", "own"], use_threads=False).aggregate([(c, "list") for c in Packed.COLUMNS] + [("ts", "max")])
        yield from lists.select(["room", "own", *(f"{c}_list" for c in Packed.COLUMNS), "ts_max"]).rename_columns(["room", "own", *Packed.COLUMNS, "ts"]).to_batches()


def leave_fans(beats: DataFrame, ttl: int = PRESENCE_TTL, delay: str = "0 seconds", slices: int = SLICES) -> DataFrame:
    """The rows of leave_stream folded to fans, which unfold() opens; a fan is small against its rows.

    A room's clients are dealt to slices by hash and each pair of slices is a cell with state of its own, so a room is
    the work of slices * slices tasks and a row goes to 2 * slices - 1 of them. The number is part of the checkpoint.
    Rows travel in packs, one for each room and slice of an Arrow batch.
    """
    kinds = dict(beats.dtypes)
    own = F.pmod(F.xxhash64("client"), F.lit(slices)).cast("int")
    rows = beats.filter("room is not null and client is not null and ts is not null")
    rows = rows.select("room", own.alias("own"), "client", F.unix_micros("ts").alias("at"), "seq", F.coalesce("leave", F.lit(False)).alias("leave"), "ts")
    packed = f"room {kinds['room']}, own int, client array<{kinds['client']}>, at array<long>, seq array<{kinds['seq']}>, leave array<boolean>, ts timestamp"
    packs = rows.mapInArrow(_pack, packed).withWatermark("ts", delay)
    packs = packs.withColumn("all", F.sequence(F.lit(0), F.lit(slices - 1)))
    sends, gets = F.expr("transform(all, x -> struct(own as i, x as j))"), F.expr("transform(all, x -> struct(x as i, own as j))")
    packs = packs.withColumn("cell", F.explode(F.array_union(sends, gets)))
    side = F.when(F.col("cell.i") == F.col("own"), Room.SENDS).otherwise(0) + F.when(F.col("cell.j") == F.col("own"), Room.GETS).otherwise(0)
    packs = packs.select("room", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), *Packed.COLUMNS, "ts", side.cast("long").alias("side"))
    schema = f"room {kinds['room']}, from_clients array<{kinds['client']}>, expired array<boolean>, ats array<long>, to_clients array<{kinds['client']}>, los array<int>, his array<int>"
    return packs.groupBy("room", "i", "j").transformWithStateInPandas(Packed(ttl * 1_000_000, kinds["client"]), schema, "Append", "EventTime")


def unfold(fans: DataFrame) -> DataFrame:
    """The rows of fans: room, from_client, to_client, reason, at (of the type that ats hold).

    Fans are dealt evenly to tasks where fans is no stream, and opened leave by leave, so all that a leave fixes is
    looked up once and files hold it in runs.
    """
    if not fans.isStreaming:
        fans = fans.repartition(partitions(fans.sparkSession), "room", F.expr("from_clients[0]"), F.expr("ats[0]"), F.expr("to_clients[0]"))
    one = fans.withColumn("n", F.explode(F.expr("sequence(0, size(ats) - 1)")))
    one = one.select("room", F.expr("from_clients[n]").alias("from_client"), F.expr("if(expired[n], 'expired', 'leave')").alias("reason"), F.expr("ats[n]").alias("at"), "n", "to_clients", "los", "his")
    one = one.withColumn("k", F.explode(F.expr("sequence(0, size(to_clients) - 1)"))).filter("los[k] <= n and n < his[k]")
    return one.select("room", "from_client", F.expr("to_clients[k]").alias("to_client"), "reason", "at")


def leave_stream(beats: DataFrame, ttl: int = PRESENCE_TTL, delay: str = "0 seconds", slices: int = SLICES) -> DataFrame:
    """room, from_client, to_client, reason (leave or expired), at (when, in microseconds) for a stream of beats (room,
    client, ts, leave, seq): one row for every other client live at that time.

    Rows of equal ts are in order of seq. Rows must not come later than delay after newer ones; a beat that does only
    prolongs. A client that beats at the very end of its time stays. Rows without room, client or ts take no part. Rows
    that are later than they may are dropped only where all of their pack is.
    """
    return unfold(leave_fans(beats, ttl, delay, slices))


class Machine(StatefulProcessor):
    """The message machine of one recipient in one room: candidates that come before a description wait in a list."""

    NAMES = ["room", "to_client", "seq", "type", "action", "buffered", "flushed"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getListState("early", "seq long")
        self.state = handle.getValueState("state", "cursor long, described boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, described = self.state.get() if self.state.exists() else (None, False)
        early, out = [x[0] for x in self.early.get()] if self.early.exists() else [], []
        for r in _rows(rows, ["seq"]):
            if cursor is not None and r["seq"] <= cursor:
                continue  # handed out before: a message is applied once
            cursor, kind, flushed = r["seq"], r["type"], []
            if kind == "leave":
                action, early, described = "reset", [], False
            elif kind == "ice":
                action = "add_ice" if described else "buffer_ice"
                early = early if described else [*early, cursor]
            else:
                action, described = "answer_offer" if kind == "offer" else "set_answer", True
                flushed, early = early, []
            out.append((*key, cursor, kind, action, len(early), flushed))
        self.state.update((cursor, described))
        self.early.clear()
        if early:
            self.early.put([(x,) for x in early])
        yield from _frame(out, self.NAMES)

    def close(self) -> None:
        pass


def message_stream(log: DataFrame) -> DataFrame:
    """The log (room, to_client, seq, type) with action, buffered as in signals.message_states, and flushed: the early
    candidates that a description adds. A mailbox's messages come in order of seq; repeated ones are passed over."""
    kinds = dict(log.dtypes)
    schema = f"room {kinds['room']}, to_client {kinds['to_client']}, seq long, type string, action string, buffered long, flushed array<long>"
    rows = log.select("room", "to_client", F.col("seq").cast("long").alias("seq"), "type")
    return rows.groupBy("room", "to_client").transformWithStateInPandas(Machine(), schema, "Append", "None")


class Mailbox(StatefulProcessor):
    """Messages of one recipient in one room, and polls with a cursor. Reading deletes nothing; messages live ttl ms."""

    NAMES = ["room", "to_client", "poll", "seq", "size", "place"]

    def __init__(self, ttl: int, limit: int, native: bool) -> None:
        self.ttl, self.limit, self.native = ttl, limit, native

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "seq long, size long, at long", self.ttl if self.native else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {m[0]: m for m in self.messages.get()} if self.messages.exists() else {}
        known, new, out = set(held), [], []
        for r in _rows(rows, ["at", "poll", "seq"]):
            if r["poll"] < 0:
                if r["seq"] not in held:
                    held[r["seq"]] = (int(r["seq"]), int(r["size"]), int(r["at"]))
                    new.append(held[r["seq"]])
            else:
                page = sorted(m for m in held.values() if m[0] > r["seq"] and m[2] + self.ttl > r["at"])[: self.limit]
                out += [(*key, r["poll"], m[0], m[1], i) for i, m in enumerate(page, 1)]
        if new:
            self.messages.appendList(new)
            if not self.native and not known:
                self.handle.registerTimer(min(m[2] for m in new) + self.ttl)
        yield from _frame(out, self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [tuple(m) for m in self.messages.get() if m[2] + self.ttl > now]
        self.messages.clear()
        if left:
            self.messages.put(left)
            self.handle.registerTimer(min(m[2] for m in left) + self.ttl)
        yield from ()

    def close(self) -> None:
        pass


def mailbox_stream(messages: DataFrame, polls: DataFrame, ttl: int = MESSAGE_TTL, limit: int = PAGE, delay: str = "0 seconds", native: bool = False) -> DataFrame:
    """room, to_client, poll, seq, size, place: the page of each poll.

    messages have room, to_client, seq, size, ts; polls have room, to_client, poll (a number from 0), after (null: all)
    and ts. A poll sees the messages that came before it (messages first at equal ts) and are younger than ttl
    seconds. State goes by event-time timers, or with native in processing time by the store's own expiry.
    """
    none = F.lit(-(1 << 62)).cast("long")
    put = messages.select("room", "to_client", F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"), F.lit(-1).cast("long").alias("poll"), "ts")
    ask = polls.select("room", "to_client", F.coalesce(F.col("after").cast("long"), none).alias("seq"), F.lit(0).cast("long").alias("size"), F.col("poll").cast("long").alias("poll"), "ts")
    rows = put.unionByName(ask)
    rows = (rows if native else rows.withWatermark("ts", delay)).withColumn("at", F.unix_millis("ts"))
    kinds = dict(messages.dtypes)
    schema = f"room {kinds['room']}, to_client {kinds['to_client']}, poll long, seq long, size long, place long"
    processor = Mailbox(ttl * 1000, limit, native)
    return rows.groupBy("room", "to_client").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if native else "EventTime")


def replay(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that its source holds now, appending to the table out, and return that table."""
    spark = stream.sparkSession
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
