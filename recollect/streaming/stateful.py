"""Keyed state over streams: limits, one-time codes, event streams cut into chunks, merged answers, jobs that try again.

Where order matters in time, rows wait in the state until the watermark has passed them and are then folded by time and id, so that any order of arrival
within the watermark gives what the batch form gives; the state of a key goes by a timer once nothing can need it. The watermark
moves with the data, so the last rows of a stream come out once later ones arrive. Where a sender numbers its rows (chunks, answers),
they wait for their number instead. Everything is in the state store, so a restart in mid-stream changes nothing. Needs the RocksDB store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..schemas import schema

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL_MINUTES, TRIES = 10, 5
ERROR_TEXT = "Error al generar respuesta."
#: Ends of the two answers of a session, and the event that tells the failure of one.
ENDS, FAILED = {"a": "plain_done", "b": "memory_done"}, "error"
DELTAS = {"a": "plain_delta", "b": "memory_delta"}


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def plain(v):
    """Rows as tuples, inside lists too: states are read as the former and written as the latter."""
    return tuple(map(plain, v)) if isinstance(v, tuple) else [plain(x) for x in v] if isinstance(v, list) else v


class Keyed(StatefulProcessor):
    """A processor with the schemas of its states, which are parsed where there is a session: in the driver."""

    ddl: dict[str, str] = {}

    def __init__(self):
        self.kind = {name: StructType.fromDDL(ddl) for name, ddl in self.ddl.items()}

    def close(self) -> None:
        pass


class InTime(Keyed):
    """Rows of a key in order of ``us`` (microseconds) and ``id``, each once the watermark has passed it.

    A subclass folds them: ``fold(key, state or None, row)`` gives (state, output row or None), ``ends(state)`` the microsecond from which the state can be forgotten.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kind["row"])
        self.state = handle.getValueState("state", self.kind["state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.kind["row"].names
        new = [tuple(r[c] for c in names) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(plain, self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        state, out = (plain(self.state.get()) if self.state.exists() else None), []
        later = [r for r in rows if r[0] > passed]
        for r in rows[: len(rows) - len(later)]:
            state, told = self.fold(key, state, r)
            out += [told] if told else []
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if state is None or not later and self.ends(state) <= passed:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(self.ends(state) // 1000 + 1)
        return iter(out)


class FixedWindow(InTime):
    """State: when the window started and its hits so far."""

    ddl = {"row": "us long, id long", "state": "start long, n int"}

    def __init__(self, limit: int, seconds: int):
        super().__init__()
        self.limit, self.span = limit, seconds * 1_000_000

    def fold(self, key, state, row):
        us, hit = row
        start, n = state if state and us < state[0] + self.span else (us, 0)
        return (start, n + 1), Row(kind=key[0], key=key[1], id=hit, us=us, hit_no=n + 1, allowed=n + 1 <= self.limit)

    def ends(self, state) -> int:
        return state[0] + self.span


def in_time(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)


def limiter(hits: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """hits (kind, key, id, us) of a stream with hit_no and allowed, as ``limits.fixed_window`` tells in batch form. Keys of different kinds differ; null is a key like others."""
    rows = in_time(hits.select("kind", "key", "id", "us"), late)
    return rows.groupBy("kind", "key").transformWithState(FixedWindow(limit, seconds), "kind string, key string, id long, us long, hit_no int, allowed boolean", "Append", "EventTime")


class Verdict(Keyed):
    """One row a hit once all its limits have spoken; the state goes with it."""

    ddl = {"seen": "n int, allowed boolean"}

    def __init__(self, of: int):
        super().__init__()
        self.of = of

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", self.kind["seen"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, allowed = tuple(self.seen.get()) if self.seen.exists() else (0, True)
        for r in rows:
            n, allowed = n + 1, allowed and r["allowed"]
        if n < self.of:
            self.seen.update((n, allowed))
            return iter(())
        self.seen.clear()
        return iter([Row(id=key[0], allowed=allowed)])


def all_limits(hits: DataFrame, keys: tuple[str, ...], limit: int = 5, seconds: int = 3600, late: str = "1 minute") -> DataFrame:
    """(id, allowed) of hits (id, us, keys): each counts against the fixed window of every key and passes only if all allow it; as ``limits.both_limits``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys]))
    judged = limiter(hits.select("id", "us", each.alias("_k")).select("_k.*", "id", "us"), limit, seconds, late)
    return judged.groupBy("id").transformWithState(Verdict(len(keys)), "id long, allowed boolean", "Append", "None")


class CodeBook(InTime):
    """State: an address's codes that have not expired, newest last, as (created, code, tries, used)."""

    ddl = {"row": "us long, id long, kind string, code string", "state": "codes array<struct<created:bigint,code:string,tries:int,used:boolean>>"}

    def __init__(self, minutes: int, tries: int):
        super().__init__()
        self.life, self.tries = minutes * 60_000_000, tries

    def fold(self, key, state, row):
        us, number, kind, code = row
        codes = [c for c in (state[0] if state else []) if c[0] + self.life > us]
        if kind == "issue":
            return (([*codes, (us, code, 0, False)]),), None
        live = [k for k, c in enumerate(codes) if not c[3]]
        if not live:
            return ((codes,) if codes else None), Row(key=key[0], id=number, outcome="none")
        created, right, tries, _ = codes[live[-1]]
        outcome = "too_many" if tries >= self.tries else "ok" if code == right else "wrong"
        codes[live[-1]] = (created, right, tries + 1, outcome == "ok")
        return (codes,), Row(key=key[0], id=number, outcome=outcome)

    def ends(self, state) -> int:
        return max(c[0] for c in state[0]) + self.life


def code_outcomes(events: DataFrame, minutes: int = TTL_MINUTES, tries: int = TRIES, late: str = "1 minute") -> DataFrame:
    """(key, id, outcome) of the tries among events (key, id, us, kind issue or try, code).

    A try is held against the newest unused code that has not expired (``none`` without one) and counts before it is judged: from the one after ``tries`` on it is ``too_many``
    unseen. A right code is used up, and an older one is the newest again. Codes are compared as given; give hashes.
    """
    return in_time(events.select("key", "id", "us", "kind", "code"), late).groupBy("key").transformWithState(CodeBook(minutes, tries), "key string, id long, outcome string", "Append", "EventTime")


class InSequence(Keyed):
    """Rows of a key by their number ``seq``, from 0 on, each side on its own; a number that was there is ignored.

    State: next numbers, the rest of the subclass's own state, rows that wait.
    """

    def __init__(self):
        super().__init__()
        self.kind |= {"side": StructType.fromDDL("side string"), "seq": StructType.fromDDL("seq long"), "place": StructType.fromDDL("side string, seq long")}

    def init(self, handle) -> None:
        self.next = handle.getMapState("next", self.kind["side"], self.kind["seq"])
        self.waiting = handle.getMapState("waiting", self.kind["place"], self.kind["row"])

    def arrived(self, rows, side: str) -> Iterator[Row]:
        """Waiting and new rows of a side that are next in turn."""
        names = self.kind["row"].names
        seq = self.next.getValue((side,))[0] if self.next.containsKey((side,)) else 0
        new = {r["seq"]: plain(tuple(r[c] for c in names)) for r in rows if r["seq"] >= seq}
        start = seq
        while True:
            if seq in new:
                row = new.pop(seq)
            elif self.waiting.containsKey((side, seq)):
                row = plain(self.waiting.getValue((side, seq)))
                self.waiting.removeKey((side, seq))
            else:
                break
            yield Row(*names)(*row)
            seq += 1
        if seq > start:
            self.next.updateValue((side,), (seq,))
        for k, row in new.items():
            self.waiting.updateValue((side, k), row)


class Parts(InSequence):
    """State: the unfinished tail of a connection's bytes, and the parts so far."""

    ddl = {"row": "data binary", "tail": "tail binary, n long"}

    def init(self, handle) -> None:
        super().init(handle)
        self.tail = handle.getValueState("tail", self.kind["tail"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tail, n = tuple(self.tail.get()) if self.tail.exists() else (b"", 0)
        pieces, out = [bytes(tail)], []
        for r in self.arrived(rows, ""):
            pieces.append(bytes(r["data"] or b""))
        *whole, tail = b"".join(pieces).split(b"\n\n")
        for part in whole:
            out.append(Row(connection=key[0], n=n, part=part.decode("utf-8", "replace")))
            n += 1
        self.tail.update((tail, n))
        return iter(out)


def chunked_events(chunks: DataFrame) -> DataFrame:
    """(connection, n, type, delta, name, tool_calls): events of streams that came in chunks (connection, seq, data), cut anywhere.

    A part ends at a blank line, which may lie across chunks, as may a character. Parts without ``data: `` are no events but are counted in ``n``.
    """
    parts = chunks.select("connection", "seq", "data").groupBy("connection").transformWithState(Parts(), "connection string, n long, part string", "Append", "None")
    lines = parts.where(F.col("part").startswith("data: "))
    return lines.select("connection", "n", F.from_json(F.substring("part", 7, 2**31 - 1), schema("stream_event")).alias("e")).where("e IS NOT NULL").select("connection", "n", "e.*")


class Answers(InSequence):
    """State: which sides have ended, the tools that were called, events told so far, whether the session is closed."""

    ddl = {"row": "type string, delta string, name string, tool_calls array<string>", "ended": "a boolean, b boolean, tools array<string>, told long, closed boolean"}

    def init(self, handle) -> None:
        super().init(handle)
        self.ended = handle.getValueState("ended", self.kind["ended"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        a, b, tools, told, closed = tuple(self.ended.get()) if self.ended.exists() else (False, False, [], 0, False)
        ended, tools, out = {"a": a, "b": b}, list(tools), []
        if closed:
            return iter(())
        by_side = {"a": [], "b": []}
        for r in rows:
            by_side[r["stream"]].append(r)
        for side, mine in by_side.items():
            for r in self.arrived(mine, side):
                if ended[side]:
                    continue
                failed = r["type"] == FAILED
                if failed:
                    out.append((DELTAS[side], ERROR_TEXT, None, None))
                if side == "b" and r["type"] == ENDS["b"]:
                    tools += r["tool_calls"] or []
                elif not failed:
                    out.append(tuple(r))
                elif side == "a":
                    out.append((ENDS["a"], None, None, None))
                ended[side] = failed or r["type"] == ENDS[side]
        closed = all(ended.values())
        if closed:
            out.append(("done", None, None, tools))
            self.next.clear()
            self.waiting.clear()
        self.ended.update((ended["a"], ended["b"], [] if closed else tools, told + len(out), closed))
        return iter([Row(session=key[0], n=told + k, type=t, delta=d, name=m, tool_calls=c) for k, (t, d, m, c) in enumerate(out)])


def merged_answers(events: DataFrame) -> DataFrame:
    """(session, n, type, delta, name, tool_calls): the two answers of each session as one stream that ends.

    events: (session, stream a or b, seq, type, delta, name, tool_calls), in any order. The order inside each answer is kept. An answer ends with its last event or with an ``error``, which is
    told as a text; after both have ended one ``done`` comes with the tools of the second one, and nothing after it.
    """
    rows = events.where(F.col("stream").isin("a", "b")).select("session", "stream", "seq", "type", "delta", "name", "tool_calls")
    kind = "session string, n long, type string, delta string, name string, tool_calls array<string>"
    return rows.groupBy("session").transformWithState(Answers(), kind, "Append", "None")


class Attempts(Keyed):
    """State: a job that waits for its next try. Timers of the clock put it back."""

    ddl = {"job": "user_id string, source string, attempts int"}

    def __init__(self, work: Callable[[str], str], most: int, first_delay: float):
        super().__init__()
        self.work, self.most, self.first_delay = work, most, first_delay

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.kind["job"])

    def attempt(self, key, job, now: int) -> Iterator[Row]:
        user, source, n = job
        text = error = None
        try:
            text = self.work(key[0])
        except Exception as e:  # one job's error is its own
            error = f"{type(e).__name__}: {e}"[:500]
        n += 1
        status = "indexed" if error is None else "failed" if n >= self.most else "pending"
        if status == "pending":
            self.job.update((user, source, n))
            self.handle.registerTimer(now + int(1000 * self.first_delay * 2 ** (n - 1)))
        else:
            self.job.clear()
        return iter([Row(file_id=key[0], user_id=user, source=source, status=status, attempts=n, error=error, text=text)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["user_id"], r["source"], 0) for r in rows][-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return self.attempt(key, new, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return iter(())
        return self.attempt(key, tuple(self.job.get()), timerValues.getCurrentProcessingTimeInMs())


def tried_jobs(queue: DataFrame, work: Callable[[str], str], most: int = 3, first_delay: float = 5.0) -> DataFrame:
    """(file_id, user_id, source, status, attempts, error, text): a row for every attempt at the queued jobs (file_id, user_id, source).

    ``work`` gets a file's id and gives its text or raises; it is shipped with the job. After an error the job is tried again by itself ``first_delay`` seconds later, then
    after twice as long each time; the ``most``-th error makes it ``failed``. Errors are cut to 500 characters. A job that is queued again starts anew.
    """
    kind = "file_id string, user_id string, source string, status string, attempts int, error string, text string"
    return queue.select("file_id", "user_id", "source").groupBy("file_id").transformWithState(Attempts(work, most, first_delay), kind, "Append", "ProcessingTime")
