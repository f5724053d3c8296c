"""Cuts of a growing text into segments that can be normalised on their own, batch and streaming.

A text is cut after the last sentence end before its protected tail; a text longer than the buffer limit
is also cut at white space. Cuts never fall into an open control tag or behind a dot of a date. The cut
itself is a small Arrow-side helper; the segments are then plain rows for ``plans.normalize``.

Chunks are rows (stream_id long, seq long, chunk string, is_last boolean, ts timestamp). Null and empty
chunks take their place in the order and add nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.words import DE_MONTHS, EN_MONTHS

TAIL, BUFFER = 64, 500
SEGMENTS = "stream_id long, seg_no long, segment string, late boolean"
#: Streams are dealt to so many groups of state; rows without a stream are one stream, in a group of its own.
GROUPS, NAMELESS = 4096, -1

_END = re.compile(r"""[.!?:;]["')\]}]*\s+""")
_DAY_LEFT = re.compile(r"(?<![0-9])([0-9]{1,2})\Z")
_MONTH_RIGHT = re.compile(r"\s+([0-9]{1,2})\.")
_NAME_RIGHT = re.compile(rf"""\s+(?:{"|".join(sorted({*DE_MONTHS, *EN_MONTHS, "Maerz"}, key=len, reverse=True))})(?:\Z|(?=[\s)\]}}"'“”.,;:!?])|(?=[*_]+(?:\Z|[\s)\]}}"'“”.,;:!?])))""", re.I)
_MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _is_date(day: str, month: str) -> bool:
    return 1 <= int(month) <= 12 and 1 <= int(day) <= _MONTH_DAYS[int(month) - 1]


def _free_left(text: str, at: int) -> bool:
    """Whether a date may begin at a place: after blanks, openers, or emphasis that follows these or punctuation."""
    mark = at
    while mark and text[mark - 1] in "*_":
        mark -= 1
    return mark == 0 or text[mark - 1].isspace() or text[mark - 1] in ("([{\"'„“" if mark == at else "([{\"'„“.,;:!?")


def _number_left(text: str, end: int) -> tuple[str, int] | None:
    """The number of one or two digits that ends at a place, and where it begins."""
    found = _DAY_LEFT.search(text[max(0, end - 3) : end])
    return found and (found[1], end - len(found[1]))


def date_dot(text: str, dot: int) -> bool:
    """Whether the dot belongs to a date: ``14.05.``, ``14. 5.`` or ``14. May``."""
    near = _number_left(text, dot)
    if not near:
        return False
    number, start = near
    before = start
    while before and text[before - 1].isspace():
        before -= 1
    if before and text[before - 1] == "." and (day := _number_left(text, before - 1)):
        if _is_date(day[0], number) and _free_left(text, day[1]):
            return True
    if not _free_left(text, start):
        return False
    after = _MONTH_RIGHT.match(text, dot + 1)
    return bool(after and _is_date(number, after[1])) or (1 <= int(number) <= 31 and bool(_NAME_RIGHT.match(text, dot + 1)))


def cut_at(text: str, tail: int = TAIL, most: int = BUFFER) -> int:
    """How many characters of a growing text can go; 0 where none can."""
    stop, cut = max(0, len(text) - tail), 0
    for end in _END.finditer(text):
        if end.end() > stop:
            break
        if not date_dot(text, end.start()):
            cut = end.end()
    if not cut and len(text) > most:
        cut = next((k for k in range(stop, 0, -1) if text[k - 1].isspace()), 0)
    opened = [text.rfind(a, 0, cut) for a, b in ("<>", "[]") if text.rfind(a, 0, cut) > text.rfind(b, 0, cut)]
    return min([cut, *opened])


def segments(pending: str, chunks: Iterable[str], tail: int = TAIL, most: int = BUFFER) -> Iterator[tuple[str, str]]:
    """(segment, text still pending) for each cut as the chunks arrive, and ("", pending) at the end."""
    for chunk in chunks:
        pending += chunk
        while chunk and (cut := cut_at(pending, tail, most)):
            yield pending[:cut], (pending := pending[cut:])
    yield "", pending


def check_buffer(tail: int, most: int) -> None:
    """Raises ValueError unless 0 <= tail < most."""
    if tail < 0 or most <= 0 or most <= tail:
        raise ValueError(f"the tail must be zero or greater and less than the buffer limit: {tail}, {most}")


def cut_segments(chunks: DataFrame, tail: int = TAIL, most: int = BUFFER) -> DataFrame:
    """The batch twin of ``cut_stream``: the segments of complete streams, (stream_id, seg_no, segment).

    Rows are dealt by stream and sorted within partitions, then read batch by batch, so a task holds one
    batch and the text still pending however long a stream is. Ties in seq go by the chunk's text; rows
    with a null stream or seq belong to no place in a stream and raise no segment.
    """
    check_buffer(tail, most)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, pending, n = None, "", 0
        for pdf in batches:
            out = []
            for s, chunk in zip(pdf["stream_id"], pdf["chunk"]):  # noqa: B905
                if s != stream:
                    out += [(stream, n, pending)] if pending else []
                    stream, pending, n = s, "", 0
                for segment, pending in segments(pending, [chunk], tail, most):  # noqa: B020
                    if segment:
                        out.append((stream, n, segment))
                        n += 1
            yield pd.DataFrame(out, columns=["stream_id", "seg_no", "segment"])
        if pending:
            yield pd.DataFrame([(stream, n, pending)], columns=["stream_id", "seg_no", "segment"])

    rows = chunks.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    placed = rows.filter("stream_id is not null and seq is not null")
    return placed.repartition("stream_id").sortWithinPartitions("stream_id", "seq", "chunk").mapInPandas(cut, "stream_id long, seg_no long, segment string")


#: Where state is a map of keys, as early chunks are, Spark asks for this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StreamCutter(StatefulProcessor):
    """The cut of one stream: what is pending as a value, chunks that came early as a map by seq, a timer for silence.

    A batch reads and writes the early chunks that it brings or needs, not those that wait, so a missing chunk
    costs no more than what comes in. The timer of a stream moves with its latest chunk.
    """

    def __init__(self, tail: int, most: int, idle_ms: int, first_seq: int):
        self.tail, self.most, self.idle_ms, self.first_seq = tail, most, idle_ms, first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "due long, seg_no long, pending string, last_seq long, newest long, timer long")
        self.early = handle.getMapState("early", "seq long", "chunk string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = (
            (None if pd.isna(seq) else int(seq), chunk, is_last is not None and not pd.isna(is_last) and is_last, 0 if pd.isna(ts) else int(pd.Timestamp(ts).timestamp() * 1000))
            for pdf in rows for seq, chunk, is_last, ts in pdf[["seq", "chunk", "is_last", "ts"]].itertuples(index=False)
        )
        yield self.rows(self.cut(key[0], came, timerValues))

    def cut(self, stream, came: Iterable[tuple], timerValues) -> list[tuple]:  # noqa: N803
        """The rows that chunks (seq, chunk, whether the last, ms of their ts) bring, with the state moved on."""
        # Without a head there are no early chunks either: a stream that comes whole asks for its state once.
        known = self.head.exists()
        due, n, pending, last, newest, timer = self.head.get() if known else (self.first_seq, 0, "", None, 0, None)
        waits = lambda seq: known and self.early.containsKey((seq,))
        new: dict[int, str] = {}
        out = []
        for seq, chunk, is_last, ms in came:
            newest = max(newest, ms)
            if seq is None or seq < due or seq in new or (seq > due and waits(seq)):
                out.append((stream, None, chunk, True))
                continue
            new[seq] = chunk or ""
            last = seq if is_last else last
        ready = []
        while due in new or waits(due):
            if due in new:
                ready.append(new.pop(due))
            else:
                ready.append(self.early.getValue((due,))[0])
                self.early.removeKey((due,))
            due += 1
        for segment, pending in segments(pending, ready, self.tail, self.most):  # noqa: B020
            if segment:
                out.append((stream, n, segment, False))
                n += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        if last is not None and due > last:
            out += [(stream, n, pending, False)] if pending else []
            # What was sent beyond the end belongs to no place in the stream.
            beyond = new | ({k[0]: v[0] for k, v in self.early.iterator()} if known else {})
            out += [(stream, None, beyond[q], True) for q in sorted(beyond)]
            if known:
                self.head.clear()
                self.early.clear()
        else:
            for seq, chunk in new.items():
                self.early.updateValue((seq,), (chunk,))
            timer = max(newest, timerValues.getCurrentWatermarkInMs() + 1) + self.idle_ms
            self.handle.registerTimer(timer)
            self.head.update((due, n, pending, last, newest, timer))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.rows(self.flush(key[0]))

    def flush(self, stream) -> list[tuple]:
        """The rows of a silent stream, over any gap; its state is cleared."""
        out = []
        if self.head.exists():
            _, n, pending, *_ = self.head.get()
            held = sorted((k[0], v[0]) for k, v in self.early.iterator())
            for segment, pending in segments(pending, [chunk for _, chunk in held], self.tail, self.most):  # noqa: B020
                if segment:
                    out.append((stream, n, segment, False))
                    n += 1
            out += [(stream, n, pending, False)] if pending else []
            self.head.clear()
            self.early.clear()
        return out

    @staticmethod
    def rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["stream_id", "seg_no", "segment", "late"]).astype({"seg_no": "Int64"})


class Member:
    """One stream's part of its group's state, as the head and the timers that ``StreamCutter`` asks for."""

    def __init__(self, group: GroupCutter, stream: int):
        self.group, self.stream = group, stream
        # Where no stream of the group waits, none is asked for. Spark warns of each value that is not there.
        found = group.head.getValue((stream,)) if group.waiting and group.head.containsKey((stream,)) else None
        self.value, (held, writes) = (found[:-2], found[-2:]) if found else (None, (0, 0))
        self.early = MemberEarly(group, stream, found[0] if found else 0, held, writes)

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.early.write()
        self.group.head.updateValue((self.stream,), (*value, self.early.held, self.early.writes))

    def clear(self) -> None:
        self.group.head.removeKey((self.stream,))

    def registerTimer(self, timer: int) -> None:  # noqa: N802
        # A timer of a group is for all streams that wait for it; those that moved on are passed over when it comes.
        if not self.exists() or self.value[-1] != timer:
            self.group.timers.setdefault(timer, []).append(self.stream)

    def deleteTimer(self, timer: int) -> None:  # noqa: N802
        pass


class MemberEarly:
    """One stream's early chunks in its group's map. Each write notes its seqs, so that they are found without looking at other streams."""

    def __init__(self, group: GroupCutter, stream: int, due: int, held: int, writes: int):
        self.group, self.stream, self.due, self.held, self.writes = group, stream, due, held, writes
        self.taken: set[int] = set()
        self.new: list[int] = []

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return self.held > 0 and self.group.early.containsKey((self.stream, *key))

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self.group.early.getValue((self.stream, *key))

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.group.early.removeKey((self.stream, *key))
        self.taken.update(key)
        self.held -= 1

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.group.early.updateValue((self.stream, *key), value)
        self.new += key
        self.held += 1

    def write(self) -> None:
        if not self.held:
            self.clear()
        if self.new:
            self.group.order.updateValue((self.stream, self.writes), (self.new,))
            self.writes, self.new = self.writes + 1, []

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        for seq in self._seqs():
            yield (seq,), self.getValue((seq,))

    def clear(self) -> None:
        for seq in self._seqs():
            self.removeKey((seq,))
        for k in range(self.writes):
            self.group.order.removeKey((self.stream, k))
        self.writes = 0

    def _seqs(self) -> list[int]:
        """Those noted that the stream has not come to yet."""
        noted = (seq for k in range(self.writes if self.held else 0) for seq in self.group.order.getValue((self.stream, k))[0])
        return [seq for seq in noted if seq >= self.due and seq not in self.taken]


class GroupCutter(StatefulProcessor):
    """The cut of a group of streams, each as ``StreamCutter`` does it on its part of the group's state.

    Calls for state, frames and Arrow batches come once a group and not once a stream, and streams that wait
    are asked for only where there are any. A batch still reads and writes what it brings or needs alone.
    """

    def __init__(self, tail: int, most: int, idle_ms: int, first_seq: int):
        self.one = StreamCutter(tail, most, idle_ms, first_seq)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getMapState("head", "stream_id long", "due long, seg_no long, pending string, last_seq long, newest long, timer long, held long, writes long")
        self.early = handle.getMapState("early", "stream_id long, seq long", "chunk string")
        self.order = handle.getMapState("order", "stream_id long, write long", "seqs array<long>")
        self.quiet = handle.getMapState("quiet", "timer long", "streams array<long>")

    def close(self) -> None:
        pass

    def member(self, stream: int) -> StreamCutter:
        self.one.head = self.one.handle = Member(self, stream)
        self.one.early = self.one.head.early
        return self.one

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came: dict[int, list[tuple]] = {}
        for pdf in rows:
            for stream, *chunk in zip(*(pdf[c].tolist() for c in ("stream_id", "seq", "chunk", "is_last", "ms"))):  # noqa: B905
                came.setdefault(stream, []).append(chunk)
        self.waiting, self.timers, out = self.head.exists(), {}, []
        for stream, chunks in came.items():
            out += self.member(stream).cut(None if key[0] == NAMELESS else stream, chunks, timerValues)
        for timer, streams in self.timers.items():
            if self.quiet.containsKey((timer,)):
                streams = [*self.quiet.getValue((timer,))[0], *streams]
            else:
                self.handle.registerTimer(timer)
            self.quiet.updateValue((timer,), (streams,))
        yield StreamCutter.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, out = expiredTimerInfo.getExpiryTimeInMs(), []
        self.waiting = self.head.exists()
        for stream in self.quiet.getValue((timer,))[0]:
            cutter = self.member(stream)
            if cutter.head.exists() and cutter.head.get()[-1] == timer:
                out += cutter.flush(None if key[0] == NAMELESS else stream)
        self.quiet.removeKey((timer,))
        yield StreamCutter.rows(out)


def cut_stream(chunks: DataFrame, tail: int = TAIL, most: int = BUFFER, delay: str = "10 minutes", idle_ms: int = 600_000, first_seq: int = 0, groups: int | None = GROUPS) -> DataFrame:
    """The segments of a stream of chunks, (stream_id, seg_no, segment, late), in append mode.

    Chunks wait until those before them have come. ``is_last`` ends a stream and flushes it; so does event
    time that passes idle_ms beyond a stream's last chunk, then over any gap. A chunk whose seq was already
    passed, or that comes again, is handed on unchanged as a row with ``late`` true and no seg_no.
    Spark itself leaves out rows whose ts the watermark has passed: ``split_late`` puts them aside before.
    Sets the session's state store to the one that holds maps, if it is another.
    State is kept by groups of streams, as many as ``groups`` says; a checkpoint is to be read with the same number. With
    None each stream is a group, and none may be null: for few streams, and for checkpoints from before there were groups.
    """
    check_buffer(tail, most)
    if groups is not None and groups < 1:
        raise ValueError(f"there must be a group or more: {groups}")
    spark = chunks.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        spark.conf.set(*STORE)
    timed = chunks.withWatermark("ts", delay)
    if groups is None:
        return timed.groupBy("stream_id").transformWithStateInPandas(StreamCutter(tail, most, idle_ms, first_seq), SEGMENTS, "Append", "EventTime")
    stream, group = F.col("stream_id").cast("long"), F.pmod(F.xxhash64(F.col("stream_id").cast("long")), F.lit(groups)).cast("int")
    # Without nulls, numbers stay numbers on the way to Python. No seq is before the least, so a missing one is late.
    dealt = timed.select(
        F.when(stream.isNull(), NAMELESS).otherwise(group).alias("group"), F.coalesce(stream, F.lit(0)).alias("stream_id"), F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"),
        "chunk", F.coalesce("is_last", F.lit(False)).alias("is_last"), F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"), "ts",
    )
    return dealt.groupBy("group").transformWithStateInPandas(GroupCutter(tail, most, idle_ms, first_seq), SEGMENTS, "Append", "EventTime")


def split_late(chunks: DataFrame, on_time: str, late: str, checkpoint: str, delay: str = "10 minutes") -> DataStreamWriter:
    """A writer that parts a stream of chunks before any watermark: rows that one would pass over go to ``late``.

    Row by row, a chunk is late if its ts is by delay or more behind the newest ts of its own batch and all before.
    The others are written to ``on_time``, a folder for each batch, for ``cut_stream(read_chunks(spark, f"{on_time}/*"), delay=delay)``:
    whatever files of a batch it reads first, its watermark is never ahead of the mark of that batch, so nothing is
    left out there. A backlog should be read in batches that span less than the delay. A batch that is repeated
    writes its own folders again. Rows without ts are on time.
    """

    def part(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{number:012d}"
        marks = f"{checkpoint}/marks"
        # One row a batch; a batch that is repeated sees no later ones.
        batch.agg(F.max("ts").alias("newest")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{marks}/{folder}")
        newest = spark.read.schema("newest timestamp, batch long").parquet(f"{marks}/*").filter(F.col("batch") <= number).agg(F.max("newest")).first()[0]
        behind = F.lit(False) if newest is None else F.coalesce(F.col("ts") <= F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.filter(behind).write.mode("overwrite").parquet(f"{late}/{folder}")
        batch.filter(~behind).write.mode("overwrite").parquet(f"{on_time}/{folder}")

    return chunks.writeStream.foreachBatch(part).option("checkpointLocation", f"{checkpoint}/split")
