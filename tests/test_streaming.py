"""The cutter against a character-by-character version, and the stream against its batch twin."""

import random
import re

import pytest

from lectern.sources.messages import read_chunks, read_messages, write_normalized, write_segments
from lectern.streaming.cutter import cut_at, cut_segments, cut_stream, date_dot, segments, split_late


def joined(chunks, tail, most):
    got, rest = [], ""
    for segment, rest in segments("", chunks, tail, most):  # noqa: B007
        got += [segment] if segment else []
    return [*got, rest] if rest else got


@pytest.mark.parametrize(
    "text, dot, want",
    [("am 14.05. um", 8, True), ("am 15. August 2025", 5, True), ("am 14. 5. um", 5, True), ("am 14. 5. um", 8, True), ("es sind 14. Und", 10, False),
     ("v1.14.05. um", 8, False), ("30.02. x", 5, False), ("(29.02. x", 6, True), (":**1.2.** x", 6, True), ("am 1. Maikäfer", 4, False)],
)
def test_dots_of_dates(text, dot, want):
    assert text[dot] == "." and date_dot(text, dot) is want


def test_cuts():
    assert joined(["eins zwei drei vier fuenf sechs"], 5, 12) == ["eins zwei drei vier fuenf ", "sechs"]
    assert joined(["Termin am 14.05. um 12 Uhr."], 5, 500) == ["Termin am 14.05. um 12 Uhr."]
    assert joined(["Termin am 15. August 2025 um 12 Uhr."], 5, 500) == ["Termin am 15. August 2025 um 12 Uhr."]
    assert joined(["Eins. [whis", "pers. more] Zwei drei vier"], 3, 500) == ["Eins. ", "[whispers. more] Zwei drei vier"]
    assert cut_at("[never closed. and more words here", 3, 500) == 0
    assert joined(["", "x" * 900], 5, 12) == ["x" * 900]


def slow_cut(text, tail, most):
    """Tries every place in turn."""
    stop, best = max(0, len(text) - tail), None
    for cut in range(stop, 0, -1):
        ends = re.search(r"""[.!?:;]["')\]}]*\s+\Z""", text[:cut])
        if ends and not text[cut : cut + 1].isspace() and not date_dot(text, ends.start()):
            best = cut
            break
    if best is None and len(text) > most:
        best = max((k for k in range(1, stop + 1) if text[k - 1].isspace()), default=None)
    if best is None:
        return 0
    for a, b in ("<>", "[]"):
        opened = text[:best].rfind(a)
        if opened > text[:best].rfind(b):
            best = min(best, opened)
    return best


def test_cut_against_slow_version():
    draw = random.Random(7)
    parts = ["word ", "one. ", "Ha! ", "14.05. ", "3. May ", "<b", "> ", "[x] ", "a.) ", "  ", "\n", "?", "1.5 ", "**2.1.** ", "z"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        tail, most = draw.randrange(8), draw.randrange(9, 30)
        assert cut_at(text, tail, most) == slow_cut(text, tail, most), (text, tail, most)


def test_buffer_is_validated(spark):
    for tail, most in ((-1, 5), (0, 0), (5, 5)):
        with pytest.raises(ValueError, match="tail"):
            cut_segments(spark.createDataFrame([], "stream_id long, seq long, chunk string"), tail, most)


def chunk_rows():
    draw = random.Random(3)
    rows = []
    for s in range(6):
        n = draw.randrange(1, 9)
        rows += [(s, k, " ".join(draw.choice(["alpha", "beta.", "am 3.", "Mai", "<i>", "x!"]) for _ in range(draw.randrange(6))) + " ", k == n - 1, f"2024-01-01 00:00:{k:02d}") for k in range(n)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "stream_id long, seq long, chunk string, is_last boolean, ts string").selectExpr("stream_id", "seq", "chunk", "is_last", "cast(ts as timestamp) AS ts")


def test_stream_equals_batch_twin(spark, tmp_path):
    rows = chunk_rows()
    mixed = random.Random(5).sample(rows, len(rows))
    for k in range(3):
        table(spark, mixed[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = cut_stream(read_chunks(spark, str(tmp_path / "in"), files_per_trigger=1), 5, 40, delay="1 hour")
    run = write_segments(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) is not False and run.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("not late").select("stream_id", "seg_no", "segment").collect())
    want = sorted(tuple(r) for r in cut_segments(table(spark, rows), 5, 40).collect())
    assert got == want and len(want) > 6
    for s in range(6):
        assert "".join(x[2] for x in want if x[0] == s) == "".join(r[2] for r in rows if r[0] == s)


def test_late_repeated_and_abandoned_chunks(spark, tmp_path):
    first = [(1, 0, "Eins. ", False, "2024-01-01 00:00:00"), (1, 2, "drei", False, "2024-01-01 00:00:01"), (2, 0, "x", True, "2024-01-01 00:00:00")]
    again = [(1, 0, "Eins. ", False, "2024-01-01 00:00:02"), (3, 0, "new", True, "2024-01-02 00:00:00")]
    final = [(4, 0, "later", True, "2024-01-03 00:00:00")]
    for k, rows in enumerate((first, again, final)):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = cut_stream(read_chunks(spark, str(tmp_path / "in")), 0, 40, delay="1 second", idle_ms=1000)
        run = write_segments(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
        assert run.awaitTermination(120) is not False and run.exception() is None, k
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.stream_id, r.segment) for r in got if r.late] == [(1, "Eins. ")]
    assert sorted((r.stream_id, r.seg_no, r.segment) for r in got if not r.late) == [(1, 0, "Eins. "), (1, 1, "drei"), (2, 0, "x"), (3, 0, "new"), (4, 0, "later")]


def test_batch_edge_cases(spark):
    rows = [(1, 0, None), (1, 1, ""), (None, 0, "a"), (2, None, "b"), (3, 0, "c")]
    assert [tuple(r) for r in cut_segments(spark.createDataFrame(rows, "stream_id long, seq long, chunk string")).collect()] == [(3, 0, "c")]
    assert cut_segments(spark.createDataFrame([], "stream_id long, seq long, chunk string")).count() == 0


def test_messages_round_trip(spark, tmp_path):
    rows = [(1, "de", "a"), (2, "en", None)]
    write_normalized(spark.createDataFrame(rows, "msg_id long, lang string, text string"), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in read_messages(spark, str(tmp_path / "m")).select("msg_id", "lang", "text").collect()) == rows
    (tmp_path / "t.txt").write_text("x\ny\n")
    assert [r.text for r in read_messages(spark, str(tmp_path / "t.txt"), "text").collect()] == ["x", "y"]


def run_to_end(writer):
    run = writer.trigger(availableNow=True).start()
    assert run.awaitTermination(300) is not False and run.exception() is None
    return run


def test_early_chunks_cost_what_comes_in_and_survive_restarts(spark, tmp_path):
    n, parts = 8000, 4
    rows = [(1, k, f"word{k}. ", k == n, f"2024-01-01 00:{k // 200:02d}:00") for k in range(1, n + 1)]
    spent = []
    for k in range(parts + 1):
        part = rows[k * n // parts : (k + 1) * n // parts] if k < parts else [(1, 0, "first. ", False, "2024-01-01 00:40:00")]
        table(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Each run is a restart from the checkpoint of the one before.
        run = run_to_end(write_segments(cut_stream(read_chunks(spark, str(tmp_path / "in")), 5, 40, delay="1 day", idle_ms=10**9), str(tmp_path / "out"), str(tmp_path / "check")))
        spent.append(sum(p["durationMs"].get("addBatch", 0) for p in run.recentProgress if p["numInputRows"]))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seg_no").collect()
    assert "".join(r.segment for r in got) == "first. " + "".join(r[2] for r in rows) and not any(r.late for r in got)
    assert max(spent[1:parts]) < 3 * spent[0] + 2000


def test_every_chunk_of_a_shuffled_replay_is_somewhere(spark, tmp_path):
    draw = random.Random(11)
    rows = [(s, k, f"{s}-{k}. ", k == 39, f"2024-01-01 {k // 4:02d}:{k % 4 * 15:02d}:00") for s in range(5) for k in range(40)]
    order = sorted(rows, key=lambda r: r[4] if draw.random() < 0.8 else f"2024-01-02 {draw.randrange(9)}")  # a fifth comes after all others
    for k in range(0, len(order), 20):
        table(spark, order[k : k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    on_time, late = str(tmp_path / "ontime"), str(tmp_path / "late")
    for _ in range(2):  # the second run finds nothing new
        run_to_end(split_late(read_chunks(spark, str(tmp_path / "in"), files_per_trigger=1), on_time, late, str(tmp_path / "split"), delay="1 hour"))
    run_to_end(write_segments(cut_stream(read_chunks(spark, f"{on_time}/*", files_per_trigger=1), 5, 40, delay="1 hour", idle_ms=1000), str(tmp_path / "out"), str(tmp_path / "check")))
    behind = [r.chunk for r in spark.read.parquet(f"{late}/*").collect()]
    assert behind and spark.read.parquet(f"{on_time}/*").count() + len(behind) == len(rows)
    # A last chunk far ahead in time brings what still waits for a gap.
    table(spark, [(99, 0, "end", True, "2024-03-01 00:00:00")]).coalesce(1).write.parquet(f"{on_time}/999999999998")
    table(spark, [(98, 0, "end", True, "2024-04-01 00:00:00")]).coalesce(1).write.parquet(f"{on_time}/999999999999")
    for _ in range(2):
        run_to_end(write_segments(cut_stream(read_chunks(spark, f"{on_time}/*", files_per_trigger=1), 5, 40, delay="1 hour", idle_ms=1000), str(tmp_path / "out"), str(tmp_path / "check")))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    said = [p for r in out for p in re.findall(r"\d+-\d+\. ", r.segment)]
    assert sorted(said + behind) == sorted(r[2] for r in rows)


def test_a_stream_that_comes_whole_asks_for_its_state_once():
    """Each call for state is a round trip; without a head there is nothing early, out of order or beyond the end."""
    from lectern.streaming.cutter import StreamCutter

    import pandas as pd

    asked = []

    class State:
        def __getattr__(self, name):
            return lambda *args: asked.append(name)

    cutter = StreamCutter(64, 500, 1000, 0)
    cutter.head, cutter.early, cutter.handle = State(), State(), State()
    ts = pd.Timestamp("2026-01-01")
    rows = pd.DataFrame([(1, "lo.", True, ts), (0, "Hel", False, ts), (5, "x", False, ts)], columns=["seq", "chunk", "is_last", "ts"])
    out = [tuple(r) for pdf in cutter.handleInputRows((7,), iter([rows]), None) for r in pdf[["segment", "late"]].itertuples(index=False)]
    assert out == [("Hello.", False), ("x", True)] and asked == ["exists"]


def test_a_group_of_new_streams_asks_for_its_state_once():
    """Streams that come whole cost one call for state and one frame a group, not each."""
    from lectern.streaming.cutter import GroupCutter

    import pandas as pd

    asked = []

    class State:
        def __getattr__(self, name):
            return lambda *args: asked.append(name)

    cutter = GroupCutter(64, 500, 1000, 0)
    cutter.head = cutter.early = cutter.order = cutter.quiet = cutter.handle = State()
    rows = pd.DataFrame([(s, k, f"{s}{'ab'[k]}", k == 1, 0) for k in (1, 0) for s in range(50)], columns=["stream_id", "seq", "chunk", "is_last", "ms"])
    out = [[tuple(r) for r in pdf.itertuples(index=False)] for pdf in cutter.handleInputRows((7,), iter([rows[:70], rows[70:]]), None)]
    assert out == [[(s, 0, f"{s}a{s}b", False) for s in range(50)]] and asked == ["exists"]


def awkward_rows(draw, streams):
    """Chunks in parts, with some lost, repeated, beyond the end or without a place, and streams without an end or begun anew."""
    rows = []
    for s in range(streams):
        n = draw.randrange(1, 9)
        for k in range(n):
            text = draw.choice([None, "", "alpha beta. ", "am 3.", " Mai gamma! ", "<i>", "x! y ", "word " * 20])
            rows += [(s, k, text, k == n - 1 and draw.random() < 0.9, f"2024-01-01 {k:02d}:{draw.randrange(60):02d}:00")] * (draw.random() > 0.06)
            rows += [(s, k, text, k == n - 1, rows[-1][4])] * (rows != [] and draw.random() < 0.1)
            rows += [(s, draw.choice([None, n + 1, n + 2]), f"beyond {len(rows)}", False, "2024-01-01 03:00:00")] * (draw.random() < 0.08)
        rows += [(s, 0, "anew", True, "2024-01-01 09:00:00")] * (draw.random() < 0.1)
    rows.sort(key=lambda r: r[4] if draw.random() < 0.8 else f"2024-01-01 1{draw.randrange(9)}")
    # Two last ones far ahead in time bring what waits.
    return [rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] for k in range(4)] + [[(999, 0, "end", True, "2024-01-03 00:00:00")], [(998, 0, "end", True, "2024-01-05 00:00:00")]]


def grouped(spark, tmp_path, groups):
    stream = cut_stream(read_chunks(spark, str(tmp_path / "in" / "*"), files_per_trigger=1), 5, 40, delay="12 hours", idle_ms=3_600_000, groups=groups)
    run_to_end(write_segments(stream, str(tmp_path / f"out{groups}"), str(tmp_path / f"check{groups}")))
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{groups}")).collect()), key=str)


def test_groups_of_streams_give_what_each_gives_alone(spark, tmp_path):
    for k, part in enumerate(awkward_rows(random.Random(3), 60)):
        table(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    want = grouped(spark, tmp_path, None)
    assert grouped(spark, tmp_path, 3) == want and sum(r[3] for r in want) > 9 and len(want) > 99


def test_rows_without_a_stream_leave_others_alone(spark, tmp_path):
    """A null among the names made numbers of all others inexact, and streams were taken for each other."""
    big = 2**60
    rows = [(big + s, k, f"{s}-{k}. ", k == 2, f"2024-01-01 00:00:0{k}") for s in range(4) for k in range(3)] + [(None, k, f"none-{k}. ", k == 2, "2024-01-01 00:00:00") for k in range(3)]
    for k in range(2):
        table(spark, rows[k::2]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = cut_stream(read_chunks(spark, str(tmp_path / "in" / "*"), files_per_trigger=1), 0, 40)
    run_to_end(write_segments(stream, str(tmp_path / "out"), str(tmp_path / "check")))
    said = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seg_no):
        said[r.stream_id] = said.get(r.stream_id, "") + r.segment
    assert said == {**{big + s: f"{s}-0. {s}-1. {s}-2. " for s in range(4)}, None: "none-0. none-1. none-2. "}
