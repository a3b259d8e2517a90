"""Working memory: the stream, the table form and a plain walk."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from parlance.streaming import jobs, working
from test_streaming import at

SCHEMA = "session_id string, turn_id string, ts timestamp"


def by_hand(rows, size, ttl):
    """rows: (session, turn, second) -> the same with what is remembered."""
    out, memory, last = set(), {}, {}
    for session, turn, second in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        forgot = session not in last or second - last[session] > ttl
        memory[session] = [*([] if forgot else memory.get(session, [])), turn][-size:]
        last[session] = second
        out.add((session, turn, tuple(memory[session]), forgot))
    return out


def result(df):
    rows = df.collect()
    assert all(r["window_size"] == len(r["remembered"]) for r in rows)
    made = [(r["session_id"], r["turn_id"], tuple(r["remembered"]), r["starts_anew"]) for r in rows]
    assert len(set(made)) == len(made)
    return set(made)


def random_rows(rng, n):
    return [(f"s{rng.choice([0, 0, 1, 2])}", f"t{i}", rng.choice([rng.randrange(3000), 500])) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(s, t, at(x)) for s, t, x in rows], SCHEMA)


def test_table_form(spark):
    rows = random_rows(random.Random(1), 80)
    assert result(working.working_memory(table(spark, rows), 4, 60)) == by_hand(rows, 4, 60)


def test_stream_over_batches_with_late_order_within_the_delay(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(random_rows(rng, 60), key=lambda r: r[2])
    rows += [("s9", "alone", 100), ("end", "end", 9000)]
    batches = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 900), (900, 2100), (2100, 10_000))]
    for batch in batches:
        rng.shuffle(batch)
        table(spark, batch).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table(spark, []).schema).parquet(str(tmp_path / "in"))
        made = working.working_memory_stream(stream, 4, 60)
        jobs.append_to(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = result(spark.read.schema(made.schema).parquet(str(tmp_path / "out")))
    assert found == {r for r in by_hand(rows, 4, 60) if r[0] != "end"}
    assert any(r[3] for r in found) and max(len(r[2]) for r in found) == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(0, 5), st.integers(1, 20), st.integers(1, 6))
def test_window_sizes(times, carried, ttl, size):
    at_ = np.sort(np.array(times, np.int64))
    carried = min(carried, size)
    last = int(at_[0]) - 3 if carried else None
    held, forgot = working.remembered(at_, carried, ttl, size, last)
    n, before = carried, last
    for i, t in enumerate(at_):
        gone = before is None or t - before > ttl
        n = min(size, (0 if gone else n) + 1)
        assert (held[i], forgot[i]) == (n, gone)
        before = t


def test_a_turn_at_the_watermark_itself_is_given_out(spark, tmp_path):
    table(spark, [("a", "first", 1000), ("b", "end", 1060)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table(spark, []).schema).parquet(str(tmp_path / "in"))
    made = working.working_memory_stream(stream, 4, 600)
    jobs.append_to(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert result(spark.read.schema(made.schema).parquet(str(tmp_path / "out"))) == {("a", "first", ("first",), True)}
