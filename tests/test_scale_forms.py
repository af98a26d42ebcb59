"""The split forms of sequential work against plain sequential code."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from sluice.operators import chunks, failures, ranking
from sluice.session import shared_dir
from sluice.sources.tables import RelayTables
from sluice.streaming.suppress import suppress_keyed, suppress_stream

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def hot_rows(seed, n=600):
    rng = random.Random(seed)
    return [(i * rng.choice([1, 1, 1, 50]) * 1000 + i, rng.choice(["hot"] * 5 + ["a", "b"]), rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("slices", [16, 64])
def test_row_numbers_and_sums_equal_the_plain_window(spark, slices):
    df = spark.createDataFrame(hot_rows(slices), "id bigint, g string, v bigint")
    plain = Window.partitionBy("g").orderBy("id")
    want = {r["id"]: (r["n"], r["s"], r["p"]) for r in df.select(
        "id", F.row_number().over(plain).alias("n"), F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.lag("v").over(plain).alias("p")).collect()}
    numbers = {r["id"]: r["n"] for r in ranking.row_numbers(df, ["g"], "id", "n", slices).collect()}
    sums = {r["id"]: r["s"] for r in ranking.running_sums(df, ["g"], "id", {"s": "v"}, slices).collect()}
    before = {r["id"]: r["p"] for r in ranking.previous_values(df, ["g"], "id", {"p": "v"}, slices).collect()}
    assert {i: (numbers[i], sums[i], before[i]) for i in want} == want


def test_a_hot_group_is_spread_over_ranges(spark):
    df = spark.range(20_000).selectExpr("id", "'hot' AS g")
    sizes = [r["count"] for r in ranking.with_slices(df, "id", 64).groupBy(ranking.SLICE).count().collect()]
    assert len(sizes) > 32 and max(sizes) < 20_000 // 8 and sum(sizes) == 20_000


def test_text_ids_and_struct_orders(spark):
    df = spark.range(300).selectExpr("concat('e-', lpad(id * 7919 % 300, 4, '0')) AS id", "id % 2 AS g")
    got = {r["id"]: r["n"] for r in ranking.row_numbers(df, ["g"], "id", "n", 16).collect()}
    for g in (0, 1):
        ids = sorted(r["id"] for r in df.filter(F.col("g") == g).collect())
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    tied = df.selectExpr("id", "1 AS t")
    got = {r["id"]: r["n"] for r in ranking.row_numbers(tied, [], "struct(t, id)", "n", 16).collect()}
    assert [got[i] for i in sorted(got)] == list(range(1, 301))


def test_oldest_is_exact(spark):
    df = spark.range(1000).repartition(16).selectExpr("id * 37 % 1000 AS id")
    assert [r["id"] for r in ranking.oldest(df, "id", 50, slices=4).collect()] == list(range(50))


def greedy(rows):
    out, state = {}, {}
    for i, queue, size in sorted(rows):
        no, count, total = state.get(queue, (1, 0, 0))
        if count and (count >= 10 or total + size > 1_048_576):
            no, count, total = no + 1, 0, 0
        state[queue] = (no, count + 1, total + size)
        out[i] = no
    return out


@few
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b"]), st.sampled_from([1, 10, 100_000, 300_000, 700_000, 1_048_576])), min_size=1, max_size=120),
       st.sampled_from([10, 13, 40]))
def test_greedy_chunks(spark, sizes, block_rows):
    rows = [(n, q, s) for n, (q, s) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id bigint, queue string, message_size bigint")
    want = greedy(rows)
    assert {r["id"]: r["chunk_no"] for r in chunks.greedy_chunks(df, block_rows).collect()} == want
    assert {r["id"]: r["chunk_no"] for r in chunks.batch_chunks(df).collect()} == want


def silence(records, window):
    out, state = [], {}
    for at, i, sig in sorted(records):
        next_at, pending = state.get(sig, (None, 0))
        if next_at is not None and at < next_at:
            state[sig] = (next_at, pending + 1)
        else:
            out.append((sig, at, i, pending))
            state[sig] = (at + window, 0)
    return sorted(out)


def as_frame(spark, records):
    rows = [(s, datetime.fromtimestamp(1_700_000_000 + at, timezone.utc), i) for at, i, s in records]
    return spark.createDataFrame(rows, "signature string, at timestamp, id bigint")


def emitted(df):
    rows = df.select("signature", (F.unix_micros("at") / 1_000_000 - 1_700_000_000).cast("bigint"), "id", "suppressed_count").collect()
    return sorted(tuple(r) for r in rows)


@few
@given(st.lists(st.tuples(st.integers(0, 900), st.sampled_from(["x", "x", "y"])), min_size=2, max_size=150), st.integers(1, 3),
       st.sampled_from([(1, 2), (2, 3), (16, 64)]))
def test_suppression_with_and_without_carried_state(spark, times, cuts, blocks):
    window = timedelta(seconds=5)
    records = [(at, n, s) for n, (at, s) in enumerate(sorted(times))]
    want = silence(records, 5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(failures, "BLOCK_WINDOWS", blocks[0])
        patch.setattr(failures, "SPAN_BLOCKS", blocks[1])
        assert emitted(failures.suppress_failures(as_frame(spark, records), window)) == want
        got, state = [], None
        step = len(records) // (cuts + 1) + 1
        for start in range(0, len(records), step):
            through, state = failures.suppress_step(as_frame(spark, records[start:start + step]), window, state)
            got += emitted(through)
    assert sorted(got) == want


def test_composed_spans_against_plain_code():
    """Many dense histories through the block and span summaries, without Spark."""
    import pandas as pd

    rng = random.Random(11)
    for trial in range(300):
        window, block, span = rng.choice([3, 5, 8]), rng.choice([1, 2, 3]), rng.choice([2, 3, 5])
        times = sorted(rng.choices(range(rng.choice([60, 300])), k=rng.randint(1, 80)))
        want = silence([(t, n, "s") for n, t in enumerate(times)], window)
        grouped = pd.Series(times).groupby(times).size()
        frame = pd.DataFrame({"signature": "s", "at": grouped.index, "n": grouped.values, "id": [times.index(t) for t in grouped.index]})
        frame["block"] = frame["at"] // (window * block)
        rows = pd.concat([failures._summarise(g, window) for _, g in frame.groupby("block")])
        rows["span"] = rows["block"] // span
        spans = pd.concat([failures._compose(g, window) for _, g in rows.groupby("span")])
        spans = spans.assign(span=0, state_at=failures.NEVER, state_pending=0)
        entered = pd.concat(failures._carry(iter([spans]), window)).set_index("block")
        rows["state_at"] = rows["span"].map(entered["next_at"])
        rows["state_pending"] = rows["span"].map(entered["pending"])
        states = pd.concat(failures._carry(iter([rows]), window)).set_index("block")
        got = []
        for number, part in frame.groupby("block"):
            part = part.assign(next_at=states["next_at"][number], pending=states["pending"][number])
            got += [tuple(r) for r in failures._emit(part, window).itertuples(index=False)]
        assert sorted(got) == want, (trial, times, window, block, span)


def test_the_next_record_exactly_one_window_later_is_emitted(spark):
    df = as_frame(spark, [(0, 1, "s"), (30, 2, "s"), (59, 3, "s"), (60, 4, "s")])
    assert emitted(failures.suppress_failures(df, timedelta(seconds=60))) == [("s", 0, 1, 0), ("s", 60, 4, 2)]


def test_streaming_suppression_both_forms(spark):
    rng = random.Random(5)
    records = [(at, n, rng.choice(["x", "y"])) for n, at in enumerate(sorted(rng.sample(range(3000), 300)))]
    want = silence(records, 60)
    tables = RelayTables(spark, f"{shared_dir(spark)}/suppress")
    source = tables.path("source")
    for part in (records[:120], records[120:121], records[121:]):
        as_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    arrivals = spark.readStream.schema("signature string, at timestamp, id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    suppress_stream(arrivals, timedelta(seconds=60), tables, tables.path("checkpoint"), {"availableNow": True}).awaitTermination()
    assert emitted(tables.read("emitted", "signature string, at timestamp, id bigint, suppressed_count bigint")) == want

    out = tables.path("keyed")
    stream = (suppress_keyed(arrivals, timedelta(seconds=60)).writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", tables.path("keyed_checkpoint")).trigger(availableNow=True).start())
    stream.awaitTermination()
    keyed = spark.read.parquet(out).withColumn("at", F.timestamp_micros("at_us"))
    assert emitted(keyed) == want


def test_silence_that_is_over_leaves_the_state(spark):
    """Only signatures that are silent, held something back or were seen lately stay in the state; emissions are the same."""
    window = timedelta(seconds=60)
    parts = [[(0, 1, "a"), (0, 2, "b"), (5, 3, "b"), (1, 4, "c")], [(200, 5, "c")], [(300, 6, "b"), (301, 7, "a"), (400, 8, "c")]]
    states, through = {}, {}
    for lateness in (None, window):
        state, out, sizes = None, [], []
        for part in parts:
            some, state = failures.suppress_step(as_frame(spark, part), window, state, lateness)
            out += emitted(some)
            state = spark.createDataFrame(state.collect(), state.schema)
            sizes.append(sorted(r["signature"] for r in state.collect()))
        states[lateness], through[lateness] = sizes, sorted(out)
    assert through[None] == through[window]
    assert states[None][-1] == ["a", "b", "c"] and states[window] == [["a", "b", "c"], ["b", "c"], ["a", "b", "c"]]
