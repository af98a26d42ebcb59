"""Batches that are made ready together, and sent one after the other."""

import random
import uuid
from dataclasses import replace
from datetime import timedelta

import pytest

from sluice.operators import collect
from sluice.operators.triage import EXPIRED
from sluice.session import shared_dir
from sluice.sources.tables import SETTLED, RelayTables
from test_relay import CFG, NOW, PUBSUB, SQS, delivered, keyed, new_relay, ok, outbox, recorder


class Counting(RelayTables):
    """Tables that count how often each is written."""

    def write(self, df, name, batch_id):
        WRITES[name.split("/")[0]] = WRITES.get(name.split("/")[0], 0) + 1
        super().write(df, name, batch_id)


WRITES: dict[str, int] = {}


def drained(spark, folder, rows, send=ok, clock=lambda: NOW, **changes):
    """A relay over a log that holds the rows, and what ``drain_log`` returned."""
    relay = new_relay(spark, folder, send, **changes)
    relay = replace(relay, tables=Counting(spark, relay.tables.root), clock=clock)
    WRITES.clear()
    log = relay.pending_log(rows)
    log.append(rows, 0)
    return relay, log, relay.drain_log(log)


def settled(relay):
    """Settled ids by batch."""
    found = {}
    for r in relay.tables.read("settled", SETTLED).collect():
        found.setdefault(r["batch_id"], set()).add(r["id"])
    return [found[b] for b in sorted(found)]


def by_hand(routes, target):
    """Batches of a table of (route, ids in order) when each is settled before the next one is selected."""
    left, batches = {r: sorted(ids) for r, ids in routes.items() if ids}, []
    while left:
        share = max(1, -(-target // len(left)))
        batches.append({i for ids in left.values() for i in ids[:share]})
        left = {r: ids[share:] for r, ids in left.items() if ids[share:]}
    return batches


@pytest.mark.parametrize("seed, most", [(0, 3), (1, 7), (2, 50)])
def test_batches_selected_together_follow_each_other(spark, seed, most):
    pick = random.Random(seed)
    routes = {f"q{n}": [] for n in range(6)}
    for i in range(150):
        routes[f"q{min(pick.randrange(9), 5)}" if i > 20 else "q5"].append(i)
    df = outbox(spark, [(i, "p", SQS, r, None) for r, ids in routes.items() for i in ids] + [(900, "p", "kafka", "x", None)]).repartition(5)
    cfg = replace(CFG, batch_target=14)
    got = {}
    for r in collect.fair_share_batches(df, cfg, most, "n", slices=3).collect():
        got.setdefault(r["n"], set()).add(r["id"])
    assert [got[n] for n in range(len(got))] == by_hand(routes, 14)[:most]
    assert {r["id"] for r in collect.fair_share_ids(df, cfg, 3).collect()} == got[0]


def test_depths_end_where_nothing_is_pending():
    assert collect.batch_depths([(5, 1), (12, 1)], 10, 9) == [5, 15]
    assert collect.batch_depths([], 10, 9) == []
    assert collect.batch_depths([(3, 100)], 10, 2) == [1, 2]


def test_many_small_batches_are_not_selected_one_by_one(spark, tmp_path):
    routes = {"q": list(range(0, 60, 2)), "topic-a": list(range(1, 40, 2))}
    rows = outbox(spark, [(i, "p", PUBSUB if r[0] == "t" else SQS, r, None) for r, ids in routes.items() for i in ids])
    relay, _, log = drained(spark, tmp_path, rows, batch_target=4)
    want = by_hand(routes, 4)
    assert settled(relay) == want and [r["selected"] for r in log] == [len(b) for b in want]
    assert sorted(s[3] for s in delivered(tmp_path)) == sorted(set().union(*want))
    # One more batch finds nothing; each has its own start and commit.
    assert relay.tables.batch_commits().count() == relay.tables.states().filter("state = 'committed'").count() == len(want) + 1
    assert len(want) > 10 and WRITES["selected_ids"] <= 4


def test_a_kept_row_comes_before_what_was_made_ready(spark, tmp_path):
    marks, sent = tmp_path / "marks", tmp_path / "sent"
    marks.mkdir(), sent.mkdir()

    def flaky(row):
        if row.id == 9 and not list(marks.iterdir()):
            (marks / "tried").write_text("x")
            return "error", "503", "unavailable", False
        return ok(row)

    rows = outbox(spark, [(i, "p", PUBSUB, "topic-a", keyed(PUBSUB, "k")) for i in range(20)])
    relay, _, log = drained(spark, sent, rows, flaky, batch_target=4)
    assert settled(relay) == [set(range(4)), set(range(4, 8)), {8}, set(range(9, 13)), set(range(13, 17)), set(range(17, 20))]
    assert [r["kept"] for r in log] == [0, 0, 3, 0, 0, 0]
    assert [s[3] for s in delivered(sent)] == list(range(20))


def test_a_batch_is_committed_before_the_next_one_is_sent(spark, tmp_path):
    def dying(row):
        if row.id == 13:
            raise RuntimeError("killed")
        return ok(row)

    rows = outbox(spark, [(i, "p", SQS, "q.fifo", keyed(SQS, "g")) for i in range(24)])
    relay = replace(new_relay(spark, tmp_path, dying, batch_target=4))
    log = relay.pending_log(rows)
    log.append(rows, 0)
    with pytest.raises(Exception, match="killed"):
        relay.drain_log(log)
    assert relay.tables.next_batch_id() == 3 and {s[3] for s in delivered(tmp_path)} <= set(range(13))
    replace(relay, publishers=recorder(tmp_path)).drain_log(log)
    states = [(r["batch_id"], r["attempt"], r["state"]) for r in relay.tables.states().orderBy("batch_id", "attempt").collect()]
    assert states[2:5] == [(2, 0, "committed"), (3, 0, "failed"), (3, 1, "committed")]
    assert {s[3] for s in delivered(tmp_path)} == set(range(24)) == set().union(*settled(relay))


def test_rows_that_expire_before_their_batch_are_not_sent(spark, tmp_path):
    """The clock moves on an hour a batch; rows made ready in time are triaged by their own batch's clock."""
    ticks = iter(range(100))
    rows = outbox(spark, [(i, "p", SQS, "q", None) for i in range(24)])
    relay, _, _ = drained(spark, tmp_path, rows, clock=lambda: NOW + timedelta(hours=next(ticks)), batch_target=4, max_age=timedelta(hours=3))
    got = {r["id"]: r["reason"] for r in relay.tables.settled().collect()}
    assert [got[i] for i in range(24)] == [None] * 16 + [EXPIRED] * 8
    assert {s[3] for s in delivered(tmp_path)} == set(range(16))


def test_ids_that_come_twice_are_treated_as_one_by_one(spark, tmp_path):
    """Copies of an id that fall into two batches go out with the first; the next one starts after them."""
    rows = outbox(spark, [(i, "p", SQS, "q", None) for i in [*range(24), 7, 15, 19]])
    found = []
    for name in ("together", "alone"):
        (tmp_path / name).mkdir()
        relay = new_relay(spark, tmp_path / name, batch_target=4)
        log = relay.pending_log(rows)
        log.append(rows, 0)
        if name == "together":
            relay.drain_log(log)
        else:
            relay.drain(rows)
        found.append((settled(relay), sorted(s[3] for s in delivered(tmp_path / name))))
    assert found[0] == found[1] and set(found[0][1]) == set(range(24))


def test_committed_batches_are_found_without_gaps(spark):
    tables = RelayTables(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    assert tables.committed_after(-1) == []
    for n in range(7):
        tables.write(spark.range(1), "batch_log", n)
        assert tables.committed_after(-1) == list(range(n + 1)) and tables.committed_after(n) == []
    assert tables.committed_after(2) == [3, 4, 5, 6]


def test_batches_leave_no_threads_behind(spark, tmp_path):
    """A Python thread that ends leaves one in the JVM; helpers are kept, so their number does not grow with the batches."""
    def threads():
        return spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean().getThreadInfo(
            spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean().getAllThreadIds())

    def connections():
        return sum(t is not None and "Thread-" in t.getThreadName() for t in threads())

    rows = outbox(spark, [(i, "p", SQS if i % 2 else PUBSUB, "q", None) for i in range(24)])
    relay, log, _ = drained(spark, tmp_path, rows, batch_target=4)
    before = connections()
    log.append(outbox(spark, [(100 + i, "p", SQS if i % 2 else PUBSUB, "q", None) for i in range(24)]), 1)
    assert len(relay.drain_log(log)) == 6 and connections() <= before + 4
