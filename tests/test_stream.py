"""Exactly-once ingestion under faults."""

import datetime as dt
import logging
import random
import threading
import time
import types

import pytest

from pyspark.sql import functions as F

from rillmark.functions import wire
from rillmark.model import RangeState, State
from rillmark.operators import verify
from rillmark.sources import topic
from rillmark.streaming import ingest
from rillmark.streaming.ingest import Ingest, InvalidRange, LeaseLost, transient
from rillmark.streaming.lease import FileLease
from rillmark.streaming.ledger import Fenced, FileLedger
from rillmark.streaming.progress import watch
from rillmark.streaming.sink import TokenSink

STEPS = ["before IN_PROGRESS", "after IN_PROGRESS", "after write", "after COMPLETED"]


class Crash(RuntimeError):
    pass


class Fault:
    def __init__(self, *steps):
        self.left = list(steps)

    def __call__(self, step):
        if self.left and self.left[0] == step:
            self.left.pop(0)
            raise Crash(step)


def rows(spark, n, partitions=2, start=0):
    made = [(dt.date(2025, 3, 1), f"t{p}-{o}", f"user{o % 5}", "product1", o + 1, p, o) for p in range(partitions) for o in range(start, start + n)]
    return spark.createDataFrame(made, "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint")


def parts(spark, tmp_path, fault=lambda step: None):
    ledger, sink = FileLedger(spark, f"file://{tmp_path}/ledger"), TokenSink(spark, f"file://{tmp_path}/tables")
    return Ingest(spark, ledger, sink, fault, lambda s: None), ledger, sink


def holds(produced, sink):
    s = verify.summary(verify.compare(produced, sink.transactions())).head()
    assert (s.missing, s.duplicates, s.unexpected, s.corrupted) == (0, 0, 0, 0)
    assert s.produced_sum == s.stored_sum == sink.reports().agg(F.sum("amount")).head()[0]


@pytest.mark.parametrize("step", STEPS)
def test_crash_and_replay_of_a_batch(spark, tmp_path, step):
    produced = rows(spark, 6)
    job, ledger, sink = parts(spark, tmp_path, Fault(step))
    with pytest.raises(Crash):
        job.batch(wire.encode(produced))
    job.batch(wire.encode(produced))
    holds(produced, sink)
    assert ledger.get(0) == RangeState(0, 5, State.COMPLETED)
    # once more, and then what follows
    job.batch(wire.encode(produced))
    more = rows(spark, 4, start=6)
    job.batch(wire.encode(more))
    holds(produced.union(more), sink)


def test_replay_in_parts(spark, tmp_path):
    produced = rows(spark, 6, 1)
    job, ledger, sink = parts(spark, tmp_path, Fault("after IN_PROGRESS"))
    with pytest.raises(Crash):
        job.batch(wire.encode(produced))
    messages = wire.encode(produced)
    job.batch(messages.where("offset < 2"))
    assert ledger.get(0).state is State.IN_PROGRESS
    with pytest.raises(InvalidRange, match="before the range in progress is whole"):
        job.batch(messages.where("offset >= 4").union(wire.encode(rows(spark, 1, 1, 6))))
    job.batch(messages.where("offset between 1 and 3"))
    job.batch(messages.where("offset >= 4").union(wire.encode(rows(spark, 2, 1, 6))))
    holds(produced.union(rows(spark, 2, 1, 6)), sink)


def test_bad_ranges_are_refused(spark, tmp_path):
    job, ledger, _ = parts(spark, tmp_path)
    job.batch(wire.encode(rows(spark, 3, 1)))
    with pytest.raises(InvalidRange, match="follow"):
        job.batch(wire.encode(rows(spark, 3, 1, start=5)))
    gap = wire.encode(rows(spark, 4, 1, start=3)).where("offset <> 4")
    with pytest.raises(InvalidRange, match="contiguous"):
        job.batch(gap)
    assert ledger.get(0) == RangeState(0, 2, State.COMPLETED)


def test_store_failures_are_retried(spark, tmp_path):
    left = [1, 2]

    def broken(step):
        if step == "after write" and left:
            left.pop()
            raise OSError("store is away")

    produced = rows(spark, 3)
    job, _, sink = parts(spark, tmp_path, broken)
    job.batch(wire.encode(produced))
    holds(produced, sink)
    assert not left


def test_failures_of_spark_and_the_jvm_are_retried(spark, tmp_path):
    """A store that is away makes Spark's own exceptions; messages that can't be read are refused at once."""
    produced, left, slept = rows(spark, 3), [1, 2], []
    job, _, sink = parts(spark, tmp_path)
    job.sleep = slept.append
    push = sink.push

    def broken(transactions, ranges):
        if left:
            left.pop()
            spark.read.text(f"file://{tmp_path}/nowhere").write.parquet("nofs://x/y") if len(left) > 5 else spark._jvm.org.apache.hadoop.fs.Path("nofs://x").getFileSystem(spark._jsc.hadoopConfiguration())
        push(transactions, ranges)

    sink.push = broken
    job.batch(wire.encode(produced))
    holds(produced, sink)
    assert slept == [0.5, 1.0]
    with pytest.raises(Exception, match="MALFORMED") as e:
        job.batch(spark.createDataFrame([(0, 3, '{"amount":"x"')], "partition_id bigint, offset bigint, value string"))
    assert not transient(e.value)
    assert slept == [0.5, 1.0]
    # no more than three tries
    left += [1] * 5
    with pytest.raises(Exception, match="nofs"):
        job.batch(wire.encode(rows(spark, 2, 1, start=3)))
    assert len(left) == 2


def test_empty_batch_and_replay_of_completed(spark, tmp_path):
    produced = rows(spark, 4)
    job, ledger, sink = parts(spark, tmp_path)
    job.batch(wire.encode(produced.limit(0)))
    assert ledger.partitions() == []
    job.batch(wire.encode(produced))
    written = sink.tokens().count()
    epochs = dict(job.epochs)
    job.batch(wire.encode(produced))  # COMPLETED: nothing is written again
    assert sink.tokens().count() == written and job.epochs == epochs
    holds(produced, sink)


def test_of_two_ingesters_the_older_is_refused(spark, tmp_path):
    """The second takes the partitions over while the first is held up in the middle of a batch."""
    produced = rows(spark, 4)
    new, ledger, sink = parts(spark, tmp_path)

    def pause(step):
        if step == "after write":
            new.batch(wire.encode(produced))

    old = Ingest(spark, ledger, sink, pause, lambda s: None)
    with pytest.raises(Fenced):
        old.batch(wire.encode(produced))
    assert ledger.get(0) == RangeState(0, 3, State.COMPLETED)
    holds(produced, sink)
    more = rows(spark, 3, start=4)
    new.batch(wire.encode(more))
    holds(produced.union(more), sink)


def test_leases(spark, tmp_path):
    now = [0.0]
    ledger, sink = FileLedger(spark, f"file://{tmp_path}/ledger"), TokenSink(spark, f"file://{tmp_path}/tables")
    tick = lambda s: now.__setitem__(0, now[0] + s)
    make = lambda name, at=lambda step: None: Ingest(spark, ledger, sink, at, tick, FileLease(spark, f"file://{tmp_path}/leases", name, 120, lambda: now[0]), 60, 20, lambda: now[0])
    a, b = make("a"), make("b")
    first, second, third = rows(spark, 3), rows(spark, 3, start=3), rows(spark, 3, start=6)
    a.batch(wire.encode(first))
    with pytest.raises(LeaseLost, match="a's"):
        b.batch(wire.encode(second))
    now[0] = 200  # a's leases have ended
    b.batch(wire.encode(second))
    with pytest.raises(LeaseLost, match="b's"):
        a.batch(wire.encode(third))
    now[0] = 500
    # a batch that takes too long gives up before it writes on, and its replay repairs it
    slow = make("b", lambda step: tick(61) if step == "after write" and now[0] < 700 else None)
    with pytest.raises(LeaseLost, match="60 s"):
        slow.batch(wire.encode(third))
    assert ledger.get(0).state is State.IN_PROGRESS
    # its leases are free at once, long before they would have ended
    assert now[0] < 500 + 120 and all(a.lease.holder(p) is None for p in range(2))
    a.batch(wire.encode(third))
    holds(first.union(second).union(third), sink)


def test_many_replays_are_one_job(spark, tmp_path):
    """Twelve partitions crash and come back in parts: the jobs of a replay don't grow with the partitions."""
    used = []
    for n in (2, 12):
        produced = rows(spark, 4, n)
        job, _, sink = parts(spark, tmp_path / str(n), Fault("after IN_PROGRESS"))
        messages = wire.encode(produced)
        with pytest.raises(Crash):
            job.batch(messages)
        job.batch(messages.where("offset < 2"))
        tag = f"replay-{n}"
        spark.sparkContext.setJobGroup(tag, tag)
        job.batch(messages.where("offset >= 2"))
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        holds(produced, sink)
    assert used[1] <= used[0] + 3


def test_topic_log(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/topic"
    topic.produce(wire.encode(rows(spark, 5)), root)
    assert [topic.end_offset(root, p) for p in topic.partitions(root)] == [5, 5]
    assert topic.append(root, 1, ["x", "y"]) == (5, 6)
    got = {(r.partition_id, r.offset) for r in topic.scan(spark, root).collect()}
    assert got == {(p, o) for p in (0, 1) for o in range(5 + 2 * p)}
    topic.recreate(root)
    assert topic.partitions(root) == []
    monkeypatch.setattr(topic, "SEGMENT", 3)
    assert topic.append(root, 0, [str(i) for i in range(8)]) == (0, 7)
    assert [s[:2] for s in topic._segments(root, 0)] == [(0, 3), (3, 3), (6, 2)]
    assert [m[1:] for m in topic._lines(root, 0, 2, 7)] == [(i, str(i)) for i in range(2, 7)]
    assert topic.append(root, 0, []) == (8, 7)


def test_stream_with_crashes_and_lost_checkpoint(spark, tmp_path):
    root = f"{tmp_path}/topic"
    first, second = rows(spark, 30), rows(spark, 10, start=30)
    topic.produce(wire.encode(first), root)
    job, ledger, sink = parts(spark, tmp_path, Fault("after write", "after IN_PROGRESS"))
    for _ in range(2):
        with pytest.raises(Exception, match="Crash"):
            job.catch_up(root, f"{tmp_path}/checkpoint", most=20)
    job.catch_up(root, f"{tmp_path}/checkpoint", most=20)
    holds(first, sink)
    for p in (0, 1):
        topic.append(root, p, [r.value for r in wire.encode(second).where(f"partition_id = {p}").orderBy("offset").collect()])
    # without its checkpoint the job goes on from the ledger
    job.catch_up(root, f"{tmp_path}/other", most=20)
    holds(first.union(second), sink)
    assert ledger.get(1).max_offset == 39


def test_second_consumer_and_fresh_topic(spark, tmp_path):
    """A second job with its own ledger, tables and checkpoint sees the same messages; after a reset both begin anew."""
    root = f"{tmp_path}/topic"
    produced = rows(spark, 12)
    topic.produce(wire.encode(produced), root)
    jobs = [parts(spark, tmp_path / name) for name in ("one", "two")]
    for k, (job, _, sink) in enumerate(jobs):
        job.catch_up(root, f"{tmp_path}/checkpoint-{k}", most=8)
        holds(produced, sink)
    topic.recreate(root)
    fresh = rows(spark, 5).withColumn("transaction_id", F.concat(F.lit("new-"), "transaction_id"))
    topic.produce(wire.encode(fresh), root)
    job, ledger, sink = jobs[0]
    ledger.clear()
    sink.files.delete(sink.base)
    again = Ingest(spark, ledger, sink)
    again.catch_up(root, f"{tmp_path}/checkpoint-new", most=8)
    holds(fresh, sink)
    holds(produced, jobs[1][2])


def test_progress_is_logged(spark, tmp_path, caplog):
    root = f"{tmp_path}/topic"
    topic.produce(wire.encode(rows(spark, 3)), root)
    job, _, _ = parts(spark, tmp_path)
    with caplog.at_level(logging.INFO, "rillmark.progress"):
        listener = watch(spark)
        try:
            job.catch_up(root, f"{tmp_path}/checkpoint")
            until = time.monotonic() + 20
            while "ended" not in caplog.text and time.monotonic() < until:
                time.sleep(0.1)
        finally:
            spark.streams.removeListener(listener)
    assert "started" in caplog.text and "6 rows" in caplog.text and "ended" in caplog.text


def test_soak(spark, tmp_path):
    """A producer and faults run beside the job; when both have ended it drains, and every record is held against what was
    produced. Jobs that a fault has ended are started anew, as two owners in turn."""
    r, root = random.Random(11), f"{tmp_path}/topic"
    topic.recreate(root)
    made, stop, steps, faults = [], threading.Event(), [], []

    def produce():
        at = [0, 0]
        for _ in range(6):
            for p in range(2):
                n = r.randrange(0, 9)
                new = [(dt.date(2025, 3, 1), f"s{p}-{at[p] + k}", f"user{k}", "product1", k + 1, p, at[p] + k) for k in range(n)]
                made.extend(new)
                topic.append(root, p, [f'{{"transaction_id":"{t[1]}","user_id":"{t[2]}","product_id":"{t[3]}","amount":{t[4]},"date":"2025-03-01T00:00:00Z"}}' for t in new])
                at[p] += n
            time.sleep(0.5)
        stop.set()

    def fault(step):
        steps.append(step)
        if len(steps) in (2, 7, 12):
            faults.append(step)
            raise Crash(step)

    ledger, sink = FileLedger(spark, f"file://{tmp_path}/ledger"), TokenSink(spark, f"file://{tmp_path}/tables")
    producer = threading.Thread(target=produce)
    producer.start()
    while not topic.partitions(root):
        time.sleep(0.05)
    turns = 0
    while (not stop.is_set() or len(faults) < 2) and turns < 20:
        turns += 1
        job = Ingest(spark, ledger, sink, fault, lambda s: None)
        try:
            job.catch_up(root, f"{tmp_path}/checkpoint", most=20, timeout=60)
        except Exception as e:
            if "Crash" not in str(e):
                raise
    producer.join()
    Ingest(spark, ledger, sink).catch_up(root, f"{tmp_path}/checkpoint", most=20)
    produced = spark.createDataFrame(made, "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint")
    assert verify.wait_for_distinct(sink.transactions, len(made), 60, sleep=lambda s: None) == len(made)
    holds(produced, sink)
    sink.compact(ledger.frame())
    holds(produced, sink)
    checks = verify.invariants(sink.transactions(), sink.reports(), verify.totals(produced)).collect()
    assert all(c.ok for c in checks)
    assert len(faults) >= 2


def test_a_batch_is_read_by_several_tasks(tmp_path, monkeypatch):
    root = f"{tmp_path}/topic"
    monkeypatch.setattr(topic, "READ", 4)
    topic.append(root, 0, [str(i) for i in range(15)])
    reader = topic._Reader({"path": root, "startoffsets": '{"0": 2}'})
    found = reader.partitions({"0": 2}, {"0": 13})
    assert [(s.start, s.end) for s in found] == [(2, 4), (4, 8), (8, 12), (12, 13)]
    assert [o for s in found for _, o, _ in reader.read(s)] == list(range(2, 13))
    assert reader.partitions({"0": 13}, {"0": 13}) == []


def test_batches_grow_with_the_log(tmp_path):
    root = f"{tmp_path}/topic"
    topic.append(root, 0, ["x"] * 100)
    topic.append(root, 1, ["x"] * 7)
    assert topic.batch_messages(root, 3, 10, 1000) == 34
    assert topic.batch_messages(root, 3, 50, 1000) == 50
    assert topic.batch_messages(root, 3, 10, 20) == 20
    assert topic.batch_messages(f"{tmp_path}/none", 3, 10, 20) == 10


def test_catching_up_may_take_long_while_it_goes_on(spark, tmp_path, monkeypatch):
    """Each of three batches takes 40 s of this clock; only a minute without any progress ends the run."""
    root, late = f"{tmp_path}/topic", [0.0]
    topic.produce(wire.encode(rows(spark, 30)), root)

    def slow(step):
        if step == "after COMPLETED":
            late[0] += 40.0
            time.sleep(1.0)

    monkeypatch.setattr(ingest, "time", types.SimpleNamespace(monotonic=lambda: late[0], sleep=time.sleep))
    job, ledger, sink = parts(spark, tmp_path, slow)
    job.catch_up(root, f"{tmp_path}/checkpoint", most=10, timeout=60)
    holds(rows(spark, 30), sink)
