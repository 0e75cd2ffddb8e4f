"""Records, wire format, sink, reports, verification and generators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillmark.functions import state as S
from rillmark.functions import wire
from rillmark.model import RANGES, RangeState, State, state_name, with_offsets
from rillmark.operators import generate, reports, verify
from rillmark.operators import ranges as R
from rillmark.sources import tables
from rillmark.streaming.lease import FileLease
from rillmark.streaming.ledger import Fenced, FileLedger, start_offsets
from rillmark.streaming.sink import Rejected, TokenSink

D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
# fixed values: acceptance rows and the totals that go with them
GOLDEN = [
    (D1, "transaction_1", "user_1", "product1", 20, 1, 0),
    (D2, "transaction_2", "user_1", "product2", 30, 1, 1),
    (D1, "transaction_3", "user_1", "product1", 40, 1, 2),
    (D2, "transaction_4", "user_2", "product1", 50, 1, 3),
    (D1, "transaction_5", "user_2", "product1", 60, 1, 4),
    (D2, "transaction_6", "user_10", "product1", 70, 1, 5),
]
TX = "date date, transaction_id string, user_id string, product_id string, amount bigint, partition_id bigint, offset bigint"


@pytest.fixture
def golden(spark):
    return spark.createDataFrame(GOLDEN, TX)


def bounds(spark, *rows):
    return spark.createDataFrame(list(rows), "partition_id bigint, min_offset bigint, max_offset bigint")


def test_record_codec(spark):
    assert S.to_bytes(RangeState(3, 12, State.IN_PROGRESS)).hex().upper() == "0000000000000003000000000000000C01"
    assert S.from_bytes(S.to_bytes(RangeState(9, 19, State.COMPLETED))) == RangeState(9, 19, State.COMPLETED)
    assert S.from_bytes(None).state is State.UNKNOWN
    with pytest.raises(ValueError, match="17 bytes"):
        S.from_bytes(b"\0" * 16)
    row = spark.range(1).select(S.record(F.lit(3), F.lit(12), F.lit(1)).alias("r")).select("r", S.unrecord(F.col("r")).alias("u")).head()
    assert bytes(row.r) == S.to_bytes(RangeState(3, 12, State.IN_PROGRESS))
    assert tuple(row.u) == (3, 12, 1)
    with pytest.raises(Exception, match="17 bytes"):
        spark.range(1).select(S.unrecord(F.unhex(F.lit("0011")))).collect()
    with pytest.raises(Exception, match="no such state"):
        spark.range(1).select(state_name(F.lit(3))).collect()


def test_wire_round_trip(spark, golden):
    assert sorted(map(tuple, wire.decode(wire.encode(golden)).collect())) == sorted(GOLDEN)


@pytest.mark.parametrize("amount", ["100.0", "1e2", '"100"', "9223372036854775808", "{"])
def test_wire_is_strict(spark, amount):
    topic = spark.createDataFrame([(0, 0, f'{{"amount":{amount},"date":"2025-03-01T00:00:00Z"}}')], "partition_id bigint, offset bigint, value string")
    with pytest.raises(Exception, match=r"(?s)MALFORMED|malformed"):
        wire.decode(topic).collect()


def test_wire_defaults(spark):
    topic = spark.createDataFrame([(4, 9, '{"offset":1,"partition_id":2,"other":[],"date":"2025-03-01T23:59:59Z"}')], "partition_id bigint, offset bigint, value string")
    assert tuple(wire.decode(topic).head()) == (dt.date(2025, 3, 1), "", "", "", 0, 4, 9)
    with pytest.raises(Exception, match="without date"):
        wire.decode(topic.withColumn("value", F.lit("{}"))).collect()


def test_golden_write_and_report(spark, golden, tmp_path):
    sink = TokenSink(spark, f"file://{tmp_path}")
    for _ in range(2):
        sink.push(golden, bounds(spark, (1, 0, 5)))
    assert [tuple(r) for r in sink.tokens().collect()] == [(1, "transactions-insert-1-0-5")]
    assert [tuple(r) for r in sink.written().collect()] == [(1, 0, 5)]
    assert sink.transactions().agg(F.sum("amount")).head()[0] == 270
    got = sorted((r.date, r.user_id, r.product_id, r.amount, r.offset) for r in sink.reports().collect())
    assert got == [(D1, "user_1", "product1", 60, 2), (D1, "user_2", "product1", 60, 4), (D2, "user_1", "product2", 30, 1), (D2, "user_10", "product1", 70, 5), (D2, "user_2", "product1", 50, 3)]


def test_sink_refuses(spark, golden, tmp_path):
    sink = TokenSink(spark, f"file://{tmp_path}")
    sink.push(golden.limit(0), bounds(spark).limit(0))
    with pytest.raises(Rejected, match="greater"):
        sink.push(golden, bounds(spark, (1, 5, 0)))
    with pytest.raises(Exception, match="row outside its range"):
        sink.push(golden, bounds(spark, (1, 0, 4)))
    with pytest.raises(Exception, match="row outside its range"):
        sink.push(golden, bounds(spark, (2, 0, 5)))
    sink.push(golden, bounds(spark, (1, 0, 5)))
    with pytest.raises(Rejected, match="overlaps"):
        sink.push(golden.where("offset < 3"), bounds(spark, (1, 0, 2)))


def test_compaction_and_replay(spark, golden, tmp_path):
    sink = TokenSink(spark, f"file://{tmp_path}")
    low, high, later = golden.where("offset < 3"), golden.where("offset >= 3"), golden.withColumn("offset", F.col("offset") + 6)
    state = lambda: (sorted(map(tuple, sink.reports().drop("write_time").collect())), sorted(map(tuple, sink.transactions().drop("write_time").collect())))
    sink.push(low, bounds(spark, (1, 0, 2)))
    sink.push(high, bounds(spark, (1, 3, 5)))
    want = state()
    # the range in progress isn't folded
    assert sink.compact(spark.createDataFrame([(1, 3, 5, 1)], RANGES)) == 1
    assert state() == want
    # late replays, of what is folded and what isn't
    sink.push(low, bounds(spark, (1, 0, 2)))
    sink.push(high, bounds(spark, (1, 3, 5)))
    assert state() == want
    done = spark.createDataFrame([(1, 3, 5, 2)], RANGES)
    assert sink.compact(done) == 1
    assert state() == want
    assert sink.compact(done) == 0  # and the folders of what was folded are gone
    assert sink.tokens().count() == 0
    assert state() == want
    sink.push(low, bounds(spark, (1, 0, 2)))
    sink.push(later, bounds(spark, (1, 6, 11)))
    assert sink.transactions().count() == 12
    assert sink.reports().agg(F.sum("amount")).head()[0] == 540
    with pytest.raises(Rejected, match="overlaps"):
        sink.push(golden.where("offset < 2"), bounds(spark, (1, 0, 1)))
    assert [tuple(r) for r in sink.written().collect()] == [(1, 0, 11)]


def test_a_long_range_is_several_sorted_files(spark, golden, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr("rillmark.streaming.sink.FILE_OFFSETS", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        TokenSink(spark, f"file://{tmp_path}").push(golden, bounds(spark, (1, 0, 5)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{tmp_path}/main/transactions/partition_id=1/token=*/*.parquet")
    assert len(files) > 1
    for f in files:
        rows = [(r["offset"] // 2, r["date"], r["user_id"], r["offset"]) for r in pq.ParquetFile(f).read().to_pylist()]
        assert rows == sorted(rows)


def test_a_write_without_a_note_still_counts(spark, golden, tmp_path):
    """A crash between the write and the note of its end: another range may not overlap it, its own replay may."""
    sink = TokenSink(spark, f"file://{tmp_path}")
    sink.push(golden, bounds(spark, (1, 0, 5)))
    sink._note(1, [], [0, 5])
    with pytest.raises(Rejected, match="overlaps"):
        sink.push(golden.where("offset < 3"), bounds(spark, (1, 0, 2)))
    sink.push(golden, bounds(spark, (1, 0, 5)))
    assert sink.transactions().count() == 6


def test_ledger(spark, tmp_path):
    led = FileLedger(spark, f"file://{tmp_path}/ledger")
    assert led.get(3).state is State.UNKNOWN
    led.put(3, RangeState(0, 9, State.IN_PROGRESS))
    led.put(3, RangeState(0, 9, State.COMPLETED))
    led.put(4, RangeState(5, 6, State.IN_PROGRESS))
    (last, before) = sorted((tmp_path / "ledger" / "3").glob("[0-9]*"), reverse=True)
    assert last.stat().st_size == before.stat().st_size == 17
    assert sorted(map(tuple, led.frame().collect())) == [(3, 0, 9, 2), (4, 5, 6, 1)]
    assert [tuple(r) for r in led.frame([4, 9]).collect()] == [(4, 5, 6, 1)]
    assert start_offsets(led, {3: 0, 4: 0, 5: 8}) == {3: 10, 4: 5, 5: 8}
    # a file left by a crash before the rename is no record
    led.files.create(f"{led.root}/3/left.tmp", b"x")
    assert led.get(3) == RangeState(0, 9, State.COMPLETED)
    assert led.partitions() == [3, 4]
    old, new = led.claim(3), led.claim(3)
    with pytest.raises(Fenced):
        led.put(3, RangeState(10, 11, State.IN_PROGRESS), old)
    at = led.put(3, RangeState(10, 11, State.IN_PROGRESS), new)
    with pytest.raises(Fenced):  # of two that have seen the same record one is refused
        led.put(3, RangeState(12, 13, State.IN_PROGRESS), new)
    assert led.put(3, RangeState(10, 11, State.COMPLETED), at) == at + 1
    with pytest.raises(ValueError, match="partition 3"):
        led.put(3, RangeState(2, 1))
    assert led.claim(8) == 1 and led.get(8).state is State.UNKNOWN
    assert sorted(r.partition_id for r in led.frame().collect()) == [3, 4]
    led.clear()
    assert led.partitions() == []


def test_ledger_of_many_writers(spark, tmp_path):
    """Threads that swap one record: each epoch is one writer's."""
    from concurrent.futures import ThreadPoolExecutor

    led = FileLedger(spark, f"file://{tmp_path}/ledger")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: led.claim(1), range(12)))
    assert sorted(got) == list(range(1, 13))


def test_lease(spark, tmp_path):
    now = [0.0]
    make = lambda owner: FileLease(spark, f"file://{tmp_path}", owner, 10, lambda: now[0])
    a, b = make("a"), make("b")
    assert a.acquire(1)
    assert not b.acquire(1)
    assert b.acquire(2)
    now[0] = 8
    assert a.acquire(1)  # refreshed
    now[0] = 17
    assert not b.acquire(1)
    now[0] = 19
    assert b.acquire(1)
    assert b.holder(1) == "b"
    assert not a.acquire(1)
    b.release(1)
    assert a.holder(1) is None
    assert a.acquire(1)

    def sleep(s):
        now[0] += s

    assert b.wait(1, 60, 2, sleep)


def test_verify_planted(spark, golden):
    other = golden.where("offset < 4").union(golden.where("offset = 0")).union(spark.createDataFrame([(D1, "stranger", "u", "p", 5, 1, 9)] * 2, TX))
    other = other.withColumn("amount", F.when(F.col("offset") == 3, 51).otherwise(F.col("amount")))
    got = verify.summary(verify.compare(golden, other)).head().asDict()
    assert got == {"missing": 2, "duplicates": 2, "unexpected": 1, "corrupted": 1, "produced_sum": 270, "stored_sum": 171, "missing_min": "transaction_5", "missing_max": "transaction_6"}
    assert verify.summary(verify.compare(golden, golden)).head().missing == 0
    checks = {r.check: r.ok for r in verify.invariants(golden, reports.partials(golden), verify.totals(golden)).collect()}
    assert checks == dict.fromkeys(("loss", "double_write", "raw_sum", "double_count"), True)
    checks = {r.check: r.ok for r in verify.invariants(other, reports.partials(golden), verify.totals(golden)).collect()}
    assert checks == {"loss": False, "double_write": False, "raw_sum": False, "double_count": True}


def test_generators(spark):
    assert generate.distribution(spark, 100_000, 500).agg(F.sum("amount"), F.max("amount") <= 500).head()[:] == (100_000, True)
    assert generate.distribution(spark, 3, 1000).agg(F.sum("amount")).head()[0] == 3
    assert generate.distribution(spark, 0, 10).count() == 0
    d = generate.dataset(spark, 200)
    assert d.agg(F.count_distinct("transaction_id"), F.min("amount") >= 1, F.max("amount") <= 500).head()[:] == (200, True, True)
    made = generate.history(spark, dt.date(2025, 3, 1), dt.date(2025, 3, 3), 4000, 1000, 300)
    assert sorted(map(tuple, made.groupBy("pass", "date").agg(F.sum("amount")).collect())) == [(p, dt.date(2025, 3, d), 1000) for p in (0, 1) for d in (1, 2)]
    assert made.count() == made.select("transaction_id").distinct().count()
    assert generate.history(spark, dt.date(2025, 3, 1), dt.date(2025, 3, 1), 4000).count() == 0
    assert [r.date.day for r in generate.days(spark, dt.date(2025, 3, 1), dt.date(2025, 3, 3)).collect()] == [1, 2]


def test_offsets_over_chunks(spark):
    rows = spark.createDataFrame([(i % 3, i * 7) for i in range(100)], "p bigint, k bigint")
    got = with_offsets(rows, "p", "k", chunk=50).orderBy("p", "k").collect()
    for p in range(3):
        assert [r.offset for r in got if r.p == p] == list(range(len([r for r in got if r.p == p])))


def test_sql_files(spark):
    assert tables._statements("a;  ; b -- c; d\n ; 'x;y'") == ["a", "b", "'x;y'"]
    tables.reset(spark)
    spark.sql("INSERT INTO transactions PARTITION (token='t') VALUES (date'2020-01-01','a','u','p',5L,0L,0L,now()), (date'2020-01-01','b','u','p',6L,1L,3L,now())")
    assert spark.table("reports_mv").count() == 2
    assert spark.table("transactions_d").agg(F.sum("amount")).head()[0] == 11
    assert tables.all_transactions(spark.table("transactions_d")).count() == 2
    tables.reset(spark)
    assert spark.table("transactions").count() == 0
    tables.drop(spark)


def test_shards_hold_whole_partitions(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("p"))
    assert rows.select("p", S.shard(F.col("p")).alias("s")).distinct().count() == 7


def test_latest(spark):
    h = spark.createDataFrame([(1, 0, 5, 1, 1), (1, 0, 5, 2, 2), (2, 0, 3, 1, 3)], RANGES + ", seq bigint")
    assert sorted(map(tuple, R.latest(h).collect())) == [(1, 0, 5, 2), (2, 0, 3, 1)]


def test_scalars_and_waiting(spark, golden):
    left, slept = [1, 1], []

    def broken():
        if left:
            left.pop()
            raise OSError("away")
        return golden.agg(F.sum("amount"))

    assert verify.scalar(broken, sleep=slept.append) == 270
    assert slept == [1.0, 1.0]
    left += [1] * 5
    with pytest.raises(OSError, match="away"):
        verify.scalar(broken, sleep=slept.append)
    parts, now = [2, 6, 6], [0.0]
    stored = lambda: golden.where(F.col("offset") < parts[0])

    def sleep(s):
        now[0] += s
        del parts[0]

    assert verify.wait_for_distinct(stored, 6, sleep=sleep, clock=lambda: now[0]) == 6
    with pytest.raises(TimeoutError, match="2 of 6"):
        verify.wait_for_distinct(lambda: golden.limit(2), 6, 3, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])


def test_settings(spark, tmp_path):
    from rillmark.config import Settings
    from rillmark.streaming import job

    env = {"RILLMARK_LEDGER": f"file://{tmp_path}/l", "RILLMARK_TABLES": f"file://{tmp_path}/t", "RILLMARK_LEASES": f"file://{tmp_path}/s", "RILLMARK_BATCH_SIZE": "7", "RILLMARK_OWNER": "me", "RILLMARK_STREAM": ""}
    s = Settings.from_env(env)
    assert (s.batch_size, s.owner, s.stream, s.lease_ttl) == (7, "me", "main", 120.0)
    with pytest.raises(ValueError, match="RILLMARK_BATCH_SIZE"):
        Settings.from_env(env | {"RILLMARK_BATCH_SIZE": "x"})
    with pytest.raises(ValueError, match="positive"):
        Settings.from_env(env | {"RILLMARK_LEASE_TTL": "0"})
    made = job.build(spark, s)
    assert made.lease.owner == "me" and made.budget == 60.0
    made.ledger.put(1, RangeState(0, 3, State.COMPLETED))
    assert made.lease.acquire(1)
    job.reset(spark, s)
    assert made.ledger.get(1).state is State.UNKNOWN and made.lease.holder(1) is None
    with pytest.raises(ValueError, match="tables"):
        job.build(spark, Settings(ledger="x"))


def test_in_order(spark, golden):
    got = R.in_order(R.merge_pending(golden.where("offset > 2"), golden)).collect()
    assert [r.offset for r in got] == list(range(6))
