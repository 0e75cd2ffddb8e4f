"""The registered queries and their SQL.

All run over the canonical stream of the events table (rillmark.model.canonical).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import state as S
from rillmark.functions import wire
from rillmark.model import BATCH_SIZE, RANGES, State, canonical, events, state_name
from rillmark.operators import generate, reports, verify
from rillmark.operators import ranges as R
from rillmark.sources import topic
from rillmark.sources.tables import all_transactions, run_sql
from rillmark.streaming.ingest import Ingest
from rillmark.streaming.ledger import FileLedger
from rillmark.streaming.sink import TokenSink
from rillmark.workspace import new_path

#: The ledger that queries hold the stream against: partition 0 completed, 1 in progress, 2 unknown.
LEDGER = [(0, 1000, 1999, 2), (1, 500, 999, 1)]

#: Batches that a stream is cut into, if messages of a partition in each are within these bounds.
BATCHES, BATCH_MESSAGES = 3, (1 << 14, 1 << 20)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _WITH + sql
        return f

    return put


_WITH = """WITH tx AS (
  SELECT CAST(ts AS DATE) AS "date", 'tx-' || CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id,
         event_type AS product_id, CAST(round(value * 100) AS BIGINT) AS amount, CAST(event_id % 3 AS BIGINT) AS partition_id,
         CAST(row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS BIGINT) AS "offset", event_id
  FROM events),
ledger AS (SELECT CAST(0 AS BIGINT) AS partition_id, CAST(1000 AS BIGINT) AS stored_min, CAST(1999 AS BIGINT) AS stored_max, 2 AS stored_state
           UNION ALL SELECT 1, 500, 999, 1),
ranges AS (SELECT partition_id, CAST(floor("offset" / 1000) AS BIGINT) AS batch, min("offset") AS min_offset, max("offset") AS max_offset,
                  count(*) AS n, count(DISTINCT "offset") AS n_distinct
           FROM tx GROUP BY 1, 2),
produced AS (SELECT * FROM tx WHERE event_id % 100 <> 21),
stored AS (SELECT "date", transaction_id, user_id, product_id, CASE WHEN event_id % 100 = 34 THEN amount + 1 ELSE amount END AS amount,
                  partition_id, "offset" FROM tx WHERE event_id % 100 <> 7
           UNION ALL
           SELECT "date", transaction_id, user_id, product_id, amount, partition_id, "offset" + 1000000 FROM tx WHERE event_id % 100 = 13)
"""


def _ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEDGER, RANGES)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of the batches of BATCH_SIZE messages."""
    cut = canonical(spark, sf_dir).withColumn("batch", F.floor(F.col("offset") / BATCH_SIZE).cast("bigint"))
    return R.range_state(cut, "partition_id", "batch")


# raw rows and totals


@query('SELECT "date", transaction_id, user_id, product_id, amount, partition_id, "offset" FROM tx')
def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir)


@query('SELECT transaction_id, user_id, product_id, amount, "date" FROM tx')
def full_row_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_transactions(events(spark, sf_dir))


@query("SELECT count(*) AS row_count FROM tx")
def raw_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"))


@query("SELECT count(DISTINCT transaction_id) AS distinct_ids FROM tx")
def distinct_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count_distinct("transaction_id").alias("distinct_ids"))


@query("SELECT CAST(sum(amount) AS BIGINT) AS total FROM tx")
def raw_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.sum("amount").alias("total"))


@query("SELECT CAST(sum(amount) AS BIGINT) AS total FROM (SELECT sum(amount) AS amount FROM tx GROUP BY \"date\", user_id, product_id) r")
def reports_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merged(reports.partials(events(spark, sf_dir))).agg(F.sum("amount").alias("total"))


@query("SELECT count(*) AS row_count, CAST(sum(amount) AS BIGINT) AS total FROM tx")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.totals(events(spark, sf_dir))


# reports


@query('SELECT "date", user_id, product_id, partition_id, CAST(sum(amount) AS BIGINT) AS amount, max("offset") AS "offset" FROM tx GROUP BY 1, 2, 3, 4')
def reports_mv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.partials(canonical(spark, sf_dir))


@query('SELECT "date", user_id, product_id, CAST(sum(amount) AS BIGINT) AS amount, max("offset") AS "offset" FROM tx GROUP BY 1, 2, 3')
def reports_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merged(reports.partials(canonical(spark, sf_dir)))


def _by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report without offsets, which no period asks for."""
    return reports.merged(reports.partials(events(spark, sf_dir)))


def _rollup_sql(unit: str) -> str:
    return f'SELECT CAST(date_trunc(\'{unit}\', "date") AS DATE) AS period, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS "rows" FROM (SELECT "date", sum(amount) AS amount FROM tx GROUP BY "date", user_id, product_id) r GROUP BY 1'


@query(_rollup_sql("day"))
def reports_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(_by_key(spark, sf_dir), "day")


@query(_rollup_sql("week"))
def reports_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(_by_key(spark, sf_dir), "week")


@query(_rollup_sql("month"))
def reports_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(_by_key(spark, sf_dir), "month")


# wire and records


@query('SELECT "date", transaction_id, user_id, product_id, amount, partition_id, "offset" FROM tx')
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.decode(wire.encode(canonical(spark, sf_dir)))


@query("SELECT partition_id, batch, 'transactions-insert-' || CAST(partition_id AS VARCHAR) || '-' || CAST(min_offset AS VARCHAR) || '-' || CAST(max_offset AS VARCHAR) AS token, n FROM ranges")
def insert_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select("partition_id", "batch", S.insert_token(F.col("partition_id"), F.col("min_offset"), F.col("max_offset")).alias("token"), "n")


@query("SELECT partition_id, batch, lpad(hex(min_offset), 16, '0') || lpad(hex(max_offset), 16, '0') || '01' AS record, min_offset, max_offset, 1 AS state FROM ranges")
def state_codec_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = batches(spark, sf_dir).select("partition_id", "batch", S.record(F.col("min_offset"), F.col("max_offset"), F.col("state")).alias("r"))
    back = S.unrecord(F.col("r"))
    return coded.select("partition_id", "batch", F.hex("r").alias("record"), back["min_offset"].alias("min_offset"), back["max_offset"].alias("max_offset"), back["state"].cast("int").alias("state"))


@query('SELECT partition_id, count(*) AS "rows", CAST(1 AS BIGINT) AS shards, true AS within FROM tx GROUP BY 1')
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds whatever the hash is: each partition lies whole in one of the shards."""
    rows = events(spark, sf_dir).select("partition_id", S.shard(F.col("partition_id")).alias("shard"))
    return rows.groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shard").alias("shards"), F.min("shard").between(0, 1).alias("within"))


@query("""SELECT 'tx-' || CAST(event_id AS VARCHAR) AS transaction_id, CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOUR AS DATE) AS same FROM events""")
def same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message's day is still the same six hours later."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return rows.select(F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("transaction_id"), S.same_day(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("same"))


@query("SELECT partition_id, batch, CASE WHEN partition_id = 0 THEN 'UNKNOWN' WHEN partition_id = 1 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS name FROM ranges")
def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select("partition_id", "batch", state_name(F.col("partition_id").cast("tinyint")).alias("name"))


@query("SELECT product_id, CAST(sum(amount) AS BIGINT) AS total, true AS named FROM tx GROUP BY 1")
def sql_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of statements: a comment, a view, and a query over it that tells whether the database has a name."""
    events(spark, sf_dir).createOrReplaceTempView("tx_of_file")
    text = """-- totals; by product
        CREATE OR REPLACE TEMP VIEW totals_of_file AS SELECT product_id, sum(amount) AS total FROM tx_of_file GROUP BY product_id;
        SELECT product_id, total, length(current_database()) > 0 AS named FROM totals_of_file;
    """
    return run_sql(spark, text)[-1]


# offset ranges


@query("SELECT partition_id, batch, min_offset, max_offset, n, n_distinct, 1 AS state FROM ranges")
def range_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).withColumn("state", F.col("state").cast("int"))


@query(
    """SELECT tx.partition_id, "offset", CASE WHEN stored_min IS NULL THEN 'NEW' WHEN "offset" < stored_min THEN 'SKIP'
       WHEN "offset" <= stored_max THEN 'OLD' ELSE 'NEW' END AS class FROM tx LEFT JOIN ledger ON tx.partition_id = ledger.partition_id"""
)
def range_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classify(canonical(spark, sf_dir), _ledger(spark)).select("partition_id", "offset", "class")


@query(
    """SELECT ranges.partition_id, batch, CASE WHEN stored_min IS NULL OR min_offset < stored_min OR max_offset > stored_max
       THEN 'not contained in the stored range' WHEN n <> max_offset - min_offset + 1 OR n_distinct <> n THEN 'not contiguous' END AS error
       FROM ranges LEFT JOIN ledger ON ranges.partition_id = ledger.partition_id"""
)
def validate_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate_old(batches(spark, sf_dir), _ledger(spark)).select("partition_id", "batch", "error")


@query(
    """SELECT ranges.partition_id, batch, CASE WHEN stored_max IS NOT NULL AND min_offset <> stored_max + 1 THEN 'does not follow the stored range'
       WHEN n <> max_offset - min_offset + 1 OR n_distinct <> n THEN 'not contiguous'
       WHEN stored_state = 1 THEN 'the stored range is still in progress' END AS error
       FROM ranges LEFT JOIN ledger ON ranges.partition_id = ledger.partition_id"""
)
def validate_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate_new(batches(spark, sf_dir), _ledger(spark)).select("partition_id", "batch", "error")


@query("""SELECT partition_id, "offset", CASE WHEN "offset" % 1000 < 600 THEN amount ELSE amount + 1 END AS amount FROM tx""")
def merge_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream: of each batch the first 600 offsets are pending, and those from 400 on incoming."""
    rows = canonical(spark, sf_dir).select("partition_id", "offset", "amount")
    place = F.col("offset") % BATCH_SIZE
    later = rows.where(place >= 400).withColumn("amount", F.col("amount") + 1)
    return R.merge_pending(rows.where(place < 600), later)


@query("""SELECT partition_id, step, step = 2 AS covers FROM (SELECT partition_id, unnest([0, 1, 2]) AS step FROM tx GROUP BY 1) q""")
def accumulate_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's whole range is in progress and comes again in three parts, which overlap: whole only after the last."""
    rows = canonical(spark, sf_dir).select("partition_id", "offset", "amount")
    stored = R.range_state(rows).select("partition_id", "min_offset", "max_offset", "state")
    held, place, seen = rows.limit(0), F.col("offset") % 10, None
    for step, part in enumerate((place < 5, place.between(3, 8), place >= 7)):
        held, now = R.accumulate(held, rows.where(part), stored)
        now = now.select("partition_id", F.lit(step).alias("step"), "covers")
        seen = now if seen is None else seen.unionByName(now)
    return seen


@query(
    """SELECT ranges.partition_id, batch, coalesce(min_offset = stored_min AND max_offset = stored_max AND n = max_offset - min_offset + 1 AND n_distinct = n, false) AS covers
       FROM ranges LEFT JOIN ledger ON ranges.partition_id = ledger.partition_id"""
)
def covers_full_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.covers_full_range(batches(spark, sf_dir), _ledger(spark)).select("partition_id", "batch", "covers")


@query(
    """SELECT t.partition_id, CAST(CASE WHEN stored_state = 2 THEN stored_max + 1 WHEN stored_state = 1 THEN stored_min ELSE committed END AS BIGINT) AS start_offset
       FROM (SELECT partition_id, max("offset") AS committed FROM tx GROUP BY 1) t LEFT JOIN ledger ON t.partition_id = ledger.partition_id"""
)
def start_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = canonical(spark, sf_dir).groupBy("partition_id").agg(F.max("offset").alias("committed"))
    return R.start_offset(parts, _ledger(spark)).select("partition_id", F.col("start_offset").cast("bigint").alias("start_offset"))


@query("SELECT partition_id, min_offset, max_offset, 1 AS state FROM (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY batch DESC) AS r FROM ranges) q WHERE r = 1")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(batches(spark, sf_dir), "batch").withColumn("state", F.col("state").cast("int"))


@query(
    """SELECT a.partition_id, a.min_offset, a.max_offset, min(w.min_offset) AS written_min, min(w.max_offset) AS written_max
       FROM (SELECT partition_id, min_offset + 250 AS min_offset, max_offset + 250 AS max_offset FROM ranges) a
       JOIN ranges w ON a.partition_id = w.partition_id AND w.min_offset <= a.max_offset AND w.max_offset >= a.min_offset GROUP BY 1, 2, 3"""
)
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of all batches, moved, against those of all batches as written."""
    written = batches(spark, sf_dir)
    return R.overlaps(written.withColumns({"min_offset": F.col("min_offset") + 250, "max_offset": F.col("max_offset") + 250}), written)


# verification


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was produced, and a store of it with losses, copies, strangers and changed amounts."""
    tx = canonical(spark, sf_dir).withColumn("e", F.substring("transaction_id", 4, 20).cast("bigint") % 100)
    changed = tx.where("e <> 7").withColumn("amount", F.when(F.col("e") == 34, F.col("amount") + 1).otherwise(F.col("amount")))
    again = tx.where("e = 13").withColumn("offset", F.col("offset") + 1000000)
    return tx.where("e <> 21").drop("e"), changed.unionByName(again).drop("e")


_COMPARED = """, have AS (SELECT transaction_id, count(*) AS copies, CAST(sum(amount) AS BIGINT) AS stored_amount, CAST(min(amount) AS BIGINT) AS one FROM stored GROUP BY 1),
both_sides AS (SELECT coalesce(p.transaction_id, h.transaction_id) AS transaction_id, p.transaction_id IS NOT NULL AS produced, coalesce(copies, 0) AS copies,
                      p.amount AS produced_amount, stored_amount, p.transaction_id IS NOT NULL AND one IS NOT NULL AND one <> p.amount AS differs
               FROM produced p FULL JOIN have h ON p.transaction_id = h.transaction_id)
"""


@query(
    """, s AS (SELECT count(DISTINCT transaction_id) AS d, count(*) AS n, CAST(sum(amount) AS BIGINT) AS t FROM stored),
       p AS (SELECT count(*) AS n, CAST(sum(amount) AS BIGINT) AS t FROM produced),
       r AS (SELECT 'loss' AS "check", s.d AS actual, p.n AS expected FROM s, p UNION ALL SELECT 'double_write', s.n, p.n FROM s, p
             UNION ALL SELECT 'raw_sum', s.t, p.t FROM s, p UNION ALL SELECT 'double_count', s.t, p.t FROM s, p)
       SELECT "check", actual, expected, actual = expected AS ok FROM r"""
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    produced, stored = _sides(spark, sf_dir)
    return verify.invariants(stored, reports.partials(stored), verify.totals(produced))


@query(
    _COMPARED
    + """SELECT count(CASE WHEN produced AND copies = 0 THEN 1 END) AS missing, CAST(sum(CASE WHEN copies > 1 THEN copies - 1 ELSE 0 END) AS BIGINT) AS duplicates,
         count(CASE WHEN NOT produced THEN 1 END) AS unexpected, count(CASE WHEN differs THEN 1 END) AS corrupted,
         CAST(sum(produced_amount) AS BIGINT) AS produced_sum, CAST(sum(stored_amount) AS BIGINT) AS stored_sum,
         min(CASE WHEN produced AND copies = 0 THEN transaction_id END) AS missing_min, max(CASE WHEN produced AND copies = 0 THEN transaction_id END) AS missing_max FROM both_sides"""
)
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.summary(verify.compare(*_sides(spark, sf_dir)))


@query("SELECT transaction_id FROM produced WHERE transaction_id NOT IN (SELECT transaction_id FROM stored)")
def missing_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.missing(*_sides(spark, sf_dir))


@query("SELECT min(transaction_id) AS missing_min, max(transaction_id) AS missing_max FROM produced WHERE transaction_id NOT IN (SELECT transaction_id FROM stored)")
def missing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.missing(*_sides(spark, sf_dir)).agg(F.min("transaction_id").alias("missing_min"), F.max("transaction_id").alias("missing_max"))


@query("SELECT transaction_id FROM produced WHERE transaction_id NOT IN (SELECT transaction_id FROM stored) ORDER BY transaction_id LIMIT 10")
def missing_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.examples(verify.missing(*_sides(spark, sf_dir)))


@query("SELECT DISTINCT transaction_id FROM stored WHERE transaction_id NOT IN (SELECT transaction_id FROM produced)")
def unexpected_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.unexpected(*_sides(spark, sf_dir))


@query("SELECT transaction_id, count(*) AS copies FROM stored GROUP BY 1 HAVING count(*) > 1")
def duplicate_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicates(_sides(spark, sf_dir)[1])


@query(_COMPARED + "SELECT transaction_id, produced_amount, stored_amount FROM both_sides WHERE differs")
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.field_diff(*_sides(spark, sf_dir))


# writes and streams

_BY_PARTITION = 'SELECT partition_id, count(*) AS "rows", CAST(sum(amount) AS BIGINT) AS total, max("offset") AS last_offset FROM tx GROUP BY 1'


def _by_partition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total"), F.max("offset").alias("last_offset"))


@query(_BY_PARTITION)
def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream is written twice under its ranges' tokens and read back."""
    sink = TokenSink(spark, new_path(spark, "sink"))
    rows = canonical(spark, sf_dir)
    whole = R.range_state(rows)
    for _ in range(2):
        sink.push(rows, whole)
    return _by_partition(sink.transactions())


@query('SELECT "date", user_id, product_id, CAST(sum(amount) AS BIGINT) AS amount, max("offset") AS "offset" FROM tx GROUP BY 1, 2, 3')
def replay_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports after a write, a compaction and a replay of the write."""
    sink = TokenSink(spark, new_path(spark, "sink"))
    rows = canonical(spark, sf_dir)
    whole = R.range_state(rows)
    sink.push(rows, whole)
    sink.compact(whole.select("partition_id", "min_offset", "max_offset", F.lit(State.COMPLETED.value).cast("tinyint").alias("state")))
    sink.push(rows, whole)
    return sink.reports().drop("write_time")


@query(_BY_PARTITION)
def ingest_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream as one batch of messages, and the same batch again after it is COMPLETED; then an empty one."""
    root = new_path(spark, "ingest")
    sink = TokenSink(spark, f"{root}/tables")
    job = Ingest(spark, FileLedger(spark, f"{root}/ledger"), sink)
    messages = wire.encode(canonical(spark, sf_dir))
    for part in (messages, messages, messages.limit(0)):
        job.batch(part)
    return _by_partition(sink.transactions())


class _Crash(RuntimeError):
    pass


@query(_BY_PARTITION)
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream goes through a topic log; its first batch crashes after the write, and the restart replays it."""
    root = new_path(spark, "stream")
    log = topic.local(root) + "/topic"
    topic.produce(wire.encode(canonical(spark, sf_dir)), log)
    ledger, sink = FileLedger(spark, f"{root}/ledger"), TokenSink(spark, f"{root}/tables")
    left = ["after write"]

    def crash(step: str) -> None:
        if step in left:
            left.remove(step)
            raise _Crash(step)

    job = Ingest(spark, ledger, sink, crash)
    most = topic.batch_messages(log, BATCHES, *BATCH_MESSAGES)
    try:
        job.catch_up(log, f"{root}/checkpoint", most)
    except Exception as e:  # Spark wraps what the batch raised
        if left or "_Crash" not in str(e):
            raise
    job.catch_up(log, f"{root}/checkpoint", most)
    return _by_partition(sink.transactions())


# generators


@query("SELECT 1000000 AS total, true AS within")
def generator_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate.distribution(spark, 1_000_000, 500)
    return made.agg(F.sum("amount").cast("int").alias("total"), (F.min("amount").between(0, 500) & F.max("amount").between(0, 500)).alias("within"))


@query("SELECT CAST(p AS BIGINT) AS pass, CAST(d AS DATE) AS \"date\", CAST(CASE WHEN p = 2 AND d = DATE '2025-03-02' THEN 7 ELSE 20000 END AS BIGINT) AS total, true AS within FROM (SELECT unnest([0, 0, 1, 1, 2, 2]) AS p, unnest([DATE '2025-03-01', DATE '2025-03-02', DATE '2025-03-01', DATE '2025-03-02', DATE '2025-03-01', DATE '2025-03-02']) AS d) q")
def generator_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over two days until the total is reached."""
    made = generate.history(spark, date(2025, 3, 1), date(2025, 3, 3), 100_007, 20_000, 500)
    return made.groupBy("pass", "date").agg(F.sum("amount").alias("total"), (F.min("amount").between(0, 500) & F.max("amount").between(0, 500)).alias("within"))


@query("SELECT 1000 AS rows_made, 1000 AS ids, true AS within")
def generator_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate.dataset(spark, 1000)
    return made.agg(F.count(F.lit(1)).cast("int").alias("rows_made"), F.count_distinct("transaction_id").cast("int").alias("ids"), (F.min("amount").between(1, 500) & F.max("amount").between(1, 500)).alias("within"))


@query("SELECT CAST(d AS DATE) AS \"date\" FROM (SELECT unnest(generate_series(DATE '2025-03-01', DATE '2025-03-31', INTERVAL 1 DAY)) AS d) q")
def generator_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.days(spark, date(2025, 3, 1), date(2025, 4, 1))


def _loaded() -> None:
    """The modules that register more queries on top of this one."""
    from rillmark.plans import ordered, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
