"""Tables and SQL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.model import REPORTS, TRANSACTIONS

#: What reset() drops, views first.
DROPPED = [("VIEW", "reports_d"), ("VIEW", "reports_mv"), ("TABLE", "reports"), ("VIEW", "transactions_d"), ("TABLE", "transactions")]


def schema_sql() -> str:
    """Tables for raw rows and report partials, both kept by write token, and the views over them."""
    return f"""
        CREATE TABLE IF NOT EXISTS transactions ({_columns(TRANSACTIONS)}, token STRING) USING parquet PARTITIONED BY (token);
        CREATE TABLE IF NOT EXISTS reports ({_columns(REPORTS)}, token STRING) USING parquet PARTITIONED BY (token);
        CREATE OR REPLACE VIEW transactions_d AS SELECT date, transaction_id, user_id, product_id, amount, partition_id, `offset`, write_time FROM transactions;
        CREATE OR REPLACE VIEW reports_mv AS
            SELECT date, user_id, product_id, partition_id, sum(amount) AS amount, max(`offset`) AS `offset`, max(write_time) AS write_time
            FROM transactions GROUP BY ALL;
        CREATE OR REPLACE VIEW reports_d AS
            SELECT date, user_id, product_id, sum(amount) AS amount, max(`offset`) AS `offset`, max(write_time) AS write_time
            FROM reports GROUP BY date, user_id, product_id
    """


def _columns(schema: str) -> str:
    return ", ".join("`{}` {}".format(*c.split(" ")) for c in schema.split(", "))


def run_sql(spark: SparkSession, text: str) -> list[DataFrame]:
    """Runs the statements of a SQL file, which end in semicolons; empty ones and comment lines are passed over."""
    out = []
    for statement in _statements(text):
        out.append(spark.sql(statement))
    return out


def _statements(text: str) -> list[str]:
    """Splits at semicolons outside quotes and comments."""
    found, now, quote, i = [], [], "", 0
    while i < len(text):
        c = text[i]
        if quote:
            now.append(c)
            if c == quote:
                quote = ""
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            now.append("\n")
        elif c == ";":
            found.append("".join(now))
            now = []
        else:
            quote = c if c in "'\"`" else ""
            now.append(c)
        i += 1
    return [s.strip() for s in [*found, "".join(now)] if s.strip()]


def create(spark: SparkSession) -> None:
    run_sql(spark, schema_sql())


def drop(spark: SparkSession) -> None:
    for kind, name in DROPPED:
        spark.sql(f"DROP {kind} IF EXISTS {name}")


def reset(spark: SparkSession) -> None:
    drop(spark)
    create(spark)


def all_transactions(transactions: DataFrame) -> DataFrame:
    """The five columns that reconciliation compares."""
    return transactions.select("transaction_id", "user_id", "product_id", "amount", "date")
