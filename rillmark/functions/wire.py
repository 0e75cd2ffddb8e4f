"""Messages: JSON encoding and strict decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.model import WIRE


def encode(df: DataFrame) -> DataFrame:
    """Topic rows (partition_id, offset, value) of transactions. Amounts stay integers in the text."""
    payload = F.struct("transaction_id", "user_id", "product_id", F.col("amount").cast("bigint").alias("amount"), F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    return df.select("partition_id", "offset", F.to_json(payload).alias("value"))


def parsed(value: Column) -> Column:
    """The payload as a struct. Garbage, a wrong type, a fraction, an amount beyond 64 bits or a literal null fails
    the query, as one message that can't be read makes the whole range unsafe."""
    return F.from_json(value, WIRE, {"mode": "FAILFAST"})


def decode(topic: DataFrame) -> DataFrame:
    """Transactions of topic rows. Missing strings are empty and a missing amount is 0; a missing date is refused.

    partition_id and offset are the topic's own, whatever the payload says.
    """
    p = topic.select("partition_id", "offset", parsed(F.col("value")).alias("m"))
    date = F.coalesce(F.to_date("m.date"), F.raise_error(F.concat(F.lit("message without date at offset "), F.col("offset").cast("string"))).cast("date"))
    return p.select(
        date.alias("date"),
        F.coalesce("m.transaction_id", F.lit("")).alias("transaction_id"),
        F.coalesce("m.user_id", F.lit("")).alias("user_id"),
        F.coalesce("m.product_id", F.lit("")).alias("product_id"),
        F.coalesce("m.amount", F.lit(0).cast("bigint")).alias("amount"),
        F.col("partition_id").cast("bigint").alias("partition_id"),
        F.col("offset").cast("bigint").alias("offset"),
    )
