"""History import: identity of an event, and the ones that are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import content_hash


def dedup_key(runtime: str, session: str, event_type: str, at: str, message: Column | str, hashed: str, input_hash: str) -> Column:
    """Hash of seven NUL-parted fields; nulls are empty, the event type stands in quotes."""
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    quoted = F.concat(F.lit('"'), col(event_type), F.lit('"'))
    return content_hash(F.concat_ws("\x00", col(runtime), col(session), quoted, col(at), col(message), col(hashed), col(input_hash)))


def accepted(events: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Events once each by ``key``, without those that the ledger has."""
    return events.dropDuplicates(key).join(ledger.select(*key).distinct(), key, "left_anti")


def counts(rows: DataFrame, by: str) -> DataFrame:
    """What an import saw, skipped (rows with a ``problem``) and wrote, and in how many sessions."""
    fine = F.col("problem").isNull()
    return rows.groupBy(by).agg(F.count("*").alias("seen"), F.count_if(~fine).alias("skipped"), F.count_if(fine).alias("written"), F.count_distinct("session_id").alias("sessions"))
