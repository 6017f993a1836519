"""Who is there, and which snapshots may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(seen: DataFrame, now: DataFrame, ttl: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Rows of ``seen`` (updated_at) not older than ``ttl`` at ``now`` (one row); a clock ahead counts as live."""
    return seen.join(F.broadcast(now)).where(F.expr(f"now - updated_at <= {ttl}")).drop("now")


def superseded(versions: DataFrame, pointers: DataFrame, key: str, made: str, now: DataFrame, grace: str = "INTERVAL 1 DAY") -> DataFrame:
    """Versions that no pointer names and that are older than ``grace``."""
    old = versions.join(F.broadcast(now)).where(F.expr(f"{made} < now - {grace}")).drop("now")
    return old.join(pointers, key, "left_anti")


def intents(lines: DataFrame, fleet: str) -> DataFrame:
    """Intents of a fleet from JSON lines (key, value): its own by what the body says, not by the key; malformed lines are skipped."""
    fields = "fleet_id string, agent_id string, updated_at string, _corrupt string"
    e = lines.select("key", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return e.where((F.col("e.fleet_id") == fleet) & F.col("e._corrupt").isNull() & F.col("e.agent_id").isNotNull()).select("key", "e.*").drop("_corrupt")


def roster(seen: DataFrame) -> DataFrame:
    """One row an agent: when it was last seen and how many intents it has."""
    return seen.groupBy("agent_id").agg(F.max("updated_at").alias("updated_at"), F.count("*").alias("intents"))
