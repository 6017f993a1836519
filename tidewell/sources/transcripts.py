"""Transcript files (one JSON record a line) as outcomes of tool calls and usage of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import edited_paths

_LINE = (
    "gitBranch string, toolUseResult struct<stdout: string, stderr: string, filePath: string, content: string>, "
    "message struct<content: array<struct<type: string, tool_use_id: string, is_error: boolean>>, usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>"
)


def outcomes(lines: DataFrame) -> DataFrame:
    """session_id, message_id, result, exit_code, paths of each tool result in lines (session_id, n, value); paths are all that it says it edited."""
    j = lines.withColumn("j", F.from_json("value", _LINE)).where("j is not null")
    item = j.select("session_id", "n", "j.toolUseResult", edited_paths(F.get_json_object("value", "$.toolUseResult")).alias("paths"), F.explode("j.message.content").alias("c")).where("c.type = 'tool_result' and c.tool_use_id is not null")
    text = F.nullif(F.concat_ws("\n", F.nullif("toolUseResult.stdout", F.lit("")), F.nullif("toolUseResult.stderr", F.lit("")), F.nullif("toolUseResult.content", F.lit(""))), F.lit(""))
    row = F.struct("n", text.alias("result"), F.when(F.col("c.is_error"), 1).otherwise(0).cast("long").alias("exit_code"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
    return item.groupBy("session_id", F.col("c.tool_use_id").alias("message_id")).agg(F.max(row).alias("x")).select("session_id", "message_id", "x.result", "x.exit_code", "x.paths")


def usage(lines: DataFrame) -> DataFrame:
    """session_id, token sums, and the first branch that is not empty."""
    j = lines.withColumn("j", F.from_json("value", _LINE)).where("j is not null")
    total = lambda f, c: F.coalesce(F.sum(f"j.message.usage.{f}"), F.lit(0)).cast("long").alias(c)
    branch = F.min(F.when(F.col("j.gitBranch") != "", F.struct("n", F.col("j.gitBranch").alias("b"))))
    return j.groupBy("session_id").agg(total("input_tokens", "input_tokens"), total("output_tokens", "output_tokens"), total("cache_read_input_tokens", "cache_read_tokens"), total("cache_creation_input_tokens", "cache_write_tokens"), branch.alias("f")).withColumn("branch", F.col("f.b")).drop("f")
