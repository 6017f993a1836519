"""Numbered records in a folder of a shared store: each number is taken once, by whoever creates it first."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import SparkSession

#: Last key of a complete record; one that is cut short has none.
END = "end"
#: Seconds after which a record that is not complete is its dead writer's, and passed over.
GRACE = 30.0


def store_of(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of ``path`` and its path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = store_of(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that are taken, ascending, whether their records are complete or not."""
    fs, at = store_of(spark, f"{folder}/*.json")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.globStatus(at) or [])


def record(spark: SparkSession, folder: str, number: int) -> dict | None:
    """A record's body, None where its writer has not finished or has died."""
    fs, at = store_of(spark, f"{folder}/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    try:
        body = json.loads(text)
    except ValueError:
        return None
    return body if body.pop(END, None) else None


def newest(spark: SparkSession, folder: str) -> tuple[int, int, dict | None]:
    """The greatest number that is taken, and number and body of the last complete record (0 and None if there is none).

    A record that is being written is waited for, so that who takes the next number has read the last one.
    """
    taken = numbers(spark, folder)
    for number in reversed(taken):
        while (body := record(spark, folder, number)) is None:
            fs, at = store_of(spark, f"{folder}/{number:012d}.json")
            if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > GRACE:
                break
            time.sleep(0.1)
        if body is not None:
            return taken[-1], number, body
    return (taken or [0])[-1], 0, None


def take(spark: SparkSession, folder: str, number: int, body: dict) -> bool:
    """Create record ``number``; False if somebody has it already.  No record is ever overwritten."""
    fs, at = store_of(spark, f"{folder}/{number:012d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(json.dumps(body | {END: True}).encode()))
    stream.close()
    return True
