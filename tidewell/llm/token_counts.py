"""Token counts of sections by the character offsets of whole-document encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import frugal
from tidewell.llm.tokens import encoded, encoder

_OUT = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long"


def lines(text: str) -> list[int]:
    """Character places at which lines begin; a line holds the newline that ends it."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def token_starts(ids: np.ndarray, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of byte-level tokens; a token of part of a character has that character."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    char = np.cumsum((raw & 0xC0) != 0x80)  # 1-based number of the character a byte is in
    return char[starts] - 1, char[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from token spans and the sections' begins.

    A token whose span reaches into a later section crosses.  It counts once: ``start``
    gives it to the section of its first character, ``end`` to that of its last, ``most``
    to the one with most of its characters, the first of equals.  Crossing tokens are
    counted where they are given.
    """
    first = np.searchsorted(begins, starts, "right") - 1
    last = np.searchsorted(begins, np.maximum(ends - 1, starts), "right") - 1
    owner = last.copy() if rule == "end" else first.copy()
    crossing = first != last
    if rule == "most":
        for i in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[i]], begins[first[i] + 1 : last[i] + 1], [ends[i]]])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(begins)), np.bincount(owner[crossing], minlength=len(begins))


def token_counts(docs: DataFrame, *, sections: Callable[[str], list[int]] = lines, rule: str = "start", text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """One row a section: doc_id, section, its characters [start_char, end_char), n_tokens, n_crossing.

    Each whole text is encoded once.  The spans of its tokens are joined to the intervals
    of its sections by binary search; a token over a boundary is given to one section by
    ``rule`` (see allocate()), so a document's counts add up to those of its whole text.

    Null or empty text has one empty section with no tokens.  Null ids stay null, repeated
    rows are counted each, an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        lengths = enc.byte_lengths() if enc.byte_level else None
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            ids_ = encoded(texts, tokenizer) if enc.byte_level else (None for _ in texts)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            ids_out: list = []
            for doc, t, ids in zip(docs_, texts, ids_, strict=True):
                begins = np.array(sections(t), np.int64)
                if lengths is not None:
                    raw = np.frombuffer(t.encode(), np.uint8)
                    starts, ends = token_starts(np.frombuffer(ids, "<u4"), raw, lengths) if t else (np.zeros(0, int), np.zeros(0, int))
                else:
                    spans = np.array(enc.tokenizer.encode(t, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
                    starts, ends = spans[:, 0], spans[:, 1]
                n, crossing = allocate(starts, ends, begins, rule)
                ids_out += [doc] * len(begins)
                for a, b in zip(out, (np.arange(len(begins)), begins, np.append(begins[1:], len(t)), n, crossing), strict=True):
                    a.append(b)
            cols = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), *cols], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), _OUT)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
