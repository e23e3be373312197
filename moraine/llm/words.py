"""Words of texts, the same for all text operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Batches are worked on in pieces of about so many characters; a longer text is a piece of its own.
PIECE_CHARS = 8_000_000


def words(text: str | None) -> list[str]:
    """The words of ``text``: after NFC and lower-casing, the maximal runs of letters and digits.

    Null and empty texts have none.
    """
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def pieces(batches: Iterable[pa.RecordBatch], text: str, chars: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``chars`` characters each, and their texts; whole texts only."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "") + 1
            if size >= chars:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def word_ids(texts: list, known: dict[str, int] | None = None, ids: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, one after another, and each text's word count.

    With ``known``, words outside it get -1; without, ids are given by first occurrence, and added to ``ids``.
    """
    counts, parts = np.zeros(len(texts), np.int64), []
    ids = {} if ids is None else ids
    for i, text in enumerate(texts):
        found = words(text)
        counts[i] = len(found)
        if known is None:
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found)))
        else:
            parts.append(np.fromiter((known.get(w, -1) for w in found), np.int64, len(found)))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), counts


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: one file of texts is else one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def host(source: str = "source"):
    """The source in its one spelling: trimmed, lower case, underscores; empty is null."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(source))), "[\\s-]+", "_")
    return F.when(plain != "", plain)
