"""Repeated content inside one document, with verdicts on the hosts documents come from."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.words import host, pieces, spread, word_ids
from moraine.operators.skew import salted_aggregate, skew_join
from moraine.session import materialize

#: Words in a sequence whose second occurrence is a repetition.
SPAN = 8
#: Share of repeated words from which on a document breaks the rule.
LIMIT = 0.30


def repeated_words(ids: np.ndarray, counts: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each text the number of its words that lie in a repeated sequence of ``span`` words.

    ``ids`` holds the texts' words one after another, ``counts`` their number per text.
    Sequences get exact numbers by doubling (pairs, fours, ...), no hashes, so that
    nothing is taken for repeated by accident. A text of any length is one run of it.
    """
    n, docs = len(ids), len(counts)
    repeated = np.zeros(docs, np.int64)
    if n < span:
        return repeated
    doc = np.repeat(np.arange(docs), counts)
    code, have = np.unique(ids, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
    while have < span:
        step = min(have, span - have)  # two sequences of `have` words, overlapping if need be
        pair = code[:-step] * (code.max() + 1) + code[step:]
        code, have = np.unique(pair, return_inverse=True)[1].reshape(-1).astype(np.int64), have + step
    inside = doc[: len(code)] == doc[span - 1 :]  # starts whose sequence ends in the same text
    start = np.flatnonzero(inside)
    if not len(start):
        return repeated
    key = doc[start] * (code.max() + 1) + code[start]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    hits = start[times[inverse.reshape(-1)] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + span, -1)
    return np.bincount(doc[np.cumsum(edge)[:n] > 0], minlength=docs)


def _measure(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            ids, counts = word_ids(texts)
            again = repeated_words(ids, counts, span)
            share = np.where(counts > 0, again / np.maximum(counts, 1), 0.0)
            cols = [rows.column("doc_id"), rows.column("host"), pa.array(counts), pa.array(again), pa.array(share)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", "words", "repeated", "share"])

    return run


def measure(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, host, words, repeated, share`` for every row; no shuffle of the texts.

    A text that is null, empty or without words has no repeated word and share 0.
    """
    rows = spread(docs.select("doc_id", host().alias("host"), "text"))
    return rows.mapInArrow(_measure(span), "doc_id long, host string, words long, repeated long, share double")


def host_rates(measured: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Rule failures per host, shrunk with an empirical beta prior.

    ``host, docs, failures, rate, prior_rate, prior_weight, shrunk``. The prior's mean is
    the rate over all documents; its weight comes from the variance of the hosts' rates by
    the method of moments, so that hosts of few documents move to the mean; where the rates differ no more than
    chance explains, it is infinite and every host has the mean. The counts per
    host are salted, as one host may hold a large share. Documents without a host form a
    host of their own (null). An empty table has no hosts.
    """
    fails = (F.col("share") >= F.lit(limit)).cast("long")
    hosts = salted_aggregate(measured, "host", {"docs": ("count", F.lit(1)), "failures": ("sum", fails)}, ["doc_id"])
    hosts = materialize(hosts.withColumn("rate", F.col("failures") / F.col("docs")), "hosts")
    sums = hosts.agg(F.sum("docs").alias("d"), F.sum("failures").alias("f"), F.sum(F.col("docs") * F.col("rate") * F.col("rate")).alias("sq"), F.sum(F.lit(1.0)).alias("k")).first()
    mean = (sums["f"] or 0) / sums["d"] if sums["d"] else 0.0
    spread_ = mean * (1 - mean)
    # Between-host variance: the weighted variance of the rates less what binomial counts give by themselves.
    seen = sums["sq"] / sums["d"] - mean * mean if sums["d"] else 0.0
    noise = spread_ * (sums["k"] or 0.0) / sums["d"] if sums["d"] else 0.0
    between = seen - noise
    weight = max(spread_ / between - 1, 0.0) if between > 0 else math.inf
    shrunk = F.lit(float(mean)) if math.isinf(weight) else (F.col("failures") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight))
    return hosts.withColumns({"prior_rate": F.lit(float(mean)), "prior_weight": F.lit(float(weight)), "shrunk": shrunk})


def repetition(docs: DataFrame, span: int = SPAN, limit: float = LIMIT, host_factor: float = 1.5) -> DataFrame:
    """Every document's repeated share, its rule's outcome and its host's verdict.

    ``doc_id, host, words, repeated, share, fails, host_rate, host_fails``: ``fails`` when
    ``share`` is at least ``limit``; ``host_fails`` when the host's shrunk rate is at least
    ``host_factor`` times the rate over all documents and not zero. The texts are read once; only counts
    travel. Rows come out as often as they are in ``docs``; other columns aren't used.
    """
    measured = materialize(measure(docs, span), "repetition")
    hosts = host_rates(measured, limit)
    verdict = hosts.select(F.col("host").alias("__host"), F.col("shrunk").alias("host_rate"), ((F.col("shrunk") >= F.lit(host_factor) * F.col("prior_rate")) & (F.col("shrunk") > 0)).alias("host_fails"))
    rows = hosts.count()
    joined = skew_join(measured, verdict.withColumnRenamed("__host", "host"), "host", ["doc_id"], rows)
    return joined.withColumn("fails", F.col("share") >= F.lit(limit))
