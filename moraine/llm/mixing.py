"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.words import host, pieces, spread
from moraine.operators.skew import skew_join
from moraine.session import materialize

#: How that vocabulary cuts a text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Steps of a factor two in size, for the odds of a source's documents.
STEPS = 1 << 10
#: Rank buckets of one source; the cut falls into one of them, which alone is sorted.
BUCKETS = 1 << 14


@lru_cache(2)
def _tokenizer(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary, pattern).encode_ordinary
        for rows, texts in pieces(batches, "text"):
            n = np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), pa.array(n)], names=["doc_id", "source", "tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, tokens``: the source in its one spelling, whole texts in tokens.

    ``tokenizer``: vocabulary file of a public byte-level tokenizer; the driver reads it and sends its content along.
    A null or empty text has 0 tokens.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    rows = spread(docs.select("doc_id", host().alias("source"), "text"))
    return rows.mapInArrow(_count(vocabulary, pattern), "doc_id long, source string, tokens long")


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """How much each source gives to each mix.

    ``mix_name, source, target_share, max_repeats, docs, available, total, wanted, given,
    whole, rest``: the mix's total tokens, the tokens ``wanted`` from the source and, after
    the cap on repeats, ``given``; every document goes ``whole`` times into the mix and
    documents of about ``rest`` tokens once more. ``total_tokens`` sets the total; by default
    it is the largest one at which every source with documents can reach its share
    without breaking its cap. A source without tokens gives nothing. A null or
    negative share or cap counts as 0, a null mix or source is left out; of repeated targets
    the shares are added and the smallest cap holds. One row per target.
    """
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    share = F.when(F.isnan(share), F.lit(0.0)).otherwise(share)
    cap = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    wish = targets.select("mix_name", host().alias("source"), share.alias("share"), cap.alias("cap")).where("mix_name IS NOT NULL AND source IS NOT NULL")
    wish = wish.groupBy("mix_name", "source").agg(F.sum("share").alias("target_share"), F.min("cap").alias("max_repeats"))
    have = counts.where("tokens > 0 AND source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("available"))
    rows = wish.join(have, "source", "left").fillna(0, ["docs", "available"])
    feasible = F.when((F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(feasible).over(Window.partitionBy("mix_name")), F.lit(0.0))
    rows = rows.withColumn("total", total).withColumn("wanted", F.col("total") * F.col("target_share"))
    rows = rows.withColumn("given", F.least(F.col("wanted"), (F.col("available") * F.col("max_repeats")).cast("double")))
    whole = F.when(F.col("available") > 0, F.floor(F.col("given") / F.greatest(F.col("available"), F.lit(1)) + F.lit(1e-9))).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole.cast("int"))
    return rows.withColumn("rest", F.greatest(F.col("given") - F.col("whole") * F.col("available"), F.lit(0.0)))


def odds(usable: DataFrame, todo: DataFrame) -> DataFrame:
    """The factor ``c`` per ``mix_name, source``: documents ``source, tokens, size`` are included with p = min(1, c * size).

    c makes the expected tokens those of ``rest``: the largest sizes are certain as long as c * size exceeds 1, and c is
    solved for the others. Sizes are put into steps of a thousandth for that, so a source has a bounded number
    of them whatever its rows; a source where no size is above zero has the factor null: equal odds.
    """
    step = F.floor(F.log2("size") * STEPS).cast("long")
    level = usable.where("size > 0").groupBy("source", step.alias("step")).agg(F.max("size").alias("size"), F.sum(F.col("tokens").cast("double")).alias("t"), F.sum(F.col("size") * F.col("tokens")).alias("st"))
    want = todo.where("rest > 0").select("mix_name", "source", "rest").join(level, "source")
    down = Window.partitionBy("mix_name", "source").orderBy(F.desc("step"))
    above, left = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    c = (F.col("rest") - F.coalesce(F.sum("t").over(above), F.lit(0.0))) / F.sum("st").over(left)
    fits = c * F.col("size") <= 1
    return want.select("mix_name", "source", "step", c.alias("c"), fits.alias("fits")).groupBy("mix_name", "source").agg(
        F.coalesce(F.max_by("c", F.when(F.col("fits"), F.col("step"))), F.lit(1e300)).alias("c")
    )  # none fits where hardly anything is left out: all are certain


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None, seed: int = 7, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Choose documents for each mix, so that each source has its share of the tokens.

    Returns (chosen, report). ``chosen``: ``mix_name, source, doc_id, copies, tokens``, at
    most ``max_repeats`` copies of a document. ``report``: per target the ``target_share``,
    ``actual_share`` of the mix's tokens, ``tokens`` and ``copies`` really chosen and the
    most ``most_copies`` of one document.

    Whole copies come first; of what is left of a source, a sample is drawn by Pareto
    order sampling: u / (1 - u) over p / (1 - p), with u a random number fixed by document,
    mix and ``seed`` and p the document's inclusion probability, in proportion to its tokens, or to the column
    ``weight`` (null, NaN and negative weigh nothing and are taken last). Documents whose p
    reaches 1 are certain, and the others' p is solved again (see :func:`odds`). The documents of lowest rank
    are taken up to the wanted tokens, the last one if that comes nearer: the sample's size is fixed in tokens.
    Rank buckets are added up first and only the bucket of the cut is sorted, so a source may hold most rows. Texts are
    tokenized once. Documents without tokens are never chosen; ``doc_id`` is unique.
    """
    rows = docs if weight is None else docs.withColumn("__w", F.col(weight).cast("double"))
    counts = materialize(token_counts(docs, tokenizer), "tokens")
    todo = materialize(plan(counts, targets, total_tokens), "mix")
    usable = counts.where("tokens > 0 AND source IS NOT NULL")
    size = F.col("tokens").cast("double")
    if weight is not None:
        w = F.when(F.col("__w").isNull() | F.isnan("__w") | (F.col("__w") < 0), F.lit(0.0)).otherwise(F.col("__w"))
        usable = usable.join(rows.select("doc_id", w.alias("w")), "doc_id", "left").fillna(0.0, ["w"])
        size = F.col("w")
    usable = usable.select("doc_id", "source", "tokens", size.alias("size"))
    factor = materialize(odds(usable, todo), "odds")
    wanted = materialize(todo.where("given > 0").join(factor, ["mix_name", "source"], "left").select("mix_name", "source", "whole", "rest", "available", "c"), "wanted")
    each = skew_join(usable, wanted, "source", ["doc_id"], wanted.count()).where("mix_name IS NOT NULL")
    u = (F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.coalesce(F.col("c") * F.col("size"), F.col("rest") / F.col("available"))
    some = F.greatest(p, F.lit(1e-12))
    rank = F.when(p >= 1, F.lit(0.0)).otherwise((u / (F.lit(1.0) - u)) * (F.lit(1.0) - some) / some)
    # x / (1 + x) keeps the order and lies between 0 and 1; for equal p the cut is near p's own place.
    place = F.floor(rank / (F.lit(1.0) + rank) * F.lit(BUCKETS)).cast("int")
    ranked = each.select("mix_name", "source", "doc_id", "tokens", "whole", "rest", rank.alias("rank"), place.alias("place"))
    sums = ranked.where("rest > 0").groupBy("mix_name", "source", "rest", "place").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("mix_name", "source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("t").over(upto))
    cut = sums.groupBy("mix_name", "source").agg(
        F.min(F.when(F.col("upto") >= F.col("rest"), F.col("place"))).alias("cut"),
        F.max(F.when(F.col("upto") < F.col("rest"), F.col("upto"))).alias("before"),
    )
    marked = ranked.join(cut, ["mix_name", "source"], "left")
    edge = Window.partitionBy("mix_name", "source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.where((F.col("rest") > 0) & (F.col("place") == F.col("cut")))
    inside = inside.withColumn("upto", F.sum("tokens").over(edge) + F.coalesce("before", F.lit(0)))
    # The document at the cut goes in if the total with it is at least as near to the target as without it.
    inside = inside.where(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))
    once = marked.where((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("place") < F.col("cut")))).select("mix_name", "source", "doc_id", "tokens")
    extra = once.unionByName(inside.select("mix_name", "source", "doc_id", "tokens")).withColumn("copies", F.lit(1))
    whole = ranked.where("whole > 0").select("mix_name", "source", "doc_id", "tokens", F.col("whole").alias("copies"))
    chosen = whole.unionByName(extra).groupBy("mix_name", "source", "doc_id").agg(F.sum("copies").cast("int").alias("copies"), F.max("tokens").alias("tokens"))
    chosen = materialize(chosen, "chosen")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    report = todo.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "copies", "most_copies"])
    all_ = F.sum("tokens").over(Window.partitionBy("mix_name"))
    actual = F.when(all_ > 0, F.col("tokens") / all_).otherwise(F.lit(0.0))
    report = report.select("mix_name", "source", "target_share", "max_repeats", "docs", "available", "wanted", "tokens", "copies", "most_copies", actual.alias("actual_share"))
    return chosen, report
