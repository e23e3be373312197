"""Passages of evaluation items inside training documents, by a stored positional index.

The index is one table of postings, partitioned by document: a shard is some millions of characters of
documents, and a row holds one term's positions in one shard. It is written in one pass over the texts,
without a shuffle, sorted by term within each file, and kept for as many sets of items as will come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.words import pieces, spread, word_ids, words
from moraine.operators.arrow import groups
from moraine.session import materialize

#: Consecutive words that make a leak.
PHRASE = 12
#: Shorter items are no passage; those of so many words on, up to a phrase, must stand in a document as a whole.
SHORT = 5
#: Empty places between two documents of a shard: more than any passage reaches (a phrase of up to 31 words).
GAP = 64
#: Item terms up to this number are sent to every executor; more are joined by shuffle.
BROADCAST_TERMS = 1_000_000
#: Windows of an item and places of a document that near matches are counted for at once.
_WINDOWS, _PLACES = 32, 32_768
_SCHEMA = "doc_id long, item_id long, kind string, words long, doc_pos long, item_pos long"
#: A row of the index: a term's positions in a shard; with a null term, the shard's documents and where each starts.
INDEX = "shard long, term string, n long, positions array<int>, docs array<long>"


@dataclass
class Items:
    """Test items as arrays of terms."""

    known: dict[str, int] = field(default_factory=dict)
    terms: list = field(default_factory=list)  # term ids, item after item
    item: list = field(default_factory=list)  # index of the item, per term
    ids: list = field(default_factory=list)
    starts: list = field(default_factory=lambda: [0])

    def add(self, item_id: int, found: list[str]) -> None:
        self.terms += [self.known.setdefault(w, len(self.known)) for w in found]
        self.item += [len(self.ids)] * len(found)
        self.ids.append(item_id)
        self.starts.append(len(self.terms))


class PositionalIndex:
    """Postings of a set of documents: for each known term its positions, ascending.

    Positions count through all the documents, with ``gap`` empty places between two, so
    that no match runs over a border. It is one shard of a document-partitioned index.
    """

    def __init__(self, texts: list, known: dict[str, int], gap: int):
        ids, counts = word_ids(texts, known)
        self.doc_starts = np.concatenate([[0], np.cumsum(counts + gap)]) + gap
        self.tokens = np.full(self.doc_starts[-1] + gap, -2, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(ids)) + (self.doc + 1) * gap
        self.tokens[place] = ids
        hit = ids >= 0
        order = np.argsort(ids[hit], kind="stable")
        self.positions = place[hit][order]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(ids[hit], minlength=len(known)))])

    @classmethod
    def stored(cls, lists: list, doc_starts: np.ndarray, gap: int = GAP) -> PositionalIndex:
        """A shard from its stored postings: ``lists`` holds the positions of the terms 0, 1, ... that are looked for."""
        self = cls.__new__(cls)
        self.doc_starts = doc_starts
        self.positions = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        size = np.array([len(v) for v in lists], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.tokens = np.full(int(doc_starts[-1]) + gap, -2, np.int64)
        self.tokens[self.positions] = np.repeat(np.arange(len(lists)), size)
        return self

    def frequency(self) -> np.ndarray:
        return np.diff(self.offsets)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each of ``terms``, and for each position the index into ``terms``."""
        n = self.offsets[terms + 1] - self.offsets[terms]
        which = np.repeat(np.arange(len(terms)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.positions[self.offsets[terms][which] + inside], which

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, side="right") - 1


def _anchors(freq: np.ndarray, starts: np.ndarray, phrase: int) -> np.ndarray:
    """Places in the items that cover every window of ``phrase`` terms by its rarest term."""
    picked = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= phrase:
            windows = np.lib.stride_tricks.sliding_window_view(freq[a:b], phrase)
            place = np.unique(np.arange(len(windows)) + windows.argmin(1)) + a
            picked.append(place[freq[place] > 0])
    return np.concatenate(picked) if picked else np.empty(0, np.int64)


def phrase_matches(index: PositionalIndex, items: Items, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
    """Maximal runs of at least ``phrase`` words shared by a document and an item.

    Every window of an item is looked up by the postings of its rarest term; the lists of
    its neighbours, adjusted by their offset, are intersected from there to both sides.
    Returns document, item index, run length, position in the document and in the item.
    """
    terms, item, starts = np.array(items.terms, np.int64), np.array(items.item, np.int64), np.array(items.starts, np.int64)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if not len(terms):
        return none
    anchor = _anchors(index.frequency()[terms], starts, phrase)
    if not len(anchor):
        return none
    at, which = index.postings(terms[anchor])
    place = anchor[which]
    lo, hi = starts[item[place]], starts[item[place] + 1]
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for side, out in ((-1, left), (1, right)):
        live = np.arange(len(at))
        step = 0
        while len(live):
            step += 1
            p, d = place[live] + side * step, at[live] + side * step
            ok = (p >= lo[live]) & (p < hi[live])
            live, p, d = live[ok], p[ok], d[ok]
            same = index.tokens[d] == terms[p]
            live = live[same]
            out[live] += 1
    size = left + right + 1
    keep = size >= phrase
    d, p, size = (at - left)[keep], (place - left)[keep], size[keep]
    _, first = np.unique(np.stack([d, p]), axis=1, return_index=True)
    d, p, size = d[first], p[first], size[first]
    doc = index.doc_of(d)
    return doc, item[p], size, d - index.doc_starts[doc], p - starts[item[p]]


def near_matches(index: PositionalIndex, items: Items, phrase: int = PHRASE, share: float = 0.9, slack: float = 1.5) -> tuple[np.ndarray, ...]:
    """Passages that hold most words of an item's window near by each other, in any order.

    A window of ``phrase`` terms, of which one starts at every place of an item, matches where any span of ``slack * phrase`` words of a document
    holds at least ``share`` of the window's different terms. Spans are looked up by the
    postings of the window's rarest terms, of which a match holds one; every span around
    them is counted, so the outcome depends neither on them nor on the other documents.
    Per document and item the best passage, the first of equal ones: document, item index, matched
    words, position of the first of them in the document and of the window in the item.
    """
    terms, starts = np.array(items.terms, np.int64), np.array(items.starts, np.int64)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    freq = index.frequency()
    found: list = []
    span = int(round(slack * phrase))
    around, inside = np.arange(1 - span, span), np.arange(span)
    local = np.full(len(freq) + 2, -1, np.int64)  # the last two: unknown words and gaps
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        windows = np.arange(a, b - phrase + 1)
        for g in range(0, len(windows), _WINDOWS):
            group = windows[g : g + _WINDOWS]
            own, place = np.unique(terms[group[:, None] + np.arange(phrase)], return_inverse=True)
            holds = np.zeros((len(group), len(own)), np.float32)
            holds[np.arange(len(group))[:, None], place.reshape(len(group), phrase)] = 1
            size = holds.sum(1)
            need = np.ceil(share * size)
            # A match misses at most size - need terms, so it holds one of the rarest size - need + 1.
            rank = np.argsort(np.where(holds > 0, freq[own], np.iinfo(np.int64).max), axis=1, kind="stable")
            rarest = np.unique(rank[np.arange(len(own)) < (size - need + 1)[:, None]])
            at, _ = index.postings(own[rarest])
            if not len(at):
                continue
            local[own] = np.arange(len(own))
            for s in range(0, len(at), _PLACES):
                # Spans with too few words of any of the group's windows are left out first.
                known = local[index.tokens[at[s : s + _PLACES, None] + around]] >= 0
                upto = np.cumsum(np.pad(known, ((0, 0), (1, 0))), 1, dtype=np.int32)
                row, col = np.nonzero(upto[:, span:] - upto[:, :-span] >= need.min())
                begin = np.unique(at[s + row] + around[col])
                for k in range(0, len(begin), _PLACES):
                    t = begin[k : k + _PLACES]
                    word = local[index.tokens[t[:, None] + inside]]
                    has = np.zeros((len(t), len(own) + 1), np.float32)
                    has[np.arange(len(t))[:, None], word] = 1  # -1 is the spare last one
                    n = has[:, :-1] @ holds.T
                    row, w = np.nonzero(n >= need)
                    if len(row):
                        first = ((word[row] >= 0) & (holds[w[:, None], word[row]] > 0)).argmax(1) + t[row]
                        found.append((index.doc_of(first), np.full(len(row), i), n[row, w].astype(np.int64), first, group[w] - a))
            local[own] = -1
    if not found:
        return none
    doc, it, n, at, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, at, -n, it, doc))
    doc, it, n, at, p = doc[order], it[order], n[order], at[order], p[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (it[1:] != it[:-1])
    doc, it, n, at, p = doc[first], it[first], n[first], at[first], p[first]
    return doc, it, n, at - index.doc_starts[doc], p


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of each piece of the texts."""
    number = TaskContext.get().partitionId() << 32
    names = [f.split()[0] for f in INDEX.split(", ")]
    for rows, texts in pieces(batches, "text"):
        known: dict[str, int] = {}
        ids, counts = word_ids(texts, None, known)
        starts = np.concatenate([[0], np.cumsum(counts + GAP)]) + GAP
        place = (np.arange(len(ids)) + (np.repeat(np.arange(len(texts)), counts) + 1) * GAP).astype(np.int32)
        order = np.argsort(ids, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(known)))]).astype(np.int32)
        m = len(known)
        head = [pa.array([number]), pa.array([None], pa.string()), pa.array([len(texts)]), pa.array([starts.tolist()], pa.list_(pa.int32())), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(head, names=names)
        if m:
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(list(known)), pa.array(np.diff(edges).astype(np.int64)), lists, pa.nulls(m, pa.list_(pa.int64()))], names=names)
        number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The postings of ``doc_id, text``: :data:`INDEX` rows, not yet stored. Null ids and texts are left out.

    Texts are read once and not shuffled; what is written is of the size of the corpus in numbers. A term's
    rows lie together within each file, so that reading a few terms skips the rest.
    """
    rows = spread(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    return rows.mapInArrow(_postings, INDEX).sortWithinPartitions("term", "shard")


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Store the index at ``path``; it replaces what is there."""
    build_index(docs).write.mode("overwrite").parquet(path)
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [words(t) for t in b.column("item_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])


def _rarest(phrase: int, near: bool, share: float):
    """Of each item the terms that every match of it holds one of: the rarest of each window, and
    for near matches as many as a match may miss, and one more."""

    def pick(freq: list, terms: list) -> set:
        many = len(terms)
        size, out = min(phrase, many), set()
        for s in range(many - size + 1):
            own = {t: f for t, f in zip(terms[s : s + size], freq[s : s + size])}
            order = sorted(own, key=lambda t: (own[t], t))
            out.update(order[: len(order) - math.ceil(share * len(order)) + 1 if near and many >= phrase else 1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in groups(batches, "item"):
            order = np.argsort(t.column("pos").to_numpy())
            terms, freq = t.column("term").take(order).to_pylist(), t.column("freq").to_numpy()[order].tolist()
            got = sorted(pick(freq, terms))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(got)), pa.array(got)], names=["item", "term"])

    return run


def _match(phrase: int, near: bool, share: float):
    """Each shard's documents, postings and items together: its matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, "shard"):
            docs = t.filter(t.column("docs").is_valid())
            asked = t.filter(t.column("terms").is_valid())
            post = t.filter(t.column("term").is_valid())
            if not docs.num_rows or not asked.num_rows:
                continue
            doc_ids = np.array(docs.column("docs")[0].as_py(), np.int64)
            items, short = Items(), {}
            for item_id, terms in sorted(zip(asked.column("item_id").to_pylist(), asked.column("terms").to_pylist())):
                if len(terms) >= phrase:
                    items.add(item_id, terms)
                else:
                    short.setdefault(len(terms), Items(known=items.known)).add(item_id, terms)
            found = dict(zip(post.column("term").to_pylist(), (v.values.to_numpy() for v in post.column("positions"))))
            index = PositionalIndex.stored([found.get(w, np.empty(0, np.int32)) for w in items.known], np.array(docs.column("positions")[0].as_py(), np.int64))
            runs = [("phrase", items, phrase_matches(index, items, phrase))]
            if near:
                runs.append(("near", items, near_matches(index, items, phrase, share)))
                runs += [("whole", few, phrase_matches(index, few, size)) for size, few in short.items()]
            for kind, own, (doc, it, n, d, p) in runs:
                cols = [pa.array(doc_ids[doc]), pa.array(np.array(own.ids, np.int64)[it]), pa.array([kind] * len(doc), pa.string()), pa.array(n), pa.array(d), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "kind", "words", "doc_pos", "item_pos"])

    return run


def search(index: DataFrame, items: DataFrame, phrase: int = PHRASE, near: bool = False, share: float = 0.9) -> DataFrame:
    """Where passages of ``items`` stand in an indexed corpus: see :func:`leaks`.

    1. The corpus frequency of the items' terms is added up from the index, without positions.
    2. Each item gives its rarest terms: one of every window of ``phrase`` words (for near matches as many as
       a match may miss, and one more). Their postings tell which shards may hold the item.
    3. Only for those shards are the lists of the item's terms read. They meet by shard, where the lists
       are intersected from the rarest term outwards, adjusted by their offset.
    """
    if not 1 <= phrase < GAP // 2:
        raise ValueError(f"a phrase has 1 to {GAP // 2 - 1} words")
    spark = index.sparkSession
    rows = items.select("item_id", "item_text").where("item_id IS NOT NULL AND item_text IS NOT NULL")
    rows = spread(rows).mapInArrow(_item_words, "item_id long, terms array<string>")
    least = min(SHORT, phrase) if near else phrase
    rows = materialize(rows.where(F.size("terms") >= least).withColumn("item", F.monotonically_increasing_id()), "items")
    terms = rows.select("item", F.posexplode("terms").alias("pos", "term"))
    vocabulary = materialize(terms.select("term").distinct(), "vocabulary")
    n = vocabulary.count()
    if not n:
        return spark.createDataFrame([], _SCHEMA)
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_TERMS else (lambda df: df)
    freq = index.select("term", "n").join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("freq"))
    known = terms.join(freq, "term", "left").select("item", "pos", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    rare = known.repartition("item").sortWithinPartitions("item").mapInArrow(_rarest(phrase, near, share), "item long, term string")
    rare = materialize(rare, "rare-terms")
    shards = index.select("term", "shard").join(small(rare) if rare.count() <= BROADCAST_TERMS else rare, "term").select("shard", "item").distinct()
    shards = materialize(shards, "candidates")
    near_by = materialize(shards.select("shard").distinct(), "shards")
    some = F.broadcast(near_by) if near_by.count() <= BROADCAST_TERMS else near_by
    lists = index.join(small(vocabulary), "term", "left_semi").join(some, "shard", "left_semi")
    none = {c: F.lit(None).cast(t) for c, t in (("term", "string"), ("positions", "array<int>"), ("docs", "array<long>"), ("item_id", "long"), ("terms", "array<string>"))}
    cols = lambda df, *keep: df.select("shard", *[F.col(c) if c in keep else none[c].alias(c) for c in none])
    heads = index.where("term IS NULL").join(some, "shard", "left_semi")
    asked = shards.join(rows, "item")
    both = cols(lists, "term", "positions").unionByName(cols(heads, "positions", "docs")).unionByName(cols(asked, "item_id", "terms"))
    return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(_match(phrase, near, share), _SCHEMA)


def leaks(docs: DataFrame, items: DataFrame, phrase: int = PHRASE, near: bool = False) -> DataFrame:
    """Where passages of ``items`` stand in ``docs``: one row per maximal shared run.

    ``doc_id, item_id, kind, words, doc_pos, item_pos``; kind "phrase": at least ``phrase``
    consecutive words of both; with ``near`` also "near": the best passage per document
    and item with nine tenths of a window's words close together in any order; and "whole": items of under
    ``phrase`` but at least :data:`SHORT` words that stand in the document as a whole.
    The index of ``docs`` is stored in the shared folder and searched; to keep one for other sets of items use
    :func:`write_index` and :func:`search`. Texts are read once, whatever the number of items, and never shuffled;
    shards are of even size, so no frequent word or source can load one task. Null, empty and shorter texts, on
    either side, match nothing; equal items are reported each; repeated documents as often as they occur.
    """
    return search(materialize(build_index(docs), "index"), items, phrase, near)
