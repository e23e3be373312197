import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import leakage, mixing, repetition
from moraine.llm.queries import TOKENIZER
from moraine.llm.words import host, pieces, words

DOCS = "doc_id long, text string, source string, words long, share double, host string, tokens long, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, "z", 5, 6) for i, t, s in rows], DOCS)


def test_words():
    assert words("Ein Café—NR. 7b, o'Neill_x") == ["ein", "café", "nr", "7b", "o", "neill", "x"]
    assert words(None) == words("") == words("... !") == []


def test_pieces_are_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 30, None, "b", "c" * 50, ""]})
    got = list(pieces([batch], "text", 20))
    assert [t for _, ts in got for t in ts] == batch.column("text").to_pylist() and len(got) == 3
    assert all(b.num_rows == len(ts) for b, ts in got)


def brute_share(text, span=8):
    w = words(text)
    grams = [tuple(w[i : i + span]) for i in range(len(w) - span + 1)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + span)}
    return len(hit), len(w)


def test_repetition_against_brute_force(spark):
    random.seed(2)
    texts = [None, "", "a", "a " * 8, "a " * 9, "x y " * 5]
    for _ in range(60):
        base = [random.choice("abcdefgh") + random.choice("xyz") for _ in range(random.randint(0, 40))]
        texts.append(" ".join(base + base[: random.randint(0, len(base))] + [random.choice("ab") for _ in range(random.randint(0, 9))]))
    df = docs(spark, [(i, t, random.choice(["A b", "a_B ", None])) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    for i, t in enumerate(texts):
        again, n = brute_share(t)
        assert (got[i].repeated, got[i].words) == (again, n)
        assert got[i].fails == (n > 0 and again / n >= 0.3)
    assert {r.host for r in got.values()} == {"a_b", None}
    assert repetition.repetition(df.limit(0)).count() == 0


def test_repetition_of_a_very_long_text(spark):
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 10**9, 300_000)))
    r = repetition.repetition(docs(spark, [(1, text + " " + text[:2000], "s"), (2, "one two", "s")])).collect()
    share = {x.doc_id: x.share for x in r}
    assert 0 < share[1] < 0.01 and share[2] == 0.0


def test_host_rates_shrink(spark):
    rows = [(i, 0.9 if i < 50 else 0.0, "bad") for i in range(100)] + [(200 + i, 0.0, "good") for i in range(900)] + [(5000, 0.9, "tiny")]
    m = spark.createDataFrame(rows, "doc_id long, share double, host string")
    h = {r.host: r for r in repetition.host_rates(m).collect()}
    assert h["bad"].rate == 0.5 and h["tiny"].rate == 1.0
    assert h["tiny"].shrunk < 0.95 and abs(h["bad"].shrunk - 0.5) < 0.1 and h["good"].shrunk < 0.05
    assert repetition.host_rates(m.limit(0)).count() == 0


def test_a_bad_host_is_told_from_chance(spark):
    """One host of many failures fails with all of its documents, good ones too; a small host of one failure doesn't."""
    bad, good = "again and again we say the same eight words " * 3, " ".join(f"w{i}" for i in range(60))
    rows = [(i, bad if i % 2 else good, "bad host") for i in range(60)] + [(100 + i, bad if i == 0 else good, f"h{i % 9}") for i in range(400)] + [(900, bad, "tiny")]
    got = repetition.repetition(docs(spark, rows)).collect()
    fails = {r.host for r in got if r.host_fails}
    assert "bad_host" in fails and not {f"h{i}" for i in range(9)} & fails
    assert all(r.host_fails for r in got if r.host == "bad_host") and {r.fails for r in got if r.host == "bad_host"} == {True, False}
    rate = {r.host: r.host_rate for r in got}
    assert rate["h0"] < rate["tiny"] < 1 and rate["bad_host"] == pytest.approx(0.5, abs=0.05)
    flat = docs(spark, [(i, bad if i % 5 == 0 else good, f"h{i // 50}") for i in range(200)])
    assert {round(r.host_rate, 12) for r in repetition.repetition(flat).collect()} == {0.2}


def brute_leaks(texts, items, n=12):
    out = set()
    for i, t in texts:
        w = words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for j, it in items:
            v = words(it)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((i, j))
    return out


def test_leaks_against_brute_force(spark):
    random.seed(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(j, " ".join(random.choice(vocab) for _ in range(random.randint(5, 30)))) for j in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1]), (103, "short one")]
    texts = [(0, None), (1, ""), (2, items[0][1].upper()), (3, items[1][1]), (3, items[1][1])]
    for i in range(4, 60):
        it = words(random.choice(items)[1])
        a = random.randint(0, max(len(it) - 11, 0))
        part = it[a : a + random.randint(8, 16)]
        texts.append((i, ", ".join([random.choice(vocab) for _ in range(random.randint(0, 30))] + part + [random.choice(vocab) for _ in range(random.randint(0, 30))])))
    d = docs(spark, [(i, t, "s") for i, t in texts])
    e = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id long, item_text string, text string")
    want = brute_leaks(texts, items)
    got = leakage.leaks(d, e)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    for r in got.where("kind = 'phrase'").collect():
        w, v = words(dict(texts)[r.doc_id]), words(dict(items)[r.item_id])
        assert w[r.doc_pos : r.doc_pos + r.words] == v[r.item_pos : r.item_pos + r.words] and r.words >= 12
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_near_matches(spark):
    item = "the quick brown fox jumps over a lazy dog near some river"
    moved = "so the brown quick fox jumps over some lazy dog near a river today"
    d = docs(spark, [(1, moved, "s"), (2, "the fox is near the river and nothing else is said here today by anyone at all", "s")])
    e = spark.createDataFrame([(7, item)], "item_id long, item_text string")
    got = leakage.leaks(d, e, near=True).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(1, 7, "near")]


def found_near(texts, item_texts):
    items = leakage.Items()
    for j, t in enumerate(item_texts):
        items.add(j, words(t))
    doc, it, n, at, _ = leakage.near_matches(leakage.PositionalIndex(texts, items.known, 26), items)
    return {(int(d), int(j), int(k), int(p)) for d, j, k, p in zip(doc, it, n, at)}


def test_near_matches_whatever_the_rarest_word():
    item = [f"w{i}" for i in range(12)]
    edited = [" ".join(["a", *item[:k], "x", *item[k + 1 :], "b"]) for k in range(12)]
    want = [(0, 11, 1 if k else 2) for k in range(12)]
    for k, text in enumerate(edited):
        assert found_near([text], [" ".join(item)]) == {(0, *want[k])}
        for j in range(12):  # other documents make another word the rarest
            others = [w for i, w in enumerate(item) if i != j] * 2
            assert {x for x in found_near([text, *others], [" ".join(item)]) if x[0] == 0} == {(0, *want[k])}
    stretched = " ".join(" z ".join(item[s : s + 2]) for s in range(0, 12, 2))  # 18 words
    assert found_near([stretched], [" ".join(item)]) == {(0, 0, 12, 0)}


def test_near_matches_at_every_offset_of_an_item():
    item = [f"w{i}" for i in range(23)]
    for s in range(12):
        for k in range(1, 11):
            text = " ".join(["a", *item[s : s + k], "x", *item[s + k + 1 : s + 12], "b"])
            assert found_near([text], [" ".join(item)]) == {(0, 0, 11, 1)}


def test_near_matches_against_brute_force():
    random.seed(11)
    vocab = [f"w{i}" for i in range(40)]
    items = [[random.choice(vocab) for _ in range(random.randint(8, 90))] for _ in range(12)]
    texts = []
    for _ in range(60):
        part = random.choice(items)
        a = random.randint(0, max(len(part) - 12, 0))
        part = [random.choice([w, w, w, w, w, w, "x", f"{w} x"]) for w in part[a : a + random.randint(9, 20)]]
        texts.append(" ".join([random.choice(vocab) for _ in range(random.randint(0, 30))] + part + ["y"] * random.randint(0, 9)))
    want = set()
    for d, text in enumerate(texts):
        w = words(text)
        for j, v in enumerate(items):
            best = []
            for window in (set(v[s : s + 12]) for s in range(len(v) - 11)):
                for t in range(-17, len(w)):
                    at = [p for p in range(max(t, 0), min(t + 18, len(w))) if w[p] in window]
                    n = len({w[p] for p in at})
                    if n >= 0.9 * len(window):
                        best.append((-n, at[0]))
            if best:
                want.add((d, j, -min(best)[0], min(best)[1]))
    items = [" ".join(v) for v in items]
    assert want and found_near(texts, items) == want
    assert {(d, *x[1:]) for d, t in enumerate(texts) for x in found_near([t], items)} == want


def test_match_does_not_run_over_documents(spark):
    item = " ".join(f"k{i}" for i in range(14))
    d = docs(spark, [(1, " ".join(f"k{i}" for i in range(8)), "s"), (2, " ".join(f"k{i}" for i in range(8, 14)), "s")]).coalesce(1)
    assert leakage.leaks(d, spark.createDataFrame([(1, item)], "item_id long, item_text string")).count() == 0


def test_a_stored_index_serves_other_items(spark, tmp_path):
    """Items are searched without the texts; of other terms than the items' own no list is read."""
    random.seed(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(0, 80)))) for i in range(60)]
    d = docs(spark, [(i, t, "s") for i, t in [*texts, (None, "w1 w2"), (61, None)]]).repartition(5)
    index = leakage.write_index(d, f"{tmp_path}/index")
    n = {r.term: r.n for r in index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert n == {w: sum(words(t).count(w) for _, t in texts) for w in vocab}
    assert index.where("term IS NULL").agg(F.sum("n")).first()[0] == 60
    for seed in range(2):
        random.seed(seed)
        items = []
        for j in range(8):
            w = words(random.choice(texts)[1])
            a = random.randint(0, max(len(w) - 20, 0))
            items.append((j, " ".join(w[a : a + 14] + ["never"] + w[:3])))
        e = spark.createDataFrame(items, "item_id long, item_text string")
        got = {(r.doc_id, r.item_id) for r in leakage.search(leakage.read_index(spark, f"{tmp_path}/index"), e).collect()}
        assert got == brute_leaks(texts, items)
        near = leakage.search(index, e, near=True).where("kind = 'near'").collect()
        known = {(r.doc_id, r.item_id, r.words) for r in near}
        assert known == {(d, j, n) for d, j, n, _ in found_near([t for _, t in texts], [t for _, t in items])}


def test_short_items_are_found_as_a_whole(spark):
    d = docs(spark, [(1, "a b c d e f g", "s"), (2, "b c d x e f", "s")])
    e = spark.createDataFrame([(1, "b c d e f"), (2, "B, c!"), (3, "b c d x e f")], "item_id long, item_text string")
    assert leakage.leaks(d, e).count() == 0
    got = leakage.leaks(d, e, near=True).collect()
    assert {(r.doc_id, r.item_id, r.kind, r.doc_pos) for r in got} == {(1, 1, "whole", 1), (2, 3, "whole", 0)}


TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def corpus(spark):
    random.seed(5)
    rows = [(i, " ".join(random.choice(["apple", "pear", "fig"]) for _ in range(random.randint(1, 60))), "Big-One" if i % 2 else "big_one ") for i in range(600)]
    rows += [(1000 + i, "plum " * random.randint(1, 30), "small") for i in range(60)]
    rows += [(5000, None, "small"), (5001, "", "small"), (5002, "no source", None)]
    return docs(spark, rows)


@pytest.mark.parametrize("weight", [None, "words"])
def test_mix_reaches_the_shares(spark, weight):
    d = corpus(spark).withColumn("words", F.col("doc_id") % 7 + 1)
    t = spark.createDataFrame([("m", "big_one", 0.7, 1), ("m", "small", 0.3, 3), ("other", "small", 1.0, 4), ("m", "absent", 0.0, 2)], TARGETS)
    chosen, report = mixing.mix(d, t, TOKENIZER, weight=weight)
    r = {(x.mix_name, x.source): x for x in report.collect()}
    assert r["m", "big_one"].actual_share == pytest.approx(0.7, abs=0.01)
    assert r["m", "small"].actual_share == pytest.approx(0.3, abs=0.01)
    assert r["other", "small"].actual_share == 1.0 and r["other", "small"].most_copies == 4
    assert r["m", "absent"].tokens == 0
    c = chosen.toPandas()
    assert not c.duplicated(["mix_name", "doc_id"]).any()
    assert c[(c.mix_name == "m") & (c.source == "small")].copies.max() <= 3 and c.copies.min() >= 1
    assert set(c.doc_id) & {5000, 5001, 5002} == set()
    again, _ = mixing.mix(d.repartition(3), t, TOKENIZER, weight=weight)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))


def test_mix_with_a_total_and_caps(spark):
    t = spark.createDataFrame([("m", "big_one", 0.5, 1), ("m", "small", 0.5, 2)], TARGETS)
    total = 40 * mixing.token_counts(corpus(spark), TOKENIZER).where("source = 'small'").agg(F.sum("tokens")).first()[0]
    _, report = mixing.mix(corpus(spark), t, TOKENIZER, total_tokens=int(total))
    r = {x.source: x for x in report.collect()}
    assert r["small"].most_copies == 2 and r["small"].tokens == 2 * r["small"].available  # capped: short of its share
    assert r["big_one"].tokens <= r["big_one"].available
    chosen, report = mixing.mix(corpus(spark).limit(0), t, TOKENIZER)
    assert chosen.count() == 0 and report.count() == 2
    dirty = spark.createDataFrame([(None, "small", 0.5, 1), ("m", None, 0.5, 1), ("m", "small", None, None), ("n", "SMALL", 0.5, 2), ("n", "small", 0.5, 3)], TARGETS)
    _, report = mixing.mix(corpus(spark), dirty, TOKENIZER)
    assert {(x.mix_name, x.source, x.target_share, x.max_repeats) for x in report.collect()} == {("m", "small", 0.0, 0), ("n", "small", 1.0, 2)}


def test_inclusion_is_in_proportion_to_size(spark):
    """Over 400 mixes of one source: each document's frequency is its p, the largest ones are certain, sizes are kept."""
    random.seed(4)
    d = docs(spark, [(i, " ".join(["word"] * (900 if i < 2 else random.choice([5, 20, 60]))), "s") for i in range(60)])
    t = spark.createDataFrame([(f"m{k}", "s", 1.0, 1) for k in range(400)], TARGETS)
    counts = {r.doc_id: r.tokens for r in mixing.token_counts(d, TOKENIZER).collect()}
    wanted = 1800 + 0.4 * (sum(counts.values()) - 1800)
    chosen, report = mixing.mix(d, t, TOKENIZER, total_tokens=int(wanted))
    assert all(abs(r.tokens - int(wanted)) <= 35 for r in report.collect())
    rest = {i: n for i, n in counts.items() if i > 1}
    c = (int(wanted) - counts[0] - counts[1]) / sum(n * n for n in rest.values())
    assert c * 900 > 1 > c * 60
    times = dict(chosen.groupBy("doc_id").count().collect())
    assert times[0] == times[1] == 400
    for n in (5, 20, 60):
        same = [i for i in rest if rest[i] == n]
        assert sum(times.get(i, 0) for i in same) / len(same) / 400 == pytest.approx(c * n, abs=0.015)


def test_shares_are_reached_within_a_document(spark):
    d, t = corpus(spark), spark.createDataFrame([("m", "big_one", 0.55, 2), ("m", "small", 0.45, 3)], TARGETS)
    _, report = mixing.mix(d, t, TOKENIZER)
    for r in report.collect():
        assert abs(r.tokens - r.wanted) <= 200 and abs(r.actual_share - r.target_share) < 0.01


def test_mix_of_equal_records(spark):
    d = docs(spark, [(i, "same text", "s") for i in range(100)] + [(1000 + i, "same text", "t") for i in range(900)])
    t = spark.createDataFrame([("m", "s", 0.5, 1), ("m", "t", 0.5, 1)], TARGETS)
    chosen, report = mixing.mix(d, t, TOKENIZER)
    assert {x.source: x.copies for x in report.collect()} == {"s": 100, "t": 100}


def test_token_counts_are_those_of_the_tokenizer(spark):
    got = {r.doc_id: r.tokens for r in mixing.token_counts(docs(spark, [(1, "Hello, wörld! <|endoftext|>", "s"), (2, None, "s")]), TOKENIZER).collect()}
    with open(TOKENIZER, "rb") as f:
        encode = mixing._tokenizer(f.read(), mixing.PATTERN)
    ids = encode.encode_ordinary("Hello, wörld! <|endoftext|>")
    assert got == {1: len(ids), 2: 0} and encode.decode(ids) == "Hello, wörld! <|endoftext|>"


def test_host(spark):
    df = spark.createDataFrame([(" A-b ",), ("a_B",), ("",), (None,)], "source string")
    assert [r[0] for r in df.select(host()).collect()] == ["a_b", "a_b", None, None]
