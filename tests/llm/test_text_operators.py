"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvial.llm import bpe, cotrain, decontam, hostrules, langid, licenses, neardup, queries, quotes, sufdedup, toxicity

D = "/root/testdata/sf0.001"


def documents(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))


# --- suffix-array dedup -------------------------------------------------------


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def test_difference_covers():
    for period in (7, 13, 31, 57, 133):
        c = sufdedup.difference_cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))


@pytest.mark.parametrize("length", [5, 30, 200])
def test_repeats_equal_brute_force(spark, prose, length):
    shared, other = prose(60, 1), prose(50, 2)
    texts = [None, "", "x", prose(80, 3), shared, shared, "ab" + shared[7:] + prose(30, 5), prose(10, 6) + other + prose(10, 7) + other[:250], "ü" * 500, prose(400, 8) + shared[:260], "z" * 199, prose(3000, 9)]
    got = sufdedup.dedup(documents(spark, texts), length=length, digests=True).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_spans(texts, length)


def test_texts_made_to_collide(spark):
    """Words of equal polynomial hash modulo 2**64 for a known base, and words of a Thue-Morse sequence, repeat nothing."""
    ending = "".join(chr(97 + k * k % 23) + chr(97 + k % 19) for k in range(88))
    pair = [w + ending for w in ("lklllmmolmnmknnmomlnlmmm", "mnnmnmlknmllnlklkmnlnllm")]
    morse = ["".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(128)) + "x" * 72 for swap in (0, 1)]
    got = sufdedup.dedup(documents(spark, [*pair, *morse]), digests=True).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0] * 4
    long = "".join("ab"[bin(k).count("1") % 2] for k in range(5000))
    for length in (30, 1024):
        texts = [long, long[700:2900] + "z", "z" + long[3000:]]
        got = sufdedup.dedup(documents(spark, texts), length=length, digests=True).orderBy("doc_id").collect()
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_spans(texts, length)


def test_many_identical_rows(spark, prose):
    rows = [(1, prose(50, 1))] * 3000 + [(2, prose(60, 2))]
    got = sufdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", (F.col("n_bytes") == F.col("n_removed")).alias("all")).count().collect()
    assert {tuple(r) for r in got} == {(1, True, 3000), (2, False, 1)}


def test_repeats_of_near_copies_equal_brute_force(spark, prose):
    """Edited copies, passages at many offsets, and overlapping repeats in one text."""
    base, passage = prose(300, 11), prose(70, 12)
    texts = [base, *(edited(base, 1 + k, k) for k in range(12)), *(prose(k, 50 + k) + passage + prose(9, 70 + k) for k in range(30)), (passage + " ") * 7, "ab" * 700, passage[:-1], passage[1:]]
    got = sufdedup.dedup(documents(spark, texts), digests=True).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_spans(texts, 200)


def test_repeated_rows_and_empty_table(spark, prose):
    t = prose(60, 1)
    df = spark.createDataFrame([(1, t, 7), (1, t, 7)], "doc_id long, text string, n_bytes long")
    rows = sufdedup.dedup(df, keep=("doc_id", "n_bytes")).collect()
    assert len(rows) == 2 and all(r["n_removed"] == r["n_bytes"] == len(t.encode()) and r["kept"] == "" for r in rows)
    assert sufdedup.dedup(df.limit(0)).count() == 0


# --- byte-level BPE -----------------------------------------------------------


def test_bpe_equals_library(spark, prose):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "\n\n \t x", "don't  we'll", "aaaaaaaaaaaaaaa", "日本語🎉 ﷽", "<|endoftext|>", prose(500, 1), "a" * 20_000, " " * 3000, "x  y\x1c z", prose(500, 1)]
    got = bpe.encode_documents(documents(spark, texts), ranks, P.PATTERN, block_chars=900).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]).decode() for r in got] == [t or "" for t in texts]
    back = bpe.decode_documents(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got], "doc_id long, ids array<int>"), ranks).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t or "" for t in texts]


def test_bpe_out_of_order_ranks():
    # "ab" is earlier than "bc", but "abc" earlier than both: a merge may make an earlier pair
    ranks = {bytes([b]): b for b in range(256)} | {b"abcab": 256, b"abc": 257, b"ab": 258, b"bc": 259}
    replay = bpe.MergeReplay(ranks)
    for word in (b"abcabc", b"abcab", b"aabbcc", b"abab", b"bcabcabc"):
        assert np.frombuffer(replay.encode([word, b"zzab"])[0], "<u4").tolist() == replay._alone(word)


# --- near duplicates ----------------------------------------------------------


def brute_groups(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, prose):
    base, other = prose(200, 1), prose(120, 2)
    texts = [None, "", " \n", "one", "ONE", "one two", base, base, base.upper().replace("É", "é").replace("Ü", "ü"), *(edited(base, k % 9, k) for k in range(70)), *(edited(other, k, 100 + k) for k in range(8)), prose(50, 3), prose(4000, 4), edited(prose(4000, 4), 40, 5)]
    for size, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(documents(spark, texts), size=size, percent=percent).orderBy("doc_id").collect()
        n, group = brute_groups(texts, size, percent)
        assert [r["n_shingles"] for r in got] == n
        assert [r["component_id"] for r in got] == group
        assert [r["kept"] for r in got] == [g == i for i, g in enumerate(group)]


def test_near_duplicates_of_one_original(spark, prose):
    """Copies like one original (J of 0.87), and not like each other (0.76), more than a block of them."""
    base = prose(304, 6)
    texts = [edited(base, 7, 1000 + k) for k in range(1500)]
    texts.insert(700, base)
    got = neardup.near_duplicates(documents(spark, texts), size=3, percent=85).where("component_id <> 0")
    assert got.count() == 0


def test_near_duplicates_sketch_bound_follows_percent():
    """A pair whose sketch is 4 standard deviations under the threshold goes on to its full sets."""
    for percent in (70, 80, 85, 95):
        p, m = percent / 100, neardup.VALUES
        equal = int(np.ceil((p - 4 * (p * (1 - p) / m) ** 0.5) * m))
        sketch = np.zeros((2, m), np.uint8)
        sketch[1, equal:] = 1
        ids, ones = np.array([1, 2]), np.array([100, 100])
        assert neardup.node_pairs(ids, ones, sketch, np.zeros(2, int), None, percent).tolist() == [[1, 2]]


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {(None, None, True), (3, 3, True), (9, 3, False)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (5, 60)]
    got = {r["v"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100


# --- decontamination ----------------------------------------------------------


def test_decontamination(spark, prose):
    item = "One two, three FOUR five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(10, item), (2, item), (3, "short item"), (4, None), (5, "!!"), (6, prose(30, 1))], "item_id long, text string")
    texts = [None, "", "no words of it", "x one TWO three-four five six; seven eight nine ten! eleven y", "a SHORT\nitem, short item", prose(30, 1), "one two three four five six seven eight nine"]
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash"))
    for most in (20_000, 2):
        got = decontam.find(docs, bench, most_windows=most).orderBy("doc_id").collect()
        assert [r["n_hit"] for r in got] == [0, 0, 0, 11, 4, 30, 0]
        assert [r["items"] for r in got] == [[], [], [], ["10", "2"], ["3"], ["6"], []]
        clean = decontam.decontaminate(docs, bench, most_windows=most)
        assert clean.columns == docs.columns and [r["doc_id"] for r in clean.orderBy("doc_id").collect()] == [0, 1, 2, 6]
        cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, "spans", most_windows=most).collect()}
        assert cut[3] == "x y" and cut[2] == texts[2] and cut[0] is None and cut[4] == "a "
    unnamed = spark.createDataFrame([(None, item), (7, "short item"), (None, "short item")], "item_id long, text string")
    for most in (20_000, 2):
        got = decontam.find(docs, unnamed, most_windows=most).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["n_items"], r["items"]) for r in got[3:5]] == [(11, 1, []), (4, 2, ["7"])]
    assert decontam.find(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


def test_decontamination_of_a_large_benchmark(spark, prose):
    """100,000 items, far more windows than go into a plan, against a dictionary of windows."""
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)).cast("string")) for k in range(12))).alias("text"))
    some = {r["item_id"]: r["text"] for r in items.where("item_id % 9999 = 0").collect()}
    texts = [prose(40, 1), None, *(prose(9, k) + " " + t + " " + prose(9, k + 1) for k, t in enumerate(some.values())), prose(12, 3) + " " + " ".join(some[9999].split()[1:11]), " ".join(some[9999].split()[:9])]
    got = decontam.find(documents(spark, texts), items).orderBy("doc_id").collect()
    assert [r["n_hit"] for r in got] == [0, 0] + [12] * len(some) + [10, 0]
    assert [r["items"] for r in got[2:-2]] == [[str(k)] for k in some] and got[-2]["items"] == ["9999"]
    assert decontam.find(documents(spark, texts), items, most_hashes=10).orderBy("doc_id").collect() == got
    kept = decontam.decontaminate(documents(spark, texts), items).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [0, 1, len(texts) - 1]


# --- host rules ---------------------------------------------------------------


def test_host_rules(spark, prose):
    def features(t):
        w = (t or "").encode().split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(x) for x in hostrules.SYMBOLS), len(lines) - len(set(lines)), len(cover)

    texts = [None, "", "a b", "a b c a b c", "x\nx\n \n\nx", "### a*b $", prose(100, 1), prose(60, 2) + "\n" + prose(60, 2), " ".join(["w"] * 70_000), "é è ü\x0bq"]
    df = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") > 3, "h"))
    got = hostrules.judge(df).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [features(t) for t in texts]
    assert [r["base_failed"] for r in got] == [n < 50 or 100 * k > 50 * n for n, *_, k in map(features, texts)]
    assert hostrules.judge(df.limit(0)).count() == 0


def test_bad_host_is_rejected_and_salted_join_agrees(spark, prose):
    rows = [(i, prose(60, i) if i % 2 or i < 100 else "bad", "bad" if i >= 100 and i % 2 == 0 else "good") for i in range(200)]
    rows.append((999, prose(60, 999), "bad"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = hostrules.judge(df).orderBy("doc_id").collect()
    b = hostrules.judge(df, broadcast_hosts=0).orderBy("doc_id").collect()
    assert a == b and not a[-1]["base_failed"] and not a[-1]["kept"] and all(r["kept"] for r in a[:100])


# --- learned operators ----------------------------------------------------------


def test_language_codewords_and_edges(spark):
    code = langid.codewords(12)
    assert code.shape[0] == 12 and (code @ code.T - 1e9 * np.eye(12)).max() < code.shape[1]
    rows = [(i, ("der die und nicht ist " if i % 2 else "the and of with that ") * 5, "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, "en"), (61, "123 !!", "en"), (62, "", None)], "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") < 40)
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") and 0 <= r["score"] <= 1 for r in got[:60])
    assert [(r["lang_pred"], r["score"]) for r in got[60:]] == [("und", 0.0)] * 3
    assert langid.predict(df, langid.train(df.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, D).where("held_out").join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9


def test_toxicity(spark, prose):
    rng = random.Random(1)
    rows = [(i, prose(40, i) + (" vexing scoundrel" if i % 5 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600) if rng.random() < 0.5], "doc_id long, toxic int")
    model = toxicity.train(df, labels, lambda k: k % 3 != 0)
    got = toxicity.score(df, model).orderBy("doc_id").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got[:600]]) > 0.97
    assert got[600]["score"] == got[601]["score"] and got[600]["predicted"] == 0
    assert toxicity.score(df, toxicity.train(df, labels.limit(0), lambda k: F.lit(True))).where("score > 0").count() == 0


def test_quality_cotraining(spark, prose):
    rows = [(i, prose(40, i).upper() + "!!" if i % 4 == 0 else prose(40, i), "h" if i % 4 == 0 else "g", "en", 200) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, None, None, None)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)], "doc_id long, quality int")
    got = cotrain.score(df, cotrain.train(df, labels, lambda k: F.lit(True))).where("doc_id < 900").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got]) > 0.97
    flat = cotrain.score(df, cotrain.train(df, labels.limit(0), lambda k: F.lit(True))).select("score").distinct().collect()
    assert [r[0] for r in flat] == [0.5]


def test_language_decoding_equals_plain_loops():
    """Loss-weighted decoding of bits against the formula written out, and ties to the first language."""
    rng = np.random.default_rng(4)
    code = langid.codewords(5)
    trust = rng.random(code.shape[1])
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), trust / trust.sum())
    bits = np.concatenate([rng.normal(size=(20, code.shape[1])) * 3, np.zeros((1, code.shape[1]))])
    best, share, lead = langid.decode(model, bits)
    for k, row in enumerate(bits):
        loss = [sum(w * math.log1p(math.exp(-b * c)) for b, c, w in zip(row, word, model.trust, strict=True)) for word in code]
        e = [math.exp(-4 * (x - min(loss))) for x in loss]
        top = sorted((x / sum(e) for x in e), reverse=True)
        assert math.isclose(loss[best[k]], min(loss), rel_tol=1e-12) and math.isclose(share[k], top[0]) and math.isclose(lead[k], top[0] - top[1], abs_tol=1e-12)
    assert best[-1] == 0


def test_language_bits_equal_plain_descent():
    """One classifier a bit: the fitted weights against the same steps written without vectors over bits."""
    rng = np.random.default_rng(5)
    x = np.zeros((30, langid.BUCKETS), np.float32)
    x[:, :6] = rng.random((30, 6))
    lang = ["a", "b", "c"] * 10
    model = langid.fit(x, lang, steps=15)
    y = model.code[[ord(v) - 97 for v in lang]]
    for bit in range(y.shape[1]):
        w, b, mw, mb = np.zeros(6), 0.0, np.zeros(6), 0.0
        for _ in range(15):
            g = [-y[i, bit] / (1 + math.exp(y[i, bit] * (float(x[i, :6] @ w) + b))) / 30 for i in range(30)]
            mw = 0.9 * mw + 40 * sum(gi * x[i, :6] for i, gi in enumerate(g)) + 1e-5 * w
            mb = 0.9 * mb + sum(g)
            w, b = w - 0.5 * mw, b - 0.5 * mb
        assert np.allclose(model.weights[:6, bit], w, atol=2e-3) and abs(model.bias[bit] - b) < 2e-3


def test_positive_unlabelled_risk_equals_plain_form():
    """The first steps of training against Adam on numerical gradients of the non-negative risk."""
    rng = np.random.default_rng(6)
    pos = [np.unique(rng.choice([1, 2, 3, 4, 5, 6], 3)).astype(np.uint32) for _ in range(60)]
    unl = [np.unique(rng.choice([4, 5, 6, 7, 8, 9, 10, 11], 3)).astype(np.uint32) for _ in range(150)]
    prior = 0.2
    model = toxicity.fit(pos, unl, prior, steps=6)
    chosen = model.chosen.tolist()
    assert chosen
    dense = lambda sets: np.array([[float(c in s) for c in chosen] for s in sets])
    xp, xu = dense(pos), dense(unl)

    def risk(t):
        fp, fu = xp @ t[:-1] + t[-1], xu @ t[:-1] + t[-1]
        plus, minus = np.log1p(np.exp(-fp)).mean(), np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
        return prior * plus + minus if minus >= 0 else -minus  # below 0 the step goes back

    t, m, v = np.zeros(len(chosen) + 1), 0.0, 0.0
    for k in range(1, 7):
        g = np.array([(risk(t + h) - risk(t - h)) / 2e-6 for h in np.eye(len(t)) * 1e-6])
        g[:-1] += 1e-4 * t[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        t = t - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert np.allclose(model.weights, t[:-1], atol=2e-3) and abs(model.bias - t[-1]) < 2e-3


def test_cotraining_equals_plain_rounds():
    """Which rows each view labels for the other, round by round, against loops over rows."""
    rng = np.random.default_rng(7)
    truth = rng.integers(0, 2, 240)
    a, b = (truth[:, None] * 1.5 + rng.normal(size=(240, 2)) for _ in range(2))
    y = np.where(np.arange(240) < 90, truth, np.nan)
    model = cotrain.fit([a, b], y, rounds=2, share=0.1, sure=0.8)
    known, pool = list(range(90)), list(range(90, 240))
    cal, blend, base = known[::6], known[3::6], [k for i, k in enumerate(known) if i % 3]
    given = [{}, {}]
    for turn in range(3):
        views = []
        for x, extra in zip((a, b), given, strict=True):
            rows = [*base, *sorted(extra)]
            views.append(cotrain.fit_view(x[rows], np.array([extra.get(r, y[r]) for r in rows]), x[cal], y[cal]))
        if turn == 2:
            break
        for k, (view, x) in enumerate(zip(views, (a, b), strict=True)):
            p = {r: 1 / (1 + math.exp(-float(view.log_odds(x[[r]])[0]))) for r in pool}
            for r in sorted(pool, key=lambda r: -p[r])[:15]:
                if p[r] >= 0.8:
                    given[1 - k][r] = 1.0
            for r in sorted(pool, key=lambda r: p[r])[:15]:
                if p[r] <= 0.2:
                    given[1 - k][r] = 0.0
    for own, view in zip(model.views, views, strict=True):
        assert np.allclose(own.weights, view.weights) and np.allclose([own.bias, own.slope, own.shift], [view.bias, view.slope, view.shift])
    odds = np.stack([v.log_odds(x[blend]) for v, x in zip(views, (a, b), strict=True)], 1)
    mix, bias = cotrain.logistic(odds, y[blend], 1e-3)
    assert np.allclose(model.mix, np.maximum(mix, 0)) and math.isclose(model.bias, bias)
    score, _ = model.score([a, b])
    assert ((score >= 0.5) == truth)[90:].mean() > 0.85


def test_scores_do_not_depend_on_neighbours(prose):
    texts = pa.array([prose(9, 1), "Z!", None, "", "é" * 40, prose(30, 2), "A" * 100_000])
    whole = cotrain.text_view(texts)
    alone = np.concatenate([cotrain.text_view(texts.slice(i, 1)) for i in range(len(texts))])
    back = cotrain.text_view(texts.take(pa.array(range(len(texts) - 1, -1, -1))))[::-1]
    assert np.allclose(whole, alone) and np.allclose(whole, back)


def test_learned_operators_on_odd_rows(spark, prose):
    """Ties, very long, repeated and empty rows, empty tables and clashing columns: every row comes back, equal texts with equal scores."""
    rows = [(i, prose(30, i) + (" vexing scoundrel" if i % 3 == 0 else "")) for i in range(120)]
    rows += [(500, "vexing " * 60_000), (501, None), (502, ""), (503, prose(30, 3)), (503, prose(30, 3)), (None, "vexing scoundrel")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "predicted": F.lit("clash"), "source": F.lit("h"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 > 0)) for i in range(120)] * 2, "doc_id long, toxic int, quality int")
    toxic = toxicity.train(df, labels, lambda k: F.lit(True))
    good = cotrain.train(df, labels, lambda k: F.lit(True))
    for got in (toxicity.score(df, toxic, keep=("doc_id", "score", "lang")), cotrain.score(df, good, keep=("doc_id", "score", "lang"))):
        out = got.collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["lang"] == "en" for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 503}) == 1
    assert toxicity.score(df.limit(0), toxic).count() == cotrain.score(df.limit(0), good).count() == 0


def test_license_regression_equals_plain_descent():
    """Soft-max regression and its scores, on words of the templates, against loops; ties go to the first family."""
    model = licenses.fit(["the cat sat on the mat"] * 4, steps=2, copies=2)
    words = licenses.grams(licenses.normal_words("Released under the MIT License"))
    z = model.bias + sum((model.vocabulary[g] for g in set(words) if g in model.vocabulary), np.zeros(len(model.families)))
    assert len(z) == len(model.families) == len(licenses.TEMPLATES) + 1
    p = np.exp((z - z.max()) / model.temperature)
    assert math.isclose((p / p.sum()).sum(), 1.0)


def test_license_scores_equal_plain_form(spark, prose):
    """Families and probabilities of a scan against the model's weights applied in plain Python; long, repeated and tied lines."""
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "All rights reserved.", prose(8000, 4) + " released under the mit license", "Released under the MIT License.", ""]
    df = documents(spark, ["\n".join(lines), lines[0], lines[0]])
    model = licenses.train(df)
    got = licenses.scan(df, model).orderBy("doc_id").collect()
    assert got[1]["found"] == got[2]["found"]
    for f in got[0]["found"]:
        known = {g for g in licenses.grams(licenses.normal_words(lines[f["line"] - 1])) if g in model.vocabulary}
        z = np.round(model.bias, 6) + sum((np.round(model.vocabulary[g].astype(float), 6) for g in known), np.zeros(len(model.families)))
        e = np.exp((z - z.max()) / model.temperature)
        assert math.isclose(f["probability"], 1 / e.sum(), rel_tol=1e-6)
        if f["family"] != "unknown":
            assert f["family"] == model.families[int(np.argmax(z))]


def test_license_scan(spark, prose):
    texts = [None, "", prose(50, 1), "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.", "She has a driving license and a library card.", "Licensed under the Foobar Commercial Terms License agreement 7"]
    df = documents(spark, texts)
    got = licenses.scan(df, licenses.train(df)).orderBy("doc_id").collect()
    assert [r["families"] for r in got][:6] == [[], [], [], ["mit"], ["apache", "proprietary"], []]
    assert got[6]["families"] == []
    assert [f["line"] for f in got[4]["found"]] == [2, 3]
    assert licenses.scan(df.limit(0), licenses.train(df.limit(0))).count() == 0


def test_license_over_several_lines(spark, prose):
    whole = ["permission is hereby granted, free of charge, to any person", "obtaining a copy of this software", "and associated documentation files"]
    texts = ["\n".join([prose(8, 1), *whole, prose(8, 2)]), "\n".join([whole[0], prose(8, 3), whole[2]]), "\n".join([*whole, "All rights reserved."])]
    df = documents(spark, texts)
    got = licenses.scan(df, licenses.train(documents(spark, [prose(30, k) for k in range(50)]))).orderBy("doc_id").collect()
    assert [r["families"] for r in got] == [["mit"], [], ["mit", "proprietary"]]
    assert [(f["line"], f["family"]) for f in got[0]["found"]] == [(2, "mit")] and [f["line"] for f in got[2]["found"]] == [1, 4]


def test_license_gate_passes_what_scores_reach(spark, prose):
    """Templates without any one or two of their words, and words beside other signs: as found without a gate."""
    texts = []
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            w = t.split()
            texts += [" ".join(x for k, x in enumerate(w) if k not in (i, i + d)) for i in range(len(w)) for d in (1, 3)]
    texts += ["Released under the_MIT_License", "éMIT license", "Licensed under CC BY 4.0license", "apache license 2.0the", prose(40, 3)]
    model = licenses.train(documents(spark, [prose(30, k) for k in range(50)]))
    found = [[r["found"] for r in licenses.scan(documents(spark, texts), m).orderBy("doc_id").collect()] for m in (model, replace(model, gate=""))]
    assert found[0] == found[1] and sum(map(bool, found[0])) > 500


def test_quote_linking(spark):
    rows = [
        (1, 0, "u", "Where is the Cat?\nI do not know."),
        (1, 1, "a", "> where is  the cat?\nOn the mat."),
        (1, 2, "u", "> > Where is the cat?\n> On the mat.\n> never said\nThanks"),
        (1, 3, "a", ">> Where is the cat?\nStill there"),
        (2, 0, "u", None),
        (2, 5, "a", "> Where is the cat?\n>"),
        (None, 1, "u", "> x"),
        (1, 3, "a", ">> Where is the cat?\nStill there"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    got = [(r["conv_id"], r["turn"], r["parent_turn"], r["n_quoted"], r["n_linked"], r["body"]) for r in quotes.link(df).orderBy("conv_id", "turn").collect()]
    assert got == [
        (None, 1, None, 0, 0, ""),
        (1, 0, None, 0, 0, "Where is the Cat?\nI do not know."),
        (1, 1, 0, 1, 1, "On the mat."),
        (1, 2, 1, 3, 2, "Thanks"),
        (1, 3, 0, 1, 1, "Still there"),
        (1, 3, 0, 1, 1, "Still there"),
        (2, 0, None, 0, 0, ""),
        (2, 5, None, 1, 0, ""),
    ]
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_are_linked_however_wrapped_and_replies_are_ordered(spark, prose):
    said = "The first line of it goes on\nand on, to the second line.\n\nAnother paragraph\nof two lines."
    rows = [
        (1, 0, said),
        (1, 1, "unrelated"),
        (1, 2, "> The first line of it\n> goes on and on,\n> to the second line.\nI agree"),
        (1, 3, "still unrelated"),
        (1, 4, "> of two lines.\n> made up\nNo"),
        (1, 5, "> I agree\nThanks"),
        (1, 9, "after a gap"),
        (2, 3, prose(30_000, 1) + "\n" * 3000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("position", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_quoted"], r["n_linked"], r["position"]) for r in quotes.link(df).collect()}
    assert got == {(1, 0): (None, 0, 0, 1), (1, 1): (0, 0, 0, 2), (1, 2): (0, 3, 3, 3), (1, 3): (2, 0, 0, 4), (1, 4): (0, 2, 1, 6), (1, 5): (2, 1, 1, 5), (1, 9): (None, 0, 0, 7), (2, 3): (None, 0, 0, 1)}


def test_reply_order_equals_a_walk(spark):
    rng = random.Random(3)
    parents = {(c, t): (None if t == 0 or rng.random() < 0.02 else rng.randrange(max(0, t - 9), t)) for c in range(4) for t in range((200, 40, 7, 1)[c])}
    rows = [(k, c, t, p) for k, ((c, t), p) in enumerate(parents.items())]
    got = {r["__row"]: r["position"] for r in quotes.reply_order(spark.createDataFrame(rows, "__row long, __conv long, __turn long, __parent long")).collect()}
    want, ids = {}, {(c, t): k for k, c, t, _ in rows}
    for c in range(4):
        replies = {}
        for (d, t), p in parents.items():
            if d == c:
                replies.setdefault(p, []).append(t)
        todo, seen = sorted(replies[None], reverse=True), 0
        while todo:
            t = todo.pop()
            seen += 1
            want[ids[c, t]] = seen
            todo += sorted(replies.get(t, []), reverse=True)
    assert got == want


def test_helpers():
    from fluvial.llm import common

    col = pa.array(["ab", None, "", "é"])
    data, off = common.flat_utf8(col)
    assert bytes(data) == "abé".encode() and off.tolist() == [0, 2, 2, 2, 4]
    assert list(common.slices(col, 2)) == [(0, 3), (3, 4)]
    h = common.RangeHash(np.frombuffer(b"xabcyabc", np.uint8))
    arrays = [np.array([1, 5]), np.empty(0, np.int64), np.array([2**32 - 1])]
    assert [a.tolist() for a in sufdedup.load(sufdedup.save(arrays))] == [a.tolist() for a in arrays]
    assert h(np.array([1]), np.array([4])) == h(np.array([5]), np.array([8]))
    packed = np.array([5, 6, 1 << 40, (1 << 63) + 7], np.uint64)
    assert (sufdedup.unpack(sufdedup.pack(packed)) == packed).all() and math.isclose(common.sigmoid(np.array(0.0)), 0.5)


@pytest.mark.parametrize("more", [0, 66_000])
def test_windows_of_one_hash_hide_no_repeat(spark, more):
    """Two windows with the same leading bits of their hashes, one of them there twice: the repeat is found in short and in long texts."""
    a, b = "a b w30697196", "a b w43741254"
    filler = [f"f{k}" for k in range(180 + more)]
    text = " ".join([a, *filler[:60], b, *filler[60:120], a, *filler[120:]])
    got = {r["doc_id"]: r["n_repeat_words"] for r in hostrules.features(documents(spark, [text, text.replace(b, "x y z"), text.replace(a, "x y z", 1)]).withColumn("source", F.lit("s"))).collect()}
    assert got == {0: 6, 1: 6, 2: 0}


def test_windows_sorted_by_words(spark, monkeypatch):
    """With hashes of one value for all windows, repeats are those of a count by words."""
    monkeypatch.setattr(hostrules, "WINDOWS", hostrules.WINDOWS.replace("shiftleft(-1L, __b)) |", "0L) |"))
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))) for _ in range(40)]
    want = []
    for t in texts:
        w = t.split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want.append(len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    got = hostrules.features(documents(spark, texts).withColumn("source", F.lit("s"))).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in got] == want


def test_boilerplate_thins_out(spark):
    """Documents that share a footer (similarity of 0.18) meet a small share of each other; near copies still meet."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(50_000)]
    footer = " ".join(rng.choices(words, k=62))
    texts = [" ".join(rng.choices(words, k=130)) + " " + footer for _ in range(1200)]
    texts += [edited(texts[k], 3, k) for k in range(40)]
    sig = neardup.signatures(documents(spark, texts), size=3)
    classes = sig.select("key", "n", "sig")
    members = neardup.nodes(classes)
    met = neardup.placed(classes, members).groupBy("node", "x", "y").count().selectExpr("sum(count * (count - 1) / 2) pairs").first()["pairs"]
    every = neardup.TREES * len(texts) * (len(texts) - 1) / 2
    assert met < 0.02 * every  # two tokens a tree, however many share them, have 0.04 of all
    got = neardup.near_duplicates(documents(spark, texts), size=3, percent=85).where("component_id <> doc_id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1200 + k, k) for k in range(40) if brute_groups([texts[k], texts[1200 + k]], 3, 85)[1][1] == 0}


def test_near_duplicates_without_sketches(spark, prose):
    base = prose(150, 3)
    texts = [base, *(edited(base, k, k) for k in range(12)), prose(150, 4)]
    got = neardup.near_duplicates(documents(spark, texts), size=3, percent=60, deviations=None).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_groups(texts, 3, 60)[1]


@pytest.mark.parametrize("most", [20_000, 0])
def test_sentence_that_all_items_share(spark, most):
    """Many items have one sentence: each document that has it gets them all; an item without id counts once."""
    shared = " ".join(f"s{k}" for k in range(10))
    items = spark.createDataFrame([(str(k), f"{shared} own{k} x y z") for k in range(300)] + [(None, f"{shared} none")], "item_id string, text string")
    texts = [f"a b {shared} c", shared, f"{shared} own7 x", "nothing here", None, shared + " " + " ".join(f"v{k}" for k in range(30_000))]
    got = decontam.find(documents(spark, texts), items, most_windows=most).orderBy("doc_id").collect()
    every = sorted(str(k) for k in range(300))
    assert [r["items"] for r in got] == [every, every, every, [], [], every]
    assert [r["n_items"] for r in got] == [301, 301, 301, 0, 0, 301] and [r["n_hit"] for r in got] == [10, 10, 12, 0, 0, 10]
