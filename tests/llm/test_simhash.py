"""Operator 12 against plain forms: fingerprints a shingle at a time, and all pairs of fingerprints."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fluvial.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_code(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            count[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * count[bit] > len(shingles))


def plain_groups(codes: list[int], most: int) -> list[int]:
    """The smallest place that can be reached from each."""
    group = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def made_codes(rng, n: int) -> np.ndarray:
    """Codes at random, near a few centres, and in a dense run."""
    centres = rng.integers(0, 1 << 63, 4)
    near = [int(rng.choice(centres)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(n)]
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), np.array(near, np.uint64), np.arange(n, dtype=np.uint64) << np.uint64(40)]))
    return codes[np.argsort(simhash.gray_rank(codes))]


def test_fingerprints_equal_plain_ones():
    rng = np.random.default_rng(1)
    texts = ["", None, " \t\n", "a", "A b", "a  b\tc\n d E", "É x Ünï y z", " led and trailed "]
    texts += [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 60))) for _ in range(60)] + ["lorem ipsum dolor " * 12_000]
    assert [int(c) for c in simhash.simhash(pa.array(texts))] == [plain_code(t) for t in texts]


def test_gray_rank_orders_neighbours():
    codes = np.arange(1 << 10, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@pytest.mark.parametrize(("n", "most"), [(1, 4), (40, 4), (300, 0), (300, 4), (300, 12), (300, 64)])
def test_index_finds_all_links(n, most):
    codes = made_codes(np.random.default_rng(n + most), n)
    want = np.array(plain_groups(codes.tolist(), most))
    assert (simhash.forest(simhash.Index(codes), None, most)[1] == want).all()
    third, label = max(1, len(codes) // 3), np.arange(len(codes))
    place = {int(c): i for i, c in enumerate(codes)}
    for x, y in ((codes[:third], None), (codes[third:], None), (codes[:third], codes[third:])):
        if len(x) and (y is None or len(y)):
            flat, found = simhash.forest(simhash.Index(x), None if y is None else simhash.Index(y), most)
            at = np.array([place[int(c)] for c in flat])
            label = simhash.merged(label, at, at[found])
    assert (label == want).all()


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_links_of_any_number_of_blocks(spark, blocks):
    codes = made_codes(np.random.default_rng(5), 250)
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    got = [(place[r["a"]], place[r["b"]]) for r in simhash.links(frame, 4, blocks).collect()]
    a, b = np.array(got).T
    assert (simhash.merged(np.arange(len(codes)), a, b) == np.array(plain_groups(codes.tolist(), 4))).all()
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 64).all() and len(got) < 4 * blocks * len(codes)


def test_documents(spark):
    """Null and empty texts and texts without words link; repeated rows, ties, clashing columns and null ids have a defined result."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    rows = [(k, base[k % 6] if k % 3 else base[k % 6].replace(words[int(rng.integers(3000))], "x")) for k in range(10, 60)]
    rows += [(70, None), (71, ""), (72, " \n"), (73, "one"), (74, "ONE"), (75, "one two three"), (10, base[4]), (10, base[4]), (None, base[0]), (None, "alone " * 9)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, code string, fingerprint string, component_id string")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = sorted(map(tuple, got.collect()), key=str)
    codes = [plain_code(t) for _, t in rows]
    group = plain_groups(codes, 4)
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    assert found == sorted(((i, f"{c:016x}", least[g]) for (i, _), c, g in zip(rows, codes, group, strict=True)), key=str)
    assert {r[2] for r in found if r[0] in (70, 71, 72)} == {70}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_plain_form(spark):
    from fluvial.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    codes = [plain_code(texts[i]) for i in ids]
    want = [(i, f"{c:016x}", ids[g]) for i, c, g in zip(ids, codes, plain_groups(codes, 4), strict=True)]
    assert sorted(map(tuple, queries.QUERIES["op12_simhash"](spark, sf).collect())) == want
