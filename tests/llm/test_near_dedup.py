import random
import re

import numpy as np
import pytest

from siftwell.llm import near_dedup
from siftwell.llm.near_dedup import distinct_documents, near_duplicates, sketch_limit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, share=(85, 100), width=5):
    sets = []
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        sets.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    by = {}
    for i, (doc_id, _) in enumerate(docs):
        by[find(i)] = min(by.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), by[find(i)], d == by[find(i)]) for i, (d, _) in enumerate(docs))


def made(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 40, 120]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i * 7 % (n * 7), (" " if rng.random() < 0.5 else "\n").join(w)))
    return [*docs, (100001, None), (100002, ""), (100003, " \t\n"), (100004, ""), (100005, "One"), (100006, "one"), (100007, "x y Éa"), (100008, "x y éa")]


def test_matches_brute_force(spark):
    docs = made()
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), (85, 100))
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_sample_table_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), (85, 100))
    assert sorted(map(tuple, got.collect())) == brute(docs)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == ([] if not rows else sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str))


def test_different_texts_of_one_id_stay(spark):
    a, b, c = ("one two three four five six seven", "red green blue black white brown", "north east south west up down")
    docs = [(1, a), (1, b), (1, None), (1, ""), (2, b), (3, c), (3, c), (4, c), (None, a), (None, a)]
    got = distinct_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("1", a), ("1", ""), ("2", b), ("3", c), ("None", a), ("None", a)])


def test_sketch_limit_holds_for_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    limit, counts = sketch_limit((85, 100)), []
    for _ in range(4000):
        parity = np.zeros(512, bool)
        for _ in range(rng.binomial(96, 0.15)):
            for bit in rng.integers(0, 512, 2):
                parity[bit] ^= True
        counts.append(int(parity.sum()))
    assert max(counts) <= limit and sketch_limit((85, 100), 0.02) == pytest.approx(np.quantile(counts, 0.98), abs=3)


def test_mixed_buckets_are_compared_whole(spark):
    """Many documents that share most of their words, some of them linked, meet in cells of few rows."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for i in range(300):
        own = [f"o{i // 2}x{j}" for j in range(rng.choice([6, 14, 30]))] if i % 2 == 0 else docs[-1][1].split()[60:]
        docs.append((i, " ".join([*common, *own[: len(own) - (i % 4 == 1)]])))
    old, near_dedup.CELL = near_dedup.CELL, 16
    try:
        got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), (85, 100))
        assert sorted(map(tuple, got.collect())) == brute(docs)
    finally:
        near_dedup.CELL = old


def test_very_long_and_short_texts_together(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = [*long[:58_000], *(f"v{i}" for i in range(2000))]
    docs = [(1, " ".join(long)), (2, " ".join(other)), *((10 + i, f"a{i % 50} b c") for i in range(3000))]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), (85, 100)).collect()}
    assert got[1].n_shingles == len({tuple(long[i : i + 5]) for i in range(len(long) - 4)})
    assert got[2].component_id == 1 and len({got[10 + i].component_id for i in range(3000)}) == 50
