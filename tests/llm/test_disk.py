"""What the corpus operators leave on disk while they run."""

import random
import time

from pyspark.sql import functions as F

from siftwell.llm import collocations as C
from siftwell.llm.suffix_dedup import dedup_suffixes


def shuffle_bytes(spark):
    """Bytes of each shuffle file that this machine holds."""
    import os

    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f: os.path.getsize(f) for f in held.split("\n") if f.endswith(".data") and "/shuffle_" in f and os.path.exists(f)}


def left_over(spark, before):
    """Bytes of shuffle files that were not there before; Spark removes them a moment after a query's end."""
    for _ in range(20):
        left = sum(n for f, n in shuffle_bytes(spark).items() if f not in before)
        if left < 50_000:
            break
        time.sleep(0.25)
    return left


def random_texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop ") for _ in range(size)) for _ in range(n)]


def test_suffix_dedup_leaves_no_shuffles_of_its_rounds(spark):
    texts = random_texts(300, 3000, 3)
    df = spark.createDataFrame([(i, texts[i % 250]) for i in range(300)], "doc_id long, text string")
    before = shuffle_bytes(spark)
    done = dedup_suffixes(df, 100, home_bytes=50_000)
    assert left_over(spark, before) < 50_000
    assert done.where("n_removed = n_bytes").count() == 50


def test_blocks_fill_with_one_language(spark):
    docs = [(f"{'word ' * 79}w{i:04d}", f"l{i % 4}") for i in range(40)]
    df = spark.createDataFrame(docs, "text string, lang string").coalesce(1)
    blocks = C._first_level(df, 4, 4000).where(F.col("kind") == C.STATE).select("lang", "block", "n").collect()
    assert sorted((b.lang, b.n) for b in blocks) == [(f"l{i}", 800) for i in range(4)]
    assert len({b.block for b in blocks}) == 4


def test_blocks_meet_their_answers_in_parts(spark, monkeypatch):
    written = []
    whole = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, what: written.append(what) or whole(df, what))
    rng = random.Random(5)
    docs = [(" ".join(rng.choice("abcdef") for _ in range(40)), rng.choice(["en", "de", None])) for _ in range(120)]
    df = spark.createDataFrame(docs, "text string, lang string")
    got = {tuple(r) for r in C.frequent_phrases(df, 6, 4, block_bytes=70, bucket_bytes=2000)[0].collect()}
    assert [written.count(f"postings-{level}") for level in (1, 2, 3, 4)] == [1, 4, 4, 4]
    assert got == {tuple(r) for r in C.frequent_phrases(df, 6, 4)[0].collect()} and {r[2] for r in got} == {1, 2, 3, 4}
    assert written.count("postings-2") == 5
