"""Overlap of texts: BLEU and ROUGE of every row, and the lexicon for scripts without spaces.

Sequences are compared as arrays of small numbers, each distinct word of an Arrow batch being cut, lower-cased or stemmed
once; the longest common subsequence is bit-parallel, so it takes one wide addition a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import words as W

#: Characters of scripts that don't part words, as a pattern of the JVM.
HAN_RUN = r"([぀-ヿ㐀-䶿一-鿿]+)"


def count_lexicon(df: DataFrame, text: str, longest: int = 4, least: int = 5, cohesion: float = 8.0, most: int = 200_000) -> DataFrame:
    """word, n of the strings of a script without spaces that hold together.

    A string of 2 to ``longest`` characters is a word if it occurs ``least`` times and, at every cut, ``cohesion``
    times as often as its two parts would meet by chance; single characters always are.  Counts cover all
    texts; the ``most`` words of the largest counts (ties: the smaller word) are kept, which bounds what is broadcast.
    """
    runs = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(HAN_RUN), F.lit(1))).alias("run"))
    sized = runs.select("run", F.explode(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(longest)))).alias("size"))
    grams = sized.select("size", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1), lambda i: F.substring(F.col("run"), i, F.col("size")))).alias("word"))
    counts = grams.groupBy("word", "size").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("size") == 1))
    total = counts.where("size = 1").agg(F.sum("n").alias("total"))
    known = counts.select("word", "n")
    part = lambda a, b: F.substring(F.col("word"), a, b)
    cuts = counts.where("size > 1").select("word", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("word", "n", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size")).alias("tail"))
    cuts = cuts.join(known.select(F.col("word").alias("head"), F.col("n").alias("x")), "head").join(known.select(F.col("word").alias("tail"), F.col("n").alias("y")), "tail").crossJoin(F.broadcast(total))
    held = cuts.groupBy("word").agg(F.first("n").alias("n"), F.min(F.col("n") * F.col("total") / (F.col("x") * F.col("y"))).alias("bond")).where(F.col("bond") >= cohesion)
    return held.select("word", "n").unionByName(counts.where("size = 1").select("word", "n")).orderBy(F.col("n").desc(), "word").limit(most)


# ---- scores of two sequences ---------------------------------------------------------------


def _grams(words: Sequence, n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


def bleu(reference: Sequence, candidate: Sequence, most: int = 4, effective: bool = False) -> float:
    """Geometric mean of clipped n-gram precisions and a brevity penalty; the k-th precision of 0 counts as 1 / (2^k n).

    A candidate without n-grams of a size counts 0, or, with effective, by the sizes that it has.
    """
    if not candidate or not reference:
        return 0.0
    total, smooth, orders = 0.0, 1.0, most
    for n in range(1, most + 1):
        c, r = _grams(candidate, n), _grams(reference, n)
        hit, all_ = sum(min(k, r[g]) for g, k in c.items()), sum(c.values())
        if not all_:
            if not effective:
                return 0.0
            orders = n - 1
            break
        if not hit:
            smooth *= 2
        total += log(hit / all_ if hit else 1 / (smooth * all_))
    return exp(total / orders) * (1.0 if len(candidate) >= len(reference) else exp(1 - len(reference) / len(candidate)))


def bleu_of_characters(reference: str, candidate: str) -> float:
    """BLEU-4 of characters: without a common one 0; sizes that the candidate is too short for are smoothed as misses."""
    if not candidate or not set(reference) & set(candidate):
        return 0.0
    total, misses = 0.0, 0
    for n in range(1, 5):
        c, r = _grams(candidate, n), _grams(reference, n)
        hit, all_ = sum(min(k, r[g]) for g, k in c.items()), max(1, sum(c.values()))
        misses += not hit
        total += log(hit / all_ if hit else 1 / (2**misses * all_)) / 4
    return exp(total) * (1.0 if len(candidate) > len(reference) else exp(1 - len(reference) / len(candidate)))


def rouge_n(reference: Sequence, candidate: Sequence, n: int) -> float:
    r, c = _grams(reference, n), _grams(candidate, n)
    hit = sum(min(k, c[g]) for g, k in r.items())
    return 2 * hit / (sum(r.values()) + sum(c.values())) if hit else 0.0


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence: a row of the table is one number, a zero bit where it grows."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        met = row & where.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def rouge_l(reference: Sequence, candidate: Sequence) -> float:
    both = common_length(reference, candidate)
    return 2 * both / (len(reference) + len(candidate)) if both else 0.0


SCORES = ("bleu", "bleu_char", "rouge_1", "rouge_2", "rouge_l", "bleu_mean", "rouge_mean")


def overlap_scores(df: DataFrame, reference: str, candidate: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Scores of every row's candidate against its reference; nulls count as empty.

    times 100: bleu (words), bleu_char (four-grams of characters), rouge_1, rouge_2, rouge_l (words).
    In 0..1: bleu_mean of BLEU-1 to BLEU-3 over words with punctuation apart, rouge_mean of the three ROUGE values
    over English stems.  lexicon (word, n: ``count_lexicon``; broadcast, so bounded) cuts runs without spaces into words.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    sent = None
    if lexicon is not None:
        sent = df.sparkSession.sparkContext.broadcast({r.word: r.n for r in lexicon.select("word", "n").toLocalIterator()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = W.Lexicon(sent.value) if sent is not None else None
        cut = (lambda t: W.segment(t, known)) if known else str.split

        def one(r: str, c: str) -> tuple[float, ...]:
            a, b = cut(r), cut(c)
            stems, plain = [W.stemmed_words(t) for t in (r, c)], [W.international_words(t) for t in (r, c)]
            rouge = [rouge_n(a, b, 1), rouge_n(a, b, 2), rouge_l(a, b)]
            means = sum(bleu(*plain, n, True) for n in (1, 2, 3)) / 3, (rouge_n(*stems, 1) + rouge_n(*stems, 2) + rouge_l(*stems)) / 3
            return *(round(100 * x, 4) for x in (bleu(a, b), bleu_of_characters(r, c), *rouge)), *(round(x, 6) for x in means)

        for pdf in batches:
            made = [one(r or "", c or "") for r, c in zip(pdf[reference], pdf[candidate], strict=True)]
            yield pdf.assign(**{n: pd.Series([m[i] for m in made], index=pdf.index, dtype="float64") for i, n in enumerate(SCORES)})

    return df.mapInPandas(run, schema + ", " + ", ".join(f"{n} double" for n in SCORES))
