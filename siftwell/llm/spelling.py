"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter that it holds an odd number of times.  One inserted or
deleted letter flips one bit, one replaced letter at most two, so of three bands (letters dealt
by code point modulo 3) at least one is equal, after an insertion or deletion even two.

Words of equal length meet where a band is equal; words whose lengths differ by one meet where
two bands are equal.  Either way the half of the word that the edit leaves alone is part of the
join key too (an edit lies before or behind the middle), so that a key's words stay few as the
vocabulary grows.  Each pair is counted at its first equal key only and verified by its edit
distance.  All steps are joins and aggregations inside the JVM; occurrences are counted
map-side before any shuffle.

Defined cases: a null text has no words; a null doc_id counts as an empty text in the hash that
chooses a letter to drop; repeated rows count each time; an empty table gives no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, shuffled

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bands of a mask, and the bits of each (letters of one bit only cost a look).
BANDS, BAND_BITS = 3, 21
#: A form is followed by one of at least RATIO times its count, so chains are short: this many doublings do.
DOUBLINGS = 6


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 199) -> DataFrame:
    """word, n: runs of letters, lower-cased, of which every drop_every-th (by hash) has lost a letter."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(drop_every)) == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """One bit for each letter (by code point), set if the word holds it an odd number of times; band by band."""

    def bit(letter: Column) -> Column:
        code = F.ascii(letter)
        place = code % BANDS * BAND_BITS + F.floor(code / BANDS) % BAND_BITS
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, letter: mask.bitwiseXOR(bit(letter)))


def band(mask: Column, *which: int) -> Column:
    """The bits of some bands."""
    return mask.bitwiseAND(F.lit(sum(((1 << BAND_BITS) - 1) << (BAND_BITS * i) for i in which)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_b: each ordered pair of words that are exactly one edit apart."""
    w = materialise(words.select("word", "n", parity_mask(F.col("word")).alias("mask")), "masks")
    return materialise(_replaced(w).unionByName(_inserted(w)), "near")


def _half(shorter: Column, front: bool) -> Column:
    """The first half of the shorter word's length, or what of that length is behind it."""
    h = F.floor(shorter / 2).cast("int")
    return F.substring("word", F.lit(1), h) if front else F.substring("word", F.length("word") - (shorter - h) + 1, shorter - h)


def _keyed(w: DataFrame, name: str, shorter: Column, bands: list[tuple[int, ...]]) -> DataFrame:
    """Each word under its keys: the shorter word's length, which bands and half (slot), their bits and letters."""
    keys = F.array(*(F.struct(shorter.cast("short").alias("len"), F.lit(2 * i + front).cast("byte").alias("slot"), band(F.col("mask"), *some).alias("bits"), _half(shorter, front == 0).alias("half")) for i, some in enumerate(bands) for front in (0, 1)))
    return w.select(F.explode(keys).alias("key"), *(F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "mask"))).select("key.*", f"{name}_word", f"{name}_n", f"{name}_mask")


_KEY = ["len", "slot", "bits", "half"]


def _replaced(w: DataFrame) -> DataFrame:
    """Words of one length: the letter replaced stands in one half, so the other half is equal, and a band is."""
    bands = [(i,) for i in range(BANDS)]
    a, b = (_keyed(w, side, F.length("word"), bands) for side in "ab")
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(band(F.col("a_mask"), i) == band(F.col("b_mask"), i), F.lit(i)).otherwise(first)
    same = (F.col("a_word") < F.col("b_word")) & (F.floor(F.col("slot") / 2) == first)
    return _both_ways(shuffled(a).join(shuffled(b), _KEY).where(same & (F.levenshtein("a_word", "b_word", 1) == 1)))


def _inserted(w: DataFrame) -> DataFrame:
    """Words whose lengths differ by one: exactly one bit differs, so two bands are equal, and the half before
    or behind the extra letter.  Where both halves are (a repeated letter), the first counts."""
    bands = [(i, j) for i in range(BANDS) for j in range(i + 1, BANDS)]
    a, b = _keyed(w, "a", F.length("word"), bands), _keyed(w, "b", F.length("word") - 1, bands)
    h = F.floor(F.length("a_word") / 2).cast("int")
    front = F.substring("a_word", F.lit(1), h) == F.substring("b_word", F.lit(1), h)
    once = (F.col("slot") % 2 == 0) | ~front
    return _both_ways(shuffled(a).join(shuffled(b), _KEY).where(once & (F.levenshtein("a_word", "b_word", 1) == 1)))


def _both_ways(pairs: DataFrame) -> DataFrame:
    way = lambda x, y: F.struct(F.col(f"{x}_word").alias("a"), F.col(f"{y}_word").alias("b"), F.col(f"{y}_n").alias("n_b"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")


def spelling_forms(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 199, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text).

    A word's form is the near word of the largest count (ties: the smallest) if that is at least
    ratio times its own; root follows forms to the last.
    """
    words = materialise(word_counts(docs, least_length, least_count, drop_every), "words")
    best = near_pairs(words).groupBy(F.col("a").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    known = words.join(shuffled(best), words.word == best.of, "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
    known = materialise(known.select("word", "n", "n_near", "to.form", "to.form_n"), "forms")
    roots = _roots(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return known.join(shuffled(roots.withColumnRenamed("word", "of")), F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame) -> DataFrame:
    """Each word with the end of its chain, by doubling; counts grow along a chain, so there are no cycles."""
    for _ in range(DOUBLINGS):
        on = links.select(F.col("word").alias("of"), F.col("root").alias("further"))
        step = materialise(links.join(shuffled(on), F.col("root") == F.col("of"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return links
