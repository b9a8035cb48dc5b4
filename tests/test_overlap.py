"""Overlap scores, stems and words of scripts without spaces against plain rules."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions import words as W
from siftwell.operators import overlap as O
from siftwell.plans import registry

# The examples of the paper that describes the stemmer.
STEMS = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dies die flies fli died die spied spi dying die news news""".split()


def test_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert W.stem(word) == stem, word
    assert W.stemmed_words("The Ponies' 12 cats, sky-high") == ["the", "poni", "12", "cat", "sky", "high"]


def test_means_of_short_answers(spark):
    rows = spark.createDataFrame([(1, "a b c", "a b d"), (2, "a b c", "a b c"), (3, "cats", "cat"), (4, None, None), (5, "x", "x")], "i long, r string, c string")
    one, two, three, none, single = O.overlap_scores(rows, "r", "c").orderBy("i").collect()
    # precisions 2/3, 1/2 and, smoothed, 1/2
    bleus = (2 / 3, (2 / 3 * 1 / 2) ** (1 / 2), (2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    assert one.bleu == 0 and one.bleu_mean == pytest.approx(sum(bleus) / 3, abs=1e-6)
    assert one.rouge_mean == pytest.approx((2 / 3 + 1 / 2 + 2 / 3) / 3, abs=1e-6)
    assert two.bleu_mean == two.rouge_mean == 1
    assert three.bleu_mean == 0.5 and three.rouge_mean == pytest.approx(2 / 3, abs=1e-6)  # one stem has no word pair
    assert (none.bleu, none.bleu_char, none.rouge_l, none.rouge_mean) == (0, 0, 0, 0)
    assert single.bleu_mean == 1


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(0, 4), max_size=80))
def test_common_length(a, b):
    assert O.common_length(a, b) == plain_common(a, b)


@settings(max_examples=100, deadline=None)
@given(st.text("甲乙丙", min_size=1, max_size=9), st.dictionaries(st.text("甲乙丙", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
def test_paths_are_the_most_likely(text, counts):
    lexicon = W.Lexicon(counts)
    total = sum(counts.values()) + 1

    def weight(words):
        return sum(math.log(counts[w] if w in counts else 0.5) - math.log(total) for w in words)

    ways = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        words = [text[a:b] for a, b in itertools.pairwise(edges)]
        if all(len(w) == 1 or w in counts for w in words):
            ways.append(weight(words))
    found = lexicon.path(text)
    assert "".join(found) == text and weight(found) == pytest.approx(max(ways))


def test_segments_of_mixed_text():
    lexicon = W.Lexicon({"北京": 9, "大学": 9, "北京大学": 30, "生": 5})
    assert W.segment("我在北京大学生 abc-1 é!", lexicon) == ["我", "在", "北京大学", "生", "abc", "-", "1", "é", "!"]
    assert W.segment("", lexicon) == [] and W.Lexicon({}).path("北") == ["北"]


def plain_scores(reference, candidate, cut):
    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    def f(a, b, n):
        hit = sum((grams(a, n) & grams(b, n)).values())
        return 2 * hit / (sum(grams(a, n).values()) + sum(grams(b, n).values())) if hit else 0.0

    def chars(a, b):
        if not set(a) & set(b):
            return 0.0
        value, misses = 1.0, 0
        for n in (1, 2, 3, 4):
            hit, of = sum((grams(a, n) & grams(b, n)).values()), max(1, len(b) - n + 1)
            misses += hit == 0
            value *= (hit / of if hit else 0.5**misses / of) ** 0.25
        return value * min(1.0, math.exp(1 - len(a) / len(b)))

    a, b = cut(reference), cut(candidate)
    both = plain_common(a, b)
    return tuple(round(100 * x, 4) for x in (chars(reference, candidate), f(a, b, 1), f(a, b, 2), 2 * both / (len(a) + len(b)) if both else 0.0))


@pytest.mark.parametrize("name", ["overlap_scores", "segmented_overlap_scores"])
def test_queries_match_a_loop(spark, sf_dir, name):
    """All rows of the queries, from the same texts."""
    from siftwell.plans.catalog import scores as Q

    rows = Q.replies(spark, sf_dir).collect()
    got = {(r.conv_id, r.turn): tuple(r[c] for c in ("bleu_char", "rouge_1", "rouge_2", "rouge_l")) for r in registry.queries()[name](spark, sf_dir).collect()}
    cut, turned = str.split, lambda t: t
    if name.startswith("segmented"):
        turned = lambda t: re.sub("[^a-z]", "", t.lower()).translate(str.maketrans(Q.LETTERS, Q.HAN))
        texts = spark.createDataFrame([(turned(t),) for r in rows for t in (r.reference, r.candidate)], "t string")
        lexicon = W.Lexicon({r.word: r.n for r in O.count_lexicon(texts, "t").collect()})
        cut = lexicon.path
    assert len(got) == len(rows)
    for r in random.Random(1).sample(rows, min(len(rows), 300)):
        want = plain_scores(turned(r.reference), turned(r.candidate), cut)
        assert got[r.conv_id, r.turn] == pytest.approx(want, abs=2e-4)
