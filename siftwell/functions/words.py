"""Words of texts: English stems, tokens of the overlap scores, and words of scripts written without spaces.

``segment`` cuts a run of Han or Kana characters along the most likely path through its word
lattice: from each place lead the lexicon's words that start there (found in a trie) and the
single character, and a path's likelihood is the product of its words' shares.  The lexicon is
counted from texts (``operators.overlap.count_lexicon``) or given.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

# ---- stems -----------------------------------------------------------------------------------

# The rules of Porter's stemmer (1980) with the usual later additions.  Each step takes the longest
# suffix that fits; a rule holds if the measure of what is left exceeds its number.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _closed(word: str) -> bool:
    """Ends with consonant, vowel, consonant (the last not w, x or y), or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _rule(word: str, rules: dict[str, str], above: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            left = word[: len(word) - len(suffix)]
            if suffix == "ion" and left[-1:] not in ("s", "t"):
                return word
            tested = left + "l" if suffix == "logi" else left
            return left + rules[suffix] if measure(tested) > above else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        left = word[: -len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(left):
                return word
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if len(left) > 1 and left[-1] == left[-2] and _shape(left)[-1] == "c":
                return left if left[-1] in "lsz" else left[:-1]
            return left + "e" if measure(left) == 1 and _closed(left) else left
    return word


def _last(word: str) -> str:
    if word.endswith("e"):
        left = word[:-1]
        m = measure(left)
        word = left if m > 1 or (m == 1 and not _closed(left)) else word
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and measure(word[:-4]) > 0:
        word = word[:-2]
    word = _rule(word, STEP_2, 0)
    return _last(_rule(_rule(word, STEP_3, 0), STEP_4, 1))


def stemmed_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits, words of over three letters by their stems."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())]


def international_words(text: str) -> list[str]:
    """Words with punctuation (but inside numbers) and symbols apart."""
    import regex

    text = regex.sub(r"(\P{N})(\p{P})", r"\1 \2 ", text)
    text = regex.sub(r"(\p{P})(\P{N})", r" \1 \2", text)
    return regex.sub(r"(\p{S})", r" \1 ", text).split()


# ---- words without spaces -------------------------------------------------------------------

#: Characters of scripts that don't part words, runs of other word characters, single other signs.
PIECES = re.compile(r"([぀-ヿ㐀-䶿一-鿿\U00020000-\U0002ffff]+)|([^\W぀-ヿ㐀-䶿一-鿿\U00020000-\U0002ffff]+)|\s+|(.)")


class Lexicon:
    """Words with counts, held in a trie; what is missing counts half an occurrence a character."""

    def __init__(self, counts: dict[str, int]):
        self.total = log(sum(counts.values()) + 1)
        self.missing = log(0.5) - self.total
        self.trie: dict = {}
        for word, n in counts.items():
            if word and n > 0:
                node = self.trie
                for letter in word:
                    node = node.setdefault(letter, {})
                node[""] = log(n) - self.total

    def starting(self, text: str, at: int) -> list[tuple[int, float]]:
        """Ends of the words that start at a place, with their weights; the single character is always one."""
        out, node = [], self.trie
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                out.append((end + 1, node[""]))
        return out if out and out[0][0] == at + 1 else [(at + 1, self.missing), *out]

    def path(self, text: str) -> list[str]:
        """The most likely words of a run; of equally likely ones those that start with the longer word."""
        best = [(0.0, len(text))] * (len(text) + 1)
        for at in range(len(text) - 1, -1, -1):
            best[at] = max((weight + best[end][0], end) for end, weight in self.starting(text, at))
        out, at = [], 0
        while at < len(text):
            out.append(text[at : best[at][1]])
            at = best[at][1]
        return out


def segment(text: str, lexicon: Lexicon) -> list[str]:
    """The words of a text: runs without spaces along the lexicon's best path, other runs as they stand."""
    out: list[str] = []
    for run, word, sign in PIECES.findall(text):
        out += lexicon.path(run) if run else [x for x in (word, sign) if x]
    return out
