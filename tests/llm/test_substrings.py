import hashlib
import random
import re

import numpy as np
import pytest

from siftwell.llm import superwindows as S
from siftwell.llm.lyndon_sort import common_prefixes, suffix_array
from siftwell.llm.substring_dedup import dedup_substrings
from siftwell.llm.suffix_dedup import dedup_suffixes


def test_suffix_array_matches_sorting():
    rng = random.Random(5)
    for _ in range(400):
        t = [rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(0, 40))] + [0]
        order = suffix_array(np.array(t))
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = common_prefixes(t, order, 0)
        for r in range(1, len(t)):
            a, b = t[order[r - 1] :], t[order[r] :]
            assert lcp[r] == next(i for i in range(len(t)) if a[i] != b[i])


def brute(docs, length, symbols, join):
    """Window by window, in order of (doc_id, null last, text) and place."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        s = symbols(text or "")
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            w = tuple(s[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = join([x for x, g in zip(s, gone, strict=True) if not g])
        out.append((doc_id, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=70):
    rng = random.Random(seed)
    vocabulary = ["the", "ab", "x", "wörd", "日本", "zz."]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[a : a + rng.randrange(10, 200)]
            if rng.random() < 0.4 and p:
                a = rng.randrange(len(p))
                p = p[:a] + rng.choice("qé ") + p[a + 1 :]
            parts.append(p)
        docs.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "\n", "  "]).join(parts)))
    return [*docs, (5, None), (6, ""), (None, passages[0]), (None, None), (7, "a" * 900), (8, passages[1]), (8, passages[1]), (9, "b " * 300)]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", t.encode())


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_match_brute_force(spark, seed):
    docs = made(seed)
    got = dedup_suffixes(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, home int"), 100, home_bytes=3000)
    want = brute(docs, 100, lambda t: list(t.encode()), bytes)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_words_match_brute_force(spark, batches):
    docs = made(batches + 10)
    got = dedup_substrings(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, home int"), batches, home_bytes=3000, fan_in=2)
    want = [(a, b, c, e) for a, b, c, _, e in brute(docs, 20, words, b" ".join)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_suffixes(none).count() == 0
    assert dedup_substrings(none).count() == 0


def test_sample_table_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, dedup_suffixes(df, home_bytes=100_000).collect()), key=str)
    assert got == brute(docs, 100, lambda t: list(t.encode()), bytes)
    got = sorted(map(tuple, dedup_substrings(df, home_bytes=100_000).collect()), key=str)
    assert got == sorted(((a, b, c, e) for a, b, c, _, e in brute(docs, 20, words, b" ".join)), key=str)


def test_texts_and_spans_agree(spark):
    docs = [(i, t) for i, t in made(4, 30) if i is not None and i != 8]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in dedup_suffixes(df, 100, home_bytes=3000, texts=True, spans=True).collect():
        raw = (dict(docs)[r.doc_id] or "").encode()
        for x in reversed(r.removed):
            raw = raw[: x.start] + raw[x.start + x.length :]
        assert hashlib.sha256(raw).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans
        gone = {i for x in r.removed for i in range(x.start, x.start + x.length)}
        at, kept = 0, []
        for c in dict(docs)[r.doc_id] or "":
            n = len(c.encode())
            kept += [c] if not gone.issuperset(range(at, at + n)) else []
            at += n
        assert "".join(kept) == r.kept_text
    for r in dedup_substrings(df, 2, home_bytes=3000, texts=True, spans=True).collect():
        w = words(dict(docs)[r.doc_id] or "")
        for x in reversed(r.removed):
            del w[x.start : x.start + x.length]
        assert b" ".join(w).decode() == r.kept_text and len(w) == r.n_words - r.n_removed


def test_contents_that_share_half_their_check_are_no_repeats():
    anchor = np.array([7, 7, 9], np.uint64)
    check = np.array([5, 5 + (1 << 32), 1 << 63], np.uint64)
    first, second = (S.unpack_entries(S.pack_entries(anchor[[i, 2]], check[[i, 2]])) for i in (0, 1))
    assert second[0].tolist() == [7, 9] and second[1].tolist() == check[1:].tolist()
    home = np.array([0, 0, 1, 1], np.int32)
    both = np.r_[first[0], second[0]], np.r_[first[1], second[1]]
    code, _, lead = S.judge(*both, home, np.zeros(4, bool))
    assert code.tolist() == [S.OPEN, S.UNIQUE, S.OPEN, S.REPEAT] and lead.tolist() == [True, True, True, False]
    code, ask, lead = S.judge(*both, home, np.array([True, True, False, False]), verify=True)
    assert code.tolist() == [S.OPEN] * 4 and ask.tolist() == [True, True, False, False] and lead.tolist() == [True, True, True, False]
    assert S.judge(*both, home, np.ones(4, bool), verify=True)[0].tolist() == [S.UNIQUE] * 4
    run = S.unpack_entries(S.pack_entries(anchor, check, np.array([3, 4, 5], np.int32)))
    assert [c.tolist() for c in run] == [anchor.tolist(), check.tolist(), [3, 4, 5]]


def test_runs_are_merged_in_order():
    rng = np.random.default_rng(3)
    parts = []
    for h in range(9):
        a, c = rng.integers(0, 40, 30).astype(np.uint64), rng.integers(0, 5, 30).astype(np.uint64)
        o = np.lexsort((c, a))
        parts.append((a[o], c[o], np.full(30, h, np.int32)))
    a, c, h = (np.concatenate(x) for x in zip(*parts))
    got, want = S.merged_order(a, c, h), np.lexsort((h, c, a))
    assert (a[got] == a[want]).all() and (c[got] == c[want]).all() and (h[got] == h[want]).all()
    assert len(S.merged_order(a[:0], c[:0], h[:0])) == 0


def test_the_registered_query_compacts(spark, sf_dir, monkeypatch):
    from siftwell.llm import substring_dedup
    from siftwell.llm.queries import op1_substring_dedup

    seen = []
    whole = substring_dedup.FingerprintIndex.compact
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self: (seen.append(len(self.runs)), whole(self)))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op1_substring_dedup(spark, sf_dir).collect()), key=str)
    assert got == sorted(((a, b, c, e) for a, b, c, _, e in brute(docs, 20, words, b" ".join)), key=str) and seen == [3]


def quick(docs, length, symbols, join):
    """brute for long texts: windows are kept by hash, as the texts are made of few values."""
    seen, out = set(), []
    for doc_id, text in docs:
        s = symbols(text)
        gone = np.zeros(len(s) + 1, np.int64)
        for i in range(len(s) - length + 1):
            w = hash(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length])
            if w in seen:
                gone[i] += 1
                gone[min(i + length, len(s))] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        out.append((doc_id, len(s), int(gone.sum()), hashlib.sha256(join([x for x, g in zip(s, gone.tolist(), strict=True) if not g])).hexdigest()))
    return out


def test_texts_longer_than_the_chunks(spark):
    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(10**7)}" for _ in range(140_000))  # over 2**17 words and 2**20 bytes
    docs = [(1, text), (2, text[900_000:1_150_000] + " z " + text[:700]), (3, "x " + text[-400_000:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in dedup_suffixes(df).collect())
    assert got == quick(docs, 100, str.encode, bytes)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, 2).collect())
    assert got == quick(docs, 20, words, b" ".join)


def test_windows_longer_than_a_byte_counts(spark):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(3000))
    docs = [(1, text), (2, text[:2000]), (3, "-" + text[5:1900])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in dedup_suffixes(spark.createDataFrame(docs, "doc_id long, text string"), 300, gram=260).collect())
    assert got == quick(docs, 300, str.encode, bytes)
