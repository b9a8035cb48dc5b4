"""Spelling variants, collocations and decontamination against plain rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm import collocations as C
from siftwell.llm import decontaminate as D
from siftwell.llm import queries as Q
from siftwell.llm import spelling as S

DOCS = "doc_id long, text string, lang string, word string, n string"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_collocations", "op13_decontamination"])
def test_query_matches_sql(spark, name):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in Path(where).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, where)
    want = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# ---- spelling variants ------------------------------------------------------------------


def plain_forms(docs, least_length, least_count, drop_every, ratio):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += len(run) >= least_length
    words = {w: n for w, n in count.items() if n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        out[w] = (n, len(others), best if best and words[best] >= ratio * n else None)
    result = set()
    for w, (n, many, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        result.add((w, n, many, form, words[form] if form else None, root))
    return result


def test_forms_match_plain_rule(spark):
    rng = random.Random(3)
    base = ["kitten", "sitting", "aaaaaa", "aaaaaaa", "Émile×ß", "straße", "banana", "bananas", "ananas"]
    words = [w for w in base for _ in range(rng.choice((2, 9, 50)))]
    for _ in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            what = rng.randrange(3)
            w[i : i + (what > 0)] = [] if what == 1 else rng.choice("abiknÀÿ")
        words += ["".join(w)] * rng.randint(1, 4)
    rng.shuffle(words)
    docs = [(i // 2 if i else None, " ".join(words[i::40]) + ". 12_", "de", "x", "y") for i in range(40)] + [(7, None, "de", "", ""), (8, "", None, "", "")]
    got = {tuple(r) for r in S.spelling_forms(spark.createDataFrame(docs, DOCS), 6, 3, 7, 2).collect()}
    want = plain_forms([(d[0], d[1]) for d in docs], 6, 3, 7, 2)
    assert got == want and any(f for *_, f, _, _ in want) and len(want) > 30


def test_no_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.spelling_forms(empty).columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert S.spelling_forms(empty).count() == 0
    one = S.spelling_forms(spark.createDataFrame([(1, "lonely " * 6, None, "", "")], DOCS), drop_every=10**9).collect()
    assert [tuple(r) for r in one] == [("lonely", 6, 0, None, None, "lonely")]


def test_chains_lead_to_the_last_form(spark):
    text = " ".join(w for w, n in (("abcdefg", 1000), ("abcdefgh", 150), ("abcdefghi", 20), ("abcdefghij", 3)) for _ in range(n))
    got = {r.word: (r.form, r.root) for r in S.spelling_forms(spark.createDataFrame([(1, text, "en", "", "")], DOCS), least_count=3, drop_every=10**9).collect()}
    assert got == {"abcdefg": (None, "abcdefg"), "abcdefgh": ("abcdefg", "abcdefg"), "abcdefghi": ("abcdefgh", "abcdefg"), "abcdefghij": ("abcdefghi", "abcdefg")}


# ---- collocations -----------------------------------------------------------------------


def plain_collocations(docs, least, longest, top):
    total, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if n >= least}
        inside = {p[i : i + k]: 0 for p in often for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        for p, n in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], n)
        rows = []
        for p, a in often.items():
            if len(p) < 2 or 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def test_collocations_match_plain_rule(spark):
    rng = random.Random(11)
    vocabulary = ["New", "york", "ß", "É", "the", "of", "état", "\x0bvt", "日本", "a-b", "x\x1cy"]
    phrases = ["new york city hall", "the end of the", "aa aa aa", "日本 ß É"]
    docs = []
    for i in range(120):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        docs.append((i, "".join(p + rng.choice([" ", " ", "\t", ", ", ".", "\n", " ? "]) for p in parts), rng.choice(["en", "en", "de", None, ""]), "x", "y"))
    docs += [(1, None, "en", "", ""), (2, "", "fr", "", ""), (3, "aa " * 500, "en", "", ""), (3, "aa " * 500, "en", "", "")]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    want = plain_collocations([(d[1], d[2]) for d in docs], 12, 5, 40)
    got = {tuple(r) for r in C.collocations(df, 12, 5, 40, block_bytes=900, bucket_bytes=300).collect()}
    assert got == want and len(want) > 30
    assert C.collocations(df.limit(0)).count() == 0


def test_scores_pass_sixty_four_bits(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(7 * big).alias("n"), F.lit(big + 1).alias("l"), F.lit(big + 3).alias("r"))
    wide = "decimal(19,0)"
    got = row.select(F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {wide})) * cast(n as {wide}) div (cast(l as {wide}) * cast(r as {wide}))").alias("s")).first().s
    assert got == 1000 * big * 7 * big // ((big + 1) * (big + 3))


# ---- decontamination --------------------------------------------------------------------


def plain_hits(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    ids |= got
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [D.CHUNK_BYTES, 400])
def test_hits_match_plain_rule(spark, chunk_bytes):
    rng = random.Random(chunk_bytes)
    vocabulary = ["a", "b", "the", "Straße", "é", "x1", "longer-word", "Q", "日本語", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "-", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice((1, 3, 9, 10, 11, 25)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (None, "unique marker of a nameless item here now ok"), (3, items[3][1]), (200, items[5][1])]
    docs = [(i, text(rng.randint(0, 80)) + " ".join(rng.choice(items)[1] or "" for _ in range(rng.choice((0, 0, 1, 2)))) + text(5)) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "?"), (503, docs[4][1]), (503, docs[4][1]), (None, items[7][1]), (504, items[3][1].upper() + " tail"), (505, "unique  MARKER of a nameless item here, now ok")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], "doc_id long, text string, items string, row int, spans string")
    found = D.find_benchmark(df, spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, id string"), 10, chunk_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.length for s in r.spans), list(r["items"])) for r in found), key=repr)
    assert got == plain_hits(docs, items, 10)
    assert all(a.start + a.length < b.start for r in found for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_long_texts_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = "nothing of this kind is in the list, " * 40_000
    rows = [(1, filler + item.upper().replace(" ", " , ") + " " + filler), (2, filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in D.find_benchmark(docs, bench).collect()}
    n = 9 * 40_000 - 40_000
    assert got == {1: (2 * n + 11, [(n, 11)], ["5"]), 2: (n, [], [])}
    assert {r.doc_id: (len(r.spans), list(r["items"])) for r in D.find_benchmark(docs, bench.limit(0)).collect()} == {1: (0, []), 2: (0, [])}
    assert D.find_benchmark(docs.limit(0), bench).count() == 0


def test_query_digest_of_clean_documents(spark, sf_dir):
    clean = Q.op13_decontamination(spark, sf_dir).where("NOT contaminated").first()
    assert (clean.n_hit, clean.n_items, clean.items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
