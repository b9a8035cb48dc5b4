import hashlib
import re
import unicodedata

from siftwell.llm.fingerprints import fingerprint, fingerprint_with_edits


def canonical(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def test_canonical_form(spark):
    texts = ["", "  A  b\n\tC ", "ＡＢＣ　ｄ", "é", "é", "ﬁne", "ŁÓDŹ", "x y z", None, "STRASSE", "Straße", "ὈΔΥΣΣΕΎΣ", "ὀδυσσεύς"]
    got = {r.doc_id: r for r in fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].canonical == canonical(t or ""), t
    assert got[3].fingerprint == got[4].fingerprint and got[9].fingerprint == got[10].fingerprint and got[11].fingerprint == got[12].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({r.canonical for r in got.values()})


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, key int, fp string")
    got = sorted(fingerprint_with_edits(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.edited_sha256))
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    assert len(got) == len(docs)
    seen = {}
    want = []
    for i, (doc_id, text) in enumerate(ordered):
        t, nxt = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        c = canonical(t)
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(c == canonical(edited)), float(c == canonical(nxt)), seen.get(c)))
        seen.setdefault(c, doc_id)
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.copy_of) for r in got] == want
    by = {}
    for r, (_, t) in zip(got, ordered, strict=True):
        assert by.setdefault(r.fingerprint, canonical(t or "")) == canonical(t or "")


def test_edits_match_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, [*docs, (10**9, None), (10**9 + 1, ""), (10**9 + 2, "Ａ b"), (10**9 + 3, "a  B "), (None, "last one é𝄞x")])


def test_small_tables(spark):
    check(spark, [(4, "abcdef")])
    check(spark, [(4, None)])
    assert fingerprint_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (1, "ef gh"), (None, "q"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fingerprint_with_edits(twice).collect()) == ["1", "1", "1", "None", "None"]


def test_repeated_rows_and_null_ids_in_bulk(spark):
    """Many rows of one doc_id and of none: each gets a row, repeated ones meet their own text."""
    docs = [(7, "ab cd ef")] * 400 + [(None, f"text {i % 3}") for i in range(300)] + [(7, "other"), (8, "AB  cd ef")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = fingerprint_with_edits(df).collect()
    assert len(got) == len(docs)
    same = [r for r in got if r.doc_id == 7 and r.n_chars == 8]
    assert len(same) == 400 and sum(r.near_next for r in same) >= 399 and sum(r.copy_of is None for r in same) == 1
    assert [r.copy_of for r in got if r.doc_id == 8] == [7]
    none = [r for r in got if r.doc_id is None]
    assert len(none) == 300 and all(r.copy_of is None for r in none) and sum(r.near_next for r in none) == 297
    own = hashlib.sha256(b"ab cab c").hexdigest()
    assert sum(r.edited_sha256 == own for r in same) >= 399


def test_very_long_texts(spark):
    long = "Ä word " * 300_000
    check(spark, [(1, long), (2, long.upper()), (3, "x"), (4, long)])
