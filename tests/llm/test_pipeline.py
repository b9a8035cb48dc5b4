"""The pipeline's stages, each against a plain rule on its own input."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siftwell.llm.queries import KEEP, TARGETS

STAGES = dict(corpus_pipeline.STAGES)
LONG = "A passage of more than one hundred bytes that stands in several of the documents here, wörd for wörd, über alles."


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The sample table with nulls, an empty and a long text, repeated rows and a shared passage."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"long{i % 977} text{i % 13}" for i in range(40_000))
    more = [(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, long, "en", "s", len(long)), (900_004, f"één {LONG} einde", "de", "s", 0), (900_005, f"zwei {LONG} Schluss", "de", None, None), (None, LONG, None, None, None), (900_006, "one two three four five six", "en", "s", 27), (900_006, "one two three four five six", "en", "s", 27)]
    return df.unionByName(spark.createDataFrame(more, df.schema))


@pytest.fixture(scope="module")
def made(spark, sf_dir, docs):
    """Name to (input rows, output rows) of every stage, each on what the one before it kept."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        result = stage(spark, docs, sf_dir)
        got = result.collect()
        out[name] = (rows, got, result.columns)
        if name != "packing":
            assert result.columns == docs.columns
            docs = spark.createDataFrame(got, docs.schema)
    return out


def test_quality_drops_rejected_rows_only(spark, sf_dir, made):
    from siftwell.llm.nbsvm import score_quality

    rows, got, _ = made["quality"]
    assert not Counter(got) - Counter(rows)
    # a row goes exactly if the classifier gives it less than the threshold
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    scored = score_quality(spark.createDataFrame(rows, schema), spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3, extra=("text", "lang", "source", "n_chars"), prefix="q_").collect()
    assert Counter((r.doc_id, r.text) for r in scored if r.q_score >= 0.3) == Counter((r.doc_id, r.text) for r in got)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    before = [r for r in rows if r.doc_id in good]
    assert sum(r.doc_id in good for r in got) > 0.95 * len(before)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_keeps_one_of_each_group(made):
    rows, got, _ = made["near_dedup"]
    named = sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    sets = [shingles(t) for _, t in named]
    root = list(range(len(named)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(named)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = Counter(named[i][0] for i in range(len(named)) if find(i) == i)
    want[None] = sum(r.doc_id is None for r in rows)
    assert Counter(r.doc_id for r in got) == +want


def test_passages_are_cut_and_characters_kept(made):
    rows, got, _ = made["passage_dedup"]
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, (r.text or "").encode()))
    seen, want = set(), []
    for r in order:
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(w)
        at, kept = 0, []
        for c in r.text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        want.append((r.doc_id, "".join(kept) if r.doc_id is not None else r.text or ""))
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted(want, key=str)
    assert not any("�" in (r.text or "") for r in got) and all(r.n_chars == len(r.text) for r in got if r.doc_id is not None)


def test_mixing_meets_the_targets(spark, sf_dir, made):
    from siftwell.llm.mixing import mixing_rates

    rows, got, _ = made["mixing"]
    assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in rows}
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rates = mixing_rates(spark.createDataFrame(rows, schema), spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, "lang", KEEP).collect()
    total = sum(r.tokens for r in rates)
    for d, share in TARGETS.items():
        assert math.isclose(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rates), share * KEEP * total, rel_tol=2e-3)
    copies = {}
    for r in rates:
        if r.doc_id is not None:
            copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    want = Counter()
    for r in rows:
        want[r.doc_id] += copies.get(r.doc_id, 1)
    assert Counter(r.doc_id for r in got) == +want


def test_packing_places_every_token(made):
    rows, got, _ = made["packing"]
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = [*slow.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(by) <= least * 1.02 + 1


def test_run_and_clashing_columns(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    clash = spark.createDataFrame([(1, "one two three four five six", "en", "s", 27, 0.5, 1), (1, None, "en", "s", 0, 0.5, 1), (None, "one two three four five six", "en", None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf_dir).columns == clash.columns
        assert stage(spark, clash.limit(0), sf_dir).count() == 0


def test_columns_of_every_inner_name_are_kept(spark, sf_dir):
    """A column named as anything that a stage uses inside, or oddly, comes out with its own values."""
    names = ["_id", "_ord", "_of", "_kept", "_n", "_copies", "_same", "_row", "_pos", "_part", "_local", "_rid", "row", "root", "node", "home", "ids", "quality_score", "quality_predicted", "held_out", "copies", "tokens", "rate", "k1", "a b.c"]
    values = {d: tuple(100 * d + i for i in range(len(names))) for d in (1, 2, 3)}
    texts = {1: "one two three four five six", 2: "another text with quite different words in it", 3: "a third one that is not like those before"}
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(d, t, "en", *values[d]) for d, t in texts.items()], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all(tuple(r)[3:] == values[r.doc_id] and r.text == texts[r.doc_id] for r in rows), name
        assert name in ("quality", "mixing") or len(rows) == 3
