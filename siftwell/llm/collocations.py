"""Phrase collocations by vertical positional inverted lists.

Texts are cut into blocks of one language.  A block holds an inverted list for each of its frequent
phrases: the positions at which the phrase starts.  One level makes the next by a merge join
inside the block: a list's positions, moved on by the phrase's length, meet the postings of the
adjacent words, kept only where those end a frequent phrase themselves.  A list's length is the phrase's frequency in the
block; the sum over blocks is exact.

Sums are made per bucket (a hash of the phrase): each block sends its distinct phrases with their
list lengths once, packed, and gets back the numbers of those that are frequent in the whole
language.  So a phrase costs a bucket at most one entry a block however often it occurs, buckets
grow in number with the corpus, and no text is shuffled.  Levels are written tables, so a lost
executor costs one level's tasks.

Scores, absorption into longer phrases and ranks are joins and aggregations over the table of
frequent phrases; products are decimals of 38 digits.

Defined cases: a null text is empty; a null language counts as ``und``; repeated rows count each
time; empty tables give no phrases; a language with fewer candidates gives them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, discard, materialise, shuffle_partitions
from siftwell.llm.rolling import avalanche, cuts

#: Text of one block (its lists stay under some two megabytes), and of the blocks whose phrases one bucket takes.  A block
#: sends each distinct phrase once, so the larger it is, the less is sent and written for a text.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Blocks meet their answers in so many parts at most, one after the other, each of so many blocks' text at least: only one
#: part's blocks lie on disk twice, in their table and in the join's shuffle.
PARTS, PART_BLOCKS = 4, 32
STATE, ENTRY, ANSWER, FREQUENT = 0, 1, 2, 3
_FIELDS = [("kind", pa.int32()), ("lang", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("text", pa.string())]
_ROWS = "kind int, lang string, block long, bucket int, payload binary, id long, left long, word long, n long, text string"
_TOKENS = rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+"
_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight stand together."""
    import zstandard

    parts = [np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], "<i8").tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    head = np.frombuffer(raw, "<i8", 1 + 2 * len(kinds)).tolist()
    at, out = 8 * len(head), []
    for n, size, kind in zip(head[1 : 1 + len(kinds)], head[1 + len(kinds) :], kinds, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in _FIELDS], [name for name, _ in _FIELDS])


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each token of the joined texts as a number (-1: a break), and the words numbered."""
    import re

    tokens = pa.array(re.findall(_TOKENS, b"\n".join(texts).lower()), pa.binary()).dictionary_encode()
    code, words = np.asarray(tokens.indices), tokens.dictionary.to_pylist()
    number, kept = np.full(len(words), -1, np.int32), []
    for i, w in enumerate(words):
        if len(w) != 1 or w[0] not in _BREAKS:
            number[i] = len(kept)
            kept.append(w)
    return number[code] if len(code) else np.zeros(0, np.int32), kept


def _first_level(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """Blocks of word numbers, and each block's words with their counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lang in sorted(pc.unique(whole.column("lang")).to_pylist()):
                own_text = whole.column("text").filter(pc.equal(whole.column("lang"), lang))  # cut by language, so that rare ones fill blocks too
                for low, high in cuts(np.asarray(pc.binary_length(own_text)), block_bytes):
                    code, words = _words_of(own_text.slice(low, high - low).cast(pa.binary()).to_pylist())
                    count = np.bincount(code[code >= 0], minlength=len(words))
                    often = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack well
                    place = np.empty(len(words) + 1, np.int32)
                    place[often], place[-1] = np.arange(len(words)), -1
                    code, count, words = place[code] + 1, count[often], [words[i] for i in often]
                    bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
                    order = np.argsort(bucket, kind="stable")
                    rows = [{"kind": STATE, "lang": lang, "block": block, "payload": _pack(code.astype("<i4"), bucket.astype("<i4")), "n": int(count.sum())}]
                    for b, i, j in _ranges(bucket[order]):
                        own = [words[k] for k in order[i:j]]
                        sizes = np.array([len(w) for w in own], "<i4")
                        rows.append({"kind": ENTRY, "lang": lang, "block": block, "bucket": b, "payload": _pack(sizes, np.frombuffer(b"".join(own), np.uint8), count[order[i:j]].astype("<i8"))})
                    block += 1
                    yield _batch(rows)

    return docs.mapInArrow(run, _ROWS)


def _ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and end of each stretch of a sorted array."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut.tolist(), [*cut.tolist(), len(bucket)][1:], strict=True):
        yield int(bucket[i]), i, j


def _sum_level(rows: DataFrame, least: int, level: int, last: bool, partitions: int | None) -> DataFrame:
    """Per language and bucket: frequent phrases with their exact counts, and to each block the numbers of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, bucket), held in _groups(batches):
            spans, at, parts = [], 0, []
            for block, payload in held:
                parts.append(_unpack(payload, "<i4", "u1", "<i8") if level == 1 else _unpack_entries(payload))
                spans.append((block, at, at + len(parts[-1][2])))
                at = spans[-1][2]
            count = np.concatenate([p[2] for p in parts])
            made: list[dict]
            if level == 1:
                sizes = np.concatenate([p[0] for p in parts])
                ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([p[1] for p in parts]))]).dictionary_encode()
                which = np.asarray(words.indices).astype(np.int64)
            else:
                left, word = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                order = np.lexsort((word, left))
                new = np.r_[True, (np.diff(left[order]) != 0) | (np.diff(word[order]) != 0)]
                which = np.empty(at, np.int64)
                which[order] = np.cumsum(new) - 1
                left, word = left[order][new], word[order][new]
            total = np.zeros(int(which.max()) + 1, np.int64)
            np.add.at(total, which, count)
            some = np.flatnonzero(total >= least)
            code = np.full(len(total), -1, np.int32)
            code[some] = np.arange(len(some))
            base = bucket << 32
            if level == 1:
                names = words.dictionary.take(pa.array(some)).to_pylist()
                made = [{"kind": FREQUENT, "lang": lang, "id": base + i, "n": n, "text": w.decode("utf-8", "replace")} for i, (n, w) in enumerate(zip(total[some].tolist(), names, strict=True))]
            else:
                made = [{"kind": FREQUENT, "lang": lang, "id": base + i, "n": n, "left": a, "word": b} for i, (n, a, b) in enumerate(zip(total[some].tolist(), left[some].tolist(), word[some].tolist(), strict=True))]
            if not last:
                made += [{"kind": ANSWER, "lang": lang, "block": block, "bucket": bucket, "payload": _pack(code[which[i:j]])} for block, i, j in spans]
            yield _batch(made)

    entries = rows.where(F.col("kind") == ENTRY).select("lang", "bucket", "block", "payload")
    # small levels go to few tasks by their size, unless the corpus has more buckets than the session has partitions
    dealt = entries.repartition(partitions, "lang", "bucket") if partitions else entries.repartition("lang", "bucket")
    return dealt.sortWithinPartitions("lang", "bucket", "block").mapInArrow(run, _ROWS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple[int, bytes]]]]:
    """Consecutive rows of one language and bucket."""
    now, held = None, []
    for batch in batches:
        for lang, bucket, block, payload in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "block", "payload")), strict=True):
            if held and (lang, bucket) != now:
                yield now, held
                held = []
            now = (lang, bucket)
            held.append((block, payload))
    if held:
        yield now, held


def _extended(at: np.ndarray, phrase: np.ndarray, word: np.ndarray, level: int, buckets: int) -> tuple[np.ndarray, ...]:
    """A merge join of the phrases' positions, moved on by their length, with the adjacent words' postings.

    at (ascending), phrase, word: where phrases of ``level`` words start, their numbers and last words.  Returns the
    starts of the longer phrases, list by list, and of each list its length, bucket, phrase and further word.
    """
    postings = at + level - 1
    where = np.searchsorted(postings, at + level)
    met = np.flatnonzero(where < len(postings))
    met = met[postings[where[met]] == at[met] + level]
    start, left, right = at[met], phrase[met], word[where[met]]
    bucket = (avalanche(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, right, left, bucket))
    start, left, right, bucket = start[order], left[order], right[order], bucket[order]
    new = np.flatnonzero(np.r_[True, (np.diff(left) != 0) | (np.diff(right) != 0) | (np.diff(bucket) != 0)]) if len(start) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[new, len(start)]), bucket[new], left[new], right[new]


def _pack_entries(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> bytes:
    """A block's phrases of one bucket: their parts, the first as steps (they ascend), and how often each occurs."""
    return _pack(np.diff(left, prepend=0).astype("<i8"), right.astype("<i8"), length.astype("<i8"))


def _unpack_entries(payload: bytes) -> list[np.ndarray]:
    step, right, length = _unpack(payload, "<i8", "<i8", "<i8")
    return [np.cumsum(step), right, length]


def _pack_lists(at: np.ndarray, phrase: np.ndarray, word: np.ndarray) -> bytes:
    """Inverted lists: each phrase's number, last word (none if all are words) and list length, and the steps from position to position.

    Numbers ascend and are kept as steps, too.
    """
    order = np.lexsort((at, phrase))
    at, phrase, word = at[order], phrase[order], word[order]
    new = np.flatnonzero(np.diff(phrase, prepend=-1))
    step = np.diff(at, prepend=0)
    step[new] = at[new]
    last = word[new] if (word != phrase).any() else word[:0]
    return _pack(np.diff(phrase[new], prepend=0).astype("<i8"), last.astype("<i8"), np.diff(np.r_[new, len(at)]).astype("<i4"), step.astype("<i4"))


def _unpack_lists(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order, with each one's phrase and its last word."""
    phrase, word, length, step = _unpack(payload, "<i8", "<i8", "<i4", "<i4")
    phrase = np.cumsum(phrase)
    word = word if len(word) else phrase
    at = np.cumsum(step, dtype=np.int64)
    if len(length):
        starts = np.cumsum(length) - length
        at -= np.repeat(at[starts] - step[starts], length)
    order = np.argsort(at)
    return at[order], np.repeat(phrase, length)[order], np.repeat(word, length)[order]


def _next_level(addressed: DataFrame, level: int, buckets: int, last: bool) -> DataFrame:
    """Blocks with the lists of their frequent phrases of ``level`` words, and by bucket the phrases one word longer.

    From the second level on a block holds the lists of the level before; they are extended again, and what the
    answers call frequent stays.  So no list of a phrase that is not frequent is written.
    """

    def lists(payload: bytes, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if level == 1:
            code, bucket = _unpack(payload, "<i4", "<i4")
            number = np.r_[-1, _numbers(bucket, answers)]
            at = np.flatnonzero(number[code] >= 0)
            return at, number[code[at]], number[code[at]]
        start, length, bucket, _, word = _extended(*_unpack_lists(payload), level - 1, buckets)
        number = np.repeat(_numbers(bucket, answers), length)
        keep = np.flatnonzero(number >= 0)
        keep = keep[np.argsort(start[keep])]
        return start[keep], number[keep], np.repeat(word, length)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, block, payload, got = (batch.column(c)[i].as_py() for c in ("lang", "block", "payload", "answers"))
                at, phrase, word = lists(payload, {x["bucket"]: _unpack(x["payload"], "<i4")[0] for x in got or []})
                _, length, bucket, left, right = _extended(at, phrase, word, level, buckets)
                rows = [] if last else [{"kind": STATE, "lang": lang, "block": block, "payload": _pack_lists(at, phrase, word)}]
                rows += [{"kind": ENTRY, "lang": lang, "block": block, "bucket": b, "payload": _pack_entries(left[i:j], right[i:j], length[i:j])} for b, i, j in _ranges(bucket)]
                yield _batch(rows)

    return addressed.mapInArrow(run, _ROWS)


def _numbers(bucket: np.ndarray, answers: dict[int, np.ndarray]) -> np.ndarray:
    """The language-wide number of each of a block's entries; -1 if it is not frequent."""
    out = np.full(len(bucket), -1, np.int64)
    order = np.argsort(bucket, kind="stable")
    for b, i, j in _ranges(bucket[order]):
        code = answers[b].astype(np.int64)
        out[order[i:j]] = np.where(code >= 0, (b << 32) + code, -1)
    return out


def frequent_phrases(docs: DataFrame, least: int, longest: int, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of 1 to longest words that occurs least times, and (lang, n) of all words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = shuffle_partitions(spark)
    buckets = max(2 * partitions, -(-volume // bucket_bytes))
    partitions = buckets // 4 if buckets // 4 > partitions else None
    parts = min(PARTS, max(1, volume // (PART_BLOCKS * block_bytes)))
    rows = materialise(_first_level(docs, buckets, block_bytes), "postings-1")
    totals = rows.where(F.col("kind") == STATE).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = materialise(totals, "totals")
    words = found = before = None
    for level in range(1, longest + 1):
        last = level == longest
        sums = materialise(_sum_level(rows, least, level, last, partitions), f"sums-{level}")
        frequent = sums.where(F.col("kind") == FREQUENT)
        if level == 1:
            before = words = materialise(frequent.select("lang", "id", "text", "n"), "words")
        else:
            left, word = before.select("lang", F.col("id").alias("left"), F.col("text").alias("head")), words.select("lang", F.col("id").alias("word"), F.col("text").alias("tail"))
            before = materialise(frequent.select("lang", "id", "left", "word", "n").join(left, ["lang", "left"]).join(word, ["lang", "word"]).select("lang", "id", F.concat_ws(" ", "head", "tail").alias("text"), "n"), f"phrases-{level}")
        one = before.select("lang", F.col("text").alias("phrase"), F.lit(level).alias("size"), F.col("n").alias("f"))
        found = one if found is None else found.unionByName(one)
        if not last:
            after = None
            for part in range(parts):
                some = F.pmod(F.xxhash64("block"), F.lit(parts)) == part
                answers = sums.where((F.col("kind") == ANSWER) & some).groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers"))
                addressed = rows.where((F.col("kind") == STATE) & some).select("block", "lang", "payload").join(answers, "block", "left")
                made = materialise(_next_level(addressed, level, buckets, level + 1 == longest), f"postings-{level + 1}")
                after = made if after is None else after.unionByName(made)
            discard(rows, sums)
            rows = after
    return materialise(found, "frequent"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorb: tuple[int, int] = (100, 100), **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    docs: text, lang.  The score of a phrase with count a is floor(1000 * a * n / (l * r)) at the cut (counts l
    and r of its parts) where that is least, n being the language's words.  A phrase inside a longer one is left
    out if absorb[0] * (the longer one's count) >= absorb[1] * a.
    """
    known, totals = frequent_phrases(docs, least, longest, **sizes)
    phrases = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))

    cut = phrases.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size")).alias("rest"))
    heads = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(heads, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {wide})) * cast(n as {wide}) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least"))

    inner = phrases.where("size >= 3").select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inner = inner.select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
    longer = inner.select("lang", part(F.col("start"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (absorb[0] * F.col("longer") < absorb[1] * F.col("a")))

    rows = scored.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    return _first_rows(rows, top)


def _first_rows(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; shares of a large language are cut down before they meet."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(rows.sparkSession)))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return few.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
