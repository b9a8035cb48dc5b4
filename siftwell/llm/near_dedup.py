"""MinHash near-duplicate detection with odd sketches.

Per document, on distinct word shingles (64-bit hashes):

* BANDS x ROWS MinHash samples; each band's hash is a bucket key;
* the samples folded into a parity bitmap (odd sketch): the population count of two bitmaps' XOR
  estimates how many samples differ, which is precise for high similarities;
* the whole set folded into a second parity bitmap: there the XOR count is a lower bound on the
  symmetric difference, so it rules pairs out without error.

Documents with equal sets form one class and travel as one representative.  In every bucket the
representatives first meet the bucket's centre only (a star, no pairs).  Pairs that the bitmaps
leave open are confirmed on full sets.  What remains in a bucket are pairs across components;
those that the bitmaps allow are confirmed too, all at once.  Mixed buckets are cut into cells by
set size (linked sets differ by less than one step) and large cells by a salt, so no task holds a
large bucket.  A link between two documents of similarity s is lost only if no band agrees,
(1 - s**ROWS)**BANDS, under 2e-8 at 0.85, or if its odd sketches differ beyond the limit, under
1e-9 (see sketch_limit).

Defined cases
    null or empty text, or text without words: empty set, linked with nothing (not even with
    other empty ones).  Fewer words than a shingle: the whole sequence is the one shingle.
    Ties: none, a component is named by its smallest doc_id.  Rows that share a doc_id count as
    one document with several texts.  null doc_id: takes no part in links, component_id null,
    kept true.  Empty table: no rows.  Extra columns: ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_batches, carried, discard, materialise, restored, shuffled
from siftwell.llm.components import connected_components
from siftwell.llm.rolling import Batch, avalanche, cuts, span_hashes
from siftwell.operators.batch import with_position

BANDS, ROWS = 24, 4
SAMPLE_WORDS, SET_WORDS = 8, 16  # 64-bit words of the two parity bitmaps
_FACTORS = np.random.default_rng(77).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: Batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all documents, and each document's edges."""
    starts, ends, first = batch.words()
    words = batch.word_hashes(starts, ends, lower=True)
    n = np.diff(first)
    per = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    edges = np.r_[0, np.cumsum(per)]
    doc = np.repeat(np.arange(len(n)), per)
    at = first[:-1][doc] + np.arange(edges[-1]) - edges[:-1][doc]
    value = span_hashes(words, at, at + np.minimum(n, width)[doc], 1)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signatures(values: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the signature table; documents with empty sets get zeros."""
    n = np.diff(edges)
    full = np.flatnonzero(n)
    out = {"n_shingles": n.astype(np.int64)}
    columns = {c: np.zeros(len(n), np.uint64) for c in COLUMNS}
    if len(full):
        x, at = avalanche(values + np.uint64(0x2545F491)), edges[:-1][full]
        columns["k1"][full] = np.add.reduceat(avalanche(x), at)
        columns["k2"][full] = np.add.reduceat(avalanche(x ^ np.uint64(0x6A09E667F3BCC909)), at)
        parity = np.zeros((len(full), 64 * SAMPLE_WORDS), bool)
        row = np.arange(len(full))
        band = np.zeros(len(full), np.uint64)
        for j, factor in enumerate(_FACTORS):
            sample = np.minimum.reduceat(x * factor, at)
            parity[row, (avalanche(sample + np.uint64(j)) % np.uint64(64 * SAMPLE_WORDS)).astype(np.int64)] ^= True
            band = avalanche(band * np.uint64(0x9E3779B97F4A7C15) + sample)
            if j % ROWS == ROWS - 1:
                columns[f"b{j // ROWS}"][full] = band
                band = np.zeros(len(full), np.uint64)
        for name, bits in (("s", parity), ("f", None)):
            if bits is None:
                owner = np.repeat(row, n[full])
                bits = (np.bincount(owner * 64 * SET_WORDS + (x & np.uint64(64 * SET_WORDS - 1)).astype(np.int64), minlength=len(full) * 64 * SET_WORDS) & 1).astype(bool).reshape(len(full), -1)
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for j in range(packed.shape[1]):
                columns[f"{name}{j}"][full] = packed[:, j]
    return out | {k: v.view(np.int64) for k, v in columns.items()}


COLUMNS = ["k1", "k2", *(f"b{i}" for i in range(BANDS)), *(f"s{i}" for i in range(SAMPLE_WORDS)), *(f"f{i}" for i in range(SET_WORDS))]
_SIG_SCHEMA = "doc_id long, n_shingles long, " + ", ".join(f"{c} long" for c in COLUMNS)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
    for a, b in cuts(n, 1 << 20):
        yield batch.slice(a, b - a)


def signature_table(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                made = signatures(*shingle_sets(Batch(part.column("text")), width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v) for v in made.values())], names=["doc_id", *made])

    return docs.mapInArrow(run, _SIG_SCHEMA)


#: Bounds of the bitmap that preselects documents whose sets are needed.
LEAST_BITS, MOST_BITS = 20, 25


def wanted_bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap over hashes of the nodes: at most 2**MOST_BITS bits, gathered as 64-bit words.

    Other documents may pass it (more of them once it fills up); none of the nodes is missed.
    """
    n = nodes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    words = nodes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(pmod(xxhash64(node), %dL), 64) as int))" % (1 << bits)).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return out.view(np.uint64)


def set_table(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """node and its full sorted set, 8 bytes an element, of documents that the bitmap lets through."""
    bits = len(wanted) * 64
    docs = docs.where("doc_id IS NOT NULL").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("place")).astype(np.uint64)
            hit = (wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            for part in _parts(batch.filter(pa.array(hit.astype(bool)))):
                values, edges = shingle_sets(Batch(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items binary")


def confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, linked): whether share[1] * |A and B| >= share[0] * |A or B| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(share[1] * both >= share[0] * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    sets = shuffled(sets)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return joined.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long, linked boolean")


#: Rows of a mixed bucket's size level that meet in one task, and parts in which a bucket's rows are looked up.
CELL, SALTS = 256, 32


def _differ(prefix: str, words: int):
    return sum((F.bit_count(F.col(f"x.{prefix}{i}").bitwiseXOR(F.col(f"y.{prefix}{i}"))) for i in range(words)), F.lit(0))


def sketch_limit(share: tuple[int, int], loss: float = 1e-9) -> int:
    """The least XOR count that a pair at the threshold exceeds with probability under loss.

    The number of differing samples is binomial; each of them turns one random bit in either
    sketch, and the number of odd bits moves up or down by one a turn.  That distribution is
    computed exactly.
    """
    k, bits, p = BANDS * ROWS, 64 * SAMPLE_WORDS, 1 - share[0] / share[1]
    down = np.arange(bits + 1) / bits
    odd, total = np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0] = 1.0
    for d in range(k + 1):
        total += math.comb(k, d) * p**d * (1 - p) ** (k - d) * odd
        for _ in range(2):
            odd = np.r_[0.0, (odd * (1 - down))[:-1]] + np.r_[(odd * down)[1:], 0.0]
    beyond = np.r_[np.cumsum(total[::-1])[::-1][1:], 0.0]
    return int(np.argmax(beyond < loss))


def possible(share: tuple[int, int]):
    """On nodes x and y: the set bitmaps don't exclude a link, nor do the odd sketches.

    |A xor B| is at least the XOR count c of the set bitmaps, so a link needs
    share[1] * (a + b - c) >= share[0] * (a + b + c).  That never fails; the odd sketches' estimate
    fails a linked pair with probability under 1e-9 (see sketch_limit).
    """
    total, c = F.col("x.n_shingles") + F.col("y.n_shingles"), _differ("f", SET_WORDS)
    return (F.lit(share[1]) * (total - c) >= F.lit(share[0]) * (total + c)) & (_differ("s", SAMPLE_WORDS) <= F.lit(sketch_limit(share)))


def near_duplicates(docs: DataFrame, share: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    bounded_batches(docs.sparkSession)
    step = math.log(share[1] / share[0]) * (1 + 1e-9) if share[0] < share[1] else 1e-6
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialise(signature_table(docs, width), "signatures")
    classes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"), *(F.first(c).alias(c) for c in ["n_shingles", *COLUMNS[2:]]))
    classes = materialise(classes, "classes")
    # members of buckets that hold two representatives or more, with the bucket's centre
    member = classes.select("node", "size", F.posexplode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band", "h")).select("node", "size", F.xxhash64("band", "h").alias("bucket"))
    centre = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark")).where("n > 1")
    # buckets with the same members say the same: one of them stays
    centre = centre.groupBy("n", "mark").agg(F.min("bucket").alias("bucket"), F.first("c").alias("c")).select("bucket", F.col("c.node").alias("centre"))
    member = materialise(member.select("bucket", "node").join(shuffled(centre), "bucket").distinct(), "buckets")
    node = shuffled(classes).select("node", "n_shingles", *(f"s{i}" for i in range(SAMPLE_WORDS)), *(f"f{i}" for i in range(SET_WORDS)))
    x, y = node.alias("x"), node.alias("y")
    star = member.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    star = star.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(possible(share)).select("a", "b").distinct()
    star = materialise(star, "star")
    candidates = member.select("node").distinct()
    sets = materialise(set_table(docs, wanted_bitmap(candidates), width), "sets")

    def across(roots: DataFrame) -> DataFrame:
        """Pairs of one bucket but different components that the bitmaps leave open."""
        m = member.select("bucket", "node").join(shuffled(roots), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        mixed = m.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        salt = F.pmod(F.xxhash64(F.lit("salt"), "node"), F.lit(SALTS)).cast("int")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        m = m.withColumn("salt", salt).join(shuffled(mixed.select("*", salts)), ["bucket", "salt"])
        m = materialise(m.join(node, "node").withColumn("level", F.floor(F.log("n_shingles") / F.lit(step)).cast("int")), "mixed")
        # linked sets lie in one size level or in neighbouring ones; a cell's rows meet in parts of CELL rows
        cells = m.groupBy("bucket", "level").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("parts")).select("*", salts)
        cells = shuffled(cells)
        p = m.join(cells, ["bucket", "level", "salt"]).withColumn("part", F.pmod(F.xxhash64(F.lit("cell"), "node"), F.col("parts")).cast("int")).drop("parts")
        q = m.withColumn("own", F.col("level")).withColumn("level", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
        q = q.join(cells, ["bucket", "level", "salt"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        p, q = p.alias("x"), shuffled(q).alias("y")
        on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.part") == F.col("y.part"))
        on = on & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & possible(share)
        return p.join(q, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    linked = materialise(confirm(star.select("a", "b"), sets, share).where("linked").select("a", "b"), "links")
    roots = connected_components(linked)
    # All open pairs across these components are confirmed at once.  New links only merge
    # components, so no pair can come up that was not among them.
    more = materialise(across(roots).join(shuffled(star.select("a", "b")), ["a", "b"], "left_anti"), "open")
    if not more.isEmpty():
        new = materialise(confirm(more, sets, share).where("linked").select("a", "b"), "links")
        if not new.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
    discard(member, star, sets)
    named = classes.select("k1", "k2", F.col("node")).join(shuffled(roots), "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(shuffled(named), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (no null doc_id) with _id, which no two rows share: doc_id, or for further texts of a doc_id a number that is free.

    Rows that share doc_id and text (null is the empty text) are one; their first stays.
    """
    docs = docs.withColumn("_id", F.col("doc_id").cast("long"))
    repeated = materialise(docs.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated")
    if repeated.isEmpty():
        return docs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repeated = shuffled(repeated)
    rows = docs.join(repeated, "_id", "left_semi").withColumn("_same", F.row_number().over(Window.partitionBy("_id", text).orderBy("text"))).where("_same = 1")
    rows = materialise(rows.withColumn("_row", F.row_number().over(Window.partitionBy("_id").orderBy(text))).drop("_same"), "rows")
    low, high = docs.agg(F.min("_id"), F.max("_id")).first()
    more = rows.where("_row > 1").count()
    start = high + 1 if high + more < 2**63 - 1 else low - more
    if start < -(2**63):
        raise ValueError("doc_id leaves no free numbers for repeated rows")
    further = with_position(rows.where("_row > 1"), "_id", "_row").withColumn("_id", F.col("_pos") + F.lit(start)).drop("_pos", "_row")
    return docs.join(repeated, "_id", "left_anti").select(*docs.columns).unionByName(rows.where("_row = 1").select(*docs.columns)).unionByName(further.select(*docs.columns))


def distinct_documents(docs: DataFrame, share: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """The rows of docs that stay: one per component, all with a null doc_id.

    That is its smallest doc_id.  Rows that share a doc_id are documents of their own, unless their
    texts are equal; all but the first by text count as larger than every doc_id.
    """
    given = carried(docs, "doc_id", "text")
    rows = _numbered(given.where("doc_id IS NOT NULL"))
    kept = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), share, width).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    out = rows.join(shuffled(kept), "_id", "left_semi").select(*given.columns).unionByName(given.where("doc_id IS NULL"))
    return restored(out, docs, "doc_id", "text")
