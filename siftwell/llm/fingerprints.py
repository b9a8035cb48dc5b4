"""Canonical exact document fingerprints, with DataFrame functions only.

A text's canonical form is NFKC-normalised, case-folded (fully, and normalised again), with every
run of white space folded to one space and none at the ends.  Its fingerprint is 128 bits wide:
two xxhash64 values with different seeds.  Documents with one fingerprint stand in a chain ordered
by doc_id; each one's canonical bytes are compared with those of the one before it, and only equal
bytes make a copy.  So a document answers at most two others, however large its group is.

Defined cases
    null text: empty.  Ascending doc_id, null last; rows with one doc_id follow each other in the
    order of their texts' hashes.  The document after the last is the first (alone: itself).
    Repeated rows (one doc_id, one text): each gets a row, and the document after all but the last
    of them is their own text.  Empty table: no rows.  Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.batch import ranged_rows

_LAST = 2**63 - 1
#: What names a document: doc_id (null last) and two hashes of the text.
ID = ("key", "missing", "h1", "h2")


def _icu(cls: str, method: str, text: Column, *more: bool) -> Column:
    return F.call_function("reflect", F.lit(cls), F.lit(method), text, *(F.lit(m) for m in more))


def normalised(text: Column) -> Column:
    """NFKC; a text of ASCII alone is in that form already."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(_icu("com.ibm.icu.text.Normalizer", "compose", text, True))


def case_folded(text: Column) -> Column:
    """Full case folding (sharp s becomes ss)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(_icu("com.ibm.icu.lang.UCharacter", "foldCase", text, True))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", " "))


def digest(canonical: Column) -> Column:
    """Two xxhash64 values as 32 lower-case hex digits."""
    halves = (F.xxhash64(canonical), F.xxhash64(F.lit("wide"), canonical))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def with_canonical(df: DataFrame, text: str, canonical: str, wanted: Column | None = None) -> DataFrame:
    """Adds the canonical form (null where it isn't wanted); each step is a projection of its own, so it runs once."""
    source = F.col(text) if wanted is None else F.when(wanted, F.col(text))
    for step in (lambda c: normalised(source), case_folded, normalised, folded):
        made = step(F.col(canonical)) if canonical in df.columns else step(source)
        df = df.withColumn(canonical, made if wanted is None else F.when(wanted, made))
    return df


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint and canonical text per row: no shuffle."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_canonical(rows, "text", "canonical")
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), digest(F.col("canonical")).alias("fingerprint"), "canonical")


def _named(docs: DataFrame) -> DataFrame:
    """The columns of ID beside each text; null is the empty text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.isnull("doc_id").alias("missing"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("x"), F.col("text")))


def _neighbour(rows: DataFrame, name: str, payload: Column, forward: bool) -> DataFrame:
    """Adds the payload of the row after (or before) each one in order; forward wraps from the last to the first.

    rows come from ranged_rows; what lies across a partition's edge is one row a partition.
    """
    step, end = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    here, every = Window.partitionBy("_part").orderBy("_local"), Window.orderBy("_part")
    ends = rows.groupBy("_part").agg(end(payload, "_local").alias("_end"))
    beyond = step("_end").over(every)
    if forward:
        beyond = F.coalesce(beyond, F.first("_end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = F.broadcast(ends.select("_part", beyond.alias("_beyond")))
    return rows.withColumn(name, step(payload).over(here)).join(ends, "_part").withColumn(name, F.coalesce(F.col(name), F.col("_beyond"))).drop("_beyond")


def _with_copies(rows: DataFrame) -> DataFrame:
    """Adds copy_of: the first document of the run of equal canonical texts that a row stands in (null for that one).

    A run starts where the fingerprint changes or the bytes differ from those before.
    """
    rows = ranged_rows(rows, [F.col(c) for c in ("fingerprint", *ID)])
    here, every = Window.partitionBy("_part").orderBy("_local"), Window.orderBy("_part")
    head = F.when(~F.col("repeats"), F.struct("key", "missing"))
    rows = rows.withColumn("_head", F.last(head, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy("_part").agg(F.max_by("_head", "_local").alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(ends.select("_part", carried.alias("_carried"))), "_part")
    first = F.coalesce("_head", "_carried")
    return rows.withColumn("copy_of", F.when(F.col("repeats") & ~first["missing"], first["key"])).drop("_head", "_carried", "_part", "_local")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and of which document each is a copy.

    edited: the last floor(n/2) code points replaced by as many first ones of the next document.
    Texts are shuffled by ID once; besides, each next document sends the code points that are
    needed, and each document of a chain its canonical text to the one behind it.
    """
    rows = _named(docs)
    # repeated rows are one document that stands for n; only its first text is shuffled on
    base = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*ID).orderBy("key"))).where("_r = 1").select(*ID, "text")
    ids = with_canonical(rows, "text", "canonical").select(*ID, F.floor(F.char_length("text") / 2).cast("int").alias("half"), digest(F.col("canonical")).alias("fp"))
    ids = ids.groupBy(*ID, "half", "fp").agg(F.count(F.lit(1)).alias("n"))
    me = F.struct(*ID, "fp")
    ids = _neighbour(ranged_rows(ids, [F.col(c) for c in ID]), "next", me, forward=True).drop("_part", "_local")
    ids = _neighbour(ranged_rows(ids, [F.col(c) for c in ("fp", *ID)]), "before", me, forward=False).drop("_part", "_local")
    own = [F.col(c).alias(f"for_{c}") for c in ID]
    ask = ids.select(*own, F.lit(False).alias("chain"), "half", "n", "fp", (F.col("next.fp") == F.col("fp")).alias("same"), *(F.col(f"next.{c}").alias(c) for c in ID))
    ask = ask.unionByName(ids.where("before.fp = fp").select(*own, F.lit(True).alias("chain"), "half", "n", "fp", F.lit(True).alias("same"), *(F.col(f"before.{c}").alias(c) for c in ID)))
    sent = with_canonical(ask.join(base, [*ID]), "text", "other", F.col("same"))
    sent = sent.select(*(F.col(f"for_{c}").alias(c) for c in ID), "chain", "half", "n", "fp", "same", "other", F.when(~F.col("chain"), F.substring("text", F.lit(1), F.col("half"))).alias("prefix"))
    after = sent.where("NOT chain").select(*ID, "half", "n", "fp", "same", F.col("other").alias("next_text"), "prefix")
    before = sent.where("chain").select(*ID, F.col("other").alias("before_text"))
    rows = base.join(after, [*ID]).join(before, [*ID], "left")
    n = F.char_length("text")
    kept = F.substring("text", F.lit(1), n - F.col("half"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(kept, F.col("prefix"))).withColumn("self_edited", F.when(F.col("n") > 1, F.concat(kept, F.substring("text", F.lit(1), F.col("half")))))
    rows = with_canonical(rows, "edited", "edited_canonical")
    rows = with_canonical(rows, "self_edited", "self_canonical", F.col("n") > 1)
    rows = rows.withColumn("edited_fp", digest(F.col("edited_canonical"))).withColumn("self_fp", F.when(F.col("n") > 1, digest(F.col("self_canonical"))))
    # a fingerprint that differs proves different texts; equal ones are compared byte by byte
    rows = with_canonical(rows, "text", "canonical", F.col("same") | F.col("before_text").isNotNull() | (F.col("n") > 1) | (F.col("fp") == F.col("edited_fp")))
    alike = lambda fp, other: F.when((F.col("fp") == F.col(fp)) & (F.col("canonical") == F.col(other)), 1.0).otherwise(0.0)
    rows = rows.withColumn("near_edited", alike("edited_fp", "edited_canonical")).withColumn("near_self", alike("self_fp", "self_canonical"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = rows.select(
        *ID,
        "n",
        "n_chars",
        F.col("fp").alias("fingerprint"),
        F.coalesce(F.col("canonical") == F.col("before_text"), F.lit(False)).alias("repeats"),
        F.struct(sha("edited").alias("sha"), F.col("edited_fp").alias("fp"), F.col("near_edited").alias("near"), F.when(F.col("same") & (F.col("canonical") == F.col("next_text")), 1.0).otherwise(0.0).alias("next")).alias("last"),
        F.struct(F.when(F.col("n") > 1, sha("self_edited")).alias("sha"), F.col("self_fp").alias("fp"), F.col("near_self").alias("near"), F.lit(1.0).alias("next")).alias("others"),
    )
    rows = _with_copies(rows)
    # the rows that a document stands for: the last one meets the next document, the others their own text
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("e", F.when(F.col("i") == F.col("n"), F.col("last")).otherwise(F.col("others")))
    copy_of = F.coalesce(F.col("copy_of"), F.when((F.col("i") > 1) & ~F.col("missing"), F.col("key")))
    return rows.select(F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), F.col("e.next").alias("near_next"), copy_of.alias("copy_of"))
