"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import table


def tokenizer_files() -> dict:
    """Public tokenizer files of one byte-level vocabulary; paths are parameters of the operators."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.substring_dedup import dedup_substrings

    # three runs are one more than the index keeps apart, so the query compacts once before its last batch
    return dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), batches=4, window=20, fan_in=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.suffix_dedup import dedup_suffixes

    return dedup_suffixes(table(spark, sf_dir, "documents", "doc_id", "text"), length=100)


def op3_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Target token weights of the domains (the languages), and the share of all tokens to keep (1: mixing only
#: shifts weights; rates above 1 repeat documents).
TARGETS, KEEP = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}, 1.0


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id"), TARGETS, "lang", KEEP)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.toxicity import score_toxicity

    # the labels hold one category; the narrower ones by language come first, and the last link, which sees their
    # probabilities, decides
    english = F.col("lang") == "en"
    categories = {"toxic_english": F.col("toxic") * english.cast("int"), "toxic_other": F.col("toxic") * (~english).cast("int"), "toxic": F.col("toxic")}
    return score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "toxic"), categories, threshold=0.3, main="toxic")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), share=(85, 100), width=5)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.chat_format import digest_output, format_conversations

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return digest_output(format_conversations(rows.unionByName(extra), tokenizer_files()["tokenizer_path"]))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.vector_search import top_k

    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    whole = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    e = e.where(whole).select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(64) * v.cast("double")).cast("double")).alias("vector"))
    return top_k(e, e.where(F.col("vec_id") % 20 == 0), k=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), capacity=1024, end_id=2, **tokenizer_files())


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.nbsvm import score_quality

    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.spelling import spelling_forms

    return spelling_forms(table(spark, sf_dir, "documents", "doc_id", "text"), least_length=6, least_count=5, drop_every=199, ratio=5)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents", "text", "lang"), least=100, longest=5, top=2000)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.decontaminate import find_benchmark

    found = find_benchmark(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), width=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.length)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_canonical_fingerprint, op4_source_mixing, op5_toxicity_chain, op6_minhash_near_dedup, op7_chat_format, op8_vector_search, op9_best_fit_packing, op10_quality_nbsvm, op11_spelling_variants, op12_collocations, op13_decontamination)
}

ORACLES: dict[str, str] = {
    "op8_vector_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_spelling_variants": """
WITH RECURSIVE bits AS (
  SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS v, 1 AS k FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), codes AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS many FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, many, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      [CAST(('0x' || s) AS BIGINT) FOR s IN regexp_extract_all(hex(encode(concat(CAST(doc_id AS VARCHAR), ':', run))), '..')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, codes
), words AS (
  SELECT w AS word, CAST(sum(many) AS BIGINT) AS n FROM (
    SELECT many, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS w FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(many) >= 5
), cuts AS (
  SELECT word, n, CAST(i AS INT) AS i, left(word, CAST(i AS INT)) AS head, substr(word, CAST(i AS INT) + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a, b, nb FROM (
    SELECT x.word AS a, y.word AS b, y.n AS nb FROM cuts x JOIN cuts y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
    UNION ALL SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.head || x.tail = y.word
    UNION ALL SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.head || x.tail = y.word)
), best AS (
  SELECT a, count(*) AS n_near, max(nb) AS form_n, arg_min(b, (-nb, encode(b))) AS form FROM pairs GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON word = a
), chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)
""",
    "op12_collocations": """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (
      SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), scored AS (
  SELECT lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x USING (lang) JOIN f y USING (lang) JOIN totals USING (lang) WHERE x.phrase = head AND y.phrase = rest
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))
  GROUP BY ALL
), kept AS (
  SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
    "op13_decontamination": """
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT id, size, array_to_string(w[i : i + size - 1], ' ') AS p FROM (
    SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM item WHERE len(w) > 0))
), doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), found AS (
  SELECT row, i, d.size, id FROM (
    SELECT row, i, size, array_to_string(w[i : i + size - 1], ' ') AS p FROM (
      SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM pattern) WHERE len(w) >= size)) d
  JOIN pattern USING (p)
), hit AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM (SELECT row, i, unnest(range(size)) AS j FROM found) GROUP BY row),
ids AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY encode(id)) AS s FROM (SELECT DISTINCT row, id FROM found) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (row) LEFT JOIN ids USING (row)
""",
}
