"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A multinomial naive Bayes classifier over hashed words, fitted on the documents that labels name (at
most MAX_TRAINING_ROWS doc_ids, one fold left out), gives every document a posterior over domains.
Its log-odds are divided by a temperature that makes the left-out fold's domains most likely, so
memberships stay as soft as they are uncertain.  A document of t tokens counts t * posterior towards
each domain.  Projected gradient descent finds nonnegative rates x minimising

    sum over domains of weight_d * (sum_i x_i t_i p_id - target_d)^2 + ridge * sum_i t_i (x_i - base)^2

Each step is one distributed aggregation to as many sums as there are domains, after which all
rates move at once.  A document's rate after k steps is a fold over the k gradients so far, so no
state is written between steps; only the table of tokens and posteriors is.

Texts are exploded to words inside the scan; a word meets the table of log shares (at most
2**BITS rows, so it is broadcast) and the sums of a row are put together before the shuffle.

Defined cases
    null or empty text: no tokens; the posterior is the prior.  null doc_id: kept, never learned
    from.  null domain: not learned from.  Repeated rows: rows of their own.  A target for a domain
    that no document belongs to cannot be met: its gap is 1, and the other targets are fitted.  No
    labelled rows: uniform posteriors.  Empty table: no rows.  Extra columns: kept by resample,
    ignored by mixing_rates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import carried, discard, materialise, restored

#: Words are hashed to 2**BITS features.
BITS = 14
#: Bound on the doc_ids that a model is fitted on; they are broadcast, so texts are never shuffled.
MAX_TRAINING_ROWS = 20_000
#: Labelled rows whose hash modulo FOLDS is 0 set the temperature, the others the word shares.
FOLDS = 5
TEMPERATURES = tuple(2.0 ** (i / 2) for i in range(0, 21))


def words_of(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")


def feature(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << BITS)).cast("int")


def named(labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The doc_ids that labels name, each with its fold: the max_rows of them with the smallest hashes."""
    ids = labels.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    return ids.withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int"))


def place(domain: str, domains: list[str]) -> Column:
    """A domain's number; null for others."""
    return F.coalesce(*(F.when(F.col(domain).cast("string") == d, i) for i, d in enumerate(domains)))


def fit_words(docs: DataFrame, labels: DataFrame, domain: str, domains: list[str], smooth: float = 1.0) -> tuple[DataFrame, list[float]]:
    """(table, log priors): per feature its log share in each domain against the mean of all domains.

    Features that no labelled row has are left out; only sums per domain reach the driver.
    """
    own = docs.join(F.broadcast(named(labels)), F.col("doc_id").cast("long") == F.col("_id")).select(place(domain, domains).alias("d"), "_fold", "text").where("d IS NOT NULL")
    k = range(len(domains))
    words = own.where("_fold <> 0").select("d", F.explode(words_of("text")).alias("word")).where("word <> ''").select("d", feature("word").alias("h"))
    counts = materialise(words.groupBy("h").agg(*(F.count(F.when(F.col("d") == i, 1)).alias(f"c{i}") for i in k)), "words")
    sums = counts.agg(*(F.sum(f"c{i}").alias(f"s{i}") for i in k)).first()
    rows = {r["d"]: r["n"] for r in own.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    priors = [math.log((rows.get(i, 0) + 1) / (sum(rows.values()) + len(domains))) for i in k]
    logs = [F.log((F.col(f"c{i}") + smooth) / F.lit((sums[i] or 0) + smooth * (1 << BITS))) for i in k]
    mean = sum(logs, F.lit(0.0)) / len(domains)
    return counts.select("h", *((x - mean).alias(f"w{i}") for i, x in enumerate(logs))), priors


def evidence(docs: DataFrame, table: DataFrame, domain: str, domains: list[str]) -> DataFrame:
    """Per row of docs doc_id, d (its domain's number), tokens, and per domain the sum of its words' log shares."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), place(domain, domains).alias("d"), words_of("text").alias("words"))
    words = rows.select("_row", "doc_id", "d", F.explode("words").alias("word")).withColumn("h", feature("word"))
    words = words.join(F.broadcast(table), "h", "left")  # at most 2**BITS rows
    real = F.col("word") != ""
    sums = [F.sum(F.when(real, F.coalesce(f"w{i}", F.lit(0.0))).otherwise(0.0)).alias(f"e{i}") for i in range(len(domains))]
    return words.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("d").alias("d"), F.count(F.when(real, 1)).alias("tokens"), *sums).drop("_row")


def with_posteriors(rows: DataFrame, priors: list[float], temperature: float) -> DataFrame:
    logits = F.array(*(F.lit(p) + F.col(f"e{i}") / temperature for i, p in enumerate(priors)))
    scored = rows.withColumn("logits", logits).withColumn("top", F.array_max("logits")).withColumn("e", F.expr("transform(logits, x -> exp(x - top))")).withColumn("z", F.expr("aggregate(e, 0D, (a, x) -> a + x)"))
    return scored.withColumn("p", F.expr("transform(e, x -> x / z)")).drop("logits", "top", "e", "z", *(f"e{i}" for i in range(len(priors))))


def fit_temperature(held: DataFrame, priors: list[float]) -> float:
    """The temperature under which the held rows' domains are most likely: one aggregation over all trials."""

    def loss(t: float) -> Column:
        logits = F.array(*(F.lit(p) + F.col(f"e{i}") / t for i, p in enumerate(priors)))
        top = F.array_max(logits)
        return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) - F.element_at(logits, F.col("d") + 1)

    got = held.where("d IS NOT NULL").agg(*(F.sum(loss(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    return 1.0 if got[0] is None else min(zip(got, TEMPERATURES, strict=True))[1]


def _rate(history: list[list[float]], base: float, step: float, ridge: float) -> Column:
    """The rate after the steps so far: a fold over their gradients, projected to x >= 0 each time."""
    if not history:
        return F.lit(base)
    steps = ", ".join("array(" + ", ".join(f"{g!r}D" for g in gradient) + ")" for gradient in history)
    dot = " + ".join(f"p[{i}] * g[{i}]" for i in range(len(history[0])))
    return F.expr(f"aggregate(array({steps}), {base!r}D, (x, g) -> greatest(0D, x - {step!r}D * ({dot} + {ridge!r}D * (x - {base!r}D))))")


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], keep: float = 1.0, ridge: float = 1e-4, most_steps: int = 100, tolerance: float = 5e-4) -> tuple[Column, list[float]]:
    """(rate, gaps): a column expression over p that gives each document's rate, and per domain how far its
    token total lies from its target, as a share of the target.

    targets are weights (scaled to sum 1); together the domains get ``keep`` of all tokens.  Steps
    end once every reachable target is met within the tolerance; gaps say what was reached.
    """
    k = len(domains)
    goal = sum(targets.values())
    history: list[list[float]] = []
    step = 1.0

    def totals() -> list[float]:
        x = _rate(history, keep, step, ridge)
        row = members.select(x.alias("x"), "tokens", "p").agg(*(F.sum(F.col("x") * F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k))).first()
        return [float(v or 0.0) for v in row]

    held = [v / keep for v in totals()]  # with no step done every rate is the base rate
    everything = sum(held)
    if not everything:
        return F.lit(keep), [1.0 if targets.get(d, 0.0) else 0.0 for d in domains]
    live = [h > 1e-9 * everything for h in held]
    wanted = [targets.get(d, 0.0) / goal * keep * everything for d in domains]
    step = 0.9 / (1 + ridge)
    now = [h * keep for h in held]
    gaps = lambda: [abs(s - w) / max(w, 1e-6 * everything) for s, w in zip(now, wanted, strict=True)]
    for _ in range(most_steps):
        if max((g for g, alive in zip(gaps(), live, strict=True) if alive), default=0.0) < tolerance:
            break
        # residues in units of what the domain holds: the curvature is then near 1 in every direction
        history.append([(s - w) / h if alive else 0.0 for s, w, h, alive in zip(now, wanted, held, live, strict=True)])
        now = totals()
    return _rate(history, keep, step, ridge), gaps()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", keep: float = 1.0, **options) -> DataFrame:
    """doc_id, tokens, one posterior per domain, rate, copies (the rate rounded by a hash of doc_id), and gap.

    gap is the largest distance of a domain's token total from its target, as a share of the
    target: 0 where the fit reached them all.
    """
    docs, domains = docs.select("doc_id", "text", domain), sorted(targets)
    table, priors = fit_words(docs, labels, domain, domains)
    rows = materialise(evidence(docs, table, domain, domains), "evidence")
    held = rows.join(F.broadcast(named(labels).where("_fold = 0")), F.col("doc_id") == F.col("_id"), "left_semi")
    members = materialise(with_posteriors(rows, priors, fit_temperature(held, priors)).select("doc_id", "tokens", "p"), "members")
    discard(rows)
    rate, gaps = fit_rates(members, domains, targets, keep, **options)
    out = members.withColumn("rate", rate)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies.cast("int").alias("copies"), F.lit(max(gaps, default=0.0)).alias("gap"))


def resample(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Every document as often as its copies say.  Rows that share a doc_id share its largest number; null ids stay once."""
    often = rates.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_id")
    rows = carried(docs, "doc_id").join(often, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("_copies", F.lit(1)), F.lit(1))))).where((F.col("_n") <= F.coalesce("_copies", F.lit(1))))
    return restored(rows, docs, "doc_id")
