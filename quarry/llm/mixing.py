"""Mixing to target weights with soft domain membership, in DataFrame functions alone.

1. A labelled table gives some documents a domain. A naive Bayes classifier over
   the presence of hashed tokens (words and groups of symbols) learns, from those
   that tell domains apart significantly, from a bounded sample of it, ``sample`` rows drawn by a hash of the id; the sample's
   ids are broadcast, so texts aren't shuffled. Training returns ``buckets`` counts
   per domain to the driver, whatever the size of the corpus.
2. Every document gets its token count and the posterior of each domain, and adds
   its tokens to a domain in the proportion of the posterior.
3. Rates r >= 0 per document solve the least-squares problem
   |E[tokens by domain](r) - targets|^2 + ridge * |r - 1|^2 by projected gradient:
   r <- max(0, r - step * (a . W residual + ridge * (r - 1))). The residual has one
   number per domain and is, with the second moments of a over the documents whose
   rate isn't zero, all that a round brings to the driver; W is the inverse of those
   moments, which makes the step independent of the corpus. A step that gains too
   little is taken back for one with the moments over all documents, which can't
   enlarge the residual. Rounds end when every domain is within ``tolerance`` of its target share, or after
   ``rounds``. If a target can't be reached (a domain without tokens) the result
   is the least-squares fit.
4. ``copies`` rounds the rate up or down by a keyed hash of the id, so that the
   expected number of copies is the rate.

Edge cases: null and empty texts have no tokens; their rate is 1 and they take no
part in the fit. Labels that are null or of unknown documents aren't learned
from; without any label all domains are equally likely. Repeated rows each get a
rate. Of the other columns of the documents those named in ``columns`` are kept,
but for names of the result. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, bounded_sample, table

TOKEN = r"[\p{L}\p{N}]+|[#*$%&|<>!]+"
SHAPES = 8
RIDGE = 1e-4
DOMAINS = ("good", "poor", "toxic")
RESULT = ("n_tokens", "rate", "copies")
TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with n_tokens and b: the distinct buckets of a text's tokens, and one for how often it repeats them.

    In steps, so that tokens are found once: the optimizer doesn't join steps whose result is used twice.
    """
    words = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0), F.array().cast("array<string>"))
    out = docs.withColumn("_w", words)
    out = out.withColumn("_u", F.array_distinct(F.transform("_w", lambda t: F.pmod(F.xxhash64(t), F.lit(buckets - SHAPES)).cast("int"))))
    out = out.withColumn("n_tokens", F.size("_w").cast("long"))
    repeated = F.floor(F.least(F.lit(SHAPES - 1.0), F.col("n_tokens") / F.greatest(F.lit(1), F.size("_u")))).cast("int")
    return out.withColumn("b", F.concat("_u", F.array(F.lit(buckets - SHAPES) + repeated))).drop("_w", "_u")


def _numbers(values: np.ndarray) -> Column:
    """A constant array; folded once by the optimizer."""
    return F.split(F.lit(",".join(f"{v:.8g}" for v in values)), ",").cast("array<double>")


def domain_posteriors(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], *, sample: int = 20_000, buckets: int = 1 << 14, telling: float = 5.0, least_odds: float = 2.0, evidence: float = 300.0, smoothing: float = 0.5
) -> DataFrame:
    """docs (row, doc_id, text) with n_tokens and p_0, p_1, ... in the order of domains; labels has doc_id and domain."""
    named = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    chosen = bounded_sample(named, F.col("doc_id"), sample).select("doc_id", "domain")
    used = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of at most ``sample`` rows
    # b is never empty; a plain explode would have Spark test that for all documents, below the join
    counts = _bucketed(used, buckets).select("domain", F.explode_outer("b").alias("b")).groupBy("domain", "b").count().collect()
    sizes = np.zeros(len(domains))
    for domain, c in used.groupBy("domain").count().collect():
        sizes[domains.index(domain)] = c
    n = np.zeros((len(domains), buckets))
    for domain, b, c in counts:
        n[domains.index(domain), b] = c
    share = (n + smoothing) / (sizes[:, None] + 2 * smoothing)
    rest, others = n.sum(axis=0) - n, np.maximum(sizes.sum() - sizes, 1)[:, None]
    odds = np.log(share) - np.log((rest + smoothing) / (others + 2 * smoothing))
    weight = np.log(share)
    weight -= weight.mean(axis=0)
    # tokens that tell no domain from the others add only noise
    both = n.sum(axis=0) / max(1.0, sizes.sum())
    spread = np.sqrt(both * (1 - both) * (1 / np.maximum(sizes, 1)[:, None] + 1 / others))
    sure = np.abs(n / np.maximum(sizes, 1)[:, None] - rest / others) >= telling * np.maximum(spread, 1e-9)
    weight[:, ~(sure & (np.abs(odds) >= least_odds)).any(axis=0)] = 0
    prior = np.log(sizes + 1)
    tables = [_numbers(w) for w in weight]
    scored = _bucketed(docs, buckets)
    zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(len(domains))))
    total = F.aggregate("b", zero, lambda a, b: F.struct(*((a[f"s{k}"] + F.get(tables[k], b)).alias(f"s{k}") for k in range(len(domains)))))
    scored = scored.withColumn("s", total).drop("b", "text")
    # a long text has any token sooner or later: its evidence counts as that of ``evidence`` tokens
    scale = F.greatest(F.lit(1.0), F.col("n_tokens") / evidence)
    for k in range(len(domains)):
        scored = scored.withColumn(f"z{k}", F.col(f"s.s{k}") / scale + float(prior[k]))
    scored = scored.withColumn("top", F.greatest(*(F.col(f"z{k}") for k in range(len(domains)))))
    for k in range(len(domains)):
        scored = scored.withColumn(f"z{k}", F.exp(F.col(f"z{k}") - F.col("top")))
    all_ = sum((F.col(f"z{k}") for k in range(1, len(domains))), F.col("z0"))
    return scored.select("row", "doc_id", "n_tokens", *((F.col(f"z{k}") / all_).alias(f"p_{k}") for k in range(len(domains))))


def fit_steps(work: Work, posteriors: DataFrame, targets: np.ndarray, *, rounds: int = 60, ridge: float = RIDGE, tolerance: float = 1e-3, every: int = 10) -> tuple[float, list[np.ndarray]]:
    """The mean number of tokens and the steps that lead from rates of 1 to the fit; targets are shares of the total."""
    k = len(targets)
    p = [F.col(f"p_{i}") for i in range(k)]
    tokens = F.col("n_tokens").cast("double")
    first = posteriors.where("n_tokens > 0").agg(F.count("*"), F.avg(tokens)).first()
    if not first[0]:
        return 1.0, []
    count, mean = first
    a = [F.col(f"a_{i}") for i in range(k)]
    state = posteriors.select(*((tokens * p[i] / mean).alias(f"a_{i}") for i in range(k)), F.lit(1.0).alias("rate"))
    goal = targets / targets.sum()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        free = F.col("rate") > 0
        sums = [F.sum(a[i] * F.col("rate")) for i in range(k)] + [F.sum(F.when(free, a[i] * a[j])) for i, j in pairs]
        got = np.array([x or 0.0 for x in df.agg(*sums).first()], dtype=float) / count
        second = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            second[i, j] = second[j, i] = x
        return got[:k] - goal, second

    def moved(df: DataFrame, v: np.ndarray) -> DataFrame:
        down = sum((a[i] * float(v[i]) for i in range(1, k)), a[0] * float(v[0]))
        # the rate appears once, so that the expression grows by one term a round
        return df.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") * (1 - step * ridge) + (step * ridge - down)))

    def inverse(m: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(m + 1e-9 * max(np.trace(m), 1e-9) * np.eye(k))

    step, taken, plain, steps = 1.0 / (1.0 + ridge), 0, False, []
    residual, second = measure(state)
    metric = inverse(second)  # of the objective; in it a plain step never enlarges the residual
    for t in range(rounds):
        if np.all(np.abs(residual) <= tolerance * np.maximum(goal, tolerance)):
            break
        v = step * ((metric if plain else inverse(second)) @ residual)
        tried = moved(state, v)
        new, moments = measure(tried)
        if not plain and new @ metric @ new > 0.9 * (residual @ metric @ residual):
            plain = True
            continue
        plain = False
        taken += 1
        steps.append(v)
        state = work.write(tried, f"rates-{t}") if taken % every == 0 else tried
        residual, second = new, moments
    return mean, steps


def rate(mean: float, steps: list[np.ndarray], k: int, ridge: float = RIDGE) -> Column:
    """The rate of a document with n_tokens and p_0, p_1, ... after the steps."""
    if not steps:
        return F.lit(1.0)
    step = 1.0 / (1.0 + ridge)
    a = [F.col("n_tokens").cast("double") * F.col(f"p_{i}") / mean for i in range(k)]

    def moved(r: Column, v: Column) -> Column:
        down = sum((a[i] * F.get(v, F.lit(i)) for i in range(1, k)), a[0] * F.get(v, F.lit(0)))
        return F.greatest(F.lit(0.0), r * (1 - step * ridge) + (step * ridge - down))

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in v)) for v in steps)), F.lit(1.0), moved)


def mix(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: str = "quarry",
    columns: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Return doc_id, the named columns of docs, n_tokens, p_<domain>, rate and copies, one row per row of docs.

    labels has doc_id and domain. targets are the wanted shares of the total of tokens by domain.
    """
    work = Work(spark, "mixing")
    domains = tuple(targets)
    kept = [c for c in columns if c in docs.columns and c not in RESULT and c != "doc_id"]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *kept).alias("row"))
    scored = work.write(domain_posteriors(spark, base, labels.select(F.col("doc_id").cast("long"), "domain"), domains, **options), "posteriors")
    mean, steps = fit_steps(work, scored, np.array([targets[d] for d in domains], dtype=float))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(key)), F.lit(1 << 30)) / float(1 << 30)
    return scored.select(
        "doc_id",
        *(F.col("row").getField(c).alias(c) for c in kept),
        "n_tokens",
        *(F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)),
        F.when(F.col("n_tokens") > 0, rate(mean, steps, len(domains))).otherwise(1.0).alias("rate"),
    ).withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def op5_soft_membership_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    return mix(spark, table(spark, sf_dir, "documents"), labels, TARGETS)
