import math
import os

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quarry.llm.common import Work
from quarry.llm.mixing import TARGETS, TOKEN, domain_posteriors, fit_steps, label_domain, mix, op5_soft_membership_mix, rate


def least_squares(a, goal, ridge=1e-4, rounds=200_000):
    """Projected gradient over all documents at once, in the metric of the operator."""
    n = len(a)
    second = a.T @ a / n
    w = np.linalg.pinv(second + 1e-9 * np.trace(second) * np.eye(a.shape[1]))
    r = np.ones(n)
    for _ in range(rounds):
        e = a.T @ r / n - goal
        new = np.maximum(0, r - (a @ (w @ e) + ridge * (r - 1)) / (1 + ridge))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


@pytest.mark.parametrize("goal", [(0.7, 0.2, 0.1), (0.1, 0.1, 0.8)])
def test_rates_meet_the_targets(spark, goal):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.3, 0.2], 300)
    tokens = rng.integers(1, 400, 300)
    df = spark.createDataFrame([(i, int(tokens[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    mean, steps = fit_steps(Work(spark, "t"), df, np.array(goal), rounds=200)
    r = np.array([x["rate"] for x in df.withColumn("rate", rate(mean, steps, 3)).orderBy("doc_id").collect()])
    got = (tokens[:, None] * p * r[:, None]).sum(axis=0) / tokens.sum()
    want = (tokens[:, None] * p * least_squares(tokens[:, None] * p / tokens.mean(), np.array(goal))[:, None]).sum(axis=0) / tokens.sum()
    assert (r >= 0).all() and np.allclose(got, goal, rtol=2e-3) and np.allclose(want, goal, rtol=1e-2)


def test_unreachable_target_ends(spark):
    df = spark.createDataFrame([(i, 10, 1.0, 0.0) for i in range(20)], "doc_id long, n_tokens long, p_0 double, p_1 double")
    mean, steps = fit_steps(Work(spark, "t"), df, np.array([0.5, 0.5]), rounds=8)
    got = df.withColumn("rate", rate(mean, steps, 2)).agg(F.avg("rate")).first()[0]
    assert abs(got - 0.5) < 0.05


def labelled(spark):
    good = [(i, "plain words about gardens and rivers number" + "x" * (i % 7), 1, 0) for i in range(60)]
    poor = [(100 + i, "### $$$ buy buy buy %%%" * (1 + i % 3), 0, 0) for i in range(40)]
    toxic = [(200 + i, "you idiot clown pathetic words about rivers" + "y" * (i % 5), 1, 1) for i in range(30)]
    return spark.createDataFrame(good + poor + toxic, "doc_id long, text string, quality int, toxic int")


def test_classifier_and_copies(spark):
    df = labelled(spark)
    labels = df.where("doc_id % 3 <> 0").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    out = mix(spark, df, labels, {"good": 0.5, "poor": 0.4, "toxic": 0.1}, columns=("text", "n_tokens")).collect()
    assert len(out) == 130 and "text" in out[0].asDict()
    best = {r["doc_id"]: max(("good", "poor", "toxic"), key=lambda d: r[f"p_{d}"]) for r in out}  # noqa: B023
    want = {i: "good" if i < 100 else "poor" if i < 200 else "toxic" for i in best}
    assert sum(best[i] == want[i] for i in best) >= 0.95 * len(best)
    assert all(abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 and abs(r["copies"] - r["rate"]) < 1 for r in out)


def test_posteriors_like_a_loop(spark):
    """Naive Bayes over hashed tokens, counted and summed by plain loops."""
    df = labelled(spark)
    labels = df.where("doc_id % 3 <> 0").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    buckets, domains = 512, ("good", "poor", "toxic")
    docs = df.select(F.struct(F.lit(0)).alias("row"), "doc_id", "text")
    got = {r["doc_id"]: [r[f"p_{k}"] for k in range(3)] for r in domain_posteriors(spark, docs, labels, domains, buckets=buckets).collect()}

    def bag(text):
        words = regex.findall(TOKEN, text.lower())
        out = set()
        for w in words:
            h = xxhash.xxh64(w.encode(), seed=42).intdigest()
            out.add((h - (1 << 64) if h >> 63 else h) % (buckets - 8))
        return out | {buckets - 8 + min(7, len(words) // max(1, len(out)))}, len(words)

    texts, of = {r["doc_id"]: r["text"] for r in df.collect()}, {r["doc_id"]: domains.index(r["domain"]) for r in labels.collect()}
    sizes = [sum(d == k for d in of.values()) for k in range(3)]
    n = [[sum(d == k and b in bag(texts[i])[0] for i, d in of.items()) for b in range(buckets)] for k in range(3)]
    weight = [[0.0] * buckets for _ in range(3)]
    for b in range(buckets):
        column, telling = [], False
        for k in range(3):
            rest, others = sum(n[j][b] for j in range(3)) - n[k][b], max(1, sum(sizes) - sizes[k])
            share, other = (n[k][b] + 0.5) / (sizes[k] + 1), (rest + 0.5) / (others + 1)
            both = sum(n[j][b] for j in range(3)) / sum(sizes)
            spread = math.sqrt(both * (1 - both) * (1 / max(1, sizes[k]) + 1 / others))
            telling |= abs(n[k][b] / max(1, sizes[k]) - rest / others) >= 5 * max(spread, 1e-9) and abs(math.log(share) - math.log(other)) >= 2
            column.append(math.log(share))
        for k in range(3):
            weight[k][b] = column[k] - sum(column) / 3 if telling else 0.0
    assert sum(any(weight[k][b] for k in range(3)) for b in range(buckets)) >= 5
    for i, text in texts.items():
        b, tokens = bag(text)
        z = [sum(weight[k][x] for x in b) / max(1.0, tokens / 300) + math.log(sizes[k] + 1) for k in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(got[i], [x / sum(e) for x in e], atol=1e-5), i


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_documents_come_as_near_as_can_be(spark):
    """Against the best of all nonnegative rates, found by plain projected gradients over all documents."""
    out = op5_soft_membership_mix(spark, "/root/testdata/sf0.001").where("n_tokens > 0").collect()
    a = np.array([[r["n_tokens"] * r[f"p_{d}"] for d in TARGETS] for r in out])
    goal = np.array(list(TARGETS.values()))
    a /= a.sum()
    far = lambda r: float(((a.T @ r - goal) ** 2).sum())
    best, step = np.ones(len(a)), 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(20_000):
        best = np.maximum(0, best - step * (a @ (a.T @ best - goal)))
    got = far(np.array([r["rate"] for r in out]))
    assert far(best) <= got <= 1.3 * far(best) + 1e-4 and got < far(np.ones(len(a))) / 3


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, "good"), (8, "poor"), (None, "good"), (99, "good"), (5, None)], "doc_id long, domain string")
    targets = {"good": 0.9, "poor": 0.1}
    got = mix(spark, awkward, labels, targets).collect()
    assert len(got) == 10 and all(r["rate"] == 1 and r["n_tokens"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert mix(spark, nothing, labels, targets).isEmpty()
    assert {round(r["p_good"], 6) for r in mix(spark, awkward, labels.where("false"), targets).collect()} == {0.5}


def test_no_python_on_the_executors(spark):
    df = labelled(spark)
    plan = mix(spark, df, df.select("doc_id", F.lit("good").alias("domain")), {"good": 0.9, "poor": 0.1})._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "PythonUDF" not in plan and "Pandas" not in plan
