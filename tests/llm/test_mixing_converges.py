"""The classifier and the fit against plain versions of both."""

import math
import random
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import LABELS, frame, labelled_corpus
from thicket.llm import mixing

DOMAINS = ("clean", "low", "toxic")


def posteriors(spark, seed, n=1500):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        toxic = 10 ** -r.uniform(0.3, 6)
        low = (1 - toxic) * (r.random() ** 8)
        rows.append((r.randint(0, 400), [1 - toxic - low, low, toxic]))
    return rows, spark.createDataFrame(rows, "_n long, _p array<double>")


def plain_fit(n, p, goal, base, rounds=200_000):
    """Accelerated projected gradient with a fixed step, run far beyond need."""
    m = (p * n[:, None]).T @ p / np.outer(base, base)
    step = 1 / np.linalg.eigvalsh(m).max()
    r = y = np.ones(len(n))
    t = 1.0
    for _ in range(rounds):
        miss = ((n * y) @ p - goal) / base
        new = np.clip(y - step * (p @ (miss / base)), 0, mixing.MOST)
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / u * (new - r), new, u
        if (miss**2).sum() < 1e-12:
            break
    return r


@pytest.mark.parametrize("targets", [{"clean": 1.0, "low": 0.3, "toxic": 0.5}, {"clean": 1.0, "low": 0.3, "toxic": 0.02}, {"clean": 1.0, "low": 2.0, "toxic": 0.0}, {"clean": 9.0, "low": 1.0, "toxic": 1.0}])
def test_the_fit_is_the_least_squares_answer(spark, targets):
    """Targets that can be met are; of those that can't (a rate is at most MOST), no rates come closer."""
    rows, df = posteriors(spark, 4)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        fit = mixing.fit_rates(df, DOMAINS, targets)
    n, p = np.array([x for x, _ in rows], float), np.array([x for _, x in rows])
    got = np.array([x["r"] for x in df.select(fit.rate().alias("r")).collect()])
    base = n @ p
    goal = base * [targets[d] for d in DOMAINS]
    loss = lambda r: ((((n * r) @ p - goal) / base) ** 2).sum() / 2
    best = loss(plain_fit(n, p, goal, base, 20_000))
    assert (got >= 0).all() and (got <= mixing.MOST).all()
    assert ((n * got) @ p - goal) / base == pytest.approx([fit.misses[d] for d in DOMAINS], abs=1e-9)
    if fit.met:
        assert np.abs(((n * got) @ p - goal) / base).max() < mixing.TOLERANCE
    elif fit.gap > mixing.GAP:  # a target of 0 for what every text has a trace of
        assert targets["toxic"] == 0.0 and max(map(abs, fit.misses.values())) < mixing.LOOSE
    else:
        assert best > mixing.TOLERANCE**2 / 2 and loss(got) <= best / (1 - mixing.GAP) + 1e-12


def test_targets_out_of_reach_are_told(spark):
    _, df = posteriors(spark, 5, 300)
    with pytest.warns(RuntimeWarning, match="can't be met"):
        mixing.fit_rates(df, DOMAINS, {"clean": 9.0})


def test_a_fit_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    _, df = posteriors(spark, 5, 300)
    with pytest.raises(mixing.MixingError):
        mixing.fit_rates(df, DOMAINS, {"clean": 0.2, "low": 3.0, "toxic": 0.01})


def test_posteriors_against_a_plain_classifier(spark):
    rows, labels = labelled_corpus(2)
    df = frame(spark, rows)
    domains = mixing.label_domains(spark.createDataFrame(labels, LABELS))
    model = mixing.train(df, domains)
    kind = {r["doc_id"]: r["domain"] for r in domains.collect()}
    seen = df.select("doc_id", mixing.buckets(mixing.words("text")).alias("b"), F.size(mixing.words("text")).alias("n"), F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))
    docs = {r["doc_id"]: (set(r["b"]), r["n"], r["half"]) for r in seen.collect()}
    texts = {k: t for k, t, *_ in rows}
    assert all(n == len([w for w in texts[k].lower().translate({ord(c): None for c in mixing.MARKS}).split() if w]) for k, (_, n, _) in docs.items())
    # log odds from the counting half
    by = defaultdict(Counter)
    sizes = Counter()
    for k, (b, _, half) in docs.items():
        if k in kind and half == 0:
            sizes[kind[k]] += 1
            for x in b:
                by[x][kind[k]] += 1
    total = sum(sizes.values())
    odds = {d: {} for d in DOMAINS}
    for x, c in by.items():
        for d in DOMAINS:
            a, n, rest, m = c[d], sizes[d], sum(c.values()) - c[d], total - sizes[d]
            share = (a + rest + 1) / (total + 2)
            if abs(a / n - rest / m) >= mixing.LEAST_Z * math.sqrt(share * (1 - share) * (1 / n + 1 / m)):
                odds[d][x] = math.log((a + 2 * share) / (n + 2) / ((rest + 2 * share) / (m + 2)))
    assert model.domains == DOMAINS
    for d, found in zip(DOMAINS, model.log_odds, strict=True):
        assert found == pytest.approx(odds[d])
    # posteriors are the softmax of the evidence, and add up to the shares of the calibrating half
    got = {r["doc_id"]: r["_p"] for r in mixing.with_posteriors(df, model).select("doc_id", "_p").collect()}
    for k, (b, n, _) in docs.items():
        z = []
        for d, (c, u, v) in zip(DOMAINS, model.weights, strict=True):
            e = sum(odds[d].get(x, 0.0) for x in b)
            z.append(c + u * e + v * e / n)
        want = np.exp(np.array(z) - max(z))
        assert got[k] == pytest.approx(list(want / want.sum()), abs=1e-3)
    held = [k for k in kind if docs[k][2] == 1]
    number = Counter(kind.values())
    here = Counter(kind[k] for k in held)
    weight = {k: number[kind[k]] / here[kind[k]] for k in held}
    for j, d in enumerate(DOMAINS):
        assert sum(weight[k] * got[k][j] for k in held) == pytest.approx(number[d], rel=0.05)
