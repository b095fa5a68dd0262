"""Mixing documents to target weights with soft memberships; DataFrame and SQL functions only.

A classifier learned from a labelled table gives every document a posterior over the labelled domains.  Its evidence for
a domain is the sum, over the distinct words of a text (hashed to BUCKETS), of the log odds that texts of the domain hold
the word, for words whose shares differ by LEAST_Z standard errors or more.  One half of the labelled sample counts words;
the other half calibrates: a softmax regression on each domain's evidence, summed and per word, fitted by likelihood, so
that the posteriors of a domain add up to its share.

Document rates 0 <= r <= MOST are then fitted so that the expected tokens of each domain, T_k(r) = sum_d r_d n_d p_dk,
meet that domain's target t_k: projected gradient descent on half the squared misses f, relative to T(1),

    r_d <- min(MOST, max(0, r_d - s * g_d)),    g_d = sum_k p_dk (T_k - t_k) / T_k(1)^2,    r = 1 at the start.

The gradient is taken in the metric that weighs a document by its tokens.  Step lengths are those of Barzilai and Borwein
with a search back for enough descent below the largest of the last few f, which converges for convex f.  One round is one
aggregate of a few sums; a document's rate is an expression in its posteriors and the steps, so nothing is joined or
shuffled by document, and every STAGE_EVERY steps the rates are written with their posteriors, which keeps the expression
small.  The fit ends when all misses are below TOLERANCE, or when the duality gap (an upper bound of what is left to gain)
is below GAP of f: then the targets can't be met at once, the rates are the least squares answer, and the misses are told
in a warning.  A fit that ends neither way within ROUNDS (targets of 0 for a domain that every text has a trace of make
it slow) warns too if its misses are within LOOSE, and raises an error otherwise.

The classifier learns from at most DOCS labelled documents of each domain (by a hash of the id); everything else runs
over all rows, of any length.  Null counts as an empty text; texts without words have the prior as posterior and carry no
tokens.  A domain with no expected tokens is left out of the fit.  Without labelled rows there is one domain, "all".  An
id that is labelled more than once counts in its smallest domain.  Rows that repeat are weighed alike and each counts;
rows that agree in their id (null too) share the hash that settles the fraction of their copies.  Empty tables give empty
results, and columns other than the text's and the id's are passed on unread, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DOCS = 3_000
BUCKETS = 1 << 16
LEAST_Z = 3.0
#: Texts without a word that every share is smoothed by.
SMOOTH = 2.0
#: Largest rate of a document.
MOST = 4.0
ROUNDS = 200
TOLERANCE, LOOSE = 1e-3, 2e-2
#: Duality gap, as a share of f, at which the targets count as out of reach.
GAP = 1e-2
#: Step lengths worked out in one pass, values of f that a step may rise to, and steps between two tables of rates.
AHEAD, MEMORY, STAGE_EVERY = 3, 5, 8
MOST_DOMAINS = 64
SPACES = r"[\x20\x09-\x0D]+"
MARKS = ".,:;!?\"()"
#: Targets as multiples of each domain's expected tokens in the input.
TARGETS = {"clean": 1.0, "low": 0.3, "toxic": 0.3}


class MixingError(RuntimeError):
    """A fit that did not settle."""


def words(text: str) -> Column:
    """Runs without white space, in lower case, without MARKS."""
    plain = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), MARKS, "")
    return F.filter(F.split(plain, SPACES, -1), lambda w: w != "")


def buckets(tokens: Column) -> Column:
    """The distinct buckets of the words."""
    return F.array_distinct(F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _array(values: list[float], kind: str) -> Column:
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast(f"array<{kind}>")


def _looked_up(places: Column, table: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, k: a + F.get(table, k))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    log_odds: tuple[dict[int, float], ...]  # for each domain: bucket -> log odds against all others
    weights: tuple[tuple[float, float, float], ...]  # for each domain: constant, evidence, evidence per word

    def with_evidence(self, df: DataFrame) -> DataFrame:
        """df with _e, an array of the evidence (sum, per word) for each domain, from _b (distinct buckets) and _n (words)."""
        told = sorted(set().union(*self.log_odds))
        place = [0] * BUCKETS
        for k, b in enumerate(told):
            place[b] = k + 1
        at = _array(place, "int")
        names = [f"_t{k}" for k in range(len(self.domains))]
        # one column after the other, so that each expression is worked out once
        out = df.withColumn("_h", F.filter(F.transform("_b", lambda b: F.get(at, b)), lambda k: k > 0))
        out = out.withColumns({c: _looked_up(F.col("_h"), _array([0.0, *(odds.get(b, 0.0) for b in told)], "double")) for c, odds in zip(names, self.log_odds, strict=True)})
        return out.withColumn("_e", F.array(*[F.array(F.col(c), F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(0.0)) for c in names])).drop("_h", *names)

    def with_posterior(self, df: DataFrame) -> DataFrame:
        """df with _p, p(domain | text), from _e."""
        e = F.col("_e")
        out = df.withColumn("_logs", F.array(*[F.lit(a) + F.lit(b) * e[k][0] + F.lit(c) * e[k][1] for k, (a, b, c) in enumerate(self.weights)]))
        out = out.withColumn("_top", F.array_max("_logs")).withColumn("_pow", F.transform("_logs", lambda x: F.exp(x - F.col("_top"))))
        out = out.withColumn("_sum", F.aggregate("_pow", F.lit(0.0), lambda x, y: x + y))
        return out.withColumn("_p", F.transform("_pow", lambda x: x / F.col("_sum"))).drop("_logs", "_top", "_pow", "_sum")


def log_odds(counts: dict[int, dict[str, int]], sizes: dict[str, int], domains: tuple[str, ...]) -> tuple[dict[int, float], ...]:
    """For each domain, the smoothed log odds of the buckets that tell it from the others."""
    total, out = sum(sizes.get(d, 0) for d in domains), []
    for d in domains:
        n, found = sizes.get(d, 0), {}
        for b, by in counts.items():
            a, c = by.get(d, 0), sum(by.values())
            share = (c + 1) / (total + 2)
            if n and total > n:
                z = (a / n - (c - a) / (total - n)) / math.sqrt(share * (1 - share) * (1 / n + 1 / (total - n)))
                if abs(z) >= LEAST_Z:
                    found[b] = math.log((a + SMOOTH * share) / (n + SMOOTH)) - math.log((c - a + SMOOTH * share) / (total - n + SMOOTH))
        out.append(found)
    return tuple(out)


def calibrate(rows: list[tuple[int, float, list[tuple[float, float]]]], prior: list[float], rounds: int = 30) -> tuple[tuple[float, float, float], ...]:
    """Softmax regression: rows are (domain, weight, evidence of each domain).  Newton steps for one domain after the
    other, halved against overshooting, with a small ridge; without rows, the priors."""
    k = len(prior)
    theta = [[math.log(p), 1e-3, 1e-3] for p in prior]
    total = sum(w for _, w, _ in rows)
    for _ in range(rounds if total else 0):
        grads = [[-1e-4 * total * t if i else 0.0 for i, t in enumerate(theta[j])] for j in range(k)]
        curves = [[[(1e-4 * total if i else 1e-9 * total) if i == h else 0.0 for h in range(3)] for i in range(3)] for _ in range(k)]
        for y, w, found in rows:
            z = [a + b * u + c * v for (a, b, c), (u, v) in zip(theta, found, strict=True)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            s = sum(e)
            for j, (u, v) in enumerate(found):
                q = e[j] / s
                g, h = w * ((y == j) - q), w * q * (1 - q)
                f = (1.0, u, v)
                for a in range(3):
                    grads[j][a] += g * f[a]
                    for b in range(a + 1):
                        curves[j][a][b] += h * f[a] * f[b]
        moved = 0.0
        for j in range(k):
            for a in range(3):
                for b in range(a):
                    curves[j][b][a] = curves[j][a][b]
            step = solve(curves[j], grads[j])
            # bounded steps: the first ones start far away
            theta[j] = [t + max(-2.0, min(2.0, 0.6 * x)) for t, x in zip(theta[j], step, strict=True)]
            moved = max(moved, *map(abs, step))
        if moved < 1e-4:
            break
    return tuple((t[0], t[1], t[2]) for t in theta)


def train(df: DataFrame, labelled: DataFrame, domain: str = "domain", text: str = "text", id_col: str = "doc_id", docs: int = DOCS) -> Classifier:
    one = labelled.where(F.col(id_col).isNotNull() & F.col(domain).isNotNull()).groupBy(id_col).agg(F.min(domain).alias("_domain"))
    sizes = {r["_domain"]: r["count"] for r in one.groupBy("_domain").count().orderBy("_domain").limit(MOST_DOMAINS + 1).collect()}
    if not sizes:
        return Classifier(("all",), ({},), ((0.0, 0.0, 0.0),))
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    picks = [one.where(F.col("_domain") == d).orderBy(F.xxhash64(id_col), id_col).limit(docs) for d in sizes]
    chosen = picks[0]
    for p in picks[1:]:
        chosen = chosen.union(p)
    chosen = chosen.select(F.col(id_col).alias("_id"), "_domain")
    sample = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = sample.withColumn("_w", words("_text")).select("_id", "_domain", F.size("_w").alias("_n"), buckets(F.col("_w")).alias("_b"))
    sample = staged(sample.withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2))), "sample")
    domains = tuple(sizes)
    counted = sample.where("_half = 0")
    half = {r["_domain"]: r["count"] for r in counted.groupBy("_domain").count().collect()}
    found: dict[int, dict[str, int]] = {}
    for r in counted.select("_domain", F.explode("_b").alias("bucket")).groupBy("_domain", "bucket").count().collect():
        found.setdefault(r["bucket"], {})[r["_domain"]] = r["count"]
    prior = [n / sum(sizes.values()) for n in sizes.values()]
    draft = Classifier(domains, log_odds(found, half, domains), ((0.0, 0.0, 0.0),) * len(domains))
    rows = draft.with_evidence(sample.where("_half = 1")).select("_domain", "_e").collect()
    seen = {d: sum(r["_domain"] == d for r in rows) for d in domains}
    data = sorted((domains.index(r["_domain"]), sizes[r["_domain"]] / seen[r["_domain"]], [(u, v) for u, v in r["_e"]]) for r in rows)
    return Classifier(domains, draft.log_odds, calibrate(data, prior))


def with_posteriors(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """df with _n (words) and _p (posteriors)."""
    out = df.withColumn("_w", words(text)).withColumn("_n", F.size("_w").cast("long")).withColumn("_b", buckets(F.col("_w"))).drop("_w")
    return model.with_posterior(model.with_evidence(out)).drop("_b", "_e")


def solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Gaussian elimination with a small ridge."""
    n = len(v)
    ridge = 1e-9 * max(max(m[k][k] for k in range(n)), 1e-300)
    rows = [[*(m[i][j] + (ridge if i == j else 0.0) for j in range(n)), v[i]] for i in range(n)]
    for k in range(n):
        pivot = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[pivot] = rows[pivot], rows[k]
        for i in range(n):
            if i != k and rows[k][k]:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [rows[k][n] / rows[k][k] if rows[k][k] else 0.0 for k in range(n)]


def _moved(rate: Column, p: list[Column], x: list[float]) -> Column:
    return F.least(F.lit(MOST), F.greatest(F.lit(0.0), rate - sum((c * F.lit(y) for c, y in zip(p, x, strict=True)), F.lit(0.0))))


@dataclass(frozen=True)
class Fit:
    """steps: what each step takes from a rate, for each unit of posterior.  misses: (T - t) / T(1) for each domain."""

    domains: tuple[str, ...]
    steps: list[list[float]]
    history: list[dict[str, float]]  # totals after each step
    misses: dict[str, float]
    gap: float  # as a share of f
    rounds: int

    @property
    def met(self) -> bool:
        return max(map(abs, self.misses.values()), default=0.0) < TOLERANCE

    def rate(self) -> Column:
        """The fitted rate, as an expression in _p."""
        if not self.steps:
            return F.lit(1.0)
        p = F.col("_p")
        table = F.from_json(F.lit(str(self.steps)), "array<array<double>>")
        return F.aggregate(table, F.lit(1.0), lambda r, x: F.least(F.lit(MOST), F.greatest(F.lit(0.0), r - sum((p[k] * x[k] for k in range(len(self.domains))), F.lit(0.0)))))


def fit_rates(posteriors: DataFrame, domains: tuple[str, ...], targets: dict[str, float]) -> Fit:
    """Rates for the rows (_n, _p); see the module."""
    size = range(len(domains))
    names = [f"p{k}" for k in size]
    p = [F.col(c) for c in names]
    n = F.col("_n")
    flat = staged(posteriors.where("_n > 0").select("_n", *[F.col("_p")[k].alias(c) for k, c in enumerate(names)], F.lit(1.0).alias("_r")), "rates")
    first = [float(x or 0.0) for x in flat.agg(*[F.sum(n * c) for c in p], *[F.sum(n * c * c) for c in p]).first()]
    base, squares = first[: len(domains)], first[len(domains) :]
    goal = [targets.get(d, 1.0) * b for d, b in zip(domains, base, strict=True)]
    some = [k for k in size if base[k] > 0]

    def misses(t: list[float]) -> list[float]:
        return [(t[k] - goal[k]) / base[k] if k in some else 0.0 for k in size]

    def loss(t: list[float]) -> float:
        return sum(x * x for x in misses(t)) / 2

    now, rate, steps, past = base, F.col("_r"), [], [loss(base)]
    history = [dict(zip(domains, now, strict=True))]
    # no step is shorter than what the sum of the curvatures allows, at the start
    step = 1.0 / max(sum(squares[k] / base[k] ** 2 for k in some), 1e-300) if some else 0.0
    kept = rounds = 0
    gap = math.inf
    while rounds < ROUNDS:
        if max(map(abs, misses(now)), default=0.0) < TOLERANCE:
            break
        rounds += 1
        slope = [misses(now)[k] / base[k] if k in some else 0.0 for k in size]
        lengths = [step / 4**i for i in range(AHEAD)]
        moves = [[s * y for y in slope] for s in lengths]
        rows = flat.select("_n", *names, rate.alias("_r"))
        rows = rows.select("*", *[_moved(F.col("_r"), p, x).alias(f"r{i}") for i, x in enumerate(moves)], sum((c * F.lit(y) for c, y in zip(p, slope, strict=True)), F.lit(0.0)).alias("_g"))
        wanted = [F.sum(n * F.when(F.col("_g") > 0, F.col("_g") * F.col("_r")).otherwise(F.col("_g") * (F.col("_r") - MOST)))]
        for i in range(AHEAD):
            r = F.col(f"r{i}")
            wanted += [*[F.sum(n * r * c) for c in p], F.sum(n * (r - F.col("_r")) * (r - F.col("_r")))]
        found = [float(x or 0.0) for x in rows.agg(*[c.alias(f"s{i}") for i, c in enumerate(wanted)]).first()]
        gap = found[0] / max(loss(now), 1e-300)
        if gap <= GAP:
            break
        width = len(domains) + 1
        for i, (s, move) in enumerate(zip(lengths, moves, strict=True)):
            part = found[1 + i * width : 1 + (i + 1) * width]
            then, moved = part[:-1], part[-1]
            if loss(then) <= max(past[-MEMORY:]) - 1e-4 * moved / s:
                curve = sum(((then[k] - now[k]) / base[k]) ** 2 for k in some)
                rate, now, step = _moved(rate, p, move), then, moved / curve if curve > 0 else 4 * s
                steps.append(move)
                past.append(loss(now))
                history.append(dict(zip(domains, now, strict=True)))
                break
        else:
            step /= 4**AHEAD
        if len(steps) - kept == STAGE_EVERY:
            flat = staged(flat.select("_n", *names, rate.alias("_r")), "rates")
            rate, kept = F.col("_r"), len(steps)
    fit = Fit(domains, steps, history, dict(zip(domains, misses(now), strict=True)), gap, rounds)
    if not fit.met:
        if gap > GAP and max(map(abs, fit.misses.values())) > LOOSE:
            raise MixingError(f"after {rounds} rounds the totals miss their targets by {fit.misses} of the input's, and up to {gap:.3g} of the loss could still be gained")
        why = "the targets can't be met at once" if gap <= GAP else f"{rounds} rounds were not enough"
        warnings.warn(f"mixing: {why}; the totals miss the targets by {fit.misses} of the input's", RuntimeWarning, stacklevel=2)
    return fit


def copies(rate: Column, key: Column) -> Column:
    """Whole number of copies with the rate as its mean: the fraction is settled by a hash."""
    unit = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + unit).cast("long")


def _prepared(df: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float], text: str, id_col: str) -> tuple[Classifier, DataFrame, Fit]:
    model = train(df, labelled, domain, text, id_col)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = staged(with_posteriors(rows, model, "_text").select("_id", "_n", "_p"), "posteriors")
    return model, found, fit_rates(found, model.domains, targets)


def weigh(df: DataFrame, labelled: DataFrame, domain: str = "domain", targets: dict[str, float] = TARGETS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: the id, n_words, posterior (map of domain to probability), rate, copies."""
    model, found, fit = _prepared(df, labelled, domain, targets, text, id_col)
    names = F.array(*map(F.lit, model.domains))
    return found.withColumn("rate", fit.rate()).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.map_from_arrays(names, "_p").alias("posterior"), "rate", copies(F.col("rate"), F.col("_id")).alias("copies")
    )


def achieved(weighed: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, target, by_rates, by_copies): expected tokens of each domain as multiples of the input's."""
    rows = weighed.select("n_words", "rate", "copies", F.explode("posterior").alias("domain", "p"))
    t = F.col("n_words") * F.col("p")
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]), F.col("domain")), F.lit(1.0)) if targets else F.lit(1.0)
    sums = rows.groupBy("domain").agg(F.sum(t).alias("t"), F.sum(t * F.col("rate")).alias("r"), F.sum(t * F.col("copies")).alias("c"))
    return sums.select("domain", wanted.alias("target"), (F.col("r") / F.col("t")).alias("by_rates"), (F.col("c") / F.col("t")).alias("by_copies"))


def mix(df: DataFrame, labelled: DataFrame, domain: str = "domain", targets: dict[str, float] = TARGETS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df, each as often as its copies say, with df's columns."""
    model, _, fit = _prepared(df, labelled, domain, targets, text, id_col)
    fields = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_all"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    weighed = with_posteriors(packed, model, "_text").select("_all", copies(fit.rate(), F.col("_id")).alias("_copies"))
    # a filter on _copies would be pushed below the projection and work out every posterior twice
    times = F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    out = weighed.select("_all", F.explode_outer(times).alias("_k")).where("_k is not null")
    return out.select(*[F.col("_all").getField(c).alias(c) for c in fields])


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from the table `labels`: toxic, low (quality) or clean; rows without labels are left out."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "clean")
    return labels.select(id_col, kind.alias("domain")).where("domain is not null")
