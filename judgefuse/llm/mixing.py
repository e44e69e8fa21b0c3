"""Mixing sources to target weights by soft membership, all native.

A naive Bayes classifier over binned statistics of a text learns from a labelled
table the posterior of every *domain* (a source to be mixed).  Documents get
nonnegative rates ``r`` that minimise ``sum_d (t_d - b_d)^2 / s_d`` where
``t_d = sum_i r_i tokens_i posterior_id`` are the expected domain totals, ``b_d``
the targets and ``s_d`` the totals at rate one.  Gradient steps in the metric of the
tokens (for which a step of one is safe) subtract one number per domain from the
rates, which are then projected to zero or more; so a rate is a fold over the
steps so far, and a document's bins decide it.  A round is one aggregation over
the distinct bin patterns, whose number the bins bound: it gives the totals and,
of the rows with a positive rate, the matrix by which a step moves them.  With
that the driver takes up to ``INNER`` gradient steps on a few numbers before all
rates move and are projected again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import WORD_PATTERN, checkpoint

#: Statistic -> upper bounds of its bins (shares are per character, or per line).
BINS = {
    "german": [0.0, 0.004, 0.012, 0.03], "french": [0.0, 0.01, 0.03, 0.08], "spanish": [0.0, 0.006, 0.02, 0.05],
    "symbols": [0.0, 0.002, 0.02], "capitals": [0.01, 0.05, 0.3], "repeats": [0.0, 0.1, 0.4],
    "letters": [4.0, 5.0, 6.0, 7.0],
}
PATTERNS = {"german": "[äöüßÄÖÜ]", "french": "[éèêçàùœîâÉÈÊÇÀ]", "spanish": "[ñóíáúÑÓÍÁÚ]", "symbols": "[#*$%&|<>]",
            "capitals": "[A-ZÄÖÜÉÈÊÇÑ]"}
STEPS, INNER, TOLERANCE = 25, 200, 1e-4


def with_bins(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus __tokens (words) and __bins (array<int>, one bin per statistic)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("__tokens", F.regexp_count(raw, F.lit(WORD_PATTERN)).cast("long"))
    size = F.greatest(F.length(raw), F.lit(1))
    lines = F.split(raw, "\n")
    d = d.withColumns({f"__{k}": F.regexp_count(raw, F.lit(p)) / size for k, p in PATTERNS.items()} | {
        "__repeats": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "__letters": F.length(raw) / F.greatest("__tokens", F.lit(1)) - 1})
    binned = [sum(((F.col(f"__{k}") > x).cast("int") for x in tops), F.lit(0)) for k, tops in BINS.items()]
    return d.withColumn("__bins", F.array(*binned)).drop(*[f"__{k}" for k in BINS])


def posteriors(labelled: DataFrame, domains: list[str]) -> Column:
    """Expression over __bins: array<double> of domain posteriors (add-one smoothing)."""
    counted = (labelled.filter(F.col("domain").isin(domains))
               .select("domain", F.posexplode("__bins").alias("k", "bin")).groupBy("domain", "k", "bin").count().collect())
    count = {(r["domain"], r["k"], r["bin"]): r["count"] for r in counted}  # at most domains x bins rows
    rows = {d: sum(n for (e, k, _), n in count.items() if e == d and k == 0) for d in domains}
    total = sum(rows.values())
    logs = []
    for d in domains:
        score = F.log(F.lit((rows[d] + 1.0) / (total + len(domains))))
        for k, tops in enumerate(BINS.values()):
            wide = len(tops) + 1
            share = [(count.get((d, k, b), 0) + 1.0) / (rows[d] + wide) for b in range(wide)]
            score = score + F.log(F.get(F.array(*map(F.lit, share)), F.col("__bins")[k]))
        logs.append(score)

    def normal(s: Column) -> Column:
        top = F.array_max(s)
        grown = F.transform(s, lambda x: F.exp(x - top))
        return F.transform(F.array(grown), lambda g: F.transform(g, lambda x: x / F.aggregate(g, F.lit(0.0), lambda a, y: a + y))).getItem(0)

    return F.transform(F.array(F.array(*logs)), normal).getItem(0)


def rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after these projected steps, from one: a fold over a literal."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*map(F.lit, v)) for v in steps])
    dot = lambda p, v: F.aggregate(F.zip_with(p, v, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.array(posterior), lambda p: F.aggregate(
        moves, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - dot(p, v)))).getItem(0)


def fit(df: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id", text: str = "text",
        ready: bool = False) -> tuple[Column, Column]:
    """(posterior, rate) as expressions over __bins.

    ``labelled`` has (key, domain); ``targets`` are weights of domains, scaled to
    sum to one.  The mixed corpus is to have as many tokens as the input.  Rows
    without text have no tokens and no say; domains without labelled rows get
    their prior only; without any token every rate is one.
    """
    domains = list(targets)
    seen = df if ready else checkpoint(with_bins(df.select(F.col(key), F.col(text)), text).drop(text))
    known = labelled.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("domain").alias("domain"))
    posterior = posteriors(seen.select(key, "__bins").join(known, key), domains)
    cells = checkpoint(seen.groupBy("__bins").agg(F.sum("__tokens").alias("tokens")).filter("tokens > 0")
                       .withColumn("p", posterior))
    weight = sum(targets.values())

    size = len(domains)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def measure(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Expected domain totals, and how a move of the rates changes them."""
        r, p, t = F.col("r"), F.col("p"), F.col("tokens")
        got = cells.withColumn("r", rate(p, steps)).agg(
            *[F.sum(r * t * p[k]) for k in range(size)],
            *[F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]).first()
        numbers = [x or 0.0 for x in got]
        gram = [[0.0] * size for _ in domains]
        for (i, j), x in zip(pairs, numbers[size:]):
            gram[i][j] = gram[j][i] = x
        return numbers[:size], gram

    steps: list[list[float]] = []
    base, gram = measure(steps)
    now, whole = base, sum(base)
    goal = [whole * targets[d] / weight for d in domains]
    while whole and len(steps) < STEPS and max(abs(t - b) for t, b in zip(now, goal)) > TOLERANCE * whole:
        steps.append(descend([t - b for t, b in zip(now, goal)], gram, base, TOLERANCE * whole / 4))
        now, gram = measure(steps)
    return posterior, rate(posterior, steps)


def descend(gap: list[float], gram: list[list[float]], base: list[float], small: float) -> list[float]:
    """The sum of gradient steps from a gap (totals minus targets) until it is small."""
    move = [0.0] * len(gap)
    for _ in range(INNER):
        if max(map(abs, gap)) <= small:
            break
        step = [g / s if s > 0 else 0.0 for g, s in zip(gap, base)]
        move = [m + v for m, v in zip(move, step)]
        gap = [g - sum(a * v for a, v in zip(row, step)) for g, row in zip(gap, gram)]
    return move


def copies(key: str, rate: str, seed: int = 11) -> Column:
    """The rate rounded at random, by a hash of the key, so that its mean is the rate."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(F.col(rate)) + (u < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def document_rates(df: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, domain (likeliest), posterior, rate, copies."""
    seen = checkpoint(with_bins(df.select(key, text), text).drop(text))
    posterior, r = fit(seen, labelled, targets, key, text, ready=True)
    domains = F.array(*map(F.lit, targets))
    out = seen.withColumn("posterior", posterior).withColumn("rate", r)
    return out.select(key, F.col("__tokens").alias("n_tokens"),
                      F.get(domains, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain"),
                      "posterior", "rate", copies(key, "rate").alias("copies"))


def mix(df: DataFrame, labelled: DataFrame, targets: Mapping[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every row as often as its copies say (zero drops it); same columns.
    Repeated rows draw alike; a null key draws as one key."""
    _, r = fit(df, labelled, targets, key, text)
    out = with_bins(df, text).withColumn("__rate", r).withColumn("__copies", copies(key, "__rate"))
    # explode_outer and a filter on its result: a filter on the copies would be pushed
    # below the projections and evaluate the whole classifier again, many times over
    times = F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return out.withColumn("__n", F.explode_outer(times)).filter("__n is not null").select(*df.columns)
