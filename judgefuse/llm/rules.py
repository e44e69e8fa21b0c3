"""Quality rules: base statistics and robust multivariate outliers, all native.

Per (language, source) a minimum-covariance-determinant estimate of the
transformed statistics is found by concentration steps: distances to the current
centre, their quantile, then mean and covariance of the nearest share ``COVER``.
The steps go from three starts, each until the determinant falls no more; the
estimate of the smallest determinant counts.
Rows of small groups are judged by their language's estimate, and those of small
languages by the estimate of all rows.  Every step is an aggregation that
combines before its shuffle (means, covariances, quantile sketches), so a source
with a third of all rows is no hot spot; parameters are joined as a table, which
is broadcast while its row count allows and shuffled beyond.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import checkpoint, small_side

COVER = 0.75          # share of a group that an estimate fits
SETTLED = 1e-4        # steps end where the logarithm of the determinant falls by less
SMALL_GROUP = 200     # groups with fewer rows use the next wider estimate
TAIL = 1e-3           # chance that a regular vector lies beyond the cut
#: Smallest standard deviation that an estimate may claim for each statistic.
FLOORS = {"x_words": 0.6, "x_length": 0.08, "x_symbols": 0.06, "x_dups": 0.12, "x_repeats": 0.12}
STATS = list(FLOORS)
WIDE = 65536          # words a text may have for 16-bit positions


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def repeated_words(words: Column) -> Column:
    """Words covered by a 3-word window that the text holds more than once.

    Windows of equal hash are looked for first; only these are then sorted by their three words.
    """

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def beside(s: Column, key) -> Column:
        """Entries of a sorted list that a neighbour equals in ``key``."""
        same = lambda x, i: F.coalesce(key(F.get(s, i)) == key(x), F.lit(False))
        return F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1))

    def window(h: Column, i: Column) -> Column:
        return F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))

    def short(h: Column) -> Column:
        # 48 bits of a window's hash above 16 bits of its position: sorting brings equal windows together
        spots = F.sequence(F.lit(0), F.size(h) - 3)
        packed = F.transform(spots, lambda i: F.shiftleft(window(h, i), 16).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), lambda s: F.transform(
            beside(s, lambda x: F.shiftright(x, 16)), lambda x: x.bitwiseAND(F.lit(65535).cast("long"))))

    def long(h: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(h) - 3)
        pairs = F.transform(spots, lambda i: F.struct(window(h, i).alias("h"), i.cast("long").alias("i")))
        return let(F.sort_array(pairs), lambda s: F.transform(beside(s, lambda x: x["h"]), lambda x: x["i"]))

    def equal(p: Column) -> Column:
        at = lambda i, k: F.get(words, i.cast("int") + k)
        full = F.transform(p, lambda i: F.struct(F.struct(at(i, 0), at(i, 1), at(i, 2)).alias("w"), i.alias("i")))
        return let(F.sort_array(full), lambda s: F.sort_array(F.transform(beside(s, lambda x: x["w"]), lambda x: x["i"])))

    none = F.array().cast("array<bigint>")
    alike = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h:
                F.when(F.size(h) < 3, none).when(F.size(h) < WIDE, short(h)).otherwise(long(h)))
    return let(let(alike, equal), covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that are not called like one of ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def packed(df: DataFrame, keep: list[str]) -> Column:
    """``keep`` as one struct, out of the way of the columns added here."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("string").alias("_"))


def unpacked(keep: list[str]) -> list[Column]:
    return [F.col("__row").getField(c).alias(c) for c in keep]


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``BASE`` (all long), in place of columns that are called so."""
    raw = F.coalesce(F.col(text), F.lit(""))
    keep = others(df, *BASE)
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.select(packed(df, keep).alias("__row"), raw.alias("__raw"),
                  F.array_remove(F.split(raw, r"[\x20\x09-\x0D]+"), "").alias("__words"), lines.alias("__lines"))
    d = d.select(
        "__row", F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__raw", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"))
    return d.select(*unpacked(keep), *BASE)


def transformed() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log1p("n_words").alias("x_words"),
            F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("x_length"),
            share("n_symbols", "word_chars").alias("x_symbols"),
            share("n_dup_lines", "n_lines").alias("x_dups"),
            share("n_repeat_words", "n_words").alias("x_repeats")]


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def factor(cov: DataFrame, *more: str) -> DataFrame:
    """Cholesky factor l_i_j of c_i_j, one column at a time (k rows per key, no UDF)."""
    n = len(STATS)
    for j in range(n):
        taken = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        floor = FLOORS[STATS[j]] ** 2 / 100  # what stays of a variance beside the earlier statistics
        cov = cov.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - taken, F.lit(floor))))
        rest = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)),
                                                          F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, n)}
        if rest:
            cov = cov.withColumns(rest)
    return cov.select("key", "start", "n", *[f"m_{i}" for i in range(n)], *[f"l_{i}_{j}" for i in range(n) for j in range(i + 1)], *more)


def with_distance(rows: DataFrame, name: str = "d2", prefix: str = "") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the joined factor."""
    n = len(STATS)
    for i, x in enumerate(STATS):
        taken = sum((F.col(f"{prefix}l_{i}_{k}") * F.col(f"__z{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"__z{i}", (F.col(x) - F.col(f"{prefix}m_{i}") - taken) / F.col(f"{prefix}l_{i}_{i}"))
    return rows.withColumn(name, sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(n)), F.lit(0.0))) \
        .drop(*[f"__z{i}" for i in range(n)])


def covariances(values: list[Column], scale: Column) -> list[Column]:
    n = len(values)
    return [(F.covar_pop(values[i], values[j]) * scale).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)]


def starts(rows: DataFrame) -> DataFrame:
    """(key, start, n, m_i, c_i_j): quartiles without correlations, plain moments, spatial signs about the median."""
    n = len(STATS)
    middle = checkpoint(rows.groupBy("key").agg(
        F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in STATS]))
    width = [F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(FLOORS[x])) for x in STATS]
    middle = middle.select("key", "n", *[F.col(f"q_{x}")[1].alias(f"m_{i}") for i, x in enumerate(STATS)],
                           *[width[i].alias(f"w_{i}") for i in range(n)])
    centre = [f"m_{i}" for i in range(n)]
    quartiles = middle.select("key", F.lit(0).alias("start"), "n", *centre, *[
        (F.col(f"w_{i}") * F.col(f"w_{i}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)])
    plain = rows.groupBy("key").agg(F.lit(1).alias("start"), F.count("*").alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(STATS)],
                                    *covariances([F.col(x) for x in STATS], F.lit(1.0)))
    z = [(F.col(x) - F.col(f"m_{i}")) / F.col(f"w_{i}") for i, x in enumerate(STATS)]
    far = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-12))
    about = rows.join(small_side(middle.drop("n")), "key").withColumn("__far", far)
    signs = about.select("key", *[(v / F.col("__far")).alias(f"u_{i}") for i, v in enumerate(z)]).groupBy("key").agg(
        *[(F.avg(F.col(f"u_{i}") * F.col(f"u_{j}")) * F.lit(float(n))).alias(f"s_{i}_{j}") for i in range(n) for j in range(i + 1)])
    signs = signs.join(middle, "key").select("key", F.lit(2).alias("start"), "n", *centre, *[
        (F.col(f"s_{i}_{j}") * F.col(f"w_{i}") * F.col(f"w_{j}")).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)])
    return quartiles.unionByName(plain).unionByName(signs)


def estimates(rows: DataFrame) -> DataFrame:
    """MCD per ``key`` of rows (key, statistics): n, m_i and the Cholesky factor of the scatter."""
    n = len(STATS)
    scale = COVER / chi2_cdf(chi2_quantile(COVER, n), n + 2)  # consistency at normal data
    floored = {f"c_{i}_{i}": F.greatest(F.col(f"c_{i}_{i}"), F.lit(FLOORS[x] ** 2)) for i, x in enumerate(STATS)}
    size = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(n)), F.lit(0.0)) * 2
    moving = checkpoint(factor(starts(rows).withColumns(floored)).withColumn("det", F.lit(float("inf"))))
    settled = []
    while moving.limit(1).count():
        before = moving.select("key", "start", F.struct(*moving.columns).alias("before"))
        near = rows.join(small_side(moving.drop("n", "det")), "key")
        cut = checkpoint(with_distance(near).groupBy("key", "start").agg(F.percentile_approx("d2", COVER, 10000).alias("cut")))
        kept = with_distance(near).select("key", "start", "d2", *STATS).join(small_side(cut), ["key", "start"]).filter("d2 <= cut")
        moments = kept.groupBy("key", "start").agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(STATS)],
                                                   *covariances([F.col(x) for x in STATS], F.lit(scale)))
        moments = moments.join(before, ["key", "start"]).withColumn("n", F.col("before.n"))
        after = factor(moments.withColumns(floored), "before").withColumn("det", size)
        after = checkpoint(after.withColumn("falls", F.col("before.det") - F.col("det") > SETTLED))
        moving = after.filter("falls").drop("before", "falls")
        settled.append(after.filter("not falls").select(F.when(F.col("det") <= F.col("before.det"), F.struct(*moving.columns))
                                                        .otherwise(F.col("before")).alias("s")).select("s.*"))
    if not settled:
        return moving.drop("start", "det")
    ends = reduce(DataFrame.unionByName, settled)
    best = ends.groupBy("key").agg(F.min_by(F.struct(*ends.columns), F.struct("det", "start")).alias("s"))
    return checkpoint(best.select("s.*").drop("start", "det"))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` without its text, plus base statistics, base_failed, distance and kept.

    Null texts count as empty (base_failed); null languages and sources are
    groups of their own; constant statistics are held up by ``FLOORS``; where
    nothing passes the base rules there is no estimate and nothing is kept.
    Repeated rows are judged alike; an empty table stays empty.  Columns called like an
    output are replaced; all others are returned as they came, whatever their names.
    """
    out = [*BASE, "base_failed", "distance", "kept"]
    keep = others(df, text, *out)
    plain = df.select(packed(df, keep).alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__l"), F.col(source).alias("__s"))
    facts = checkpoint(base_statistics(plain, "__text").drop("__text").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .select("*", *transformed()))
    by_lang = F.concat(F.lit("l"), F.coalesce(F.col("__l"), F.lit("\0")))
    keys = {"source": F.concat(by_lang, F.lit("\1"), F.coalesce(F.col("__s"), F.lit("\0"))), "lang": by_lang, "all": F.lit("*")}
    rows = (facts.filter("not base_failed").select(F.explode(F.array(*keys.values())).alias("key"), *STATS))
    params = estimates(rows)
    names = [c for c in params.columns if c not in ("key", "n")]
    whole = params.filter("key = '*'").first()  # one row of numbers
    everyone = F.struct(*[F.lit(whole[c] if whole else None).cast("double").alias(c) for c in names])
    judged = facts.withColumns({f"__{k}": c for k, c in keys.items() if k != "all"})
    groups = small_side(checkpoint(params.filter((F.col("key") != "*") & (F.col("n") >= SMALL_GROUP))
                                   .select("key", F.struct(*names).alias("p"))))
    for k in ("source", "lang"):
        judged = judged.join(groups.select(F.col("key").alias(f"__{k}"), F.col("p").alias(f"__p_{k}")), f"__{k}", "left")
    best = F.coalesce(F.col("__p_source"), F.col("__p_lang"), everyone)
    judged = judged.withColumn("__p", best).select(*facts.columns, *[F.col("__p")[c].alias(c) for c in names])
    cut = chi2_quantile(1 - TAIL, len(STATS))
    judged = with_distance(judged, "distance").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(False)))
    return judged.select(*unpacked(keep), *out)
