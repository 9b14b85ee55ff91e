"""Evaluation: confusion counts, class metrics, bootstrap, weights, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import safe_divide, stable_hash
from flowlens.operators.scaling import quantile


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Per class that is true or predicted somewhere: counts, precision, recall, F1, false-positive and -negative rates.

    Rates with an empty denominator are 0. Works on the confusion counts, whose rows are classes squared.
    """
    by = by or []
    return cell_metrics(confusion(df, truth, pred, by), truth, pred, by)


def cell_metrics(cells: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """class_metrics of confusion counts (by..., truth, pred, n)."""
    sides = cells.select(*by, F.col(truth).alias("klass"), "n", F.lit(1).alias("t"), (F.col(truth) == F.col(pred)).cast("int").alias("hit")).union(
        cells.select(*by, F.col(pred), "n", F.lit(0), F.lit(0))
    )
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    per = sides.groupBy(*by, "klass").agg(
        F.sum(F.col("n") * F.col("t")).alias("support"),
        F.sum(F.col("n") * (1 - F.col("t"))).alias("predicted"),
        F.sum(F.col("n") * F.col("hit")).alias("tp"),
    )
    per = per.join(total, by) if by else per.crossJoin(F.broadcast(total))  # one row
    per = per.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    per = per.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    return per.withColumns(
        {
            "precision": safe_divide(F.col("tp"), F.col("predicted")),
            "recall": safe_divide(F.col("tp"), F.col("support")),
            "f1": safe_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")),
            "fpr": safe_divide(F.col("fp"), F.col("fp") + F.col("tn")),
            "fnr": safe_divide(F.col("fn"), F.col("support")),
        }
    ).drop("total")


def summary(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 over the classes seen, and F1 weighted by support."""
    return cell_summary(confusion(df, truth, pred, by), truth, pred, by or [])


def cell_summary(cells: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """summary of confusion counts (by..., truth, pred, n)."""
    per = cell_metrics(cells, truth, pred, by)
    return per.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def bootstrap_macro_f1(df: DataFrame, truth: str, pred: str, draws: int, seed: int) -> DataFrame:
    """Percentiles 2.5, 50 and 97.5 of macro F1 over resamples of the confusion counts.

    A resample draws as many rows as there are, with replacement, so its confusion counts are multinomial. They are drawn
    cell by cell, in order of truth and prediction (null first): given what the cells before have taken, a cell's count is
    binomial of what is left. Each is drawn from one hashed uniform, by multinomial_counts. So draws x cells numbers are
    made and no rows, whatever the size of the table. A table without rows gives nulls.
    """
    cells = confusion(df, truth, pred).withColumn("_order", F.struct(truth, pred))
    every = cells.agg(F.array_sort(F.collect_list(F.struct("_order", "n"))).alias("cells")).filter(F.size("cells") > 0)  # classes squared
    numbered = every.crossJoin(df.sparkSession.range(draws).toDF("b"))  # one row with the cells
    u = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: uniform(seed, F.col("b"), i))
    drawn = numbered.select("b", "cells", multinomial_counts(F.transform("cells", lambda c: c["n"]), u).alias("counts"))
    picked = drawn.select("b", F.posexplode("cells").alias("i", "c"), "counts").select("b", F.col(f"c._order.{truth}").alias(truth), F.col(f"c._order.{pred}").alias(pred), F.col("counts")[F.col("i")].alias("n"))
    scores = cell_summary(picked.filter("n > 0"), truth, pred, ["b"])
    return scores.agg(*[F.percentile("macro_f1", F.lit(q)).alias(name) for name, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


def uniform(seed: int, *key: Column) -> Column:
    """A number between 0 and 1, both excluded, from the first twelve digits of a hash."""
    twelve = F.conv(F.substring(stable_hash(F.lit(seed), *key), 1, 12), 16, 10).cast("double")
    return (twelve + 0.5) / F.lit(float(1 << 48))


def binomial_count(n: Column, p: Column, u: Column) -> Column:
    """A binomial count of n trials from one uniform u.

    The rarer outcome is counted (for p above a half the failures, by 1 - u). Where fewer than 100 of it are expected, it is
    the smallest count whose cumulative probability reaches u, added up from 0. Else it is the quantile of the normal
    distribution, with the corrections for whole numbers and for skewness, within a hundredth of a standard deviation.
    """
    swap = p > 0.5

    def counted(x: Column) -> Column:
        q, v, mean = x["q"], x["v"], n * x["q"]
        start = F.struct(F.lit(0).cast("bigint").alias("k"), F.pow(1 - q, n).alias("prob"), F.pow(1 - q, n).alias("total"))

        def step(s: Column, k: Column) -> Column:
            prob = s["prob"] * (n - k + 1) / k * (q / (1 - q))
            return F.when(s["total"] >= v, s).otherwise(F.struct(k.alias("k"), prob.alias("prob"), (s["total"] + prob).alias("total")))

        most = F.least(n, F.ceil(mean + 12 * F.sqrt(mean + 1) + 12))
        added = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(most, F.lit(1))), start, step, lambda s: s["k"])
        z = normal_quantile(v)
        near = F.floor(mean + z * F.sqrt(mean * (1 - q)) + (1 - 2 * q) * (z * z - 1) / 6 + 0.5)
        k = F.when((n == 0) | (q <= 0), F.lit(0).cast("bigint")).when(mean < 100, F.least(added, n)).otherwise(F.greatest(F.lit(0), F.least(n, near)).cast("bigint"))
        return F.when(swap, n - k).otherwise(k)

    sides = F.struct(F.when(swap, 1 - p).otherwise(p).alias("q"), F.when(swap, 1 - u).otherwise(u).alias("v"))
    return F.transform(F.array(sides), counted)[0]


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile, to within 0.0005."""
    # Coefficients of a well-known rational approximation of the tail.
    t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(u < 0.5, -x).otherwise(x)


def multinomial_counts(counts: Column, u: Column) -> Column:
    """One draw with replacement of as many rows as counts (an array) hold: an array of counts with the same sum.

    u has a uniform for each cell. Null where counts are empty.
    """
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n)
    start = F.struct(total.alias("left"), total.alias("rest"), F.array().cast("array<bigint>").alias("drawn"))

    def step(s, cell):
        share = F.least(F.lit(1.0), cell["n"] / s["rest"])
        k = F.when(cell["n"] >= s["rest"], s["left"]).otherwise(binomial_count(s["left"], share, cell["u"]))
        return F.transform(F.array(k), lambda k: F.struct((s["left"] - k).alias("left"), (s["rest"] - cell["n"]).alias("rest"), F.concat(s["drawn"], F.array(k)).alias("drawn")))[0]

    cells = F.zip_with(counts, u, lambda n, x: F.struct(n.alias("n"), x.alias("u")))
    return F.aggregate(cells, start, step, lambda s: s["drawn"])


def class_weights(counts: DataFrame, n: str, method: str, beta: float = 0.9999, cap: float | None = None, classes: tuple[str, list] | None = None) -> DataFrame:
    """Weight per row of counts, mean 1 before the cap, rounded to 6 digits; counts has one row a class.

    classes names the column and the classes that must have rows: one without any is an error, as it has no weight.
    """
    if classes is not None:
        column, wanted = classes
        found = {r[0] for r in counts.filter(F.col(n) > 0).select(column).collect()}  # one row a class
        missing = [c for c in wanted if c not in found]
        if missing:
            raise ValueError(f"classes without rows have no weight: {missing}")
    if not 0 <= beta < 1 or (cap is not None and cap <= 0):
        raise ValueError("beta is from 0 to below 1, and a cap is positive")
    effective = F.lit(1.0) if beta == 0 else (1 - beta) / (1 - F.pow(F.lit(beta), F.col(n)))
    raw = {"inverse_frequency": 1 / F.col(n), "inverse_sqrt": 1 / F.sqrt(F.col(n)), "effective_number": effective}
    if method not in raw:
        raise ValueError(f"method is one of {sorted(raw)}")
    every = Window.partitionBy(F.lit(1))
    weight = F.col("raw") / F.avg("raw").over(every)
    weight = weight if cap is None else F.least(weight, F.lit(cap))
    return counts.withColumn("raw", raw[method]).withColumn("weight", F.round(weight, 6)).drop("raw")


def hierarchical_weights(df: DataFrame, klass: str, subtype: str, group: str) -> DataFrame:
    """(klass, subtype, group, weight): 1 / (classes * subtypes of the class * groups of the subtype * rows of the group)."""
    sizes = df.groupBy(klass, subtype, group).agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.groupBy(klass, subtype).agg(F.count(F.lit(1)).alias("groups"))
    subtypes = groups.groupBy(klass).agg(F.count(F.lit(1)).alias("subtypes"))
    classes = subtypes.agg(F.count(F.lit(1)).alias("classes"))
    return (
        sizes.join(groups, [klass, subtype]).join(subtypes, klass).crossJoin(F.broadcast(classes))
        .withColumn("weight", 1 / (F.col("classes") * F.col("subtypes") * F.col("groups") * F.col("size")))
        .select(klass, subtype, group, "weight")
    )


def low_confidence_threshold(df: DataFrame, confidence: str, correct: Column, q: float = 0.05) -> DataFrame:
    """The q-quantile of confidence over correct rows; rows below it count as unknown."""
    return quantile(df.filter(correct), F.col(confidence), q, "threshold")


def complement_counts(df: DataFrame, group: str, klass: str, classes: list, min_train: int, min_eval: int) -> DataFrame:
    """Holdout feasibility: per group its rows, what would remain in total and by class, and a status.

    invalid: a class would vanish; weak: too few rows in or outside the group; else runnable.
    """
    pivot = df.groupBy(group).pivot(klass, classes).agg(F.count(F.lit(1))).fillna(0)
    per = pivot.select(group, *[F.col(str(c)).cast("bigint").alias(f"n{k}") for k, c in enumerate(classes)])
    total = per.agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(classes))])
    both = per.crossJoin(F.broadcast(total))  # one row
    left = [F.col(f"t{k}") - F.col(f"n{k}") for k in range(len(classes))]
    size, rest = sum(F.col(f"n{k}") for k in range(len(classes))), sum(left)
    status = F.when(F.least(*left) <= 0, "invalid").when((size < min_eval) | (rest < min_train), "weak").otherwise("runnable")
    return both.select(group, size.alias("held_out"), rest.alias("remaining"), F.least(*left).alias("least_class"), status.alias("status"))
