"""Evaluation measures and tests: perplexity, accuracy, preference, degradation, exact paired tests, false discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perplexity(df: DataFrame, loss: str, n_tokens: str, *by: str) -> DataFrame:
    """(by, n_tokens, loss, ppl): exp of the mean loss per token; infinite from a mean of 100."""
    g = df.groupBy(*by).agg(F.sum(n_tokens).cast("bigint").alias("n_tokens"), F.sum(loss).alias("__sum"))
    mean = F.col("__sum") / F.greatest(F.col("n_tokens"), F.lit(1))
    return g.select(*by, "n_tokens", mean.alias("loss"), F.when(mean < 100, F.exp(mean)).otherwise(F.lit(float("inf"))).alias("ppl"))


def perplexity_of_loss(loss: Column) -> Column:
    """exp of a mean loss; infinite where that is not a finite number."""
    value = F.exp(loss)
    return F.when(value.isNull() | F.isnan(value), None).otherwise(value)


def supervised_tokens(labels: Column, ignored: int = -100) -> Column:
    """Labels that count towards a loss after the shift by one: all but the first, without ignored ones."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != ignored)).cast("bigint")


def weighted_loss(main: Column, weights: dict[str, float]) -> Column:
    """The main loss and weighted auxiliary ones; absent ones count nothing."""
    out = main
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name), F.lit(0.0)) * w
    return out


def accuracy(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """(by, n, accuracy) per group and over all (by null), in one pass; rows without a prediction are wrong."""
    right = F.coalesce(F.col(gold) == F.col(pred), F.lit(False)).cast("int")
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy"))


def pair_preference(df: DataFrame, error: str, correct: str, *sets: str) -> DataFrame:
    """Preference of the correct sentence: overall and per set, one pass over grouping sets.

    Inputs are mean log-probabilities; perplexities that are not finite stay out of their mean."""
    delta = F.col(correct) - F.col(error)
    ppl = lambda c: F.when(F.col(c) > -100, F.exp(-F.col(c)))
    rows = df.withColumns({"__delta": delta, "__better": (delta > 0).cast("int"), "__pe": ppl(error), "__pc": ppl(correct)})
    measures = [
        F.count(F.lit(1)).alias("n"), F.avg("__better").alias("preference_accuracy"), F.avg("__delta").alias("mean_delta"),
        F.coalesce(F.sum("__pe") / F.greatest(F.count("__pe"), F.lit(1)), F.lit(0.0)).alias("mean_ppl_error"), F.coalesce(F.sum("__pc") / F.greatest(F.count("__pc"), F.lit(1)), F.lit(0.0)).alias("mean_ppl_correct"),
    ]
    return rows.groupingSets([[], *[[F.col(s)] for s in sets]], *sets).agg(F.grouping_id().alias("grain"), *measures).select("grain", *sets, "n", "preference_accuracy", "mean_delta", "mean_ppl_error", "mean_ppl_correct")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: min(1, 2 * sum of C(n, i) / 2^n up to min(b, c)); 1 without any.

    In logarithms: term i + 1 follows from term i, and the largest term is taken out of the sum."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    steps = F.sequence(F.lit(0), k)
    log_terms = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("log_c"), F.array().cast("array<double>").alias("out")),
        lambda acc, i: F.struct((acc["log_c"] + F.ln((n - i) / (i + 1.0))).alias("log_c"), F.concat(acc["out"], F.array(acc["log_c"])).alias("out")),
        lambda acc: acc["out"],
    )
    top = F.array_max(log_terms)
    total = F.aggregate(log_terms, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    p = F.exp(F.ln(total) + top + F.lit(0.6931471805599453) * (1 - n))
    return F.when(b + c == 0, F.lit(1.0)).when(b == c, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def paired_comparison(df: DataFrame, base_right: str, other_right: str, *by: str) -> DataFrame:
    """(by, n, base_acc, other_acc, delta, other_only, base_only, p) of paired results."""
    x, y = F.col(base_right), F.col(other_right)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x.cast("int")).alias("base_acc"), F.avg(y.cast("int")).alias("other_acc"), F.count_if(y & ~x).alias("other_only"), F.count_if(x & ~y).alias("base_only")
    )
    return g.withColumn("delta", F.col("other_acc") - F.col("base_acc")).withColumn("p", mcnemar_p(F.col("other_only"), F.col("base_only")))


def false_discovery(df: DataFrame, p: str = "p", level: float = 0.05) -> DataFrame:
    """Adds q (step-up) and significance over all rows; the rows are tests, a few per run."""
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(p))
    raw = df.withColumns({"__m": F.count(F.lit(1)).over(every), "__rank": rank})
    raw = raw.withColumn("__v", F.col(p) * F.col("__m") / F.col("__rank"))
    low = F.min("__v").over(every.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("q", F.least(F.lit(1.0), low)).withColumn("significant", F.col("q") < level).drop("__m", "__rank", "__v")


def degradation(df: DataFrame, name: str, value: str, clean: str = "clean", prefix: str = "noisy") -> DataFrame:
    """(name, value, degradation_pct) against the clean row; only for names with the prefix, and a clean value that is not 0."""
    reference = df.where(F.col(name) == clean).agg(F.max(value).alias("__clean"))
    rate = F.when(F.col(name).startswith(prefix) & F.col("__clean").isNotNull() & (F.col("__clean") != 0), (F.col(value) / F.col("__clean") - 1) * 100)
    return df.crossJoin(F.broadcast(reference)).select(*df.columns, rate.alias("degradation_pct"))


def summary_table(df: DataFrame, rows: list[str], setting: str, settings: list[str], base: str, other: str) -> DataFrame:
    """One row per benchmark and noise: accuracies, normalised accuracies and differences of each setting."""
    g = df.groupBy(*rows).pivot(setting, settings).agg(F.max(base).alias("base"), F.max(other).alias("other"))
    cols = [x for s in settings for x in (F.col(f"{s}_base").alias(s), F.col(f"{s}_other").alias(f"{s}_norm"), (F.col(f"{s}_other") - F.col(f"{s}_base")).alias(f"{s}_norm_delta"))]
    return g.select(*rows, *cols)


def missing_results(expected: DataFrame, found: DataFrame, *on: str) -> DataFrame:
    return expected.join(found, list(on), "left_anti")


def general_number(x: Column, digits: int = 3) -> Column:
    """%.3g: significant digits without trailing zeros, exponents for small and large values."""
    d = x.cast("double")
    scientific = F.format_string(f"%.{digits - 1}e", d)
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.substring_index(scientific, "e", -1).cast("int")
    shown = F.concat(trim(F.substring_index(scientific, "e", 1)), F.lit("e"), F.substring_index(scientific, "e", -1))
    return F.when((exponent < -4) | (exponent >= digits), shown).otherwise(trim(_fixed(d, exponent, digits)))


def _fixed(d: Column, exponent: Column, digits: int) -> Column:
    out = F.format_string(f"%.{digits + 4}f", d)
    for e in range(digits - 1, -5, -1):
        out = F.when(exponent == e, F.format_string(f"%.{max(0, digits - 1 - e)}f", d)).otherwise(out)
    return out
