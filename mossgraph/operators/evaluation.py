"""Labels, multi-label metrics, paired statistics, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform

#: The labels in their order, which is part of their meaning.
LABELS = ("NONE", "PERSON", "EMAIL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "FINANCIAL", "MEDICAL", "CREDENTIAL", "OTHER_SENSITIVE")


def multi_hot(labels: Column, domain: tuple[str, ...] = LABELS) -> Column:
    """0/1 for each label of the domain. None or only NONE: NONE. NONE is dropped beside others; a label outside the domain is an error."""
    upper = F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.upper))
    rest = F.array_remove(upper, "NONE")
    known = F.size(F.array_except(rest, F.array(*map(F.lit, domain)))) == 0
    vector = F.array(*[F.when(F.size(rest) == 0, 1).otherwise(0) if n == "NONE" else F.array_contains(rest, n).cast("int") for n in domain])
    return F.when(known, vector).otherwise(F.raise_error(F.lit("unknown label")).cast("array<int>"))


def primary(labels: Column) -> Column:
    """The first label that isn't NONE, else NONE."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(labels, F.upper), lambda x: x != "NONE"), F.lit(1)), F.lit("NONE"))


def sensitive(labels: Column) -> Column:
    return F.exists(labels, lambda x: F.upper(x) != "NONE")


def chosen(scores: DataFrame, key: str, threshold: float = 0.5, gap: float = 0.25, most: int = 3) -> DataFrame:
    """key, labels: of the scores (key, idx, label, score) but NONE's, those of at least the threshold and no more than ``gap`` below the best, ``most`` at most; else NONE."""
    rows = scores.where("label <> 'NONE'")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "idx")
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("best", F.max("score").over(Window.partitionBy(key)))
    kept = ranked.where((F.col("score") >= threshold) & (F.col("score") >= F.col("best") - gap) & (F.col("r") <= most)).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("labels"))
    return scores.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("labels", F.array(F.lit("NONE"))).alias("labels"))


def chosen_or_best(scores: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, labels: all but NONE of at least the threshold in the domain's order, else the best one, which may be NONE."""
    all_ = F.array_sort(F.collect_list(F.struct("idx", "label", "score")))  # one entry a label
    rows = scores.groupBy(key).agg(all_.alias("s"), F.max_by("label", F.struct("score", -F.col("idx"))).alias("best"))
    over = F.transform(F.filter("s", lambda x: (x["score"] >= threshold) & (x["label"] != "NONE")), lambda x: x["label"])
    return rows.select(key, F.when(F.size(over) > 0, over).otherwise(F.array("best")).alias("labels"))


def counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """label, tp, fp, fn, tn, support of rows (id, label, y, p), for each of ``by``."""
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.groupBy(*by, "label").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.count_if(y).alias("support"))


def _ratio(a: Column, b: Column) -> Column:
    """Zero where nothing is divided."""
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    c = counts(rows, by)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of ``by``): exact match, macro and micro scores."""
    classes = per_class(rows, by).groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), _ratio(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"))
    exact = rows.groupBy(*by, "id").agg(F.bool_and(F.col("y") == F.col("p")).alias("same")).groupBy(*by).agg(F.count("*").alias("examples"), F.avg(F.col("same").cast("double")).alias("exact_match"))
    return exact.join(classes, list(by)) if by else exact.join(classes)


def binary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of ``by``): accuracy and F1 of sensitive or not, of rows (y, p: booleans)."""
    tp, wrong = F.count_if(F.col("y") & F.col("p")), F.count_if(F.col("y") != F.col("p"))
    return rows.groupBy(*by).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("binary_accuracy"), _ratio(2.0 * tp, 2 * tp + wrong).alias("binary_f1"))


def paired_deltas(trials: DataFrame, model: str, reference: str) -> DataFrame:
    """pair_id, data_seed, delta of pairs that both models have."""
    a = trials.where(F.col("model") == model).select("pair_id", "data_seed", F.col("macro_f1").alias("a"))
    b = trials.where(F.col("model") == reference).select("pair_id", F.col("macro_f1").alias("b"))
    return a.join(b, "pair_id").select("pair_id", "data_seed", (F.col("a") - F.col("b")).alias("delta"))


def cluster_means(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("data_seed").agg(F.avg("delta").alias("mean"), F.count("*").alias("n"))


def sign_permutation(means: DataFrame) -> DataFrame:
    """One row: two-sided p of the clusters' mean under all 2 ** k sign choices, for k of 16 at most; else under 10,000 drawn ones, with the usual correction. Without clusters both are null."""
    k = means.count()
    ordered = means.orderBy("data_seed")
    values = F.transform(F.array_sort(F.collect_list(F.struct("data_seed", "mean"))), lambda x: x["mean"])
    packed = ordered.agg(values.alias("m"), F.avg("mean").alias("observed"))  # a number for each cluster of a study
    exact = k <= 16
    flips = means.sparkSession.range(1 << k if exact else 10_000)
    sign = lambda i: F.when((F.floor(F.col("id") / F.pow(F.lit(2.0), i)) % 2) == 1, 1.0).otherwise(-1.0) if exact else F.when(uniform(2026, F.col("id"), i) < 0.5, 1.0).otherwise(-1.0)
    total = F.aggregate(F.transform("m", lambda x, i: x * sign(i)), F.lit(0.0), lambda s, x: s + x)
    rows = flips.join(F.broadcast(packed)).select((total / max(k, 1)).alias("perm"), "observed")
    slack = 1e-12 if exact else 0.0
    hits = F.count_if(F.abs("perm") >= F.abs("observed") - slack)
    p = hits / F.count("*") if exact else (1 + hits) / 10_001.0
    return rows.agg(F.max("observed").alias("observed"), F.when(F.lit(k > 0), p).alias("p_value"), F.lit(k).cast("long").alias("clusters"))


def bootstrap(means: DataFrame, draws: int = 10_000, seed: int = 2026) -> DataFrame:
    """One row: 2.5 % and 97.5 % quantiles (linear) of the mean over clusters drawn with replacement, by hashes of draw and slot."""
    k = means.count()
    indexed = means.withColumn("i", F.row_number().over(Window.orderBy("data_seed")) - 1)  # a row for each cluster of a study
    slots = means.sparkSession.range(draws).select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    i = F.floor(uniform(seed, F.col("id"), F.col("slot")) * k).cast("int").alias("i")
    boot = slots.select("id", i).join(F.broadcast(indexed.select("i", "mean")), "i").groupBy("id").agg(F.avg("mean").alias("m"))
    return boot.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def verdict(low: Column, high: Column, p: Column) -> Column:
    return F.when(((low <= 0) & (high >= 0)) | (p > 0.05), "inconclusive").when(low > 0, "fly_ahead").otherwise("baseline_ahead")


def model_summary(trials: DataFrame) -> DataFrame:
    """By model: mean, population and sample deviation, half-width of the 95 % interval, runs, least and greatest."""
    f = "macro_f1"
    return trials.groupBy("model").agg(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std_pop"), F.stddev_samp(f).alias("std_samp"), (1.96 * F.stddev_pop(f) / F.sqrt(F.count("*"))).alias("half_width"), F.count("*").alias("runs"), F.min(f).alias("least"), F.max(f).alias("most"))


def stratified(rows: DataFrame, label: str, key: str, budget: int, seed: int = 0) -> DataFrame:
    """A sample that takes one row of each label in turn, in an order drawn from the seed, until the budget is spent."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, F.col(key)), key))
    return rows.withColumn("turn", rank).where(F.col("turn") <= budget).orderBy("turn", label).limit(budget)


def every_kth(rows: DataFrame, order: list, k: int, partition: list | None = None) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*order))
    return rows.withColumn("__n", n).where((F.col("__n") - 1) % k == 0).drop("__n")


def last_n(rows: DataFrame, partition: list, order: list, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def changes(rows: DataFrame, partition: str, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null counts as a value); first rows don't."""
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") > 1) & ~F.col(value).eqNullSafe(F.col("before"))).drop("__n")


def feedback(events: DataFrame, model: str, correct: str) -> DataFrame:
    """model, answers, hits: counts only; no text is kept."""
    return events.groupBy(model).agg(F.count(correct).alias("answers"), F.sum(F.col(correct).cast("int")).alias("hits"))


def positions(sample: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The sample with ``position``, each key's place (from 0) among all rows in order of the key."""
    from .controls import numbered

    return sample.join(numbered(rows.select(key), [key], "place").select(key, (F.col("place") - 1).alias("position")), key)
