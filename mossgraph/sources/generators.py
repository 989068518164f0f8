"""Generated rows: labelled text and modular graphs. Every choice is a hash of seed and row, so a split can be made again anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import uniform
from ..operators.evaluation import LABELS

#: Shares of hard negatives, of two labels, and of redacted digits; rows of train, validation, test.
MIXES = {"base": (0.12, 0.10, 0.08, (800, 200, 250)), "hard": (0.38, 0.12, 0.40, (900, 220, 280)), "harder": (0.42, 0.13, 0.30, (1200, 280, 360))}
FIRST = ("Ada", "Ben", "Cora", "Dev", "Eli", "Fay")
LAST = ("Moss", "Reed", "Stone", "Vale", "Wren", "York")
STREETS = ("Oak Street", "Mill Lane", "Hill Road")
NEGATIVE = ("Please review the attached plan before Monday.", "The invoice template has a field for a card number, left blank here.", "Call the front desk if the projector fails.", "The password policy was updated last spring.")


def _pick(values: tuple[str, ...], seed: int, *key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, *key) * len(values)) + 1).cast("int"))


def _number(low: int, high: int, seed: int, *key: Column) -> Column:
    return (F.floor(uniform(seed, *key) * (high - low)) + low).cast("long")


def person(seed: int, *key: Column) -> Column:
    return F.concat(_pick(FIRST, seed, F.lit("first"), *key), F.lit(" "), _pick(LAST, seed, F.lit("last"), *key))


def email(seed: int, *key: Column) -> Column:
    return F.concat(F.lower(F.replace(person(seed, *key), F.lit(" "), F.lit("."))), _number(10, 99, seed, F.lit("mail"), *key).cast("string"), F.lit("@example.com"))


def phone(seed: int, *key: Column) -> Column:
    a, b, c = (_number(200, 999, seed, F.lit("p1"), *key), _number(200, 999, seed, F.lit("p2"), *key), _number(1000, 9999, seed, F.lit("p3"), *key))
    style = _number(0, 4, seed, F.lit("style"), *key)
    return F.when(style == 0, F.format_string("%d-%d-%d", a, b, c)).when(style == 1, F.format_string("(%d) %d-%d", a, b, c)).when(style == 2, F.format_string("%d.%d.%d", a, b, c)).otherwise(F.format_string("+1 %d %d %d", a, b, c))


def ssn(seed: int, *key: Column) -> Column:
    return F.format_string("%03d-%02d-%04d", _number(100, 899, seed, F.lit("s1"), *key), _number(10, 99, seed, F.lit("s2"), *key), _number(1000, 9999, seed, F.lit("s3"), *key))


def card(seed: int, *key: Column) -> Column:
    return F.concat_ws(" ", *[F.format_string("%04d", _number(1000, 9999, seed, F.lit(f"c{k}"), *key)) for k in range(4)])


def address(seed: int, *key: Column) -> Column:
    return F.concat(_number(1, 999, seed, F.lit("house"), *key).cast("string"), F.lit(" "), _pick(STREETS, seed, F.lit("street"), *key))


def born(seed: int, *key: Column) -> Column:
    return F.format_string("%02d/%02d/%d", _number(1, 12, seed, F.lit("m"), *key), _number(1, 28, seed, F.lit("d"), *key), _number(1940, 2005, seed, F.lit("y"), *key))


def split_email(seed: int, *key: Column) -> Column:
    """An address of which a third have a zero-width space after the first character."""
    whole = email(seed, *key)
    return F.when(uniform(seed, F.lit("zw"), *key) < 0.35, F.concat(F.substring(whole, 1, 1), F.lit("\u200b"), F.substring(whole, 2, 1000))).otherwise(whole)


#: Sentences of each label; the value stands at the braces.
SENTENCES = {
    "PERSON": ("The contact is {}.", "{} signed for the parcel this morning.", "Please seat {} next to the speaker.", "Minutes were taken by {}."),
    "EMAIL": ("Write to {}.", "The draft went to {} by mistake.", "Replies reach us at {}.", "Copy {} on the thread."),
    "PHONE": ("Call {}.", "The night line is {}.", "Leave word at {} after six.", "Texts go to {}."),
    "ADDRESS": ("Deliver to {}.", "The keys are kept at {}.", "They moved to {} in spring.", "Meet at {} before noon."),
    "SSN": ("SSN on file: {}.", "The form lists social security {}.", "Her number, {}, was read aloud.", "Check {} against the payroll."),
    "CREDIT_CARD": ("Charge card {}.", "The order was paid with {}.", "Card number {} was declined.", "Refund goes back to {}."),
    "DATE_OF_BIRTH": ("Born on {}.", "Date of birth {} per the intake form.", "The record gives {} as birthday.", "DOB: {}."),
    "FINANCIAL": ("Salary is {}.", "The loan stands at {}.", "Net income came to {} last year.", "They settled for {} in cash."),
    "MEDICAL": ("Patient diagnosed, file {}.", "Chart {} mentions a relapse.", "The biopsy under {} was benign.", "Dose raised, see note {}."),
    "CREDENTIAL": ("The password is pw{}.", "Use api key k-{} for staging.", "Login with secret s{}.", "The token t{} expires tonight."),
    "OTHER_SENSITIVE": ("Passport no. P{}.", "License plate and permit {} were noted.", "Visa case {} is pending.", "Member card {} was found."),
}
#: What surrounds a sentence in the hardest set.
WRAPPERS = ("{}", "As discussed in the last meeting: {} Nothing further was agreed.", "---- forwarded ---- {} ---- end ----", "Note to file. {} This note has no legal effect.")


def filled(label: Column, seed: int, *key: Column, kind: str = "base") -> Column:
    """A sentence with a generated value of the label; in the hardest set addresses may be split and sentences wrapped."""
    digits = lambda low, high, name: _number(low, high, seed, F.lit(name), *key).cast("string")
    values = {
        "PERSON": person(seed, *key),
        "EMAIL": split_email(seed, *key) if kind == "harder" else email(seed, *key),
        "PHONE": phone(seed, *key),
        "ADDRESS": address(seed, *key),
        "SSN": ssn(seed, *key),
        "CREDIT_CARD": card(seed, *key),
        "DATE_OF_BIRTH": born(seed, *key),
        "FINANCIAL": digits(30000, 90000, "pay"),
        "MEDICAL": digits(1000, 9999, "file"),
        "CREDENTIAL": digits(1000, 9999, "pw"),
        "OTHER_SENSITIVE": digits(100000, 999999, "pass"),
    }
    out = F
    for name, value in values.items():
        out = out.when(label == name, F.replace(_pick(SENTENCES[name], seed, F.lit("sentence"), *key), F.lit("{}"), value))
    said = out.otherwise(_pick(NEGATIVE, seed, F.lit("neg"), *key))
    return F.replace(_pick(WRAPPERS, seed, F.lit("wrap"), *key), F.lit("{}"), said) if kind == "harder" else said


def split(spark: SparkSession, kind: str, n: int, seed: int) -> DataFrame:
    """text, labels, contains_sensitive, difficulty: a row for each label first, then the kind's mixture."""
    negatives, pairs, masked, _ = MIXES[kind]
    rows = spark.range(n)
    i, u = F.col("id"), uniform(seed, F.lit("mix"), F.col("id"))
    names = LABELS[1:]
    first = F.when(i < len(names), F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))).otherwise(F.when(u < negatives, F.lit("NONE")).otherwise(_pick(names, seed, F.lit("label"), i)))
    second = F.when((i >= len(names)) & (u >= negatives) & (u < negatives + pairs), _pick(names, seed, F.lit("second"), i))
    labels = F.array_distinct(F.filter(F.array("a", "b"), lambda x: x.isNotNull()))
    body = F.concat_ws(" ", filled(F.col("a"), seed, i, kind=kind), F.when(F.col("b").isNotNull(), filled(F.col("b"), seed + 1, i, kind=kind)))
    noisy = text.noise(body, _pick(text.NOISE, seed, F.lit("noise"), i))
    out = rows.withColumn("a", first).withColumn("b", second)
    return out.select(F.when(uniform(seed, F.lit("mask"), i) < masked * 0.5, text.digits_masked(noisy)).otherwise(noisy).alias("text"), labels.alias("labels"), (F.col("a") != "NONE").alias("contains_sensitive"), F.when(F.col("b").isNotNull(), "hard").when(F.col("a") == "NONE", "medium").otherwise("easy").alias("difficulty"))


def data_set(spark: SparkSession, kind: str, seed: int = 42) -> DataFrame:
    """All three splits, each from its own seed."""
    out = None
    for k, (name, n) in enumerate(zip(("train", "validation", "test"), MIXES[kind][3], strict=True), 1):
        part = split(spark, kind, n, seed + k).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def modular_graph(spark: SparkSession, n_nodes: int = 512, mean_degree: int = 8, seed: int = 42, n_regions: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: draws mostly inside a region, log-normal weights, a fifth inhibitory; repeated draws are summed."""
    nodes = spark.range(n_nodes).select(F.col("id").alias("node"), F.concat(F.lit("region_"), (F.col("id") % n_regions).cast("string")).alias("region"))
    i = F.col("id")
    draws = spark.range(n_nodes * mean_degree).select(i, _number(0, n_nodes, seed, F.lit("src"), i).alias("src"), _number(0, n_nodes, seed, F.lit("dst"), i).alias("any"), uniform(seed, F.lit("in"), i).alias("inside"))
    inside = F.pmod(F.col("any") - F.col("any") % n_regions + F.col("src") % n_regions, F.lit(n_nodes))
    normal = F.sqrt(-2 * F.log(F.greatest(uniform(seed, F.lit("n1"), i), F.lit(1e-12)))) * F.cos(2 * F.pi() * uniform(seed, F.lit("n2"), i))
    w = F.exp(0.5 * normal) * F.when(uniform(seed, F.lit("sign"), F.col("src")) < 0.2, -1.0).otherwise(1.0)
    edges = draws.select("src", F.when(F.col("inside") < 0.72, inside).otherwise(F.col("any")).alias("dst"), w.alias("w"))
    return nodes, edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
