"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents' tokens are summed to cells (source, language, topic). Starting from the cells' tokens, weights are scaled in
turn so that each margin (sources, languages, topics) gets its target total. A weight is what the cell is to keep, so after every
step it is cut to the cell's own tokens, and the next steps make up for that from other cells. A document is then sampled with
the probability weight / tokens of its cell, by a hash of its id, so the choice can be repeated.

Targets are shares of ``rate`` of all tokens: given by margin, or else each value's total raised to ``temper`` (below 1: small
sources gain). No value is asked for more than ``MOST`` of its tokens: what its share exceeds that by goes to the margin's
other values, in proportion to their shares. So every margin can be met, and there is room to meet all of them; ``margins``
tells what a share wanted, the target and what is expected, and so names the values that couldn't give more. Rounds go on,
``rounds`` at a time, until no margin's expected tokens miss their target by more than ``TOLERANCE``, or ``LIMIT`` rounds are done, as
margins given may contradict each other; the greatest miss is ``residual``.

Topics come from ``topic``, by default the text's form: the first of some marks that it holds. Any expression over the text can stand for it. Tokens are maximal runs without ASCII white space.

Scale: texts are read once and only features are kept; everything after works on cells, which are summed in each task
before they are shuffled. Each round is a query of its own over a written table: a plan of many rounds has an exchange for each of
their margins, and the driver keeps and describes all of them anew whenever one ends. Totals over all cells and what a margin's values share out are summed in tasks too; the windows are over the
cells of one source, language or topic. Documents find their cell by a join whose skew Spark splits.
Nulls: null text has no tokens; null source, language or doc_id are values of their own (empty text for the first two).
Cells without tokens keep weight 0 and probability 1; an empty text in another cell is drawn like the rest of it. Rows with one doc_id are drawn alike. Repeated rows count and return each, very long texts count
whole, an empty table gives an empty result, other columns are carried along by ``mixed`` and ignored by ``probabilities``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import replaced, spare, stored

MARGINS = ("source", "lang", "topic")
TOKEN = r"[^\x20\x09-\x0D]+"
ROUNDS, RATE, TEMPER = 12, 0.6, 0.7
MOST, TOLERANCE, LIMIT = 0.8, 0.005, 96


def topic(text: Column) -> Column:
    """A text's form, by the first mark that it holds."""
    return F.when(text.contains(" | "), "table").when(text.contains("!! "), "shout").when(text.contains("*** ") | text.contains("%%% "), "noise").when(text.contains("\n"), "prose").otherwise("line")


def features(documents: DataFrame, topic_of: Callable[[Column], Column] = topic) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(text).alias("topic"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    text = F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def level(values: DataFrame, total: float) -> dict[str, float]:
    """For each margin of ``values`` (margin, most, s): x such that the sum of min(most, x * s) is ``total``; beyond all bounds where all that can be given is less."""
    found: dict[str, float] = {}
    before: dict[str, int] = {}
    while True:
        x = F.coalesce(*(F.when(F.col("margin") == m, v) for m, v in found.items()), F.lit(0.0))
        full = F.col("most") < x * F.col("s")
        # a row for each margin
        got = {r.margin: r for r in values.groupBy("margin").agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("s"))).alias("s")).collect()}
        found = {m: (total - r.given) / r.s if r.s > 0 else float("inf") for m, r in got.items()}
        if {m: r.n for m, r in got.items()} == before:
            return found
        before = {m: r.n for m, r in got.items()}


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, rate: float = RATE, temper: float = TEMPER) -> DataFrame:
    """source, lang, topic, tokens, weight, probability of cells (source, lang, topic, tokens), residual, and for each margin m t_m and s_m, the target in tokens and what the value's share wanted. A target table has the margin's column and ``share``."""
    cells = stored(cells)
    every = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for m in MARGINS:
        total = F.sum("tokens").over(Window.partitionBy(m)).cast("double")
        w = w.withColumn(f"n_{m}", total)
        if targets and m in targets:
            w = w.join(targets[m].select(m, F.col("share").cast("double").alias(f"s_{m}")), m, "left").fillna({f"s_{m}": 0.0})
        else:
            w = w.withColumn(f"s_{m}", F.when(total > 0, F.pow(total, F.lit(temper))).otherwise(0.0))
    w = stored(w)
    values = None
    for m in MARGINS:
        part = w.groupBy(m).agg(F.first(f"s_{m}").alias("s"), (F.first(f"n_{m}") * MOST).alias("most")).select(F.lit(m).alias("margin"), "s", "most")
        values = part if values is None else values.unionAll(part)
    values = stored(values)
    whole = {r.margin: r.s for r in values.groupBy("margin").agg(F.sum("s").alias("s")).collect()}
    levels = level(values, rate * every)
    for m in MARGINS:
        asked = levels.get(m, 0.0) * F.col(f"s_{m}") if levels.get(m, 0.0) < float("inf") else F.col(f"n_{m}") * MOST
        w = w.withColumn(f"t_{m}", F.least(F.col(f"n_{m}") * MOST, F.when(F.col(f"s_{m}") > 0, asked).otherwise(0.0))).withColumn(f"s_{m}", F.col(f"s_{m}") * rate * every / (whole.get(m) or 1.0))
    last, done = w, 0
    while True:
        for _ in range(rounds):
            for m in MARGINS:
                over = F.sum("w").over(Window.partitionBy(m))
                w = w.withColumn("w", F.when(over > 0, F.least(F.col("tokens").cast("double"), F.col("w") * F.col(f"t_{m}") / over)).otherwise(0.0))
            last = w = replaced(last, w)
        done += rounds
        miss = _margins(w, F.col("w")).agg(F.max(F.when(F.col("target") > 0, F.abs(F.col("expected") / F.col("target") - 1)))).first()[0] or 0.0
        if miss <= TOLERANCE or done >= LIMIT:
            break
    chance = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
    return w.select(*MARGINS, "tokens", F.round("w", 3).alias("weight"), F.round(chance, 6).alias("probability"), F.lit(miss).alias("residual"), *(f"{k}_{m}" for k in "ts" for m in MARGINS))


def _margins(cells: DataFrame, weight: Column) -> DataFrame:
    out = None
    for m in MARGINS:
        part = cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"s_{m}").alias("wanted"), F.max(f"t_{m}").alias("target"), F.sum(weight).alias("expected"))
        out = part if out is None else out.unionAll(part)
    return out


def margins(cells: DataFrame) -> DataFrame:
    """margin, value, tokens, wanted, target, expected (tokens to keep by the cells' probabilities) of the cells of ``raked``. Where the target is below what was wanted, the value has no more tokens to give."""
    return _margins(cells, F.col("probability") * F.col("tokens"))


def probabilities(documents: DataFrame, seed: int = 17, topic_of: Callable[[Column], Column] = topic, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every row, and residual: the greatest miss of a target, the same in all rows."""
    rows = stored(features(documents, topic_of))
    cells = raked(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), **options).select(*MARGINS, "weight", "probability", F.round("residual", 4).alias("residual"))
    return rows.join(cells, list(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "weight", "probability", (draw(F.coalesce("doc_id", F.lit(-1)), seed) < F.col("probability")).alias("sampled"), "residual")


def mixed(documents: DataFrame, seed: int = 17, topic_of: Callable[[Column], Column] = topic, **options) -> DataFrame:
    """The sampled rows of ``documents``, with all their columns."""
    names = {m: spare(documents.columns, f"__{m}") for m in (*MARGINS, "p")}
    values = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), topic_of(F.coalesce("text", F.lit("")))
    cells = raked(features(documents, topic_of).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), **options)
    cells = cells.select(*(F.col(m).alias(names[m]) for m in MARGINS), F.col("probability").alias(names["p"]))
    rows = documents.select("*", *(v.alias(names[m]) for m, v in zip(MARGINS, values, strict=True))).join(cells, [names[m] for m in MARGINS])
    return rows.where(draw(F.coalesce("doc_id", F.lit(-1)), seed) < F.col(names["p"])).select(*documents.columns)


def oracle(rounds: int = ROUNDS, rate: float = RATE, temper: float = TEMPER, seed: int = 17) -> str:
    steps, last = [], "w0"
    for k in range(rounds):
        for m in MARGINS:
            name = f"w{k}_{m}"
            steps.append(f"{name} AS (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN least(tokens::DOUBLE, w * t_{m} / sum(w) OVER (PARTITION BY {m})) ELSE 0 END AS w FROM {last})")
            last = name
    values = ", ".join(
        f"""v_{m} AS (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {temper}) ELSE 0 END AS s, sum(tokens) * {MOST}::DOUBLE AS most FROM c GROUP BY {m}),
    o_{m} AS (SELECT *, most / s AS r, sum(most) OVER o - most AS given, sum(s) OVER () - sum(s) OVER o + s AS left_s FROM v_{m} WHERE s > 0 WINDOW o AS (ORDER BY most / s, {m})),
    x_{m} AS (SELECT min_by(({rate}::DOUBLE * (SELECT sum(tokens) FROM c) - given) / left_s, r) AS x FROM o_{m} WHERE given + r * left_s >= {rate}::DOUBLE * (SELECT sum(tokens) FROM c)),
    t_{m} AS (SELECT {m}, CASE WHEN s > 0 THEN least(most, coalesce((SELECT x FROM x_{m}), 1e300) * s) ELSE 0 END AS t_{m} FROM v_{m})"""
        for m in MARGINS
    )
    missed = " UNION ALL ".join(f"SELECT max(CASE WHEN t > 0 THEN abs(w / t - 1) END) AS miss FROM (SELECT sum(w) AS w, max(t_{m}) AS t FROM {last} GROUP BY {m})" for m in MARGINS)
    return rf"""
    WITH f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
        CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shout' WHEN contains(text, '*** ') OR contains(text, '%%% ') THEN 'noise' WHEN contains(text, chr(10)) THEN 'prose' ELSE 'line' END AS topic FROM documents),
    c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM f GROUP BY ALL), {values},
    w0 AS (SELECT c.*, t_source, t_lang, t_topic, tokens::DOUBLE AS w FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    {", ".join(steps)},
    p AS (SELECT source, lang, topic, round(w, 3) AS weight, round(CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END, 6) AS probability FROM {last}),
    e AS (SELECT coalesce(max(miss), 0) AS miss FROM ({missed}))
    SELECT doc_id, source, lang, topic, n_tokens, weight, probability,
        ('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(doc_id, -1))), 1, 13))::BIGINT::DOUBLE / {16**13} < probability AS sampled, round(miss, 4) AS residual FROM f JOIN p USING (source, lang, topic), e"""
