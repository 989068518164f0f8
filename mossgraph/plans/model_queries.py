"""Facts, readouts, labels, statistics and guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluation, facts, guards
from ..operators.reservoir import checkpointed
from ..registry import query, table
from .text_queries import fnv_sql

_DOM = {f: "[" + ", ".join(f"'{v}'" for v in vs) + "]" for f, vs in facts.DOMAIN.items()}
_AT = lambda f, i: f"{_DOM[f]}[(({i}) % {len(facts.DOMAIN[f])} + 1)::INTEGER] AS {f}"
_RULES = """CASE WHEN urgency = 'high' AND (harm = 'high' OR matter IN ('threat', 'official')) THEN 'refer-higher' WHEN proof = 'unclear' AND matter IN ('boundary', 'insult', 'property') THEN 'find-witness'
WHEN matter = 'property' AND property <> 'none' THEN 'request-return' WHEN ability = 'unable' OR matter = 'debt' THEN 'propose-settlement' WHEN matter IN ('account', 'charter') THEN 'sworn-account'
WHEN harm = 'high' OR intent = 'deliberate' THEN 'seek-full-reparation' WHEN harm IN ('moderate', 'low') OR matter IN ('damage', 'delivery') THEN 'seek-small-reparation' ELSE 'let-rest' END"""
CASES = f"""c0 AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'holdout' ELSE 'teach' END AS split, {_AT('matter', "ascii(o_orderpriority) + c_nationkey")}, {_AT('property', 'o_custkey')}, {_AT('harm', 'least(floor(o_totalprice / 100000), 3)::BIGINT')}, {_AT('proof', 'o_orderkey')}, {_AT('intent', 'c_nationkey')}, {_AT('relationship', 'o_custkey')},
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'ordinary' ELSE 'low' END AS urgency, CASE WHEN c_acctbal < 0 THEN 'unable' ELSE 'able' END AS ability FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, {_RULES} AS label FROM c0)"""
_H = ", ".join(fnv_sql(f"lower('{f}:' || {f})") for f in facts.FIELDS)
ENCODED = f"""h AS (SELECT case_id, split, label, unnest([{_H}]) AS h FROM c),
hv AS (SELECT case_id, (h % 96)::INTEGER AS slot, CASE WHEN (h >> 9) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM h UNION ALL SELECT case_id, ((h % 96 + 31) % 96)::INTEGER, CASE WHEN (h >> 13) & 1 = 1 THEN 0.38::DOUBLE ELSE -0.38::DOUBLE END FROM h),
hs AS (SELECT case_id, slot, sum(v) AS v FROM hv GROUP BY ALL), hn AS (SELECT case_id, sqrt(sum(v * v)) AS norm FROM hs GROUP BY case_id), u AS (SELECT case_id, slot, CASE WHEN norm > 0 THEN v / norm ELSE 0 END AS v FROM hs JOIN hn USING (case_id))"""


def cases(spark, sf_dir):
    return facts.stand_in(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


@query(f"WITH {CASES} SELECT * FROM c")
def fact_cases(spark, sf_dir):
    return cases(spark, sf_dir)


@query(f"WITH {CASES} SELECT label, count(*) AS n FROM c GROUP BY label")
def rules_recommend(spark, sf_dir):
    return cases(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {CASES}, {ENCODED} SELECT case_id, slot, round(v, 6) + 0.0 AS value FROM u WHERE abs(v) > 1e-9")
def fact_encode(spark, sf_dir):
    rows = facts.encoded(cases(spark, sf_dir)).select("case_id", F.posexplode("u").alias("slot", "v"))
    return rows.where("abs(v) > 1e-9").select("case_id", "slot", (F.round("v", 6) + 0.0).alias("value"))


@query(f"WITH {CASES}, b AS (SELECT case_id, CASE WHEN case_id % 10 = 0 THEN 'unheard' ELSE matter END AS matter FROM c) SELECT case_id, 'matter' AS field, matter AS value FROM b WHERE matter = 'unheard'")
def fact_domain_violations(spark, sf_dir):
    c = cases(spark, sf_dir)
    return facts.violations(c.withColumn("matter", F.when(F.col("case_id") % 10 == 0, "unheard").otherwise(F.col("matter"))))


_CENTROID = f"WITH {CASES}, {ENCODED}, t AS (SELECT case_id, label FROM c WHERE split = 'teach'), k AS (SELECT label, count(*) AS n FROM t GROUP BY label), m AS (SELECT label, slot, sum(v) AS s FROM u JOIN t USING (case_id) GROUP BY ALL), q AS (SELECT label, slot, s / n AS v FROM m JOIN k USING (label))"


@query(f"{_CENTROID} SELECT label, slot, round(v, 6) + 0.0 AS value FROM q WHERE abs(v) > 1e-9")
def fact_centroids(spark, sf_dir):
    c = cases(spark, sf_dir)
    teach = facts.encoded(c.where("split = 'teach'")).join(c.select("case_id", "label"), "case_id")
    return facts.centroids(teach).select("label", F.posexplode("centroid").alias("slot", "v")).where("abs(v) > 1e-9").select("label", "slot", (F.round("v", 6) + 0.0).alias("value"))


_SCORED = f"""{_CENTROID}, d AS (SELECT a.case_id, q.label, sum(a.v * q.v) AS dot FROM u a JOIN q USING (slot) JOIN c ON c.case_id = a.case_id AND split = 'holdout' GROUP BY ALL), ql AS (SELECT label, sum(v * v) AS qq FROM q GROUP BY label),
ul AS (SELECT case_id, sum(v * v) AS uu FROM u GROUP BY case_id), sc AS (SELECT c.case_id, ql.label, coalesce(dot, 0) / greatest(1e-12, sqrt(qq * uu)) AS score FROM c CROSS JOIN ql JOIN ul USING (case_id) LEFT JOIN d ON d.case_id = c.case_id AND d.label = ql.label WHERE split = 'holdout'),
pe AS (SELECT *, exp(4 * (score - max(score) OVER (PARTITION BY case_id))) AS e FROM sc), p AS (SELECT case_id, label, score, e / sum(e) OVER (PARTITION BY case_id) AS p FROM pe),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(p, 12) DESC, label) AS r FROM p), a AS (SELECT case_id, max(label) FILTER (r = 1) AS forced_choice, max(p) FILTER (r = 1) AS p1, max(p) FILTER (r = 2) AS p2 FROM r GROUP BY case_id),
adv AS (SELECT case_id, forced_choice, p1 AS confidence, p1 - p2 AS margin, CASE WHEN p1 < 0.28 OR p1 - p2 < 0.045 THEN 'abstain' ELSE forced_choice END AS action FROM a)"""


def _advice(spark, sf_dir):
    c = cases(spark, sf_dir)
    u = checkpointed(facts.encoded(c).join(c.select("case_id", "label", "split"), "case_id"))  # used twice, and costly to make
    readout = facts.centroids(u.where("split = 'teach'"))
    scores = facts.scored_arrays(u.where("split = 'holdout'").select("case_id", "u"), readout, "case_id")
    return c, facts.advised(scores, "case_id", digits=12)


@query(f"{_SCORED} SELECT case_id, action, forced_choice, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM adv")
def recommend_or_abstain(spark, sf_dir):
    return _advice(spark, sf_dir)[1].select("case_id", "action", "forced_choice", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


@query(f"{_SCORED} SELECT count(*) AS cases, count(*) FILTER (action = label) AS correct, count(*) FILTER (action = 'abstain') AS abstained, count(*) FILTER (forced_choice = label) AS forced_correct FROM adv JOIN c USING (case_id)")
def facts_only_benchmark(spark, sf_dir):
    c, advice = _advice(spark, sf_dir)
    return facts.accuracy(advice, c)


_NAMES = " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in facts.ACTIONS.items())
_NOTE = lambda i: " ".join(f"WHEN label = '{k}' THEN replace('{v[i]}', '{{}}', CASE WHEN property <> 'none' THEN property ELSE 'the matter' END)" for k, v in facts.NOTES.items())


@query(f"WITH {CASES} SELECT case_id, CASE {_NAMES} END AS name, [CASE {_NOTE(0)} END, CASE {_NOTE(1)} END] AS notes FROM c")
def authored_notes(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", facts.action_name(F.col("label")).alias("name"), facts.notes(F.col("label"), F.col("property")).alias("notes"))


# --- vectors and readouts over embeddings ---
_LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_CENT = f"{_LONG}, q AS (SELECT label, pos, avg(x) AS c FROM v GROUP BY ALL)"
_COS = f"""{_CENT}, cs AS (SELECT vec_id, q.label, sum(x * c) / greatest(1e-12, sqrt(sum(x * x) * sum(c * c))) AS score FROM v JOIN q USING (pos) GROUP BY vec_id, q.label)"""


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "u")


def _readout(spark, sf_dir):
    return facts.centroids(_emb(spark, sf_dir))


def _cosines(spark, sf_dir, temperature=4.0):
    return facts.scored(_emb(spark, sf_dir).select("vec_id", "u"), _readout(spark, sf_dir), "vec_id", temperature=temperature)


@query(f"WITH {_CENT} SELECT label, pos::INTEGER AS pos, round(c, 6) AS value FROM q")
def centroids(spark, sf_dir):
    return _readout(spark, sf_dir).select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@query(f"WITH {_CENT} SELECT label, pos::INTEGER AS pos, round(c / sqrt(sum(c * c) OVER (PARTITION BY label)), 6) AS value FROM q")
def centroids_l2(spark, sf_dir):
    return _readout(spark, sf_dir).select("label", F.posexplode(vectors.unit(F.col("centroid"))).alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@query(f"WITH {_COS} SELECT vec_id, label, round(score, 6) AS score FROM cs")
def cosine_scores(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_COS}, e AS (SELECT *, exp(4 * (score - max(score) OVER (PARTITION BY vec_id))) AS e FROM cs) SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def softmax_scores(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", "label", F.round("p", 6).alias("p"))


_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM cs)"


@query(f"WITH {_COS}, {_RANK} SELECT vec_id, max(label) FILTER (r = 1) AS label, max(label) FILTER (r = 2) AS runner_up, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 6) AS margin FROM k GROUP BY vec_id")
def margin(spark, sf_dir):
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "label")
    rows = _cosines(spark, sf_dir).select("vec_id", "label", "score", F.row_number().over(w).alias("r"), F.lead("label").over(w).alias("runner_up"), (F.col("score") - F.lead("score").over(w)).alias("margin"))
    return rows.where("r = 1").select("vec_id", "label", "runner_up", F.round("margin", 6).alias("margin"))


@query(f"WITH {_COS}, {_RANK} SELECT vec_id, r::INTEGER AS rank, label, round(score, 6) AS score, CASE WHEN max(score) OVER (PARTITION BY vec_id) >= 0.8 AND max(score) FILTER (r = 1) OVER (PARTITION BY vec_id) - max(score) FILTER (r = 2) OVER (PARTITION BY vec_id) >= 0.035 THEN 'matched' ELSE 'unmapped' END AS status FROM k QUALIFY r <= 3")
def decode_topk(spark, sf_dir):
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "label")
    all_ = Window.partitionBy("vec_id")
    rows = _cosines(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    first, second = (F.max(F.when(F.col("rank") == k, F.col("score"))).over(all_) for k in (1, 2))
    status = F.when((first >= 0.8) & (first - second >= 0.035), "matched").otherwise("unmapped")
    return rows.select("vec_id", "rank", "label", F.round("score", 6).alias("score"), status.alias("status"))


@query(f"WITH {_LONG} SELECT a.pos::INTEGER AS i, b.pos::INTEGER AS j, round(sum(a.x * b.x) + max(CASE WHEN a.pos = b.pos THEN 1e-5 ELSE 0 END), 5) AS g FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.pos <= a.pos GROUP BY ALL")
def ridge_gram(spark, sf_dir):
    from ..operators import learning

    return learning.gram(_emb(spark, sf_dir), "u").select("i", "j", F.round("g", 5).alias("g"))


@query()
def ridge_solve(spark, sf_dir):
    from ..operators import learning

    return learning.ridge(spark, _emb(spark, sf_dir).withColumn("y", F.col("label").cast("double")), "u", "y").select("i", F.round("weight", 5).alias("weight"))


@query("SELECT i::INTEGER AS i, 0.0::DOUBLE AS residual FROM range((SELECT max(len(embedding)) FROM embeddings)) r(i)")
def ridge_residual(spark, sf_dir):
    """What the solved weights leave of the normal equations, by sums over all rows: nothing."""
    from ..operators import learning

    rows = _emb(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    w = learning.ridge(spark, rows, "u", "y")
    packed = w.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "weight"))), lambda x: x["weight"]).alias("w"))  # one entry a dimension
    error = rows.join(F.broadcast(packed)).select("u", (vectors.dot(F.col("u"), F.col("w")) - F.col("y")).alias("e"))
    sums = error.select("e", F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum(F.col("e") * F.col("x").cast("double")).alias("g"))
    return sums.join(w, "i").select("i", (F.round(F.col("g") + learning.RIDGE * F.col("weight"), 4) + 0.0).alias("residual"))


@query()
def logistic_readout(spark, sf_dir):
    from ..operators import learning

    rows = _emb(spark, sf_dir).select("vec_id", "u", F.array(*[(F.col("label") == k).cast("int") for k in range(3)]).alias("y"))
    return learning.logistic_readout(rows, "vec_id", "u", "y", 3).select("vec_id", F.transform("p", lambda x: F.round(x, 3)).alias("p"))


@query(f"WITH {_LONG} SELECT count(DISTINCT vec_id) AS vectors, count(*) AS numbers, count(*) FILTER (isnan(x)) AS not_numbers, round(max(abs(x)), 6) AS largest FROM v")
def embedding_quality_gate(spark, sf_dir):
    return guards.embedding_gate(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, count(*) = count(DISTINCT vec_id) AS is_unique FROM embeddings")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids")).withColumn("is_unique", F.col("n_rows") == F.col("n_ids"))


@query(f"WITH {_COS}, f AS (SELECT vec_id, label, round(score, 3) AS score FROM cs), a AS (SELECT vec_id, arg_max(label, (score, -label)) AS l FROM cs GROUP BY vec_id), b AS (SELECT vec_id, arg_max(label, (score, -label)) AS l FROM f GROUP BY vec_id) SELECT count(*) AS cases, count(*) FILTER (a.l <> b.l) AS mismatches, (SELECT round(max(abs(cs.score - f.score)), 6) FROM cs JOIN f USING (vec_id, label)) AS max_delta FROM a JOIN b USING (vec_id)")
def backend_diff(spark, sf_dir):
    """Decisions of full and of rounded scores, compared."""
    c = _cosines(spark, sf_dir).select("vec_id", "label", "score", F.round("score", 3).alias("other"))
    best = c.groupBy("vec_id").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("a"), F.max_by("label", F.struct("other", -F.col("label"))).alias("b"), F.max(F.abs(F.col("score") - F.col("other"))).alias("d"))
    return best.agg(F.count("*").alias("cases"), F.count_if(F.col("a") != F.col("b")).alias("mismatches"), F.round(F.max("d"), 6).alias("max_delta"))


@query(f"WITH {_COS}, {_RANK}, m AS (SELECT vec_id, max(score) FILTER (r = 1) - max(score) FILTER (r = 2) AS margin FROM k GROUP BY vec_id) SELECT vec_id, round(margin, 6) AS margin FROM m WHERE margin < 0.01")
def knife_edges(spark, sf_dir):
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "label")
    rows = _cosines(spark, sf_dir).select("vec_id", F.row_number().over(w).alias("r"), (F.col("score") - F.lead("score").over(w)).alias("margin"))
    return rows.where("r = 1 AND margin < 0.01").select("vec_id", F.round("margin", 6).alias("margin"))


# --- labels and metrics ---
_LABELLED = "l AS (SELECT d.doc_id, quality, toxic, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 1 ELSE 0 END AS p_toxic, CASE WHEN contains(text, '!!') OR contains(text, '***') THEN 0 ELSE 1 END AS p_quality FROM documents d JOIN labels USING (doc_id))"
_PAIRS = f"{_LABELLED}, r AS (SELECT doc_id AS id, 'quality' AS label, quality AS y, p_quality AS p FROM l UNION ALL SELECT doc_id, 'toxic', toxic, p_toxic FROM l)"


def _pairs(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    low = F.lower("text")
    rows = d.join(lab, "doc_id").select("doc_id", "quality", "toxic", (low.contains("idiot") | low.contains("scum")).cast("int").alias("pt"), (~(F.col("text").contains("!!") | F.col("text").contains("***"))).cast("int").alias("pq"))
    return rows.select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y"), F.col("pq").alias("p")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y"), F.col("pt").alias("p")))).alias("x")).select("id", "x.*")


_COUNTS = "k AS (SELECT label, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1) AS support FROM r GROUP BY label), s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS rec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM k)"


@query(f"WITH {_PAIRS}, {_COUNTS} SELECT label, tp, fp, fn, tn, support, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM s")
def per_class_metrics(spark, sf_dir):
    return evaluation.per_class(_pairs(spark, sf_dir)).select("label", "tp", "fp", "fn", "tn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PAIRS}, {_COUNTS} SELECT (SELECT count(DISTINCT id) FROM r) AS examples, (SELECT round(avg(s), 6) FROM (SELECT bool_and(y = p)::INTEGER AS s FROM r GROUP BY id)) AS exact_match, round(avg(prec), 6) AS macro_precision, round(avg(rec), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM s")
def multilabel_metrics(spark, sf_dir):
    m = evaluation.metrics(_pairs(spark, sf_dir))
    return m.select("examples", *[F.round(c, 6).alias(c) for c in ("exact_match", "macro_precision", "macro_recall", "macro_f1", "micro_f1")])


@query(f"WITH {_PAIRS} SELECT label, y, p, count(*) AS n FROM r GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("label", "y", "p").agg(F.count("*").alias("n"))


_SETS = "s AS (SELECT doc_id, list_filter([CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN toxic = 1 THEN 'OTHER_SENSITIVE' END, CASE WHEN quality = 1 THEN 'none' END], lambda x: x IS NOT NULL) AS labels FROM documents JOIN labels USING (doc_id))"


def _sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    parts = F.array(F.when(F.col("text").contains("@"), "email"), F.when(F.col("toxic") == 1, "OTHER_SENSITIVE"), F.when(F.col("quality") == 1, "none"))
    return d.select("doc_id", F.filter(parts, lambda x: x.isNotNull()).alias("labels"))


_HOT = ", ".join(f"CASE WHEN list_contains(up, '{n}') THEN 1 ELSE 0 END" if n != "NONE" else "CASE WHEN len(list_filter(up, lambda x: x <> 'NONE')) = 0 THEN 1 ELSE 0 END" for n in evaluation.LABELS)


@query(f"WITH {_SETS}, u AS (SELECT doc_id, list_transform(labels, lambda x: upper(x)) AS up FROM s) SELECT doc_id, [{_HOT}] AS hot FROM u")
def label_multihot(spark, sf_dir):
    return _sets(spark, sf_dir).select("doc_id", evaluation.multi_hot(F.col("labels")).alias("hot"))


@query(f"WITH {_SETS} SELECT doc_id, coalesce(list_filter(list_transform(labels, lambda x: upper(x)), lambda x: x <> 'NONE')[1], 'NONE') AS label, len(list_filter(labels, lambda x: upper(x) <> 'NONE')) > 0 AS sensitive FROM s")
def primary_label(spark, sf_dir):
    return _sets(spark, sf_dir).select("doc_id", evaluation.primary(F.col("labels")).alias("label"), evaluation.sensitive(F.col("labels")).alias("sensitive"))


_SCORES = "sc AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * 2 + 0.3 AS score FROM embeddings), sl AS (SELECT vec_id, pos, [" + ", ".join(f"'{n}'" for n in evaluation.LABELS) + "][pos + 1] AS label, score FROM sc WHERE pos < 12)"


def _scores(spark, sf_dir):
    names = F.array(*map(F.lit, evaluation.LABELS))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("idx", "x"))
    return rows.select("vec_id", "idx", F.element_at(names, F.col("idx") + 1).alias("label"), (F.col("x").cast("double") * 2 + 0.3).alias("score"))


@query(f"WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS r, max(score) OVER (PARTITION BY vec_id) AS best FROM sl WHERE label <> 'NONE') SELECT vec_id, coalesce(list(label ORDER BY r) FILTER (score >= 0.5 AND score >= best - 0.25 AND r <= 3), ['NONE']) AS labels FROM k GROUP BY vec_id")
def label_select(spark, sf_dir):
    return evaluation.chosen(_scores(spark, sf_dir), "vec_id")


@query(f"WITH {_SCORES} SELECT vec_id, coalesce(list(label ORDER BY pos) FILTER (score >= 0.5 AND label <> 'NONE'), [arg_max(label, (score, -pos))]) AS labels FROM sl GROUP BY vec_id")
def label_select_argmax(spark, sf_dir):
    return evaluation.chosen_or_best(_scores(spark, sf_dir), "vec_id")


# --- trials and statistics ---
_TRIALS = "t AS (SELECT (l_orderkey % 40)::INTEGER AS pair_id, (l_orderkey % 10)::INTEGER AS data_seed, CASE WHEN l_returnflag = 'R' THEN 'connectome' WHEN l_returnflag = 'A' THEN 'linear' ELSE 'mlp' END AS model, avg(l_discount)::DOUBLE * 10 AS macro_f1 FROM lineitem GROUP BY ALL)"


def _trials(spark, sf_dir):
    model = F.when(F.col("l_returnflag") == "R", "connectome").when(F.col("l_returnflag") == "A", "linear").otherwise("mlp")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).cast("int").alias("pair_id"), (F.col("l_orderkey") % 10).cast("int").alias("data_seed"), model.alias("model")).agg((F.avg("l_discount") * 10).alias("macro_f1"))


_DELTAS = f"{_TRIALS}, dl AS (SELECT a.pair_id, a.data_seed, a.macro_f1 - b.macro_f1 AS delta FROM t a JOIN t b USING (pair_id) WHERE a.model = 'connectome' AND b.model = 'linear'), cm AS (SELECT data_seed, avg(delta) AS mean, count(*) AS n FROM dl GROUP BY data_seed)"


def _means(spark, sf_dir):
    return evaluation.cluster_means(evaluation.paired_deltas(_trials(spark, sf_dir), "connectome", "linear"))


@query(f"WITH {_DELTAS} SELECT pair_id, data_seed, round(delta, 6) AS delta FROM dl")
def paired_deltas(spark, sf_dir):
    return evaluation.paired_deltas(_trials(spark, sf_dir), "connectome", "linear").select("pair_id", "data_seed", F.round("delta", 6).alias("delta"))


@query(f"WITH {_DELTAS} SELECT data_seed, round(mean, 6) AS mean, n FROM cm")
def cluster_means(spark, sf_dir):
    return _means(spark, sf_dir).select("data_seed", F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {_DELTAS}, i AS (SELECT mean, row_number() OVER (ORDER BY data_seed) - 1 AS i FROM cm), k AS (SELECT count(*) AS k, avg(mean) AS o FROM cm), f AS (SELECT f, sum(CASE WHEN (f >> i) & 1 = 1 THEN mean ELSE -mean END) / max(k) AS perm, max(o) AS o FROM range(1024) r(f), i, k GROUP BY f) SELECT round(max(o), 6) AS observed, round(avg((abs(perm) >= abs(o) - 1e-12)::INTEGER), 6) AS p_value, (SELECT k FROM k) AS clusters FROM f")
def sign_permutation(spark, sf_dir):
    return evaluation.sign_permutation(_means(spark, sf_dir)).select(F.round("observed", 6).alias("observed"), F.round("p_value", 6).alias("p_value"), "clusters")


@query(f"WITH {_DELTAS}, i AS (SELECT mean, row_number() OVER (ORDER BY data_seed) - 1 AS i FROM cm), s AS (SELECT id, floor(('0x' || substr(md5('2026:' || id || ':' || slot), 1, 13))::BIGINT::DOUBLE / {16**13} * 10)::BIGINT AS i FROM range(10000) a(id), range(10) b(slot)), b AS (SELECT id, avg(mean) AS m FROM s JOIN i USING (i) GROUP BY id) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b")
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap(_means(spark, sf_dir)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_TRIALS} SELECT model, round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS std_pop, round(stddev_samp(macro_f1), 6) AS std_samp, round(1.96::DOUBLE * stddev_pop(macro_f1) / sqrt(count(*)), 6) AS half_width, count(*) AS runs, round(min(macro_f1), 6) AS least, round(max(macro_f1), 6) AS most FROM t GROUP BY model")
def model_summary(spark, sf_dir):
    m = evaluation.model_summary(_trials(spark, sf_dir))
    return m.select("model", "runs", *[F.round(c, 6).alias(c) for c in ("mean", "std_pop", "std_samp", "half_width", "least", "most")])


@query(f"WITH {_TRIALS} SELECT data_seed, model, pair_id FROM t QUALIFY row_number() OVER (PARTITION BY data_seed, model ORDER BY round(macro_f1, 9) DESC, pair_id) = 1")
def search_best(spark, sf_dir):
    w = Window.partitionBy("data_seed", "model").orderBy(F.desc(F.round("macro_f1", 9)), "pair_id")
    return _trials(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").select("data_seed", "model", "pair_id")


@query("SELECT doc_id, label FROM (SELECT doc_id, (quality * 2 + toxic)::INTEGER AS label, row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5('3:' || doc_id), doc_id) AS turn FROM labels) ORDER BY turn, label LIMIT 80")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))
    return evaluation.stratified(rows, "label", "doc_id", 80, 3).select("doc_id", "label")


# --- ordered operators and limits over events ---
@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND event_type IS DISTINCT FROM b")
def change_points(spark, sf_dir):
    return evaluation.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) FILTER (n > 1 AND event_type IS DISTINCT FROM b) AS changes, count(*) AS steps FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def label_change_count(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("b"), F.row_number().over(w).alias("n"))
    return rows.groupBy("user_id").agg(F.count_if((F.col("n") > 1) & ~F.col("event_type").eqNullSafe(F.col("b"))).alias("changes"), F.count("*").alias("steps"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def last_n(spark, sf_dir):
    return evaluation.last_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id")


@query("SELECT event_id FROM events QUALIFY (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 7 = 0")
def stride_sample(spark, sf_dir):
    return evaluation.every_kth(table(spark, sf_dir, "events"), ["ts", "event_id"], 7, ["event_type"]).select("event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_limit_window(spark, sf_dir):
    return guards.window_counts(table(spark, sf_dir, "events"), "user_id", "ts", 60).select("event_id", "in_window")


@query("""WITH RECURSIVE a AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id UNION ALL SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.t + INTERVAL 3600 SECONDS GROUP BY a.user_id)
SELECT event_id, a.t IS NOT NULL AND row_number() OVER (PARTITION BY e.user_id, e.ts ORDER BY event_id) = 1 AS admitted FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.t = e.ts""")
def rate_limit_stateful(spark, sf_dir):
    return guards.admitted(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 1, 3600.0)


@query("SELECT conv_id, turn, trim(text, ' ') AS text FROM conversations WHERE length(trim(text, ' ')) BETWEEN 1 AND 4000")
def request_validation(spark, sf_dir):
    return guards.valid_texts(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


@query("SELECT item_id, length(text) BETWEEN 1 AND 6000 AS ok, (SELECT sum(length(text)) <= 120000 FROM benchmark) AS total_ok FROM benchmark")
def card_validation(spark, sf_dir):
    return guards.card_checks(table(spark, sf_dir, "benchmark"), "item_id", "text")
