"""URL filter by a path-template tree. DataFrame operations only.

Per host, paths become shapes: each segment's digit runs turn into ``{n}`` and long hexadecimal runs into ``{h}``. The
tree over the shapes is then generalised from the hosts down to the longest path. A position with more than ``max_children`` different segments
under its parent becomes ``*``; so do sibling branches whose labelled share of bad pages is within ``z`` standard errors
of their parent's. What is left are templates; one whose smoothed share of good labelled pages (its purity) is below
``least_purity`` is rejected, and its pages with it.

Labels are the pages that a rule fits: block means bad, allow good. A rule's own verdict always stands. Every share is
smoothed by ``strength`` pages of a prior share. Of the whole table it is ``prior``, of a host that of the whole table, of a branch
that of the branch it springs from (of the first ones: the host's). A template's prior is the mean of two shares: that of
the branch it springs from, and that of its shapes over all hosts. So a template without labels of its own is judged by its host
and by its likes elsewhere, and one without either by the whole.

Skew: pages are aggregated to (host, shape) before anything is shuffled by host, and each level works on these counts by
joins, which Spark splits where one host or template has most of the rows; no window or group holds a host.
The tree is a radix tree: what all shapes of a branch go on with is one edge, however many segments it has, and its shares follow
in one step. So there are as many rounds as a path has branchings. Paths count whole, however many segments they have.
Nulls: a null url, or one without ``://``, has an empty host and path, and no rule fits it. Repeated rows count each and
return each. An empty table gives an empty result. Other columns of ``pages`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Fixed values: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of ``oracle`` unless told otherwise: the given tables' longest paths. ``judge`` has no such bound.
DEPTH = 3


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the smaller text), and its verdict."""
    rule = verdict = None
    for v, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(pages: DataFrame, rules=RULES, max_children: int = 50, z: float = 2.0, strength: float = 2.0, prior: float = 0.5, least_purity: float = 0.5) -> DataFrame:
    """Page_id, host, path, rule, verdict, template, purity of every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    general = F.regexp_replace(F.regexp_replace("path", "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}")
    seen = stored(base.select("*", rule.alias("rule"), ruled.alias("ruled"), general.alias("shape")))

    sums = [F.sum(x).alias(x) for x in ("labelled", "bad")]
    share = lambda before: (F.col("labelled") - F.col("bad") + strength * before) / (F.col("labelled") + strength)
    shapes = seen.groupBy("host", "shape").agg(F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    parts = F.split(F.expr("substring(shape, 2)"), "/")
    shapes = stored(shapes.select("*", F.when(F.col("shape").startswith("/"), parts).otherwise(F.array()).alias("parts")))
    total = shapes.agg(*sums).first()
    whole = ((total["labelled"] or 0) - (total["bad"] or 0) + strength * prior) / ((total["labelled"] or 0) + strength)
    roots = shapes.groupBy("host").agg(*sums).select("host", share(F.lit(whole)).alias("here"))
    tree = stored(shapes.join(roots, "host").select("host", "shape", F.lit("").alias("template"), "labelled", "bad", F.col("parts").alias("rest"), F.col("here").alias("above"), "here"))
    ended = []
    while not tree.isEmpty():
        # what all shapes of a branch go on with is one edge of the tree: the least and the greatest of them share no more than that
        groups = tree.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("labelled").alias("p_labelled"), F.sum("bad").alias("p_bad"))
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        groups = groups.select("host", "template", "p_labelled", "p_bad", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int").alias("common"))
        own = (F.col("p_labelled") - F.col("p_bad")) / F.greatest(F.col("p_labelled"), F.lit(1))
        fade = F.pow(strength / (F.col("p_labelled") + strength), F.col("common") - 1)
        edge = F.when(F.col("common") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, F.col("common")), "/"))).otherwise("")
        along = lambda power, old: F.when(F.col("common") > 0, own + (F.col("here") - own) * power).otherwise(F.col(old)).alias(old)
        rest = F.slice("rest", F.col("common") + 1, F.size("rest"))
        moved = tree.join(groups, ["host", "template"]).select("host", "shape", F.concat("template", edge).alias("template"), "labelled", "bad", rest.alias("rest"), along(fade, "above"), along(fade * strength / (F.col("p_labelled") + strength), "here"), "p_labelled", "p_bad")
        moved = stored(moved.withColumn("seg", F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit("\x00"))))
        # its end is a branching
        children = moved.groupBy("host", "template", "seg").agg(*sums, F.max("p_labelled").alias("p_labelled"), F.max("p_bad").alias("p_bad"), F.max("here").alias("before"))
        widths = children.groupBy("host", "template").agg(F.count("*").alias("width"))
        rate, pooled = F.col("bad") / F.col("labelled"), F.col("p_bad") / F.col("p_labelled")
        near = F.abs(rate - pooled) <= z * F.sqrt(pooled * (1 - pooled) / F.col("labelled"))
        similar = F.coalesce(F.when((F.col("labelled") > 0) & (F.col("labelled") < F.col("p_labelled")), near), F.lit(False))
        goes_on = F.col("seg") != "\x00"
        name = F.when(~goes_on, "").otherwise(F.concat(F.lit("/"), F.when((F.col("width") > max_children) | similar, "*").otherwise(F.col("seg"))))
        steps = stored(children.join(widths, ["host", "template"]).select("host", "template", "seg", goes_on.alias("goes_on"), F.concat("template", name).alias("next"), "labelled", "bad", "before"))
        branches = steps.where("goes_on").groupBy("host", F.col("next").alias("next")).agg(*sums, F.max("before").alias("before")).select("host", "next", share(F.col("before")).alias("share"))
        ended.append(moved.where(~goes_on).select("host", "shape", "template", "labelled", "bad", "above"))
        onward = moved.where(goes_on).join(steps.select("host", "template", "seg", "next"), ["host", "template", "seg"]).join(branches, ["host", "next"])
        tree = stored(onward.select("host", "shape", F.col("next").alias("template"), "labelled", "bad", F.slice("rest", 2, F.size("rest")).alias("rest"), F.col("here").alias("above"), F.col("share").alias("here")))
    found = stored(reduce(DataFrame.unionAll, ended)) if ended else shapes.select("host", "shape", F.lit("").alias("template"), "labelled", "bad", F.lit(0.0).alias("above"))
    likes = shapes.groupBy("shape").agg(*sums).select("shape", share(F.lit(whole)).alias("elsewhere"))
    leaves = found.join(likes, "shape").groupBy("host", "template").agg(*sums, F.max("above").alias("above"), F.avg("elsewhere").alias("elsewhere"))
    leaves = leaves.select("host", "template", F.round(share((F.col("above") + F.col("elsewhere")) / 2), 6).alias("purity"))
    verdicts = found.select("host", "shape", "template").join(leaves, ["host", "template"])
    learnt = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return seen.join(verdicts, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "template", "purity")


def oracle(depth: int = DEPTH, max_children: int = 50, z: float = 2.0, strength: float = 2.0, prior: float = 0.5, least_purity: float = 0.5, rules=RULES) -> str:
    """The same over all of ``pages`` in DuckDB's SQL, for paths of ``depth`` segments at most."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda t: (lambda at, tail: f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{tail}'))")(*t.split("/", 1))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in order) + " END"
    share = lambda labelled, bad, before: f"(({labelled} - {bad} + {strength}::DOUBLE * {before}) / ({labelled} + {strength}::DOUBLE))"
    levels, last = [], "t0"
    for k in range(1, depth + 2):
        levels.append(f"""
        s{k} AS (SELECT *, coalesce(parts[{k}], '\0') AS seg FROM {last}),
        c{k} AS (SELECT host, template, seg, sum(labelled) AS l, sum(bad) AS b FROM s{k} GROUP BY ALL),
        p{k} AS (SELECT host, template, count(*) AS width, sum(l) AS pl, sum(b) AS pb FROM c{k} GROUP BY ALL),
        w{k} AS (SELECT host, template, seg, width > {max_children} OR CASE WHEN l > 0 AND l < pl THEN abs(b / l - pb / pl) <= {z} * sqrt((pb / pl) * (1 - pb / pl) / l) ELSE false END AS wild
            FROM c{k} JOIN p{k} USING (host, template)),
        m{k} AS (SELECT host, shape, labelled, bad, parts, above, here, seg <> '\0' AS goes_on, template || CASE WHEN seg = '\0' THEN '' WHEN wild THEN '/*' ELSE '/' || seg END AS template FROM s{k} JOIN w{k} USING (host, template, seg)),
        b{k} AS (SELECT host, template, goes_on, {share("sum(labelled)", "sum(bad)", "max(here)")} AS share FROM m{k} GROUP BY ALL),
        t{k} AS (SELECT host, shape, labelled, bad, parts, template, CASE WHEN goes_on THEN here ELSE above END AS above, CASE WHEN goes_on THEN share ELSE here END AS here FROM m{k} JOIN b{k} USING (host, template, goes_on))""")
        last = f"t{k}"
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
    seen AS (SELECT *, {case(1)} AS rule, {case(0)} AS ruled, regexp_replace(regexp_replace(path, '[0-9a-f]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') AS shape FROM h),
    shapes AS (SELECT host, shape, count(ruled)::DOUBLE AS labelled, count(*) FILTER (ruled = 'block')::DOUBLE AS bad,
        CASE WHEN starts_with(shape, '/') THEN string_split(substr(shape, 2), '/') ELSE []::VARCHAR[] END AS parts FROM seen GROUP BY host, shape),
    g AS (SELECT {share("sum(labelled)", "sum(bad)", f"{prior}::DOUBLE")} AS g FROM shapes),
    t0 AS (SELECT host, shape, labelled, bad, parts, '' AS template, here AS above, here FROM shapes JOIN (SELECT host, {share("sum(labelled)", "sum(bad)", "max(g)")} AS here FROM shapes, g GROUP BY host) USING (host)),{",".join(levels)},
    likes AS (SELECT shape, {share("sum(labelled)", "sum(bad)", "max(g)")} AS elsewhere FROM shapes, g GROUP BY shape),
    leaves AS (SELECT host, template, round({share("sum(labelled)", "sum(bad)", "((max(above) + avg(elsewhere)) / 2)")}, 6) AS purity FROM {last} JOIN likes USING (shape) GROUP BY host, template)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {least_purity} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
    FROM seen JOIN {last} USING (host, shape) JOIN leaves USING (host, template)"""
