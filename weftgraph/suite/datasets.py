"""Splits, balancing, audits, metrics, validation, survey normalisation, sync and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.catalogue import register
from weftgraph.functions import scoring, terms
from weftgraph.operators import datasets as ds
from weftgraph.sources.star import table
from weftgraph.streaming import counts


def key(seed, c):
    return f"md5('{seed}:' || {c})"


@register("split_811", f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {key(3, 'o_orderkey')}, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= floor(0.8 * n) THEN 'train' WHEN k <= floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'test' END AS part FROM r")
def split_811(spark, sf):
    return ds.split_811(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=3)


@register("stratified_split", f"WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {key(4, 'o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= least(greatest(round_even(0.2 * n, 0), CASE WHEN n >= 2 THEN 1 ELSE 0 END), n - 1) THEN 'test' ELSE 'train' END AS part FROM r")
def stratified_split(spark, sf):
    return ds.stratified_split(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", 0.2, seed=4).select("o_orderkey", "part")


@register("group_split", f"WITH g AS (SELECT p_name, row_number() OVER (ORDER BY {key(5, 'p_name')}, p_name) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)) SELECT p_partkey, CASE WHEN k <= greatest(1, floor(0.25 * n)) THEN 'test' ELSE 'train' END AS part FROM part JOIN g USING (p_name)")
def group_split(spark, sf):
    return ds.group_split(table(spark, sf, "part"), "p_name", 0.25, seed=5).select("p_partkey", "part")


@register("shared_test", f"WITH t AS (SELECT p_name FROM (SELECT p_name, row_number() OVER (ORDER BY {key(5, 'p_name')}, p_name) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)) WHERE k <= greatest(1, floor(0.25 * n))) SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM t)")
def shared_test(spark, sf):
    p = table(spark, sf, "part")
    test = ds.group_split(p, "p_name", 0.25, seed=5).filter("part = 'test'").select("p_name").distinct()
    return p.join(test, "p_name", "left_anti").select("p_partkey")


@register("leakage_check", "SELECT 'documents' AS a, 'benchmark' AS b, (SELECT count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)) AS overlap")
def leakage_check(spark, sf):
    return ds.overlaps({"documents": table(spark, sf, "documents").select("text"), "benchmark": table(spark, sf, "benchmark").select("text")})


@register("split_overlap", "SELECT md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def split_overlap(spark, sf):
    k = F.md5(F.encode(F.lower(terms.squeeze("text")), "utf-8"))
    return table(spark, sf, "conversations").groupBy(k.alias("k")).agg(F.count("*").alias("n")).filter("n > 1")


@register("imbalance", "SELECT max(n) AS most, min(n) AS least, round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 1.5 AS imbalanced FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)")
def imbalance(spark, sf):
    return ds.imbalance(table(spark, sf, "labels"), "toxic")


@register("oversample", f"WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), m AS (SELECT max(n) AS m FROM c), r AS (SELECT l.doc_id, l.toxic, c.n, m.m, row_number() OVER (PARTITION BY l.toxic ORDER BY {key(6, 'l.doc_id')}, l.doc_id) AS k FROM labels l JOIN c USING (toxic), m) SELECT toxic, doc_id, (m // n + CASE WHEN k <= m % n THEN 1 ELSE 0 END)::BIGINT AS copies FROM r")
def oversample(spark, sf):
    return ds.oversample(table(spark, sf, "labels"), "toxic", "doc_id", seed=6).groupBy("toxic", "doc_id").agg(F.count("*").alias("copies"))


@register("balanced_subset", f"WITH r AS (SELECT toxic, doc_id, {key(7, 'doc_id')} AS h, row_number() OVER (PARTITION BY toxic ORDER BY {key(7, 'doc_id')}, doc_id) AS k FROM labels) SELECT toxic, doc_id FROM r ORDER BY k > 60 // (SELECT count(DISTINCT toxic) FROM labels), h, doc_id LIMIT 60")
def balanced_subset(spark, sf):
    return ds.balanced(table(spark, sf, "labels").filter("toxic is not null").select("toxic", "doc_id"), "toxic", "doc_id", 60, seed=7)


@register("sample_weights", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 2.0 ELSE 1.0 END AS weight FROM orders")
def sample_weights(spark, sf):
    boosted = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000)
    return table(spark, sf, "orders").select("o_orderkey", F.when(boosted, 2.0).otherwise(1.0).alias("weight"))


@register("answer_cap", f"WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {key(8, 'o_orderkey')}, o_orderkey) AS k, (SELECT count(*) FROM orders) AS n FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE k <= greatest(1, floor(0.05 * n))")
def answer_cap(spark, sf):
    return ds.answer_cap(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 0.05, seed=8).select("o_orderpriority", "o_orderkey")


SKEW = "SELECT p_type AS relation, count(*) AS n, round(100.0 * avg((l_returnflag = 'A')::INT), 4) AS yes_pct, round(100.0 * avg((l_returnflag <> 'A')::INT), 4) AS no_pct, greatest(avg((l_returnflag = 'A')::INT), avg((l_returnflag <> 'A')::INT)) >= 0.67 AS skewed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"


def _answers(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("yes", (F.col("l_returnflag") == "A").cast("int"))


@register("relation_skew", SKEW)
def relation_skew(spark, sf):
    return ds.relation_skew(_answers(spark, sf), "p_type", "yes", 0.67).withColumnRenamed("p_type", "relation")


@register("skew_filter", f"SELECT p_partkey, p_type FROM part WHERE p_type NOT IN (SELECT relation FROM ({SKEW}) WHERE skewed)")
def skew_filter(spark, sf):
    skewed = ds.relation_skew(_answers(spark, sf), "p_type", "yes", 0.67).filter("skewed").select("p_type")
    return table(spark, sf, "part").join(skewed, "p_type", "left_anti").select("p_partkey", "p_type")


@register("dataset_audit", "SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS yes, count(*) FILTER (toxic = 0) AS no, count(*) FILTER (toxic IS NULL OR toxic NOT IN (0, 1)) AS bad FROM labels")
def dataset_audit(spark, sf):
    return ds.audit(table(spark, sf, "labels"), "toxic")


@register("dedup_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("sort_ids", "SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY p_partkey) AS k FROM part")
def sort_ids(spark, sf):
    return ds.sorted_ids(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id")))


@register("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@register("select_instances", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 50")
def select_instances(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_size"), "p_partkey").limit(50).select("p_partkey")


@register("qa_validity", "SELECT p_partkey FROM part WHERE contains('is ' || p_name || ' a ' || p_type, p_name) AND NOT contains('is ' || p_name || ' a ' || p_type, p_brand) AND p_name <> ''")
def qa_validity(spark, sf):
    question = F.concat(F.lit("is "), "p_name", F.lit(" a "), "p_type")
    return table(spark, sf, "part").filter(question.contains(F.col("p_name")) & ~question.contains(F.col("p_brand")) & ~terms.is_blank("p_name")).select("p_partkey")


GOLD = "SELECT l_orderkey AS id, list_sort(list_distinct(list(lower(replace(p_brand, '#', ''))))) AS gold, list_sort(list_distinct(list(lower(replace(p_brand, '#', ''))) FILTER (p_size > 15))) AS predicted, min(lower(replace(p_brand, '#', ''))) AS hard FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"


def _gold(spark, sf):
    return _answers(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("p_brand").alias("gold"), F.collect_set(F.when(F.col("p_size") > 15, F.col("p_brand"))).alias("predicted"), F.min("p_brand").alias("hard_answer"))


@register("gold_build", "SELECT l_orderkey AS id, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS answers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def gold_build(spark, sf):
    return _gold(spark, sf).select("id", F.array_join(F.array_sort("gold"), "|").alias("answers"))


@register("qa_metrics", f"WITH g AS ({GOLD}), x AS (SELECT *, len(list_intersect(gold, coalesce(predicted, []))) AS k, len(coalesce(predicted, [])) AS np, len(gold) AS ng FROM g) SELECT count(*) AS n, round(avg((k > 0)::INT), 6) AS hits_any, round(avg(CASE WHEN np > 0 THEN k / np ELSE 0 END), 6) AS precision, round(avg(k / ng), 6) AS recall, round(avg(2.0 * k / (np + ng))::DOUBLE, 6) AS f1, round(avg(list_contains(coalesce(predicted, []), hard)::INT), 6) AS hits_hard FROM x")
def qa_metrics(spark, sf):
    s = scoring.qa_scores(_gold(spark, sf))
    r = lambda c: F.round(F.avg(c), 6)
    return s.agg(F.count("*").alias("n"), r("hit").alias("hits_any"), r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), r("hard").alias("hits_hard"))


CLS = "SELECT (o_totalprice > 100000)::INT AS label, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_orderstatus = 'F')::INT END AS predicted FROM orders"


def _cls(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_totalprice") > 100000).cast("int").alias("label"), F.when(F.col("o_custkey") % 11 != 0, (F.col("o_orderstatus") == "F").cast("int")).alias("predicted"))


def _cls_sql(where):
    return f"""WITH x AS ({CLS}), c AS (SELECT count(*) AS n, count(predicted) AS k, count(*) FILTER (predicted = 1 AND label = 1) AS tp, count(*) FILTER (predicted = 1 AND label = 0) AS fp, count(*) FILTER (label = 1 AND predicted IS DISTINCT FROM 1) AS fn, count(*) FILTER (predicted = 0 AND label = 0) AS tn, count(*) FILTER (label = 0 AND predicted IS DISTINCT FROM 0) AS fpn, count(*) FILTER (predicted = 0 AND label = 1) AS fnn FROM x {where})
SELECT n, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((2.0 * tp / (2 * tp + fp + fn))::DOUBLE, 6) AS f1, round(((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fnn + fpn)) / 2)::DOUBLE, 6) AS macro_f1, round(k / n, 6) AS coverage FROM c"""


@register("cls_metrics", _cls_sql("WHERE predicted IS NOT NULL"))
def cls_metrics(spark, sf):
    return scoring.binary_metrics(_cls(spark, sf))


@register("cls_metrics_strict", _cls_sql(""))
def cls_metrics_strict(spark, sf):
    return scoring.binary_metrics(_cls(spark, sf), unknown_is_wrong=True)


@register("run_compare", "SELECT o_orderpriority, round(100.0 * avg((o_orderstatus = 'F')::INT), 4) AS a, round(100.0 * avg((o_orderstatus = 'O')::INT), 4) AS b, round(round(100.0 * avg((o_orderstatus = 'O')::INT), 4) - round(100.0 * avg((o_orderstatus = 'F')::INT), 4), 4) AS delta FROM orders GROUP BY o_orderpriority")
def run_compare(spark, sf):
    pct = lambda s: F.round(100.0 * F.avg((F.col("o_orderstatus") == s).cast("int")), 4)
    out = table(spark, sf, "orders").groupBy("o_orderpriority").agg(pct("F").alias("a"), pct("O").alias("b"))
    return out.withColumn("delta", F.round(F.col("b") - F.col("a"), 4))


@register("length_stats", "SELECT count(*) AS n, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.95) AS p95, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS longest, round(avg((n_chars > 512)::INT), 6) AS over FROM documents")
def length_stats(spark, sf):
    return ds.length_stats(table(spark, sf, "documents"), "n_chars", 512)


@register("autoconfig", "SELECT (least(greatest(ceil(quantile_cont(n_chars, 0.95) / 64) * 64, 128), 4096))::BIGINT AS max_length FROM documents")
def autoconfig(spark, sf):
    return ds.recommended_length(ds.length_stats(table(spark, sf, "documents"), "n_chars", 512), 64, 128, 4096)


@register("paired_stats", "WITH d AS (SELECT (l_tax - l_discount) AS d FROM lineitem) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) FILTER (d > 0) AS plus, count(*) FILTER (d < 0) AS minus FROM d")
def paired_stats(spark, sf):
    return ds.paired(table(spark, sf, "lineitem"), "l_discount", "l_tax")


@register("wilson_interval", "WITH c AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 40) AS k, 1.959963984540054 AS z FROM part GROUP BY p_brand) SELECT p_brand, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM c")
def wilson_interval(spark, sf):
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count(F.when(F.col("p_size") > 40, 1)).alias("k"))
    low, high = ds.wilson(F.col("k"), F.col("n"))
    return c.select("p_brand", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("sign_test", "WITH c AS (SELECT p_brand, least(count(*) FILTER (p_size > 25), count(*) FILTER (p_size < 25)) AS k, count(*) FILTER (p_size <> 25) AS n FROM part GROUP BY p_brand) SELECT p_brand, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 6) AS p FROM c")
def sign_test(spark, sf):
    """Whether sizes lie above or below 25 alike, for each brand."""
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.when(F.col("p_size") > 25, 1)).alias("plus"), F.count(F.when(F.col("p_size") < 25, 1)).alias("minus"))
    return c.select("p_brand", F.round(ds.sign_test(F.col("plus"), F.col("minus")), 6).alias("p"))


@register("validate_report", "SELECT 'dangling' AS check_name, (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS n UNION ALL SELECT 'duplicate key', (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'empty value', (SELECT count(*) FROM part WHERE p_name IS NULL OR trim(p_name) = '') UNION ALL SELECT 'bad format', (SELECT count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$'))")
def validate_report(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    return ds.report({
        "dangling": li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti"),
        "duplicate key": p.groupBy("p_partkey").count().filter("count > 1"),
        "empty value": p.filter(terms.is_blank("p_name")),
        "bad format": p.filter(~F.col("p_brand").rlike("^Brand#[0-9]$")),
    })


@register("review_report", "SELECT p_brand, count(*) AS n, array_to_string(list_slice(list(p_name ORDER BY p_partkey), 1, 5), '|') AS examples FROM part GROUP BY p_brand")
def review_report(spark, sf):
    rank = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf, "part").withColumn("k", F.row_number().over(rank))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "p_name")))), lambda x: x["p_name"]), "|")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), first.alias("examples"))


@register("assertions", "SELECT 'part_' || p_partkey || '_brand_' || replace(p_brand, '#', '') AS id, p_partkey, p_brand FROM part")
def assertions(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("part_"), "p_partkey", F.lit("_brand_"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("id"), "p_partkey", "p_brand")


@register("kg_tables", "SELECT o_orderkey AS unit, count(l_partkey) AS mentions, count(DISTINCT l_partkey) AS entities FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def kg_tables(spark, sf):
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("m"))
    units = table(spark, sf, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return units.select(F.col("o_orderkey").alias("unit"), F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("mentions"), F.coalesce(F.size(F.array_distinct("m")), F.lit(0)).cast("long").alias("entities")).withColumn("mentions", F.greatest("mentions", F.lit(0))).withColumn("entities", F.greatest("entities", F.lit(0)))


@register("mention_ids", "SELECT l_suppkey, l_shipdate, l_orderkey || '_' || l_linenumber || CASE WHEN k > 1 THEN '_dup' || (k - 1) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS k FROM lineitem)")
def mention_ids(spark, sf):
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate"))
    base = F.concat_ws("_", "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("k", k).select("l_suppkey", "l_shipdate", F.when(F.col("k") > 1, F.concat(base, F.lit("_dup"), F.col("k") - 1)).otherwise(base).alias("id"))


@register("link_status", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'accepted' WHEN p_size >= 20 THEN 'close_match' ELSE 'candidate_only' END AS status FROM part")
def link_status(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") >= 40, "accepted").when(F.col("p_size") >= 20, "close_match").otherwise("candidate_only").alias("status"))


LEXICAL = [("search", "bolt|gear", "Fastener"), ("exact", "red widget", "Sample"), ("search", "ring", "Jewel")]


@register("entity_classify", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'Fastener' WHEN p_name = 'red widget' THEN 'Sample' WHEN regexp_matches(p_name, 'ring') THEN 'Jewel' WHEN p_type = 'PROMO' THEN 'Offer' ELSE 'unmapped' END AS class FROM part")
def entity_classify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ds.classify("p_name", "p_type", LEXICAL, {"PROMO": "Offer"}).alias("class"))


@register("shacl_tag", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) THEN 'INVALID' ELSE 'VALID' END AS tag FROM orders")
def shacl_tag(spark, sf):
    bad = table(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("bad", F.lit(True))
    return table(spark, sf, "orders").join(bad, "o_orderkey", "left").select("o_orderkey", F.when(F.col("bad"), "INVALID").otherwise("VALID").alias("tag"))


@register("domain_range", "SELECT n_name AS node, r_name AS expected, CASE WHEN n_regionkey = r_regionkey THEN 'ok' ELSE 'warning' END AS verdict FROM nation CROSS JOIN region WHERE r_regionkey = n_nationkey % 5")
def domain_range(spark, sf):
    n = table(spark, sf, "nation").withColumn("want", F.col("n_nationkey") % 5)
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("want"), F.col("r_name").alias("expected"))
    return n.join(r, "want").select(F.col("n_name").alias("node"), "expected", F.when(F.col("n_regionkey") == F.col("want"), "ok").otherwise("warning").alias("verdict"))


# --- survey ------------------------------------------------------------------------------------------


@register("survey_norm", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS case_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE left(c_mktsegment, 1) END AS code FROM customer")
def survey_norm(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("case_id"), F.when(F.col("c_mktsegment") == "BUILDING", "B").otherwise(F.substring("c_mktsegment", 1, 1)).alias("code"))


@register("likert_bucket", "WITH s AS (SELECT p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part), n AS (SELECT *, max(k) OVER (PARTITION BY p_brand) AS n FROM s) SELECT DISTINCT p_brand, p_size, CASE WHEN n >= 5 THEN ceil(5.0 * k / n)::BIGINT::VARCHAR ELSE 'NEEDS_REVIEW' END AS bucket FROM n")
def likert_bucket(spark, sf):
    k = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size"))
    ranked = table(spark, sf, "part").select("p_brand", "p_size").withColumn("k", k).withColumn("n", F.max("k").over(Window.partitionBy("p_brand")))
    return ranked.select("p_brand", "p_size", F.when(F.col("n") >= 5, F.ceil(5.0 * F.col("k") / F.col("n")).cast("string")).otherwise("NEEDS_REVIEW").alias("bucket")).distinct()


@register("sus_complete", "SELECT p_brand, s AS option FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([1,2,3,4,5]) AS s) WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_size = s)".replace("q.p_brand = part.p_brand", "q.p_brand = b.p_brand").replace("(SELECT DISTINCT p_brand FROM part),", "(SELECT DISTINCT p_brand FROM part) b,").replace("SELECT p_brand, s", "SELECT b.p_brand, s"))
def sus_complete(spark, sf):
    p = table(spark, sf, "part")
    full = p.select("p_brand").distinct().withColumn("option", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return full.join(p.select("p_brand", F.col("p_size").alias("option")), ["p_brand", "option"], "left_anti")


@register("sus_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END NULLS LAST, p_size, p_partkey) AS k FROM part")
def sus_order(spark, sf):
    order = F.when(F.col("p_type") == "SMALL", 1).when(F.col("p_type") == "MEDIUM", 2).when(F.col("p_type") == "LARGE", 3)
    ranked = ds.global_rank(table(spark, sf, "part").select("p_partkey", "p_size", order.alias("o")), [F.col("o").asc_nulls_last(), F.col("p_size"), F.col("p_partkey")], "k")
    return ranked.select("p_partkey", "k")


@register("answer_resolution", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a.p_name, b.p_brand, 'null answer') AS answer FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) a ON a.p_partkey = l_partkey LEFT JOIN (SELECT * FROM part WHERE p_type = 'PROMO') b ON b.p_partkey = l_partkey")
def answer_resolution(spark, sf):
    p = table(spark, sf, "part")
    code = p.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("by_code"))
    text = p.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("by_text"))
    return table(spark, sf, "lineitem").join(code, "l_partkey", "left").join(text, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("by_code", "by_text", F.lit("null answer")).alias("answer"))


@register("response_grid", "SELECT n_nationkey, s_suppkey, s_acctbal IS NOT NULL AS answered FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def response_grid(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "s_suppkey", F.col("s_acctbal").isNotNull().alias("answered"))


@register("null_collapse", "SELECT p_brand, CASE WHEN count(*) FILTER (p_size = 1) = 1 AND count(*) FILTER (p_size = 2) = 1 THEN 'collapsed' ELSE 'kept' END AS state FROM part GROUP BY p_brand")
def null_collapse(spark, sf):
    one = lambda v: F.count(F.when(F.col("p_size") == v, 1)) == 1
    return table(spark, sf, "part").groupBy("p_brand").agg(F.when(one(1) & one(2), "collapsed").otherwise("kept").alias("state"))


@register("sync_diff", "SELECT coalesce(a.c_custkey, b.s_suppkey) AS k, CASE WHEN b.s_suppkey IS NULL THEN 'new' WHEN a.c_custkey IS NULL THEN 'removed' WHEN a.c_nationkey <> b.s_nationkey THEN 'changed' ELSE 'same' END AS status FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey")
def sync_diff(spark, sf):
    fresh = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    prior = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return ds.sync(fresh, prior).select("k", "status")


@register("select_best", "SELECT o_orderpriority, arg_min(o_orderkey, -o_totalprice * 1000000000 + o_orderkey) AS best FROM orders GROUP BY o_orderpriority")
def select_best(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("best"))


@register("gen_summary", "SELECT o_orderpriority AS method, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'all', count(*), max(o_totalprice) FROM orders")
def gen_summary(spark, sf):
    o = table(spark, sf, "orders")
    agg = (F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    return o.groupBy(F.col("o_orderpriority").alias("method")).agg(*agg).unionByName(o.agg(*agg).withColumn("method", F.lit("all")))


def _halving_sql(rounds: int) -> str:
    """The rounds one after another, each over the better half of the one before."""
    parts = ["x AS (SELECT p_brand, p_size, ('0x' || substr(md5('1:' || p_partkey), 1, 4))::INT / 65536 AS slot FROM part)"]
    for r in range(rounds):
        left = f" AND p_brand IN (SELECT p_brand FROM l{r - 1})" if r else ""
        parts.append(f"m{r} AS (SELECT p_brand, round(avg(p_size), 6) AS mean FROM x WHERE slot < {1 / 2 ** (rounds - 1 - r)}{left} GROUP BY p_brand)")
        parts.append(f"l{r} AS (SELECT p_brand FROM m{r} QUALIFY row_number() OVER (ORDER BY mean DESC, p_brand) <= greatest(1, (count(*) OVER () + 1) // 2))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT p_brand AS candidate, {r} AS round, mean FROM m{r}" for r in range(rounds))


@register("halving", _halving_sql(4))
def halving(spark, sf):
    """Successive halving of part brands by mean size over growing shares of the parts."""
    return ds.halving(table(spark, sf, "part"), "p_brand", "p_size", "p_partkey", rounds=4)


# --- streams (extension) -------------------------------------------------------------------------------


@register("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return counts.tumbling(table(spark, sf, "events"))


@register("stream_session", "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, g")
def stream_session(spark, sf):
    return counts.sessions(table(spark, sf, "events"))


@register("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf):
    return table(spark, sf, "events").dropDuplicates(["event_id"]).select("event_id")


@register("stream_sliding", "WITH x AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS b FROM events) SELECT b - INTERVAL (6 * k) HOUR AS begin, event_type, count(*) AS n FROM x, range(4) r(k) GROUP BY ALL")
def stream_sliding(spark, sf):
    return counts.sliding(table(spark, sf, "events"))


@register("stream_late", "WITH x AS (SELECT *, event_id + CASE WHEN event_id % 7 = 0 THEN 500 ELSE 0 END AS arrived FROM events) SELECT event_id, event_type, (epoch_us(seen) - epoch_us(ts)) / 1e6 AS behind FROM (SELECT *, max(ts) OVER (ORDER BY arrived RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x) WHERE ts < seen - INTERVAL 1 HOUR")
def stream_late(spark, sf):
    """Every seventh event arrives 500 places late."""
    return counts.late_rows(table(spark, sf, "events"), "event_id + CASE WHEN event_id % 7 = 0 THEN 500 ELSE 0 END")
