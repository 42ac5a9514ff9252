"""Rules: parsing, groundings, labels, quality, contamination, rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.catalogue import register
from weftgraph.functions import terms
from weftgraph.operators import datasets, rules
from weftgraph.plans import bgp
from weftgraph.sources import star
from weftgraph.sources.star import SQL as T
from weftgraph.sources.star import table

RULES = [
    "?q belongsTo ?b ?a isAnswerTo ?q => ?a partOf ?b",
    "?r hasAnswer ?a ?a isAnswerTo ?q ?q belongsTo ?b => ?r answeredInQuestionnaire ?b",
    "?x subclass_of ?y ?y subclass_of ?z => ?x within ?z",
]
MINED = ["Mining...", "Rule\tHead Coverage\tStd Confidence", *(f"{r}   0.5 0.{i + 3} 0.9 1{i} 20 15 ?a" for i, r in enumerate(RULES)), "done"]
RESPONSE_RULE = rules.parse_rule(RULES[1])
M = T + ", m AS (SELECT h.s AS r, h.o AS a, i.o AS q, b.o AS b FROM t h JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo' JOIN t b ON b.s = i.o AND b.p = 'belongsTo' WHERE h.p = 'hasAnswer') "


@register("amie_parse", "SELECT * FROM (VALUES ('?q belongsTo ?b ?a isAnswerTo ?q => ?a partOf ?b', 2, '?a partOf ?b', 0.5, 0.3, '10'), ('?r hasAnswer ?a ?a isAnswerTo ?q ?q belongsTo ?b => ?r answeredInQuestionnaire ?b', 3, '?r answeredInQuestionnaire ?b', 0.5, 0.4, '11'), ('?x subclass_of ?y ?y subclass_of ?z => ?x within ?z', 2, '?x within ?z', 0.5, 0.5, '12')) v(rule, n_body, head, head_coverage, std_confidence, positive_examples)")
def amie_parse(spark, sf):
    parsed = rules.parse_mined(spark.createDataFrame([(x,) for x in MINED], "value string"))
    return parsed.select("rule", F.size("body").alias("n_body"), F.get("head", F.lit(0)).alias("head"), "head_coverage", "std_confidence", "positive_examples")


@register("rule_index", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rule_index, p_partkey FROM part")
def rule_index(spark, sf):
    ranked = datasets.global_rank(table(spark, sf, "part").select("p_partkey"), [F.col("p_partkey")], "k")
    return ranked.select((F.col("k") - 1).alias("rule_index"), "p_partkey")


@register("rule_groundings", M + "SELECT DISTINCT r, a, q, m.b FROM m JOIN t h ON h.s = r AND h.p = 'answeredInQuestionnaire' AND h.o = m.b")
def rule_groundings(spark, sf):
    return rules.groundings(star.star_graph(spark, sf), *RESPONSE_RULE).select("r", "a", "q", "b")


LABEL_RULE = ([("?x", "usesPlatform", "?p"), ("?x", "segment", "?g")], ("?x", "segment", "BUILDING"))


@register("rule_labeled", T + "SELECT u.s AS x, u.o AS p, g.o AS g, CASE WHEN EXISTS (SELECT 1 FROM t k WHERE k.s = u.s AND k.p = 'segment' AND k.o = 'BUILDING') THEN 'yes' ELSE 'no' END AS label FROM t u JOIN t g ON g.s = u.s AND g.p = 'segment' WHERE u.p = 'usesPlatform'")
def rule_labeled(spark, sf):
    return rules.labelled(star.star_graph(spark, sf), *LABEL_RULE).select("x", "p", "g", "label")


@register("grounding_summary", M + "SELECT q, count(DISTINCT r) AS groundings, count(DISTINCT a) AS answers FROM m GROUP BY q")
def grounding_summary(spark, sf):
    g = rules.groundings(star.star_graph(spark, sf), *RESPONSE_RULE)
    return g.groupBy("q").agg(F.countDistinct("r").alias("groundings"), F.countDistinct("a").alias("answers"))


GROUND = "SELECT o_orderkey AS id, 'c' || o_custkey AS head, ['c' || (o_orderkey % 1000), 'p' || o_orderstatus] AS body FROM orders"


@register("head_body_anti", f"WITH g AS ({GROUND}), b AS (SELECT id AS other, unnest(body) AS head FROM g) SELECT id, head FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.head = g.head AND other <> id)")
def head_body_anti(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("head"), F.array(F.concat(F.lit("c"), F.col("o_orderkey") % 1000), F.concat(F.lit("p"), "o_orderstatus")).alias("body"))
    return rules.uncontaminated(rows).select("id", "head")


@register("confident_semi", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30)")
def confident_semi(spark, sf):
    confident = table(spark, sf, "part").filter("p_size > 30").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(confident, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("answer_completion", T + "SELECT o AS head, string_agg(DISTINCT s, '|' ORDER BY s) AS answers FROM t WHERE p = 'belongsTo' GROUP BY o")
def answer_completion(spark, sf):
    g = star.star_graph(spark, sf)
    asked = bgp.match(g, [("?x", "type", "Questionnaire")]).select(F.col("x").alias("head"), F.lit("holds").alias("relation"))
    inverse = g.filter("p = 'belongsTo'").select(F.col("o").alias("s"), F.lit("holds").alias("p"), F.col("s").alias("o"))
    return rules.complete_answers(asked, inverse).select("head", F.array_join("answers", "|").alias("answers"))


@register("triple_removal", M + "SELECT p, count(*) AS n FROM t WHERE (s, p, o) NOT IN (SELECT r, 'answeredInQuestionnaire', b FROM m) GROUP BY p")
def triple_removal(spark, sf):
    g = star.star_graph(spark, sf)
    heads = rules.groundings(g, *RESPONSE_RULE).select(F.col("r").alias("s"), F.lit("answeredInQuestionnaire").alias("p"), F.col("b").alias("o"))
    return rules.remove_heads(g, heads).groupBy("p").agg(F.count("*").alias("n"))


@register("rule_quality", M + ", b AS (SELECT DISTINCT r, b FROM m), f AS (SELECT DISTINCT s AS r, o AS b FROM t WHERE p = 'answeredInQuestionnaire') SELECT (SELECT count(*) FROM b JOIN f USING (r, b)) AS support, (SELECT count(*) FROM b) AS body_size, (SELECT count(*) FROM b WHERE r IN (SELECT r FROM f)) AS pca_body_size, round((SELECT count(*) FROM b JOIN f USING (r, b)) / (SELECT count(*) FROM f), 6) AS head_coverage, round((SELECT count(*) FROM b JOIN f USING (r, b)) / (SELECT count(*) FROM b), 6) AS std_confidence, round((SELECT count(*) FROM b JOIN f USING (r, b)) / (SELECT count(*) FROM b WHERE r IN (SELECT r FROM f)), 6) AS pca_confidence")
def rule_quality(spark, sf):
    return rules.quality(star.star_graph(spark, sf), *RESPONSE_RULE)


RULE_TABLE = "SELECT p_partkey AS id, p_name AS head, p_size AS weight FROM part"


@register("rule_context", f"WITH r AS ({RULE_TABLE}), x AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.weight DESC, b.id) AS k FROM r a JOIN r b ON a.head = b.head AND a.id <> b.id) SELECT id, string_agg(other, ',' ORDER BY k) AS others FROM x WHERE k <= 3 GROUP BY id")
def rule_context(spark, sf):
    # the four best rules of a head serve all its rules: each leaves itself out, so no pairs of rules are made
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("head"), F.col("p_size").alias("weight"))
    best = r.withColumn("k", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("weight"), "id"))).filter("k <= 4")
    best = best.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("best"))
    others = F.slice(F.filter("best", lambda x: x != F.col("id")), 1, 3)
    return r.join(best, "head").select("id", F.array_join(others.cast("array<string>"), ",").alias("others")).filter("others <> ''")


@register("rule_render", "SELECT p_brand, '# ' || p_brand || chr(10) || string_agg('- ' || p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey) || chr(10) || 'n=' || count(*) AS text FROM part GROUP BY p_brand")
def rule_render(spark, sf):
    line = F.struct("p_partkey", F.concat(F.lit("- "), "p_partkey", F.lit(" "), "p_name").alias("line"))
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    return g.select("p_brand", F.concat_ws("\n", F.concat(F.lit("# "), "p_brand"), F.array_join("lines", "\n"), F.concat(F.lit("n="), F.size("lines"))).alias("text"))


INSTANCE = "'[' || o_orderstatus || '] order ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' POSITIVE' ELSE ' NEGATIVE' END || ' PCA=0.' || (o_custkey % 9) || ' Answer: ' || CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'no' END"


def _instances(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", F.concat(F.lit("["), "o_orderstatus", F.lit("] order "), "o_orderkey", F.when(F.col("o_orderstatus") == "F", " POSITIVE").otherwise(" NEGATIVE"), F.lit(" PCA=0."), F.col("o_custkey") % 9, F.lit(" Answer: "), F.when(F.col("o_totalprice") > 100000, "yes").otherwise("no")).alias("line"))


@register("instance_parse", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'no' END AS answer, CASE WHEN o_orderstatus = 'F' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sign, (o_custkey % 9) / 10.0 AS pca FROM orders")
def instance_parse(spark, sf):
    x = lambda p: F.regexp_extract("line", p, 1)
    return _instances(spark, sf).select("o_orderkey", x(r"Answer: (yes|no)$").alias("answer"), x(r"\b(POSITIVE|NEGATIVE)\b").alias("sign"), x(r"PCA=([\d.]+)").cast("double").alias("pca"))


@register("instance_clean", "SELECT o_orderkey, '[' || o_orderstatus || '] order ' || o_orderkey AS text FROM orders")
def instance_clean(spark, sf):
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"\s*Answer: (yes|no)$", ""), r"\s*PCA=[\d.]+", ""), r"\s*\b(POSITIVE|NEGATIVE)\b", "")
    return _instances(spark, sf).select("o_orderkey", plain.alias("text"))


@register("cot_sample", "SELECT o_orderkey, 'Question: is order ' || o_orderkey || ' large?' || chr(10) || 'Rule: price > 100000' || chr(10) || 'Answer: ' || CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'no' END AS prompt, (o_totalprice > 100000)::INTEGER AS label FROM orders")
def cot_sample(spark, sf):
    large = F.col("o_totalprice") > 100000
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("Question: is order "), "o_orderkey", F.lit(" large?")), F.lit("Rule: price > 100000"), F.concat(F.lit("Answer: "), F.when(large, "yes").otherwise("no"))).alias("prompt"), large.cast("int").alias("label"))


@register("sample_per_rule", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('5:' || p_partkey), p_partkey) AS k FROM part) WHERE k <= 3")
def sample_per_rule(spark, sf):
    order = Window.partitionBy("p_brand").orderBy(terms.stable_rank_key(5, "p_partkey"), "p_partkey")
    return table(spark, sf, "part").withColumn("k", F.row_number().over(order)).filter("k <= 3").select("p_brand", "p_partkey")


@register("grounding_parse", "SELECT p_partkey, 2 AS n, 'x' || p_partkey || ' p y' AS first_body, 'x' || p_partkey || ' h z' AS first_head FROM part")
def grounding_parse(spark, sf):
    text = F.format_string("x%d p y | y q z => x%d h z, broken, a b c => d e f", "p_partkey", "p_partkey")
    parsed = table(spark, sf, "part").select("p_partkey", rules.parse_groundings(text).alias("g"))
    first = F.get("g", F.lit(0))
    one = lambda side: F.array_join(F.get(first[side], F.lit(0)), " ")
    return parsed.select("p_partkey", F.size("g").alias("n"), one("body").alias("first_body"), one("head").alias("first_head"))


@register("rule_file_parse", "SELECT p_brand AS rule, count(*) AS instances, count(*) FILTER (p_size > 25) AS yes FROM part GROUP BY p_brand")
def rule_file_parse(spark, sf):
    part = table(spark, sf, "part")
    line = F.struct("p_partkey", F.concat(F.lit("instance "), "p_name", F.lit("\ncontinued Answer: "), F.when(F.col("p_size") > 25, "yes").otherwise("no")).alias("t"))
    files = part.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("body"))
    text = files.select("p_brand", F.concat_ws("\n", F.concat(F.lit("Rule: "), "p_brand"), "body").alias("text"))
    instances = F.regexp_extract_all("text", F.lit(r"(?s)(instance .*?Answer: (?:yes|no))"))
    return text.select(F.regexp_extract("text", r"^Rule: (.*)", 1).alias("rule"), F.size(instances).cast("long").alias("instances"), F.size(F.filter(instances, lambda x: x.endswith("yes"))).cast("long").alias("yes"))
