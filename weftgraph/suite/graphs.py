"""The SPARQL catalogue over the triple view: patterns, negation, aggregates, unions, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalogue import register
from weftgraph.functions import terms
from weftgraph.operators import graphstats
from weftgraph.operators import triples as tr
from weftgraph.plans import bgp, mapping, sparql
from weftgraph.sources import star
from weftgraph.sources.star import SQL as T

RESPONSE_CHAIN = [("?resp", "hasAnswer", "?ans"), ("?ans", "isAnswerTo", "?q"), ("?ans", "hasAnswerCategory", "?cat"), ("?q", "QuestionDescription", "?desc"), ("?q", "hasQuestionCategory", "?qcat")]
CHAIN_SQL = T + """, m AS (SELECT h.s AS resp, h.o AS ans, i.o AS q, c.o AS cat, d.o AS "desc", k.o AS qcat FROM t h JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo'
JOIN t c ON c.s = h.o AND c.p = 'hasAnswerCategory' JOIN t d ON d.s = i.o AND d.p = 'QuestionDescription' JOIN t k ON k.s = i.o AND k.p = 'hasQuestionCategory' WHERE h.p = 'hasAnswer') """


def chain(spark, sf):
    return bgp.match(star.star_graph(spark, sf), RESPONSE_CHAIN)


@register("bgp_category_counts", CHAIN_SQL + """SELECT q, "desc", cat, count(DISTINCT resp) AS n FROM m WHERE qcat = 'category/PROMO' GROUP BY ALL""")
def bgp_category_counts(spark, sf):
    return chain(spark, sf).filter("qcat = 'category/PROMO'").groupBy("q", "desc", "cat").agg(F.countDistinct("resp").alias("n"))


@register("bgp_category_counts_all", CHAIN_SQL + """SELECT qcat, "desc", cat, count(DISTINCT resp) AS n FROM m GROUP BY ALL""")
def bgp_category_counts_all(spark, sf):
    return chain(spark, sf).groupBy("qcat", "desc", "cat").agg(F.countDistinct("resp").alias("n"))


@register("pivot_counts", CHAIN_SQL + """SELECT qcat, "desc", count(DISTINCT resp) FILTER (cat = 'A') AS n_a, count(DISTINCT resp) FILTER (cat = 'N') AS n_n, count(DISTINCT resp) FILTER (cat = 'R') AS n_r FROM m GROUP BY ALL""")
def pivot_counts(spark, sf):
    n = chain(spark, sf).groupBy("qcat", "desc", "cat").agg(F.countDistinct("resp").alias("n"))
    return n.groupBy("qcat", "desc").agg(*(F.coalesce(F.sum(F.when(F.col("cat") == c, F.col("n"))), F.lit(0)).alias(f"n_{c.lower()}") for c in "ANR"))


@register("category_totals", CHAIN_SQL + "SELECT cat, count(DISTINCT resp) AS n FROM m GROUP BY cat")
def category_totals(spark, sf):
    return bgp.match(star.star_graph(spark, sf), RESPONSE_CHAIN[:3]).groupBy("cat").agg(F.countDistinct("resp").alias("n"))


@register("class_inventory", T + "SELECT o AS class, count(*) AS n FROM t WHERE p = 'type' GROUP BY o")
def class_inventory(spark, sf):
    return bgp.match(star.star_graph(spark, sf), [("?x", "type", "?class")]).groupBy("class").agg(F.count("*").alias("n"))


@register("predicate_usage", T + "SELECT p, count(*) AS n FROM t GROUP BY p")
def predicate_usage(spark, sf):
    return bgp.match(star.star_graph(spark, sf), [("?s", "?p", "?o")]).groupBy("p").agg(F.count("*").alias("n"))


def _typed(g, cls, var):
    return bgp.match(g, [(f"?{var}", "type", cls)])


HIGH = "try_cast(v AS DOUBLE) > 49"
HIGH_SQL = T + f", hi AS (SELECT h.s AS resp, h.o AS ans FROM t h JOIN (SELECT s, o AS v FROM t WHERE p = 'rawResponseValue') r ON r.s = h.s WHERE h.p = 'hasAnswer' AND {HIGH}) "


def _high(g):
    """Responses with a value above 49, and their answers: a right side that does not hold every question."""
    return bgp.match(g, [("?resp", "hasAnswer", "?ans"), ("?resp", "rawResponseValue", "?v")]).filter(HIGH).select("resp", "ans")


@register("anti_orphan_question", HIGH_SQL + "SELECT s AS q FROM t WHERE p = 'type' AND o = 'Question' AND s NOT IN (SELECT i.o FROM hi JOIN t i ON i.s = hi.ans AND i.p = 'isAnswerTo')")
def anti_orphan_question(spark, sf):
    g = star.star_graph(spark, sf)
    asked = _high(g).join(bgp.scan(g, ("?ans", "isAnswerTo", "?q")), "ans").select("q")
    return _typed(g, "Question", "q").join(asked, "q", "left_anti")


@register("anti_orphan_user", HIGH_SQL + "SELECT s AS u FROM t WHERE p = 'type' AND o = 'User' AND s NOT IN (SELECT b.o FROM hi JOIN t b ON b.s = hi.resp AND b.p = 'answeredByUser')")
def anti_orphan_user(spark, sf):
    g = star.star_graph(spark, sf)
    active = _high(g).join(bgp.scan(g, ("?resp", "answeredByUser", "?u")), "resp").select("u")
    return _typed(g, "User", "u").join(active, "u", "left_anti")


@register("anti_dangling_answer", T + "SELECT h.s AS resp, h.o AS ans FROM t h WHERE h.p = 'hasAnswer' AND NOT EXISTS (SELECT 1 FROM t n WHERE n.s = h.o AND n.p = 'type' AND n.o = 'NullAnswer')")
def anti_dangling_answer(spark, sf):
    g = star.star_graph(spark, sf)
    return bgp.not_exists(bgp.match(g, [("?resp", "hasAnswer", "?ans")]), g, [("?ans", "type", "NullAnswer")])


@register("anti_dangling_question", T + "SELECT i.s AS ans, i.o AS q FROM t i WHERE i.p = 'isAnswerTo' AND NOT EXISTS (SELECT 1 FROM t n WHERE n.s = i.o AND n.p = 'hasQuestionCategory' AND n.o = 'category/PROMO')")
def anti_dangling_question(spark, sf):
    g = star.star_graph(spark, sf)
    return bgp.not_exists(bgp.match(g, [("?ans", "isAnswerTo", "?q")]), g, [("?q", "hasQuestionCategory", "category/PROMO")])


@register("anti_no_options", T + "SELECT s AS q FROM t WHERE p = 'type' AND o = 'Question' AND s NOT IN (SELECT i.o FROM t i JOIN t h ON h.o = i.s AND h.p = 'hasAnswer' JOIN t c ON c.s = i.s AND c.p = 'hasAnswerCategory' AND c.o = 'R' WHERE i.p = 'isAnswerTo')")
def anti_no_options(spark, sf):
    g = star.star_graph(spark, sf)
    return bgp.not_exists(_typed(g, "Question", "q"), g, [("?ans", "isAnswerTo", "?q"), ("?resp", "hasAnswer", "?ans"), ("?ans", "hasAnswerCategory", "R")])


@register("anti_unused_option", T + "SELECT s AS ans FROM t WHERE p = 'type' AND o = 'Answer' AND s NOT IN (SELECT o FROM t WHERE p = 'hasAnswer')")
def anti_unused_option(spark, sf):
    g = star.star_graph(spark, sf)
    return bgp.not_exists(_typed(g, "Answer", "ans"), g, [("?resp", "hasAnswer", "?ans")])


@register("anti_empty_questionnaire", T + "SELECT s AS qn FROM t WHERE p = 'type' AND o = 'Questionnaire' AND s NOT IN (SELECT b.o FROM t b JOIN t d ON d.s = b.s AND d.p = 'QuestionDescription' AND d.o LIKE 'hot%' JOIN t k ON k.s = b.s AND k.p = 'hasQuestionCategory' AND k.o = 'category/LARGE' WHERE b.p = 'belongsTo')")
def anti_empty_questionnaire(spark, sf):
    g = star.star_graph(spark, sf)
    filled = bgp.match(g, [("?q", "belongsTo", "?qn"), ("?q", "QuestionDescription", "?d"), ("?q", "hasQuestionCategory", "category/LARGE")]).filter(F.col("d").startswith("hot"))
    return _typed(g, "Questionnaire", "qn").join(filled, "qn", "left_anti")


@register("user_completeness", T + "SELECT b.o AS u, count(DISTINCT i.o) AS questions, count(DISTINCT b.s) AS responses FROM t b JOIN t h ON h.s = b.s AND h.p = 'hasAnswer' JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo' WHERE b.p = 'answeredByUser' GROUP BY b.o")
def user_completeness(spark, sf):
    m = bgp.match(star.star_graph(spark, sf), [("?r", "answeredByUser", "?u"), ("?r", "hasAnswer", "?a"), ("?a", "isAnswerTo", "?q")])
    return m.groupBy("u").agg(F.countDistinct("q").alias("questions"), F.countDistinct("r").alias("responses"))


@register("questionnaire_usage", T + "SELECT q.o AS qn, count(b.s) AS responses, count(DISTINCT b.o) AS users FROM t q JOIN t b ON b.s = q.s AND b.p = 'answeredByUser' WHERE q.p = 'answeredInQuestionnaire' GROUP BY q.o")
def questionnaire_usage(spark, sf):
    m = bgp.match(star.star_graph(spark, sf), [("?r", "answeredInQuestionnaire", "?qn"), ("?r", "answeredByUser", "?u")])
    return m.groupBy("qn").agg(F.count("r").alias("responses"), F.countDistinct("u").alias("users"))


@register("questions_per_questionnaire", T + "SELECT o AS qn, count(DISTINCT s) AS n FROM t WHERE p = 'belongsTo' GROUP BY o")
def questions_per_questionnaire(spark, sf):
    return bgp.match(star.star_graph(spark, sf), [("?q", "belongsTo", "?qn")]).groupBy("qn").agg(F.countDistinct("q").alias("n"))


@register("platform_usage", T + "SELECT o AS platform, count(DISTINCT s) AS users FROM t WHERE p = 'usesPlatform' GROUP BY o")
def platform_usage(spark, sf):
    return bgp.match(star.star_graph(spark, sf), [("?u", "usesPlatform", "?platform")]).groupBy("platform").agg(F.countDistinct("u").alias("users"))


NULL_RATE = """SELECT ?q (COUNT(DISTINCT ?resp) AS ?n) (COUNT(DISTINCT ?hit) AS ?nulls) WHERE {
  ?resp <hasAnswer> ?a . ?a <isAnswerTo> ?q . OPTIONAL { ?a <type> <NullAnswer> . ?hit <hasAnswer> ?a } } GROUP BY ?q"""


@register("null_rate", T + ", r AS (SELECT i.o AS q, h.s AS resp, n.s IS NOT NULL AS is_null FROM t h JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo' LEFT JOIN t n ON n.s = h.o AND n.p = 'type' AND n.o = 'NullAnswer' WHERE h.p = 'hasAnswer') SELECT q, count(*) AS n, count(*) FILTER (is_null) AS nulls, round(count(*) FILTER (is_null) / count(*), 6) AS rate FROM r GROUP BY q")
def null_rate(spark, sf):
    g = star.star_graph(spark, sf)
    m = bgp.match(g, [("?resp", "hasAnswer", "?a"), ("?a", "isAnswerTo", "?q")]).join(_typed(g, "NullAnswer", "a").withColumn("is_null", F.lit(1)), "a", "left")
    return m.groupBy("q").agg(F.count("*").alias("n"), F.count("is_null").alias("nulls")).withColumn("rate", F.round(F.col("nulls") / F.col("n"), 6))


USER_TRACE = """SELECT ?u ?resp ?q ?desc ?cat ?v WHERE { VALUES ?u { <user/1> <user/2> <user/3> }
  ?resp <answeredByUser> ?u . ?resp <hasAnswer> ?a . ?a <isAnswerTo> ?q . ?q <QuestionDescription> ?desc . ?a <hasAnswerCategory> ?cat . ?resp <rawResponseValue> ?v } ORDER BY ?u ?resp"""


@register("user_trace", T + "SELECT b.o AS u, b.s AS resp, i.o AS q, d.o AS \"desc\", c.o AS cat, v.o AS v FROM t b JOIN t h ON h.s = b.s AND h.p = 'hasAnswer' JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo' JOIN t d ON d.s = i.o AND d.p = 'QuestionDescription' JOIN t c ON c.s = h.o AND c.p = 'hasAnswerCategory' JOIN t v ON v.s = b.s AND v.p = 'rawResponseValue' WHERE b.p = 'answeredByUser' AND b.o IN ('user/1','user/2','user/3')")
def user_trace(spark, sf):
    return sparql.query(star.star_graph(spark, sf), USER_TRACE)


MISSING_LINKS = """SELECT ?q ?missing WHERE { ?q <type> <Question> OPTIONAL { ?q <hasQuestionCategory> <category/PROMO> . ?q <belongsTo> ?b } OPTIONAL { ?q <QuestionDescription> ?d FILTER(STRSTARTS(?d, "red")) }
  BIND(CONCAT(IF(BOUND(?b), "", "belongsTo "), IF(BOUND(?d), "", "description")) AS ?missing) FILTER(?missing != "") }"""


@register("missing_links", T + "SELECT s.s AS q, (CASE WHEN b.o IS NULL THEN 'belongsTo ' ELSE '' END) || (CASE WHEN d.o IS NULL THEN 'description' ELSE '' END) AS missing FROM t s LEFT JOIN (SELECT b.* FROM t b JOIN t k ON k.s = b.s AND k.p = 'hasQuestionCategory' AND k.o = 'category/PROMO' WHERE b.p = 'belongsTo') b ON b.s = s.s LEFT JOIN t d ON d.s = s.s AND d.p = 'QuestionDescription' AND d.o LIKE 'red%' WHERE s.p = 'type' AND s.o = 'Question' AND (b.o IS NULL OR d.o IS NULL)")
def missing_links(spark, sf):
    return sparql.query(star.star_graph(spark, sf), MISSING_LINKS)


@register("dropout", T + ", a AS (SELECT q.o AS qn, b.o AS u, count(DISTINCT i.o) AS answered FROM t q JOIN t b ON b.s = q.s AND b.p = 'answeredByUser' JOIN t h ON h.s = q.s AND h.p = 'hasAnswer' JOIN t i ON i.s = h.o AND i.p = 'isAnswerTo' WHERE q.p = 'answeredInQuestionnaire' GROUP BY ALL), s AS (SELECT o AS qn, count(DISTINCT s) AS total FROM t WHERE p = 'belongsTo' GROUP BY o) SELECT a.qn, u, answered, total FROM a JOIN s USING (qn) WHERE answered * 20 < total")
def dropout(spark, sf):
    g = star.star_graph(spark, sf)
    m = bgp.match(g, [("?r", "answeredInQuestionnaire", "?qn"), ("?r", "answeredByUser", "?u"), ("?r", "hasAnswer", "?a"), ("?a", "isAnswerTo", "?q")])
    a = m.groupBy("qn", "u").agg(F.countDistinct("q").alias("answered"))
    s = bgp.match(g, [("?q", "belongsTo", "?qn")]).groupBy("qn").agg(F.countDistinct("q").alias("total"))
    return a.join(s, "qn").filter("answered * 20 < total")


@register("gap_report", HIGH_SQL + ", asked AS (SELECT i.o FROM hi JOIN t i ON i.s = hi.ans AND i.p = 'isAnswerTo'), active AS (SELECT b.o FROM hi JOIN t b ON b.s = hi.resp AND b.p = 'answeredByUser') SELECT 'question' AS gap, s AS node FROM t WHERE p = 'type' AND o = 'Question' AND s NOT IN (SELECT * FROM asked) UNION ALL SELECT 'user', s FROM t WHERE p = 'type' AND o = 'User' AND s NOT IN (SELECT * FROM active) UNION ALL SELECT 'option', s FROM t WHERE p = 'type' AND o = 'Answer' AND s NOT IN (SELECT o FROM t WHERE p = 'hasAnswer')")
def gap_report(spark, sf):
    parts = (("question", anti_orphan_question, "q"), ("user", anti_orphan_user, "u"), ("option", anti_unused_option, "ans"))
    frames = [f(spark, sf).select(F.lit(tag).alias("gap"), F.col(c).alias("node")) for tag, f, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register("path_sequence", T + "SELECT DISTINCT a.s AS s, b.o AS o FROM t a JOIN t b ON b.s = a.o AND b.p = 'subclass_of' WHERE a.p = 'subclass_of'")
def path_sequence(spark, sf):
    return sparql.query(star.star_graph(spark, sf), "SELECT DISTINCT ?s ?o WHERE { ?s <subclass_of>/<subclass_of> ?o }")


@register("optional_left", T + "SELECT a.s AS ans, n.o AS kind FROM t a LEFT JOIN t n ON n.s = a.s AND n.p = 'type' AND n.o = 'NullAnswer' WHERE a.p = 'type' AND a.o = 'Answer'")
def optional_left(spark, sf):
    g = star.star_graph(spark, sf)
    return bgp.optional(_typed(g, "Answer", "ans"), g, [("?ans", "type", "?kind")]).filter("kind <> 'Answer' or ans is null").unionByName(bgp.not_exists(_typed(g, "Answer", "ans"), g, [("?ans", "type", "NullAnswer")]).withColumn("kind", F.lit(None).cast("string")))


@register("answer_share", CHAIN_SQL + ', n AS (SELECT q, cat, count(DISTINCT resp) AS n FROM m GROUP BY ALL) SELECT q, cat, n, round_even((100.0 * n / sum(n) OVER (PARTITION BY q))::DOUBLE, 2) AS pct FROM n')
def answer_share(spark, sf):
    from pyspark.sql import Window

    n = bgp.match(star.star_graph(spark, sf), RESPONSE_CHAIN[:3]).groupBy("q", "cat").agg(F.countDistinct("resp").alias("n"))
    return n.withColumn("pct", terms.half_even(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("q")), 2))


@register("question_summary", CHAIN_SQL + ", n AS (SELECT qcat, q, count(*) AS n FROM m GROUP BY ALL) SELECT qcat, count(*) AS questions, sum(n)::BIGINT AS responses, round(avg(n), 4) AS mean_n, max(n) AS max_n FROM n GROUP BY qcat")
def question_summary(spark, sf):
    n = chain(spark, sf).groupBy("qcat", "q").agg(F.count("*").alias("n"))
    return n.groupBy("qcat").agg(F.count("*").alias("questions"), F.sum("n").alias("responses"), F.round(F.avg("n"), 4).alias("mean_n"), F.max("n").alias("max_n"))


@register("pivot_matrix", CHAIN_SQL + "SELECT qcat, count(*) FILTER (cat = 'A') AS a, count(*) FILTER (cat = 'N') AS n, count(*) FILTER (cat = 'R') AS r, count(*) FILTER (cat = 'X') AS x FROM m GROUP BY qcat")
def pivot_matrix(spark, sf):
    p = chain(spark, sf).groupBy("qcat").pivot("cat", ["A", "N", "R", "X"]).agg(F.count("resp")).na.fill(0)
    return p.toDF("qcat", "a", "n", "r", "x")


@register("topk_questions", CHAIN_SQL + "SELECT q, count(*) AS n FROM m GROUP BY q ORDER BY n DESC, q LIMIT 25")
def topk_questions(spark, sf):
    return sparql.query(star.star_graph(spark, sf), "SELECT ?q (COUNT(?resp) AS ?n) WHERE { ?resp <hasAnswer> ?a . ?a <isAnswerTo> ?q } GROUP BY ?q ORDER BY DESC(?n) ?q LIMIT 25")


@register("sparql_values", T + "SELECT s AS q, o AS k FROM t WHERE p = 'hasQuestionCategory' AND o IN ('category/PROMO', 'category/SMALL')")
def sparql_values(spark, sf):
    return sparql.query(star.star_graph(spark, sf), "SELECT ?q ?k WHERE { VALUES ?k { <category/PROMO> <category/SMALL> } ?q <hasQuestionCategory> ?k }")


@register("sparql_bind", T + "SELECT u.s AS u, 'user ' || l.o AS text, CASE WHEN p.o IS NOT NULL THEN 'yes' ELSE 'no' END AS zero FROM t u JOIN t l ON l.s = u.s AND l.p = 'label' LEFT JOIN t p ON p.s = u.s AND p.p = 'segment' AND p.o = 'MACHINERY' WHERE u.p = 'type' AND u.o = 'User'")
def sparql_bind(spark, sf):
    return sparql.query(star.star_graph(spark, sf), 'SELECT ?u ?text ?zero WHERE { ?u <type> <User> . ?u <label> ?l OPTIONAL { ?u <segment> ?g FILTER(?g = "MACHINERY") } BIND(CONCAT("user ", ?l) AS ?text) BIND(IF(BOUND(?g), "yes", "no") AS ?zero) }')


@register("pred_ns_filter", T + "SELECT p, count(*) AS n FROM t WHERE o_kind = 'iri' AND p LIKE 'has%' GROUP BY p")
def pred_ns_filter(spark, sf):
    return star.star_graph(spark, sf).filter((F.col("o_kind") == "iri") & F.col("p").startswith("has")).groupBy("p").agg(F.count("*").alias("n"))


@register("type_prefix_filter", T + "SELECT s, p, o FROM t WHERE s LIKE 'answer/1%' AND s IN (SELECT s FROM t WHERE p = 'type' AND o = 'NullAnswer')")
def type_prefix_filter(spark, sf):
    g = star.star_graph(spark, sf)
    typed = _typed(g, "NullAnswer", "s")
    return g.filter(F.col("s").startswith("answer/1")).join(typed, "s", "left_semi").select("s", "p", "o")


@register("node_types", T + "SELECT s AS node, string_agg(DISTINCT o, ',' ORDER BY o) AS types FROM t WHERE p = 'type' GROUP BY s")
def node_types(spark, sf):
    return bgp.match(star.star_graph(spark, sf), [("?node", "type", "?c")]).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("types"))


# --- graph statistics --------------------------------------------------------------------------------

EDGE_SQL = T + ", e AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM t WHERE o_kind = 'iri' AND p <> 'type'), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node) "


def _edges(spark, sf):
    return graphstats.undirected(star.star_graph(spark, sf).filter("p <> 'type'"))


@register("degree_centrality", EDGE_SQL + "SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 9) AS centrality FROM d")
def degree_centrality(spark, sf):
    return graphstats.degree_centrality(_edges(spark, sf))


@register("degree_by_type", EDGE_SQL + "SELECT o AS class, count(*) AS nodes, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM d JOIN t ON t.s = d.node AND t.p = 'type' GROUP BY o")
def degree_by_type(spark, sf):
    typed = bgp.match(star.star_graph(spark, sf), [("?node", "type", "?class")])
    joined = graphstats.degrees(_edges(spark, sf)).join(typed, "node")
    return joined.groupBy("class").agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


@register("components", EDGE_SQL.replace("WITH resp", "WITH RECURSIVE resp", 1) + ", n AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), cc(node, component) USING KEY (node) AS (SELECT node, node FROM d UNION SELECT n.b, min(cc.component) FROM cc JOIN n ON n.a = cc.node JOIN recurring.cc AS old ON old.node = n.b WHERE cc.component < old.component GROUP BY n.b) SELECT node, component FROM cc")
def components(spark, sf):
    """Components of all nodes of the graph that an edge joins with another node or itself."""
    return graphstats.linked_components(mapping.stars(star.SPECS, star.sources(spark, sf)))


CLUSTER_SQL = T + """, e0 AS (SELECT DISTINCT 'user/'||o_custkey AS a, 'questionnaire/'||url_encode(p_brand) AS b FROM resp UNION SELECT 'user/'||c_custkey, 'platform/'||url_encode(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'platform/'||url_encode(n_name), 'questionnaire/'||url_encode(p_brand) FROM resp JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), d AS (SELECT a AS node, count(*) AS k FROM e GROUP BY a),
tri AS (SELECT x.a AS node, count(*) AS links FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT d.node, round(CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(links, 0) / (k * (k - 1)) END::DOUBLE, 6) AS clustering FROM d LEFT JOIN tri ON tri.node = d.node"""


@register("clustering_coef", CLUSTER_SQL)
def clustering_coef(spark, sf):
    g = star.star_graph(spark, sf)
    used = bgp.match(g, [("?r", "answeredByUser", "?u"), ("?r", "answeredInQuestionnaire", "?q")]).select("u", "q").distinct()
    on = bgp.match(g, [("?u", "usesPlatform", "?p")])
    pairs = used.toDF("a", "b").union(on.select("u", "p")).union(used.join(on, "u").select("p", "q"))
    return graphstats.clustering(pairs)


@register("random_walks")
def random_walks(spark, sf):
    """Self-avoiding walks of up to four steps from every question, with hash-chosen edges, and corrupted tails."""
    g = star.star_graph(spark, sf).filter(F.col("p").isin("belongsTo", "hasQuestionCategory", "isAnswerTo"))
    return graphstats.walks(g.select(F.col("s").alias("a"), "p", F.col("o").alias("b")), steps=4, seed=11)


TREE_SQL = T.replace("WITH resp", "WITH RECURSIVE resp", 1) + """, e0 AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM t WHERE p = 'subclass_of'), e AS MATERIALIZED (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
w(a, b, d) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, w.d + 1 FROM w JOIN e ON e.a = w.b WHERE w.a <> e.b AND w.d < 7), m AS (SELECT a, b, min(d) AS d FROM w GROUP BY a, b) """


@register("path_lengths", TREE_SQL + "SELECT d, count(*) AS pairs FROM m GROUP BY d")
def path_lengths(spark, sf):
    """Distances of all pairs of the hierarchy of suppliers, nations, regions and the world (at most 6)."""
    edges = graphstats.undirected(star.star_graph(spark, sf).filter("p = 'subclass_of'"))
    return graphstats.distance_counts(edges)
