"""Scans, sinks, mappings and whole-graph rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph import shared
from weftgraph.catalogue import register
from weftgraph.functions import terms
from weftgraph.operators import resolve
from weftgraph.operators import triples as tr
from weftgraph.plans import bgp, mapping
from weftgraph.plans.mapping import Constant, Each, Literal, Reference, Template, TripleMap
from weftgraph.sources import star
from weftgraph.sources.star import SQL as T
from weftgraph.sources.star import table


def _shared(spark, tag):
    return shared.scratch(spark, tag)


def _emit(spark, sf, spec):
    return mapping.triples(spec, star.sources(spark, sf)).select("s", "p", "o")


@register("rml_subject", "SELECT 'user/' || c_custkey AS s, 'type' AS p, 'User' AS o FROM customer")
def rml_subject(spark, sf):
    return _emit(spark, sf, TripleMap("customer", Template("user/{c_custkey}"), "User"))


@register("rml_literal", "SELECT 'user/' || c_custkey AS s, 'label' AS p, c_name AS o FROM customer")
def rml_literal(spark, sf):
    return _emit(spark, sf, TripleMap("customer", Template("user/{c_custkey}"), None, (("label", Literal("c_name")),)))


@register("rml_iri", "SELECT 'part/' || p_partkey AS s, 'brand' AS p, 'brand/' || url_encode(p_brand) AS o FROM part UNION ALL SELECT 'part/' || p_partkey, 'kind', 'thing' FROM part")
def rml_iri(spark, sf):
    return _emit(spark, sf, TripleMap("part", Template("part/{p_partkey}"), None, (("brand", Template("brand/{p_brand}")), ("kind", Constant("thing")))))


@register("rml_join", "SELECT 'resp/' || l_orderkey || '_' || l_linenumber AS s, 'of' AS p, 'order/' || o_orderkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def rml_join(spark, sf):
    order = TripleMap("orders", Template("order/{o_orderkey}"))
    return _emit(spark, sf, TripleMap("lineitem", Template("resp/{l_orderkey}_{l_linenumber}"), None, (("of", Reference(order, "l_orderkey", "o_orderkey")),)))


def _nested(spark, sf):
    item = F.struct("l_partkey", "l_returnflag")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(item)).alias("items"))


@register("rml_nested", "SELECT DISTINCT 'doc/' || l_orderkey || '/item/' || l_partkey AS s, 'flag' AS p, l_returnflag AS o FROM lineitem")
def rml_nested(spark, sf):
    rows = _nested(spark, sf).select("l_orderkey", F.explode_outer("items").alias("it")).select("l_orderkey", "it.l_partkey", "it.l_returnflag")
    return mapping.triples(TripleMap("x", Template("doc/{l_orderkey}/item/{l_partkey}"), None, (("flag", Literal("l_returnflag")),)), {"x": rows}).select("s", "p", "o")


@register("rml_array", "SELECT DISTINCT 'doc/' || l_orderkey AS s, 'has' AS p, 'part/' || l_partkey AS o FROM lineitem")
def rml_array(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return mapping.triples(TripleMap("x", Template("doc/{l_orderkey}"), None, (("has", Each("parts", "part/{it}")),)), {"x": rows}).select("s", "p", "o")


@register("facts_scan", "SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation")
def facts_scan(spark, sf):
    path = _shared(spark, "facts")
    table(spark, sf, "nation").select(F.format_string('n%d\t"in"\tr%d', "n_nationkey", "n_regionkey")).union(spark.createDataFrame([("only\ttwo",)], "value string")).write.text(path)
    return tr.facts(spark, path)


@register("json_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_scan(spark, sf):
    path = _shared(spark, "json")
    table(spark, sf, "nation").write.json(path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@register("nt_render", T + """SELECT '<http://weft.example/' || s || '> <http://weft.example/' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<http://weft.example/' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM t""")
def nt_render(spark, sf):
    return tr.render_nt(star.star_graph(spark, sf))


@register("nt_scan", T + "SELECT 'http://weft.example/' || s AS s, 'http://weft.example/' || p AS p, CASE WHEN o_kind = 'iri' THEN 'http://weft.example/' ELSE '' END || o AS o, o_kind FROM t")
def nt_scan(spark, sf):
    """The graph, written as compressed lines and read back. It is a set before it is written, made so in raw columns."""
    path = _shared(spark, "nt")
    tr.render_nt(star.star_graph(spark, sf)).write.text(path, compression="gzip")
    return tr.parse_nt(spark.read.text(path), repeats=False).select("s", "p", "o", "o_kind")


@register("nt_to_tsv", T + r"SELECT DISTINCT url_decode(regexp_extract(s, '[^/]*$')) AS s, p, CASE WHEN o_kind = 'iri' THEN url_decode(regexp_extract(o, '[^/]*$')) ELSE o END AS o FROM t")
def nt_to_tsv(spark, sf):
    g = tr.parse_nt(tr.render_nt(star.star_graph(spark, sf)))
    name = lambda c: terms.pct_decode(terms.local_name(c))
    flat = F.translate(F.translate("o", "\t\n\r", "   "), '"<>', "")
    return g.select(name("s").alias("s"), name("p").alias("p"), F.when(F.col("o_kind") == "iri", name("o")).otherwise(flat).alias("o")).distinct()


@register("nt_local_names", T + "SELECT DISTINCT replace(regexp_extract(s, '[^/]*$'), '_', ' ') AS s, replace(p, '_', ' ') AS p, CASE WHEN o_kind = 'iri' THEN replace(regexp_extract(o, '[^/]*$'), '_', ' ') ELSE replace(regexp_extract(split_part(o, ' ', 1), '[^/]*$'), '_', ' ') END AS o FROM t")
def nt_local_names(spark, sf):
    parts = F.split(F.translate("value", '<>"', ""), r"\s+")
    name = lambda i: F.replace(F.substring_index(F.get(parts, F.lit(i)), "/", -1), F.lit("_"), F.lit(" "))
    return tr.render_nt(star.star_graph(spark, sf)).select(name(0).alias("s"), name(1).alias("p"), name(2).alias("o")).distinct()


@register("graph_union", T + "SELECT p, count(*) AS n FROM (SELECT s, p, o FROM t UNION SELECT s, 'kind', o FROM t WHERE p = 'type') GROUP BY p")
def graph_union(spark, sf):
    g = star.star_graph(spark, sf).select("s", "p", "o")
    return tr.union(g, g, g.filter("p = 'type'").withColumn("p", F.lit("kind"))).groupBy("p").agg(F.count("*").alias("n"))


def _brand_map(spark, sf):
    q = F.concat(F.lit("questionnaire/"), terms.pct_encode("p_brand"))
    return table(spark, sf, "part").select(q.alias("old"), F.lower(q).alias("new")).distinct()


@register("iri_remap", T + "SELECT DISTINCT CASE WHEN s LIKE 'questionnaire/%' THEN lower(s) ELSE s END AS s, p, CASE WHEN o LIKE 'questionnaire/%' THEN lower(o) ELSE o END AS o FROM t WHERE p IN ('belongsTo', 'label')")
def iri_remap(spark, sf):
    g = star.star_graph(spark, sf).filter(F.col("p").isin("belongsTo", "label"))
    return tr.remap(g, _brand_map(spark, sf)).select("s", "p", "o")


@register("reverse_edges", T + "SELECT DISTINCT o AS s, CASE p WHEN 'belongsTo' THEN 'holds' WHEN 'isAnswerTo' THEN 'hasOption' END AS p, s AS o FROM t WHERE p IN ('belongsTo', 'isAnswerTo')")
def reverse_edges(spark, sf):
    return tr.reverse(star.star_graph(spark, sf), {"belongsTo": "holds", "isAnswerTo": "hasOption"}).select("s", "p", "o")


@register("grade_shortcut", T + "SELECT DISTINCT a.s AS s, 'inQuestionnaire' AS p, b.o AS o FROM t a JOIN t b ON b.s = a.o AND b.p = 'belongsTo' WHERE a.p = 'isAnswerTo' AND a.s IN (SELECT s FROM t WHERE p = 'type' AND o = 'NullAnswer')")
def grade_shortcut(spark, sf):
    return tr.shortcut(star.star_graph(spark, sf), "isAnswerTo", "belongsTo", "inQuestionnaire", ["NullAnswer"]).select("s", "p", "o")


ENUM = [("category/PROMO", "Offer"), ("category/PROMO", "Special"), ("category/SMALL", "Size"), ("category/LARGE", "Size")]


@register("type_enrich", T + ", e(k, c) AS (VALUES ('category/PROMO', 'Offer'), ('category/PROMO', 'Special'), ('category/SMALL', 'Size'), ('category/LARGE', 'Size')) SELECT DISTINCT s, 'type' AS p, c AS o FROM t JOIN e ON o = k WHERE p = 'hasQuestionCategory'")
def type_enrich(spark, sf):
    classes = F.broadcast(spark.createDataFrame(ENUM, "o string, c string"))
    return star.star_graph(spark, sf).filter("p = 'hasQuestionCategory'").join(classes, "o").select("s", F.lit("type").alias("p"), F.col("c").alias("o")).distinct()


@register("rescope", "SELECT 'unit/' || l_orderkey || '/item_' || l_linenumber AS s, 'flag' AS p, l_returnflag AS o FROM lineitem GROUP BY ALL")
def rescope(spark, sf):
    local = table(spark, sf, "lineitem").select(F.concat(F.lit("u"), "l_orderkey").alias("file"), F.concat(F.lit("item_"), "l_linenumber").alias("s"), F.lit("flag").alias("p"), F.col("l_returnflag").alias("o"))
    units = table(spark, sf, "lineitem").select(F.concat(F.lit("u"), "l_orderkey").alias("file"), F.concat(F.lit("unit/"), "l_orderkey").alias("scope")).distinct()
    return resolve.rescope(local, units)


FORMS = "(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name || 's' END AS form FROM part)"


def _forms(spark, sf):
    form = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat("p_name", F.lit("s")))
    return table(spark, sf, "part").select("p_partkey", form.alias("form"))


@register("normalize_forms", f"SELECT p_partkey, 'form/' || url_encode(lower(form)) AS node FROM {FORMS}")
def normalize_forms(spark, sf):
    return _forms(spark, sf).select("p_partkey", F.concat(F.lit("form/"), terms.pct_encode(terms.fold("form"))).alias("node"))


@register("canonicalize", f"WITH k AS (SELECT DISTINCT lower(replace(form, '-', ' ')) AS key FROM {FORMS}), m AS (SELECT key, CASE WHEN length(key) > 3 AND key LIKE '%s' AND key NOT LIKE '%ss' AND left(key, -1) IN (SELECT key FROM k) THEN left(key, -1) ELSE key END AS root FROM k) SELECT p_partkey, root FROM {FORMS} JOIN m ON key = lower(replace(form, '-', ' '))")
def canonicalize(spark, sf):
    return resolve.canonical_keys(_forms(spark, sf), "form").select("p_partkey", F.col("root"))


@register("clean_local", "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || url_encode(p_brand) AS name FROM part")
def clean_local(spark, sf):
    return table(spark, sf, "part").select("p_partkey", resolve.clean_local(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand")).alias("name"))


@register("iri_collisions", "SELECT lower(p_name) AS new, count(DISTINCT f) AS olds FROM (SELECT p_name, unnest([p_name, upper(p_name)]) AS f FROM part) GROUP BY 1 HAVING count(DISTINCT f) > 1")
def iri_collisions(spark, sf):
    both = table(spark, sf, "part").select(F.explode(F.array("p_name", F.upper("p_name"))).alias("old"))
    return resolve.collisions(both.withColumn("new", F.lower("old")))


@register("humanize", "SELECT 'mention/' || p_partkey || '/' || replace(p_name, ' ', '-') AS iri FROM part")
def humanize(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.md5(F.col("p_partkey").cast("string")).alias("h"))
    iris = p.select(F.concat(F.lit("mention/"), "p_partkey", F.lit("/lu_"), F.substring("h", 1, 12)).alias("iri"))
    names = p.select(F.substring("h", 1, 12).alias("hash"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"))
    return resolve.humanize(iris, names)


@register("label_prefer", "SELECT p_name AS node, arg_min(lang || ':' || label, rank || label) AS best FROM (SELECT p_name, p_brand AS label, CASE p_size % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, CASE p_size % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '9' END AS rank FROM part) GROUP BY p_name")
def label_prefer(spark, sf):
    lang = F.when(F.col("p_size") % 3 == 0, "de").when(F.col("p_size") % 3 == 1, "en").otherwise("fr")
    rows = table(spark, sf, "part").select(F.col("p_name").alias("node"), F.col("p_brand").alias("label"), lang.alias("lang"))
    best = resolve.preferred_label(rows, ["en", "de"])
    return best.select("node", F.concat("lang", F.lit(":"), "label").alias("best"))


@register("label_merge", "SELECT p_name AS label, count(*) AS entries, count(DISTINCT p_brand) AS brands, min(p_size) AS hop, bool_or(p_size > 40) AS has_data, arg_min(p_type, p_partkey) AS description FROM part GROUP BY p_name")
def label_merge(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("entries"), F.countDistinct("p_brand").alias("brands"), F.min("p_size").alias("hop"), F.bool_or(F.col("p_size") > 40).alias("has_data"), F.min_by("p_type", "p_partkey").alias("description"))


@register("hop_expand", T + ", e AS (SELECT s AS a, o AS b FROM t WHERE p = 'subclass_of'), h0 AS (SELECT DISTINCT a AS n FROM e WHERE a LIKE 'supplier/%'), h1 AS (SELECT DISTINCT b AS n FROM e JOIN h0 ON a = n WHERE b NOT IN (SELECT n FROM h0)), h2 AS (SELECT DISTINCT b AS n FROM e JOIN h1 ON a = n WHERE b NOT IN (SELECT n FROM h0 UNION SELECT n FROM h1)) SELECT n AS node, 0 AS hop FROM h0 UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2")
def hop_expand(spark, sf):
    edges = star.star_graph(spark, sf).filter("p = 'subclass_of'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return resolve.expand(edges.filter("a like 'supplier/%'").select(F.col("a").alias("node")).distinct(), edges, 2)


@register("closure", T + " SELECT a.s AS child, b.o AS ancestor FROM t a JOIN (SELECT s, o FROM t WHERE p = 'subclass_of') b ON b.s = a.s WHERE a.p = 'subclass_of' UNION SELECT a.s, c.o FROM t a JOIN t b ON b.s = a.o AND b.p = 'subclass_of' JOIN t c ON c.s = b.s AND c.p = 'subclass_of' WHERE a.p = 'subclass_of' UNION SELECT a.s, c.o FROM t a JOIN t b ON b.s = a.o AND b.p = 'subclass_of' JOIN t c ON c.s = b.o AND c.p = 'subclass_of' WHERE a.p = 'subclass_of'")
def closure(spark, sf):
    edges = star.star_graph(spark, sf).filter("p = 'subclass_of'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    return bgp.closure(edges)


@register("csv_roundtrip", "SELECT doc_id, md5(text) AS h FROM documents")
def csv_roundtrip(spark, sf):
    path = _shared(spark, "csv")
    rows = table(spark, sf, "documents").select("doc_id", "text")
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    back = spark.read.csv(path, header=True, schema="doc_id long, text string", multiLine=True, escape='"', lineSep="\n", nullValue="\x00", emptyValue="")
    return back.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("h"))
