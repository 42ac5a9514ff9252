"""Readers, writers and small operators over tables written to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftgraph import shared
from weftgraph.catalogue import register
from weftgraph.functions import repair
from weftgraph.operators import datasets as ds
from weftgraph.operators import graphstats, remote
from weftgraph.sources import files, sinks, star
from weftgraph.sources.star import SQL as T
from weftgraph.sources.star import table


def _folder(spark, tag):
    return shared.scratch(spark, tag)


# --- sources -------------------------------------------------------------------------------------------


@register("table_required", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def table_required(spark, sf):
    path = _folder(spark, "tsv") + ".tsv"
    table(spark, sf, "nation").write.csv(path, header=True, sep="\t")
    return files.read_table(spark, path, ["n_nationkey", "n_name"])


@register("prior_table", "SELECT p_partkey::VARCHAR AS k, CASE WHEN p_size % 3 = 0 THEN 'null' WHEN p_size % 3 = 1 THEN NULL ELSE p_name END AS v FROM part")
def prior_table(spark, sf):
    """The text "null" stays text, an empty field is null; a table that is not there, or is broken, has no rows."""
    path = _folder(spark, "prior")
    value = F.when(F.col("p_size") % 3 == 0, "null").when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_name"))
    table(spark, sf, "part").select(F.col("p_partkey").alias("k"), value.alias("v")).write.csv(path, header=True, emptyValue="")
    return files.read_prior(spark, path, ["k", "v"]).unionByName(files.read_prior(spark, f"{path}/none", ["k", "v"])).unionByName(files.read_prior(spark, path, ["k", "w"]).toDF("k", "v"))


def _json_files(spark, sf, path):
    """Regions as an array, nations as lines, one customer as an object, and a broken file."""
    region = [r.asDict() for r in table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).collect()]
    nation = [r.asDict() for r in table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).collect()]
    sinks.write_text(spark, f"{path}/a.json", json.dumps(region, indent=1))
    sinks.write_text(spark, f"{path}/b.jsonl", "\n".join(json.dumps(r) for r in nation))
    sinks.write_text(spark, f"{path}/c/one.json", json.dumps({"k": 99, "name": "ü"}))


JSON_SQL = "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'ü'"


@register("json_autodetect", JSON_SQL)
def json_autodetect(spark, sf):
    path = _folder(spark, "json")
    _json_files(spark, sf, path)
    return files.read_json(spark, path, "k int, name string").drop("path")


@register("json_dir_skip", f"SELECT *, (SELECT 1) AS broken FROM ({JSON_SQL})")
def json_dir_skip(spark, sf):
    path = _folder(spark, "json")
    _json_files(spark, sf, path)
    sinks.write_text(spark, f"{path}/broken.json", '{"k": 1, "name":')
    broken = files.broken_files(spark, path).agg(F.count("*").cast("int").alias("broken"))
    return files.read_json(spark, path, "k int, name string", skip_broken=True).drop("path").join(F.broadcast(broken))


@register("markdown_scan", "SELECT r_regionkey, '# ' || r_name || chr(10) || 'text' AS text FROM region")
def markdown_scan(spark, sf):
    path = _folder(spark, "md")
    for r in table(spark, sf, "region").collect():
        sinks.write_text(spark, f"{path}/{r.r_regionkey % 2}/{r.r_regionkey}.md", f"# {r.r_name}\ntext")
    sinks.write_text(spark, f"{path}/other.txt", "no")
    return files.read_markdown(spark, path).select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int").alias("r_regionkey"), "text")


@register("paragraphs", "SELECT r_regionkey, 0 AS paragraph, r_name AS text FROM region UNION ALL SELECT r_regionkey, 1, 'second' FROM region")
def paragraphs(spark, sf):
    path = _folder(spark, "txt")
    for r in table(spark, sf, "region").collect():
        sinks.write_text(spark, f"{path}/{r.r_regionkey}.txt", f"{r.r_name}\n\nsecond")
    return files.read_paragraphs(spark, path).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int").alias("r_regionkey"), "paragraph", "text")


@register("nt_repair", "SELECT 'x/' || n_nationkey AS s, 'name' AS p, n_name || chr(10) || 'two' AS o FROM nation")
def nt_repair(spark, sf):
    """Line breaks inside literals are repaired before the lines are parsed."""
    from weftgraph.operators import triples as tr

    path = _folder(spark, "nt")
    rows = table(spark, sf, "nation").collect()
    sinks.write_text(spark, f"{path}/all.nt", "# a \"comment\n" + "\n".join(f'<x/{r.n_nationkey}> <name> "{r.n_name}\ntwo" .' for r in rows) + "\n")
    return tr.parse_nt(files.read_nt_files(spark, path).select("value")).select("s", "p", "o")


@register("ontology_scan", "SELECT 'http://x/N' || n_nationkey AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, 'http://x/R' || n_regionkey AS o FROM nation UNION ALL SELECT 'http://x/N' || n_nationkey, 'http://www.w3.org/2000/01/rdf-schema#label', n_name FROM nation UNION ALL SELECT 'http://x/N' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/2002/07/owl#Class' FROM nation")
def ontology_scan(spark, sf):
    path = _folder(spark, "ttl")
    head = "@prefix : <http://x/> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
    rows = table(spark, sf, "nation").collect()
    sinks.write_text(spark, f"{path}/o.ttl", head + "\n".join(f':N{r.n_nationkey} a owl:Class ; # note\n  rdfs:subClassOf :R{r.n_regionkey} ;\n  rdfs:label "{r.n_name}"@en .' for r in rows))
    return files.read_ontology(spark, path)


@register("rules_clean", "SELECT '?a ' || p_brand || ' ?b' AS body, '?a is ?b' AS head, p_size::DOUBLE AS pca FROM part WHERE p_size % 3 = 0")
def rules_clean(spark, sf):
    size = F.col("p_size") % 3
    rows = table(spark, sf, "part").select(F.concat(F.when(size == 1, "x").otherwise(" ?a "), "p_brand", F.lit(" ?b")).alias("Body"), F.when(size != 2, "?a is ?b").alias("Head"), F.col("p_size").cast("string").alias("PCA Confidence"))
    return files.clean_rules(rows, {"pca": ["pca_confidence", "PCA Confidence"]})


@register("mined_files", "SELECT 'mined ' || r_regionkey AS source, '?a p' || r_regionkey || ' ?b => ?a q ?b' AS rule FROM region")
def mined_files(spark, sf):
    from weftgraph.operators import rules

    path = _folder(spark, "mined")
    for r in table(spark, sf, "region").collect():
        sinks.write_text(spark, f"{path}/{r.r_regionkey}.txt", f"?no rule => here\nRule  Head Coverage  Std\n?a p{r.r_regionkey} ?b  => ?a q ?b  0.5 0.4 0.3 1 2 3 ?a\nend")
    lines = files.mined_lines(files.read_files(spark, path, "*.txt"))
    parsed = rules.parse_mined(lines)
    return parsed.select(F.concat(F.lit("mined "), F.regexp_extract("rule", r"p(\d+)", 1)).alias("source"), F.array_join(F.split("rule", r"\s+"), " ").alias("rule"))


@register("sparql_bindings", "SELECT * FROM (VALUES ('a', '1'), ('b', NULL)) v(x, y)")
def sparql_bindings(spark, sf):
    payload = {"head": {"vars": ["x", "y"]}, "results": {"bindings": [{"x": {"type": "uri", "value": "a"}, "y": {"value": "1"}}, {"x": {"value": "b"}}]}}
    return files.read_bindings(spark, json.dumps(payload))


# --- sinks ---------------------------------------------------------------------------------------------


@register("kg_ids", T + ", x AS (SELECT * FROM t WHERE p IN ('belongsTo', 'subclass_of')), e AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT s AS name FROM x UNION SELECT o FROM x)), r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT p AS name FROM x)) SELECT a.id::VARCHAR AS h, b.id::VARCHAR AS t, r.id::VARCHAR AS r FROM x JOIN e a ON a.name = x.s JOIN e b ON b.name = x.o JOIN r ON r.name = x.p")
def kg_ids(spark, sf):
    """Triples with dense integer ids, written with their count and read back."""
    path = _folder(spark, "ids")
    triples = star.star_graph(spark, sf).filter(F.col("p").isin("belongsTo", "subclass_of")).select("s", "p", "o")
    _, _, rows = sinks.id_triples(triples)
    sinks.write_counted(rows, path)
    return sinks.read_counted(spark, path, ["h", "t", "r"])


@register("csv_audit", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS h, (SELECT count(*) FROM documents)::BIGINT AS n FROM documents WHERE text <> ''")
def csv_audit(spark, sf):
    """All texts quoted, audited, moved into place, with the audit beside them."""
    path = _folder(spark, "audit")
    sinks.write_audited(table(spark, sf, "documents").select("doc_id", "text"), path)
    audit = spark.read.schema("rows long").json(f"{path}.audit.json").select(F.col("rows").alias("n"))
    back = files.read_table(spark, path, ["doc_id", "text"], sep=",").filter("text is not null")
    return back.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("h")).join(F.broadcast(audit))


@register("files_by_key", "SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_type")
def files_by_key(spark, sf):
    path = _folder(spark, "keys")
    summary = sinks.write_by_key(table(spark, sf, "part").select("p_type", "p_size"), path, "p_type")
    back = spark.read.schema("p_size int, p_type string").json(path).groupBy("p_type").agg(F.sum("p_size").alias("sizes"))
    return summary.join(back, "p_type")


@register("predictions_resume", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS run FROM documents")
def predictions_resume(spark, sf):
    """A run over even ids, one over all, and the second one again."""
    path = _folder(spark, "predictions")
    docs = table(spark, sf, "documents").select("doc_id")
    sinks.append_predictions(docs.filter("doc_id % 2 = 0"), path, "doc_id", "a")
    for _ in range(2):
        sinks.append_predictions(docs, path, "doc_id", "b")
    return spark.read.parquet(path).select("doc_id", "run")


@register("report_files", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def report_files(spark, sf):
    path = _folder(spark, "report")
    sinks.write_report(table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")), path)
    return spark.read.schema("p_brand string, n long").json(path)


@register("csv_columns", "SELECT n_name AS a, n_nationkey::VARCHAR AS b FROM nation")
def csv_columns(spark, sf):
    path = _folder(spark, "columns")
    sinks.write_csv(table(spark, sf, "nation"), path, ["n_name", "n_nationkey"])
    return spark.read.csv(path, header=False, schema="a string, b string").filter("a <> 'n_name'")


# --- functions -----------------------------------------------------------------------------------------


@register("list_cells", "SELECT p_partkey, string_split(p_name, ' ') AS items FROM part")
def list_cells(spark, sf):
    words = F.split("p_name", " ")
    cell = F.concat(F.lit(" "), repair.render_list(F.concat(words, F.array(F.lit("")))))
    return table(spark, sf, "part").select("p_partkey", repair.parse_list(cell).alias("items"))


@register("mojibake", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE lang IN ('de', 'fr', 'es')")
def mojibake(spark, sf):
    """Texts whose UTF-8 bytes were read as Latin-1, mended."""
    d = table(spark, sf, "documents").filter(F.col("lang").isin("de", "fr", "es"))
    broken = F.decode(F.encode("text", "utf-8"), "iso-8859-1")
    return d.select("doc_id", F.md5(F.encode(repair.mended(broken), "utf-8")).alias("h"))


@register("similarity_ratio")
def similarity_ratio(spark, sf):
    """Matching blocks of part names and of brands with types; the tests compare with the definition."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", repair.similarity("p_name", F.upper("p_name")).alias("same"), repair.similarity("p_brand", F.concat("p_brand", "p_type")).alias("share"))


@register("non_concept_filter", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo'))")
def non_concept_filter(spark, sf):
    return table(spark, sf, "part").filter(~repair.not_concept(F.concat_ws("|", "p_name", "p_type"), ["RED", "Promo"])).select("p_partkey")


@register("term_format", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x:P' || p_partkey ELSE '<http://x/P ' || p_partkey || '>' END AS term FROM part")
def term_format(spark, sf):
    iri = F.concat(F.lit("http://x/P"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" "), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", repair.format_term(iri, "x", "http://x/").alias("term"))


@register("question_keys", "SELECT trim(regexp_replace(' ' || p_name || '  x ', '\\s+', ' ', 'g')) AS k, count(*) AS n FROM part GROUP BY 1")
def question_keys(spark, sf):
    return table(spark, sf, "part").groupBy(repair.question_key(F.concat(F.lit(" "), "p_name", F.lit(" \t x "))).alias("k")).agg(F.count("*").alias("n"))


@register("token_rows", "SELECT p_partkey, i - 1 AS position, w[i] AS token FROM (SELECT p_partkey, regexp_extract_all(p_name, '[A-Za-z0-9_]+') AS w FROM part), range(1, 20) r(i) WHERE i <= len(w)")
def token_rows(spark, sf):
    """A table function over every part name."""
    spark.udtf.register("weft_tokens", repair.Tokens)
    table(spark, sf, "part").createOrReplaceTempView("weft_part")
    return spark.sql("SELECT p_partkey, position, token FROM weft_part, LATERAL weft_tokens(p_name)")


# --- operators -----------------------------------------------------------------------------------------


@register("candidate_choice", "SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN p_brand || (p_size % 4) END AS name FROM part")
def candidate_choice(spark, sf):
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("cui"), F.concat("p_brand", i).alias("name")))
    rows = table(spark, sf, "part").select("p_partkey", three.alias("candidates"), (F.col("p_size") % 4).alias("predicted"))
    return ds.chosen_candidate(rows, "candidates", "cui", "predicted").select("p_partkey", "chosen.name")


@register("claim_rank", "WITH c AS (SELECT l_orderkey AS item, l_suppkey % 5 AS property, CASE WHEN l_returnflag = 'R' THEN 'preferred' WHEN l_returnflag = 'A' THEN 'normal' ELSE 'deprecated' END AS rank, l_partkey AS value, CASE WHEN l_linenumber = 1 THEN 'novalue' ELSE 'value' END AS kind FROM lineitem) SELECT item, property, value FROM (SELECT *, max((rank = 'preferred')::INT) OVER (PARTITION BY item, property) AS m FROM c) WHERE rank = CASE WHEN m = 1 THEN 'preferred' ELSE 'normal' END AND kind <> 'novalue'")
def claim_rank(spark, sf):
    rank = F.when(F.col("l_returnflag") == "R", "preferred").when(F.col("l_returnflag") == "A", "normal").otherwise("deprecated")
    kind = F.when(F.col("l_linenumber") == 1, "novalue").otherwise("value")
    claims = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 5).alias("property"), rank.alias("rank"), F.col("l_partkey").alias("value"), kind.alias("kind"))
    return ds.claim_ranks(claims).select("item", "property", "value")


@register("parent_turns", "WITH p AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS turn FROM nation), c AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % 25 AS turn FROM part) SELECT p_partkey, n_name FROM c JOIN p USING (turn)")
def parent_turns(spark, sf):
    return ds.round_robin(table(spark, sf, "part").select("p_partkey"), "p_partkey", table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("p_partkey", "n_name")


@register("triple_split", T + ", r AS (SELECT s, p, o, row_number() OVER (ORDER BY md5('9:' || s || ':' || p || ':' || o), s, p, o) AS k, count(*) OVER () AS n FROM t WHERE p = 'belongsTo') SELECT s, o, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM r")
def triple_split(spark, sf):
    triples = star.star_graph(spark, sf).filter("p = 'belongsTo'").select("s", "p", "o")
    return ds.split_80_20(triples, ["s", "p", "o"], seed=9).select("s", "o", "part")


@register("training_sample", "SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 960")
def training_sample(spark, sf):
    return ds.training_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", steps=100, batch=2, accumulation=4, seed=5)


@register("concat_first", "SELECT k, arg_min(v, i) AS v FROM (SELECT c_custkey AS k, c_name AS v, 0 AS i FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT 1000000 + s_suppkey, s_name, 1 FROM supplier) GROUP BY k")
def concat_first(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return ds.concat_first([c, s.unionByName(s.withColumn("k", F.col("k") + 1000000))], ["k"])


@register("rows_preserved", "SELECT count(*) AS rows, 0::BIGINT AS lost, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS added FROM orders")
def rows_preserved(spark, sf):
    """Two parts that hold all orders, and those of one state twice."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ds.preserved(o, [o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus in ('F', 'P')")])


@register("flat_relations", "SELECT n_regionkey AS k, n_nationkey AS target, 'has' AS name FROM nation")
def flat_relations(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("target"), F.lit("has").alias("name"))).alias("relations"), F.collect_list("n_name").alias("types"))
    doubled = n.withColumn("relations", F.concat("relations", "relations"))
    return ds.flat_relations(doubled, "k", "relations", "types")[0]


@register("prompt_provenance", "SELECT arg_min(o_orderkey, (-o_totalprice, o_orderkey))::BIGINT AS id, max(o_totalprice) AS score FROM orders")
def prompt_provenance(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("prompt "), "o_orderkey").alias("prompt"), F.col("o_totalprice").alias("score"))
    best = rows.orderBy(F.desc("score"), "id").first()["prompt"]
    found = ds.provenance(rows, f" {best}\n", finished=True, mock=False)
    return spark.createDataFrame([(found["id"], found["score"])], "id long, score double")


@register("error_batch", "SELECT o_orderkey FROM orders WHERE o_totalprice < 100000 ORDER BY md5('2:' || o_orderkey), o_orderkey LIMIT 30")
def error_batch(spark, sf):
    return ds.error_batch(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 100000, 30, seed=2).select("o_orderkey")


@register("trajectory", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) WHERE ('0x' || substr(md5('4:' || o_orderkey), 1, 4))::INT / 65536 < 0.7")
def trajectory(spark, sf):
    return ds.trajectory(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 20, keep=0.7, seed=4).select("o_orderkey")


@register("weighted_score", "SELECT p_partkey, round(((p_size > 25)::INT * 3 + 1) / 4, 6) AS score FROM part")
def weighted_score(spark, sf):
    """Two registered metrics: an output that equals its example for large sizes only, and is never empty."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("output"), F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_name")).otherwise("").alias("example"))
    return ds.weighted_score(rows, {"exact": 3.0, "not_empty": 1.0}).select("p_partkey", F.round("score", 6).alias("score"))


@register("config_rules", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 're') THEN 'A' WHEN p_name = 'none' THEN 'B' WHEN p_type = 'PROMO' THEN 'P' ELSE 'unmapped' END AS class FROM part")
def config_rules(spark, sf):
    rules, codes = ds.rules_from_config('{"rules": [{"search": "re", "class": "A"}, {"exact": "none", "class": "B"}], "codes": {"PROMO": "P"}}')
    return table(spark, sf, "part").select("p_partkey", ds.classify("p_name", "p_type", rules, codes).alias("class"))


def _lookup():
    def fetch(ids):
        if "13" in ids:
            raise ValueError("bad id 13")
        return {i: f"entity {i}" for i in ids if int(i) % 10}

    return fetch


@register("batch_fetch", "SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey <> 13 AND n_nationkey % 10 <> 0 THEN 'entity ' || n_nationkey END AS answer, CASE WHEN n_nationkey = 13 THEN 'bad id 13' END AS error FROM nation")
def batch_fetch(spark, sf):
    """Lookups in batches; the batch with a bad id is cut in two until only that id fails."""
    return remote.fetched(table(spark, sf, "nation"), "n_nationkey", _lookup, batch=8)


@register("model_outputs", "SELECT r_regionkey::VARCHAR AS id, upper(r_name) AS output FROM region")
def model_outputs(spark, sf):
    return remote.generated(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("prompt")), lambda: str.upper)


HIERARCHY = "subclass_of"


@register("centralities", T.replace("WITH resp", "WITH RECURSIVE resp", 1) + """, e0 AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM t WHERE p = 'subclass_of'), e AS MATERIALIZED (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
w(a, b, d) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, w.d + 1 FROM w JOIN e ON e.a = w.b WHERE w.a <> e.b AND w.d < 6), m AS MATERIALIZED (SELECT a, b, min(d) AS d FROM w GROUP BY a, b),
c AS (SELECT a AS node, count(*) / sum(d) AS closeness, avg(7 - d) / 6 AS radiality FROM m GROUP BY a),
b AS (SELECT x.b AS node, count(*) AS n FROM m x JOIN m y ON y.a = x.b JOIN m z ON z.a = x.a AND z.b = y.b WHERE x.a < y.b AND x.d + y.d = z.d GROUP BY x.b)
SELECT node, round(closeness, 6) AS closeness, round(radiality, 6) AS radiality, coalesce(n, 0)::DOUBLE AS betweenness, coalesce(n, 0)::DOUBLE AS stress FROM c LEFT JOIN b USING (node)""")
def centralities(spark, sf):
    """Of the hierarchy of suppliers, nations, regions and the world: a tree, in which each pair has one shortest path."""
    edges = graphstats.undirected(star.star_graph(spark, sf).filter(F.col("p") == HIERARCHY))
    return graphstats.centralities(edges)


@register("bandit", "SELECT count(*) AS arms, 300 AS pulls FROM (SELECT DISTINCT p_brand FROM part)")
def bandit(spark, sf):
    """Upper-confidence pulls over brands whose rewards are sizes; the tests check which arm is pulled most."""
    rewards = {r.p_brand: [x / 50 for x in r.sizes] for r in table(spark, sf, "part").groupBy("p_brand").agg(F.slice(F.sort_array(F.collect_list("p_size")), 1, 100).alias("sizes")).collect()}
    found = ds.bandit(rewards, 300)
    return spark.createDataFrame(found, "arm string, pulls int, mean double").agg(F.count("*").alias("arms"), F.sum("pulls").cast("int").alias("pulls"))
