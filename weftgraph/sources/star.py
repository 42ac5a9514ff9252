"""The triple view of the star-schema tables, as mapping specs; and the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.mapping import Constant, Each, Literal, Reference, Template, TripleMap, graph

PLATFORM = TripleMap("nation", Template("platform/{n_name}"), "Platform", (("name", Literal("n_name", lang="en")),))
USER = TripleMap("customer", Template("user/{c_custkey}"), "User", (("label", Literal("c_name")), ("segment", Literal("c_mktsegment")), ("usesPlatform", Reference(PLATFORM, "c_nationkey", "n_nationkey"))))
QUESTIONNAIRE = TripleMap("brand", Template("questionnaire/{p_brand}"), "Questionnaire", (("label", Literal("p_brand")),))
QUESTION = TripleMap(
    "part", Template("question/{p_partkey}"), "Question",
    (("QuestionDescription", Literal("p_name")), ("belongsTo", Template("questionnaire/{p_brand}")), ("hasQuestionCategory", Template("category/{p_type}"))),
)
ANSWER = TripleMap("option", Template("answer/{p_partkey}_{flag}"), "Answer", (("isAnswerTo", Template("question/{p_partkey}")), ("hasAnswerCategory", Literal("flag"))))
NULL_ANSWER = TripleMap("null_option", Template("answer/{p_partkey}_{flag}"), "NullAnswer")
RESPONSE = TripleMap(
    "response", Template("resp/{l_orderkey}_{l_linenumber}_{l_partkey}_{l_suppkey}"), "Response",
    (("answeredByUser", Template("user/{o_custkey}")), ("hasAnswer", Template("answer/{l_partkey}_{l_returnflag}")), ("answeredInQuestionnaire", Template("questionnaire/{p_brand}")), ("rawResponseValue", Literal("l_quantity"))),
)
PLACE = TripleMap("nation", Template("nation/{n_name}"), None, (("subclass_of", Template("region/{n_regionkey}")),))
ROOT = TripleMap("region", Template("region/{r_regionkey}"), None, (("subclass_of", Constant("world")),))
SUPPLIER = TripleMap("supplier_nation", Template("supplier/{s_suppkey}"), None, (("subclass_of", Template("nation/{n_name}")),))
SPECS = [PLATFORM, USER, QUESTIONNAIRE, QUESTION, ANSWER, NULL_ANSWER, RESPONSE, PLACE, ROOT, SUPPLIER]
__all__ = ["SPECS", "Each", "sources", "star_graph", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    flags = F.explode(F.array(*(F.lit(f) for f in "ANR"))).alias("flag")
    t["brand"] = t["part"].select("p_brand").distinct()
    t["option"] = t["part"].select("p_partkey", flags)
    t["null_option"] = t["part"].select("p_partkey", F.lit("N").alias("flag"))
    t["response"] = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    t["supplier_nation"] = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    return t


def star_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(SPECS, sources(spark, sf_dir))


_RESPONSE = "'resp/'||l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey"
#: WITH clause that defines t(s, p, o, o_kind): the same triples in SQL.
SQL = f"""WITH resp AS MATERIALIZED (SELECT {_RESPONSE} AS r, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
opt AS (SELECT p_partkey, unnest(['A','N','R']) AS flag FROM part),
t(s, p, o, o_kind) AS MATERIALIZED (SELECT DISTINCT * FROM (
SELECT 'platform/'||url_encode(n_name), 'type', 'Platform', 'iri' FROM nation
UNION ALL SELECT 'platform/'||url_encode(n_name), 'name', n_name, 'literal' FROM nation
UNION ALL SELECT 'user/'||c_custkey, 'type', 'User', 'iri' FROM customer
UNION ALL SELECT 'user/'||c_custkey, 'label', c_name, 'literal' FROM customer
UNION ALL SELECT 'user/'||c_custkey, 'segment', c_mktsegment, 'literal' FROM customer
UNION ALL SELECT 'user/'||c_custkey, 'usesPlatform', 'platform/'||url_encode(n_name), 'iri' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'questionnaire/'||url_encode(p_brand), 'type', 'Questionnaire', 'iri' FROM part
UNION ALL SELECT 'questionnaire/'||url_encode(p_brand), 'label', p_brand, 'literal' FROM part
UNION ALL SELECT 'question/'||p_partkey, 'type', 'Question', 'iri' FROM part
UNION ALL SELECT 'question/'||p_partkey, 'QuestionDescription', p_name, 'literal' FROM part
UNION ALL SELECT 'question/'||p_partkey, 'belongsTo', 'questionnaire/'||url_encode(p_brand), 'iri' FROM part
UNION ALL SELECT 'question/'||p_partkey, 'hasQuestionCategory', 'category/'||url_encode(p_type), 'iri' FROM part
UNION ALL SELECT 'answer/'||p_partkey||'_'||flag, 'type', 'Answer', 'iri' FROM opt
UNION ALL SELECT 'answer/'||p_partkey||'_'||flag, 'isAnswerTo', 'question/'||p_partkey, 'iri' FROM opt
UNION ALL SELECT 'answer/'||p_partkey||'_'||flag, 'hasAnswerCategory', flag, 'literal' FROM opt
UNION ALL SELECT 'answer/'||p_partkey||'_N', 'type', 'NullAnswer', 'iri' FROM part
UNION ALL SELECT r, 'type', 'Response', 'iri' FROM resp
UNION ALL SELECT r, 'answeredByUser', 'user/'||o_custkey, 'iri' FROM resp
UNION ALL SELECT r, 'hasAnswer', 'answer/'||l_partkey||'_'||l_returnflag, 'iri' FROM resp
UNION ALL SELECT r, 'answeredInQuestionnaire', 'questionnaire/'||url_encode(p_brand), 'iri' FROM resp
UNION ALL SELECT r, 'rawResponseValue', printf('%.1f', l_quantity), 'literal' FROM resp
UNION ALL SELECT 'nation/'||url_encode(n_name), 'subclass_of', 'region/'||n_regionkey, 'iri' FROM nation
UNION ALL SELECT 'region/'||r_regionkey, 'subclass_of', 'world', 'iri' FROM region
UNION ALL SELECT 'supplier/'||s_suppkey, 'subclass_of', 'nation/'||url_encode(n_name), 'iri' FROM supplier JOIN nation ON s_nationkey = n_nationkey))
"""
