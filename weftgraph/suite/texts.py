"""Scalar and text operators over part names, documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.catalogue import register
from weftgraph.functions import extract, repair, scoring, terms
from weftgraph.sources.star import table

FOLD = "lower(replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), 'ß', 'ss'))"


def _names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")


@register("pct_encode", "SELECT p_partkey, url_encode(p_name || ' ~*+/' || p_brand) AS enc, p_name || ' ~*+/' || p_brand AS dec FROM part")
def pct_encode(spark, sf):
    text = F.concat("p_name", F.lit(" ~*+/"), "p_brand")
    return _names(spark, sf).select("p_partkey", terms.pct_encode(text).alias("enc"), terms.pct_decode(terms.pct_encode(text)).alias("dec"))


@register("fold_text", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents ")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(terms.fold("text").cast("binary")).alias("folded"))


@register("fold_hyphen", "SELECT DISTINCT lower(replace(upper(p_name), ' ', '-')) AS raw, lower(p_name) AS folded FROM part")
def fold_hyphen(spark, sf):
    raw = F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))
    return _names(spark, sf).select(F.lower(raw).alias("raw"), terms.fold_hyphen(raw).alias("folded")).distinct()


@register("singular_of", "SELECT DISTINCT w, CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) END AS singular FROM (SELECT unnest([p_name || 's', p_name || 'ss', left(p_name, 2) || 's', p_name]) AS w FROM part)")
def singular_of(spark, sf):
    words = _names(spark, sf).select(F.explode(F.array(F.concat("p_name", F.lit("s")), F.concat("p_name", F.lit("ss")), F.concat(F.substring("p_name", 1, 2), F.lit("s")), F.col("p_name"))).alias("w"))
    return words.select("w", terms.singular_of("w").alias("singular")).distinct()


INITIALS = "upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1))"


def _initials():
    return F.upper(F.concat(*(F.substring(F.split_part("p_name", F.lit(" "), F.lit(i)), 1, 1) for i in (1, 2))))


@register("abbrev_base", f"SELECT DISTINCT {INITIALS} || 's' AS form, {INITIALS} AS base FROM part")
def abbrev_base(spark, sf):
    form = F.concat(_initials(), F.lit("s"))
    return _names(spark, sf).select(form.alias("form"), terms.abbrev_base(form).alias("base")).distinct()


@register("local_name", "SELECT p_partkey, p_brand AS a, split_part(p_name, ' ', 2) AS b FROM part")
def local_name(spark, sf):
    return _names(spark, sf).select("p_partkey", terms.local_name(F.concat(F.lit("http://x/y/"), F.replace("p_brand", F.lit("Brand#"), F.lit("z#Brand_")))).alias("a0"), terms.local_name(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("b"), F.col("p_brand").alias("a")).drop("a0")


PREDICATES = ["http://x/o#hasAnswerCategory", "http://x/o/QuestionDescription", "usesPlatform", "http://x/y/is_Answer.To"]
PREDICATE_ROWS = ", ".join(f"('{p}')" for p in PREDICATES)


def _predicates(spark):
    return spark.createDataFrame([(p,) for p in PREDICATES], "p string")


@register("fmt_predicate", "SELECT * FROM (VALUES ('http://x/o#hasAnswerCategory', 'answer category'), ('http://x/o/QuestionDescription', 'question description'), ('usesPlatform', 'uses platform'), ('http://x/y/is_Answer.To', 'is_ answer. to')) v(p, words)")
def fmt_predicate(spark, sf):
    return _predicates(spark).select("p", terms.fmt_predicate("p").alias("words"))


@register("compact_predicate", "SELECT * FROM (VALUES ('http://x/o#hasAnswerCategory', 'x o#has answer category'), ('http://x/o/QuestionDescription', 'o question description'), ('usesPlatform', 'uses platform'), ('http://x/y/is_Answer.To', 'y is answer to')) v(p, words)")
def compact_predicate(spark, sf):
    return _predicates(spark).select("p", terms.compact_predicate("p").alias("words"))


@register("normalize_answer", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'a' THEN split_part(p_name, ' ', 2) ELSE p_name END || ' ' || lower(replace(p_brand, '#', '')) AS answer FROM part")
def normalize_answer(spark, sf):
    raw = F.concat(F.lit("The <pad>"), F.upper("p_name"), F.lit(",  an "), "p_brand", F.lit("!"))
    return _names(spark, sf).select("p_partkey", terms.normalize_answer(raw).alias("answer"))


@register("split_answers", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS answers FROM part")
def split_answers(spark, sf):
    raw = F.concat("p_name", F.lit(" , "), "p_brand", F.lit("\n ,"), "p_type", F.lit(","), "p_name")
    return _names(spark, sf).select("p_partkey", F.array_join(terms.split_answers(raw), "|").alias("answers"))


ANSWER_TEXTS = ["Answer: yes", "I think no. Answer: No", "Answer: yes ... Answer: no", "yes it is", "yes and no", "maybe", "nobody knows", None]


def _answer_rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ANSWER_TEXTS)], "id int, text string")


@register("resolve_answer", "SELECT * FROM (VALUES (0, 'yes', 'explicit'), (1, 'no', 'explicit'), (2, 'no', 'explicit'), (3, 'yes', 'word'), (4, 'no', 'default'), (5, 'no', 'default'), (6, 'no', 'default'), (7, 'no', 'default')) v(id, answer, how)")
def resolve_answer(spark, sf):
    answer, how = scoring.resolve_answer("text")
    return _answer_rows(spark).select("id", answer.alias("answer"), how.alias("how"))


@register("entity_extract", "SELECT p_partkey, 'question_' || p_partkey || '|answer_' || p_partkey || '|user_' || (p_partkey % 7) AS entities FROM part")
def entity_extract(spark, sf):
    text = F.format_string("see question_%d and answer_%d, again question_%d by user_%d", "p_partkey", "p_partkey", "p_partkey", F.col("p_partkey") % 7)
    return _names(spark, sf).select("p_partkey", F.array_join(extract.entities(text, ["question_\\d+", "answer_\\d+", "user_\\d+"]), "|").alias("entities"))


@register("concept_context", "SELECT p_partkey, 'Question ' || p_partkey || ': ' || p_name || '.' || CASE WHEN p_size > 25 THEN ' Size ' || p_size || '.' ELSE '' END || ' Part of ' || p_brand || '.' AS context FROM part")
def concept_context(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat_ws(" ", F.format_string("Question %d: %s.", "p_partkey", "p_name"), F.when(F.col("p_size") > 25, F.format_string("Size %d.", "p_size")), F.format_string("Part of %s.", "p_brand")).alias("context"))


@register("abbrev_table")
def abbrev_table(spark, sf):
    """Abbreviations of Markdown tables whose header names an abbreviation column."""
    rows = _names(spark, sf).groupBy("p_brand").agg(F.sort_array(F.collect_set(F.concat(F.lit("| "), _initials(), F.lit(" | "), "p_name", F.lit(" |")))).alias("rows"))
    doc = rows.select(F.col("p_brand").alias("doc"), F.concat_ws("\n", F.lit("Text before\n| Abbreviation | Meaning |\n| --- | --- |"), F.array_join("rows", "\n"), F.lit("\nafter")).alias("text"))
    return extract.table_abbreviations(doc)


@register("abbrev_footnote", "SELECT p_brand AS doc, 'AB' AS abbreviation, 'alpha beta' AS meaning FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT DISTINCT p_brand, 'CD', 'charlie delta' FROM part")
def abbrev_footnote(spark, sf):
    doc = _names(spark, sf).select("p_brand").distinct().select(F.col("p_brand").alias("doc"), F.lit("Intro: one thing\n\nAB: alpha beta; CD: charlie delta\n\nno list here").alias("text"))
    return extract.footnote_abbreviations(doc)


@register("abbrev_inline", f"SELECT DISTINCT p_name AS doc, {INITIALS} AS abbreviation, p_name AS meaning FROM part")
def abbrev_inline(spark, sf):
    doc = _names(spark, sf).select(F.col("p_name").alias("doc"), F.concat(F.lit("we use "), "p_name", F.lit(" ("), _initials(), F.lit(") here")).alias("text")).distinct()
    return extract.inline_abbreviations(doc)


ABBREV_SRC = f"SELECT {INITIALS} AS abbreviation, p_name AS meaning, p_partkey % 4 AS method, p_partkey AS pos, p_brand AS doc FROM part"


def _abbreviations(spark, sf):
    return _names(spark, sf).select(_initials().alias("abbreviation"), F.col("p_name").alias("meaning"), (F.col("p_partkey") % 4).cast("int").alias("method"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("doc"))


@register("abbrev_index", f"SELECT abbreviation, meaning, method FROM (SELECT *, row_number() OVER (PARTITION BY abbreviation ORDER BY method, pos) AS r FROM ({ABBREV_SRC})) WHERE r = 1")
def abbrev_index(spark, sf):
    first = F.min_by(F.struct("meaning", "method"), F.struct("method", "pos"))
    return _abbreviations(spark, sf).groupBy("abbreviation").agg(first.alias("f")).select("abbreviation", "f.meaning", "f.method")


@register("abbrev_merge", f"SELECT abbreviation, arg_min(meaning, method * 100000000 + pos) AS meaning, count(DISTINCT doc) AS n_docs, string_agg(DISTINCT doc, ',' ORDER BY doc) AS docs FROM ({ABBREV_SRC}) GROUP BY abbreviation")
def abbrev_merge(spark, sf):
    return extract.merge_abbreviations(_abbreviations(spark, sf)).select("abbreviation", "meaning", F.size("docs").cast("long").alias("n_docs"), F.array_join("docs", ",").alias("docs"))


@register("abbrev_expand", "SELECT p_partkey, 'a red thing by ' || p_name || ' RWx' AS text FROM part")
def abbrev_expand(spark, sf):
    rows = _names(spark, sf).select("p_partkey", F.concat(F.lit("a RW by "), "p_name", F.lit(" RWx")).alias("text"))
    return extract.expand_abbreviations(rows, {"RW": "red thing", "R": "wrong"})


@register("connector_split", "SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '|' || p_brand AS pieces, 'with|and' AS connectors FROM part")
def connector_split(spark, sf):
    text = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" with "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" and "), "p_brand")
    pieces, connectors = extract.connector_split(text)
    return _names(spark, sf).select("p_partkey", F.array_join(pieces, "|").alias("pieces"), F.array_join(connectors, "|").alias("connectors"))


@register("search_candidates", "SELECT p_partkey, upper(p_name) || '|' || upper(p_name) || ' and ' || p_brand || '|' || p_brand || '|' || lower(p_name) || ' and ' || lower(p_brand) AS candidates FROM part")
def search_candidates(spark, sf):
    raw = F.concat(F.upper("p_name"), F.lit(" and "), "p_brand")
    pieces, _ = extract.connector_split(raw)
    return _names(spark, sf).select("p_partkey", F.array_join(extract.candidates(F.get(pieces, F.lit(0)), raw, pieces), "|").alias("candidates"))


@register("surface_filter", "SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 9 AND NOT (p_type IN ('SMALL', 'LARGE'))")
def surface_filter(spark, sf):
    return extract.surface_filter(_names(spark, sf).withColumn("types", F.array("p_type")), "p_name", "types", 9, ["SMALL", "LARGE"]).select("p_partkey", "p_name")


MATCH_SRC = "SELECT p_name AS text, p_brand AS cand, p_partkey AS qid, p_size % 3 AS score, p_size AS pos FROM part"


@register("match_select", f"WITH c AS ({MATCH_SRC}), h AS (SELECT text, pos, arg_min(qid, -score * 1000000000 + qid) AS qid, max(score) AS score, count(*) AS hits FROM c GROUP BY text, pos), r AS (SELECT *, (hits = 1 OR score > 0) AS clean FROM h) SELECT text, pos, qid, clean FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY NOT clean, CASE WHEN clean THEN pos ELSE 0 END, score DESC, pos) AS k FROM r) WHERE k = 1")
def match_select(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("qid"), (F.col("p_size") % 3).alias("score"), F.col("p_size").alias("pos"))
    return scoring.match_select(hits)


@register("exact_label_lookup", "WITH l AS (SELECT p_name AS label, p_partkey AS id FROM part UNION SELECT p_name || ' ' || lower(p_type), p_partkey FROM part) SELECT label, count(DISTINCT id) AS n, min(id) AS first FROM l WHERE label IN ('red widget', 'hot gear', 'hot gear promo', 'none') GROUP BY label")
def exact_label_lookup(spark, sf):
    p = _names(spark, sf)
    labels = p.select(F.col("p_name").alias("label"), F.col("p_partkey").alias("id")).union(p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")), "p_partkey")).distinct()
    wanted = F.broadcast(spark.createDataFrame([("red widget",), ("hot gear",), ("hot gear promo",), ("none",)], "label string"))
    return labels.join(wanted, "label").groupBy("label").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))


@register("alias_clean", "SELECT p_name AS label, string_agg(DISTINCT lower(p_brand), '|' ORDER BY lower(p_brand)) AS aliases FROM part GROUP BY p_name")
def alias_clean(spark, sf):
    raw = _names(spark, sf).groupBy(F.col("p_name").alias("label")).agg(F.collect_list(F.concat(F.lit(" "), F.upper("p_brand"))).alias("a"))
    return raw.select("label", F.array_join(extract.clean_aliases("label", F.concat("a", F.array(F.upper("label")))), "|").alias("aliases"))


@register("storyboard_score", "SELECT (conv_id * 100 + turn)::VARCHAR AS id, conv_id % 4 <> 3 AS is_json, conv_id % 4 = 2 AS wrapped, conv_id % 4 = 0 AS strict, (CASE conv_id % 4 WHEN 1 THEN 0.85 WHEN 3 THEN 0.2 ELSE 1.0 END)::DOUBLE AS completeness, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS n_scenes, conv_id % 4 <> 3 AND turn % 2 = 0 AS compliant, (CASE conv_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.425 WHEN 2 THEN 0.5 ELSE 0.1 END * CASE WHEN turn % 2 = 0 AND conv_id % 4 <> 3 THEN 1 ELSE 0.5 END)::DOUBLE AS fitness FROM conversations WHERE trim(text) <> ''")
def storyboard_score(spark, sf):
    """Outputs made of every turn: whole, without a field, inside other text, and a plain script; odd turns are asked for two scenes."""
    c = table(spark, sf, "conversations").filter("trim(text) <> ''")
    scene = F.struct(F.lit(1).alias("scene_number"), F.col("text").alias("narration"), F.lit("a chart").alias("visual_description"), F.when(F.col("conv_id") % 4 != 1, F.col("role")).alias("on_screen_text"))
    whole = F.to_json(F.struct(F.lit("T").alias("title"), F.array(scene).alias("scenes")))
    kind = F.col("conv_id") % 4
    text = F.when(kind == 2, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```"))).when(kind == 3, F.lit("**Scene 1**\nNarration: Hello.")).otherwise(whole)
    request = F.when(F.col("turn") % 2 == 0, "Create a brief patient-education scene.").otherwise("Write two scenes on sleep.")
    return scoring.storyboard(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.alias("text"), request.alias("request"))).drop("errors")


@register("spoken_text", "SELECT p_partkey, 'the P R of ' || p_name || ' and PRx, the U S A B' AS text FROM part")
def spoken_text(spark, sf):
    raw = F.concat(F.lit("the PR of "), "p_name", F.lit(" and PRx, the USAB"))
    return _names(spark, sf).select("p_partkey", extract.spell_initialisms(raw, ["PR", "USAB"]).alias("text"))


@register("crossover", r"WITH c AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM conversations WHERE turn < 2 GROUP BY conv_id), h AS (SELECT *, ceil(length(a) / 2)::INT AS ha, ceil(length(b) / 2)::INT AS hb FROM c WHERE a IS NOT NULL AND b IS NOT NULL) SELECT conv_id, trim(substr(a, 1, ha) || regexp_extract(substr(a, ha + 1), '^\S*') || ' ' || regexp_replace(substr(b, hb + 1), '^\S*\s*', '')) AS child FROM h")
def crossover(spark, sf):
    """First half of one text and second half of another, both cut at white space."""
    d = table(spark, sf, "conversations").filter("turn < 2").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).na.drop()
    return d.select("conv_id", extract.crossover("a", "b").alias("child"))


@register("exchange_class", "WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS q, CASE WHEN turn % 2 = 0 THEN text || ' Scene 1: a visual. scene ' || (turn % 4 + 1) ELSE text END AS a FROM conversations) SELECT conv_id, turn, CASE WHEN q = '' OR coalesce(a, '') = '' THEN 'excluded_missing_request_or_response' WHEN turn % 4 = 2 THEN 'storyboard_adaptation' ELSE 'excluded_non_storyboard_or_fragment' END AS kind FROM x")
def exchange_class(spark, sf):
    """Turns as requests; those of even number answered by a text that names scene 1 and a second number."""
    c = table(spark, sf, "conversations")
    answer = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" Scene 1: a visual. scene "), F.col("turn") % 4 + 1)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", scoring.exchange_kind("text", answer).alias("kind"))


@register("chat_exchanges", "WITH x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), e AS (SELECT conv_id, k, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user')) AS request, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant')) AS response FROM x WHERE k > 0 GROUP BY ALL) SELECT conv_id, k::BIGINT AS exchange, request, response, lag(response) OVER (PARTITION BY conv_id ORDER BY k) AS previous FROM e")
def chat_exchanges(spark, sf):
    out = extract.exchanges(table(spark, sf, "conversations"))
    digest = lambda c: F.md5(F.encode(c, "utf-8")).alias(c)
    return out.select("conv_id", "exchange", *(digest(c) for c in ("request", "response", "previous")))


@register("html_text", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(extract.strip_html("html")).cast("long").alias("n"))


READ_SQL = r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences FROM documents),
c AS (SELECT doc_id, lang, len(w)::BIGINT AS words, sentences::BIGINT AS sentences, coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyäöüáéíóúàèìòùâêîôû]+'))))), 0)::BIGINT AS syllables FROM w)
SELECT doc_id, words, sentences, syllables, round(CASE WHEN words > 0 THEN CASE WHEN lang = 'de' THEN 180 - words / sentences - 58.5 * (syllables / words) ELSE 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words) END END, 4) AS ease FROM c"""


@register("readability", READ_SQL)
def readability(spark, sf):
    words, sentences, syllables = repair.counts("text")
    return table(spark, sf, "documents").select("doc_id", words.alias("words"), sentences.alias("sentences"), syllables.alias("syllables"), F.round(repair.flesch("text", F.coalesce(F.col("lang") == "de", F.lit(False))), 4).alias("ease"))


@register("surface_groups", "SELECT lower(replace(f, '-', ' ')) AS key, count(DISTINCT f) AS variants FROM (SELECT unnest([p_name, upper(p_name), replace(p_name, ' ', '-'), p_name || 's']) AS f FROM part) GROUP BY 1")
def surface_groups(spark, sf):
    forms = _names(spark, sf).select(F.explode(F.array("p_name", F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")), F.concat("p_name", F.lit("s")))).alias("f"))
    return forms.groupBy(terms.fold_hyphen("f").alias("key")).agg(F.countDistinct("f").alias("variants"))


@register("answer_rank", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem")
def answer_rank(spark, sf):
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.row_number().over(order).cast("long").alias("r"))
