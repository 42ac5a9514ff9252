"""Answer resolution, match selection, storyboard scores and evaluation metrics."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.terms import col, normalize_answer


def resolve_answer(text, mode: str = "strict") -> tuple[Column, Column]:
    """yes or no, and how: an explicit "Answer: ..." (the last one if strict, else the first), else the only bare word,
    else, if not strict, the word that comes first, else no."""
    t = F.lower(col(text))
    explicit = F.regexp_extract_all(t, F.lit(r"answer:\s*(yes|no)\b"))
    every = F.regexp_extract_all(t, F.lit(r"\b(yes|no)\b"))
    words = F.array_distinct(every)
    answer = F.when(F.size(explicit) > 0, F.element_at(explicit, -1 if mode == "strict" else 1)).when(F.size(words) == 1, F.get(words, F.lit(0)))
    how = F.when(F.size(explicit) > 0, "explicit").when(F.size(words) == 1, "word")
    if mode != "strict":
        answer, how = answer.when(F.size(every) > 0, F.get(every, F.lit(0))), how.when(F.size(every) > 0, "first")
    return answer.otherwise("no"), how.otherwise("default")


def match_select(hits: DataFrame) -> DataFrame:
    """Best match of each text among hits (text, pos, qid, score).

    Within a candidate position the highest score wins, then the least id. A position is clean if it has one
    hit or a positive score. The first clean position wins; if none is clean, the best score, then the first.
    """
    best = hits.groupBy("text", "pos").agg(F.min_by("qid", F.struct(-F.col("score"), "qid")).alias("qid"), F.max("score").alias("score"), F.count("*").alias("hits"))
    best = best.withColumn("clean", (F.col("hits") == 1) | (F.col("score") > 0))
    order = Window.partitionBy("text").orderBy(F.col("clean").desc(), F.when(F.col("clean"), F.col("pos")).otherwise(0), F.col("score").desc(), "pos")
    return best.withColumn("k", F.row_number().over(order)).filter("k = 1").select("text", "pos", "qid", "clean")


#: Fields of a storyboard's scene with the share of the score that they give, and the shares of an object, its title and its scenes (fixed values).
SCENE_FIELDS = {"scene_number": 0.1, "narration": 0.2, "visual_description": 0.15, "on_screen_text": 0.15}
OBJECT, TITLE, SCENES = 0.2, 0.1, 0.1
#: What a plain script labels, each worth 0.1 (fixed values).
LABELS = (r"\bscene\s*\d+", r"\b(?:narration|voiceover|narrator|doctor\s+(?:says|speaks)|dr\.?\s+\w+\s*:)", r"\b(?:visuals?|visual description|background)\s*:", r"\b(?:on.screen text|screen text)\s*:")
COUNT_WORDS = {"one": 1, "single": 1, "two": 2, "three": 3, "four": 4, "five": 5}


def storyboard_object(text: str | None) -> tuple[dict | None, bool]:
    """The JSON object of a model's output, and whether other text surrounds it; None if there is no whole object."""
    decoder = json.JSONDecoder()
    try:
        value = decoder.decode(text or "")
        return (value if isinstance(value, dict) else None), False
    except ValueError:
        pass
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text[at:])
            if {"title", "scenes"} & set(value):
                return value, True
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None, False


def inspect_storyboard(text: str | None) -> dict:
    """is_json, wrapped, strict, completeness, n_scenes and errors of a model's output."""
    filled = lambda x: isinstance(x, str) and bool(x.strip())
    value, wrapped = storyboard_object(text)
    if value is None:
        labels = sum(0.1 for p in LABELS if re.search(p, text or "", re.I))
        return {"is_json": False, "wrapped": False, "strict": False, "completeness": labels, "n_scenes": 0, "errors": ["no storyboard object"]}
    errors = ["other text around the object"] if wrapped else []
    scenes = value.get("scenes") if isinstance(value.get("scenes"), list) else []
    if not filled(value.get("title")):
        errors.append("title")
    if not scenes:
        errors.append("scenes")
    score = OBJECT + TITLE * filled(value.get("title")) + SCENES * bool(scenes)
    for field, share in SCENE_FIELDS.items():
        good = 0
        for place, scene in enumerate(scenes, 1):
            found = scene.get(field) if isinstance(scene, dict) else None
            fine = type(found) is int and found == place if field == "scene_number" else filled(found)
            good += fine
            if not fine:
                errors.append(f"scene {place}: {field}")
        score += share * good / max(1, len(scenes))
    return {"is_json": True, "wrapped": wrapped, "strict": not errors, "completeness": min(1.0, score), "n_scenes": len(scenes), "errors": errors}


def wanted_scenes(request) -> Column:
    """How many scenes a request asks for, or null: "two scenes", "3-scene", or "create a ... scene" for one."""
    c = F.lower(col(request))
    said = F.regexp_extract(c, r"\b(one|single|two|three|four|five|\d+)[ -]scenes?\b", 1)
    number = F.when(said.rlike(r"^\d+$"), said.cast("int"))
    for word, n in COUNT_WORDS.items():
        number = F.coalesce(number, F.when(said == word, n))
    one = c.rlike(r"\b(create|generate|write|produce)\s+an?\s+([\w‐-―-]+\s+){0,6}scene\b")
    return F.coalesce(number, F.when(one, 1))


STORYBOARD = "id string, request string, is_json boolean, wrapped boolean, strict boolean, completeness double, n_scenes int, errors array<string>"


def storyboard(rows: DataFrame, strict_weight: float = 0.5) -> DataFrame:
    """id, is_json, wrapped, strict, completeness, n_scenes, compliant, fitness, errors of model outputs (id, text, request).

    strict is an object by itself with all fields; completeness gives partial credit, also to an object in
    other text and, up to 0.4, to a labelled plain script; fitness is their weighted mean, halved if the
    request names a number of scenes that the output does not have. Null texts score 0; a null request asks
    for nothing.
    """

    def run(batches):
        for part in batches:
            found = [inspect_storyboard(t) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "request": part["request"], **{k: [f[k] for f in found] for k in ("is_json", "wrapped", "strict", "completeness", "n_scenes", "errors")}})

    out = rows.selectExpr("cast(id as string) as id", "text", "request").mapInPandas(run, STORYBOARD)
    wanted = wanted_scenes("request")
    compliant = F.col("n_scenes") > 0
    out = out.withColumn("compliant", compliant & (wanted.isNull() | (wanted == F.col("n_scenes"))))
    fitness = strict_weight * F.col("strict").cast("double") + (1 - strict_weight) * F.col("completeness")
    out = out.withColumn("fitness", F.when(wanted.isNotNull() & ~F.col("compliant"), fitness * 0.5).otherwise(fitness))
    return out.select("id", "is_json", "wrapped", "strict", F.round("completeness", 6).alias("completeness"), "n_scenes", "compliant", F.round("fitness", 6).alias("fitness"), "errors")


def exchange_kind(request, response) -> Column:
    """Kind of a chat exchange: excluded without a request or response or by what it asks for; a storyboard if it has two
    numbered scenes and names what is seen or said; else a fragment."""
    q, a = F.coalesce(col(request), F.lit("")), F.coalesce(col(response), F.lit(""))
    scenes = F.size(F.array_distinct(F.regexp_extract_all(a, F.lit(r"(?i)(?:szene|scene)\s*(\d+)"), 1)))
    source = q.rlike(r"(?i)(technische probleme|wort für wort|direktes zitat|quellenangaben|kannst du.*zugreifen)")
    shown = a.rlike(r"(?i)(voiceover|sprecher|arzt spricht|narrator|erzähler|off-text|bild|visuell|visual|animation|hintergrund)")
    return F.when((q == "") | (a == ""), "excluded_missing_request_or_response").when(source, "excluded_source_access_or_quote_request").when((scenes >= 2) & shown, "storyboard_adaptation").otherwise("excluded_non_storyboard_or_fragment")


def qa_scores(pairs: DataFrame) -> DataFrame:
    """Adds hit, precision, recall, f1 and hard of each row of pairs (gold, predicted, hard_answer); null predictions are empty sets."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: normalize_answer(x)), lambda x: x != ""))
    out = pairs.withColumn("g", clean("gold")).withColumn("q", clean("predicted"))
    k = F.size(F.array_intersect("g", "q"))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    out = out.withColumn("hit", (k > 0).cast("int")).withColumn("precision", ratio(k, F.size("q"))).withColumn("recall", ratio(k, F.size("g")))
    out = out.withColumn("f1", ratio(2.0 * k, F.size("g") + F.size("q")))
    return out.withColumn("hard", F.array_contains("q", normalize_answer("hard_answer")).cast("int")).drop("g", "q")


def binary_metrics(rows: DataFrame, unknown_is_wrong: bool = False) -> DataFrame:
    """n, accuracy, precision, recall, f1, macro_f1, coverage of rows (label, predicted), yes = 1; a null prediction is unresolved."""
    p, y = F.col("predicted"), F.col("label")
    known = p.isNotNull()
    used = rows if unknown_is_wrong else rows.filter(known)
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    a = used.agg(F.count("*").alias("n"), count(known).alias("k"), count((p == 1) & (y == 1)).alias("tp"), count((p == 1) & (y == 0)).alias("fp"), count((y == 1) & (F.coalesce(p, F.lit(-1)) != 1)).alias("fn"), count((p == 0) & (y == 0)).alias("tn"), count((y == 0) & (F.coalesce(p, F.lit(-1)) != 0)).alias("fpn"), count((p == 0) & (y == 1)).alias("fnn"))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    f1 = lambda tp, fp, fn: ratio(2.0 * tp, 2 * tp + fp + fn)
    c = F.col
    yes, no = f1(c("tp"), c("fp"), c("fn")), f1(c("tn"), c("fnn"), c("fpn"))
    r = lambda x: F.round(x, 6)
    return a.select("n", r(ratio(c("tp") + c("tn"), c("n"))).alias("accuracy"), r(ratio(c("tp"), c("tp") + c("fp"))).alias("precision"), r(ratio(c("tp"), c("tp") + c("fn"))).alias("recall"), r(yes).alias("f1"), r((yes + no) / 2).alias("macro_f1"), r(ratio(c("k"), c("n"))).alias("coverage"))
