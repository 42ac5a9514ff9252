"""Extractors and candidate builders on text columns; all of them built from SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.terms import col, fold, squeeze


def entities(text, patterns: list[str]) -> Column:
    """All matches of each pattern, pattern by pattern, without repeats."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(col(text), F.lit(f"({p})")) for p in patterns)))


def table_abbreviations(docs: DataFrame) -> DataFrame:
    """doc, abbreviation, meaning of the rows of Markdown tables with an abbreviation header. docs has doc and text.

    Lines are numbered; a header opens a block that ends with the first line that is no table row.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    is_row = F.trim("line").startswith("|")
    by_doc = Window.partitionBy("doc").orderBy("n")
    lines = lines.withColumn("block", F.sum((~is_row).cast("int")).over(by_doc)).filter(is_row)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = lines.withColumn("cells", cells)
    header = lines.filter(F.lower(F.get("cells", F.lit(0))).rlike("abbrev|abk")).select("doc", "block", F.col("n").alias("header"))
    body = lines.join(header, ["doc", "block"]).filter("n > header").filter(~F.get("cells", F.lit(0)).rlike("^:?-+:?$"))
    return body.filter(F.get("cells", F.lit(0)).rlike("^[A-Z][A-Za-z0-9-]{1,9}$")).select("doc", F.get("cells", F.lit(0)).alias("abbreviation"), F.get("cells", F.lit(1)).alias("meaning")).distinct()


def footnote_abbreviations(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc, abbreviation, meaning of paragraphs of "AB: meaning; CD: meaning" with at least two hits."""
    paragraphs = docs.select("doc", F.posexplode(F.split("text", r"\n\s*\n")).alias("n", "paragraph"))
    parts = paragraphs.select("doc", "n", F.explode(F.split("paragraph", ";")).alias("part"))
    shape = r"^\s*([A-Z][A-Z0-9-]{1,9})\s*[:=]\s*(.+?)\s*$"
    hits = parts.filter(F.col("part").rlike(shape)).select("doc", "n", F.regexp_extract("part", shape, 1).alias("abbreviation"), F.regexp_extract("part", shape, 2).alias("meaning"))
    return hits.withColumn("k", F.count("*").over(Window.partitionBy("doc", "n"))).filter(F.col("k") >= least).select("doc", "abbreviation", "meaning")


def inline_abbreviations(docs: DataFrame) -> DataFrame:
    """doc, abbreviation, meaning of "some words (SW)": as many words before as the abbreviation has letters, with its initials."""
    hits = docs.select("doc", "text", F.explode(F.regexp_extract_all("text", F.lit(r"\(([A-Z]{2,8})\)"))).alias("abbreviation"))
    before = F.regexp_replace(F.split_part("text", F.concat(F.lit("("), F.col("abbreviation"), F.lit(")")), F.lit(1)), "-", " ")
    words = F.filter(F.split(F.trim(before), r"\s+"), lambda w: w != "")
    k = F.length("abbreviation")
    taken = F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k)
    initials = F.upper(F.array_join(F.transform(taken, lambda w: F.substring(w, 1, 1)), ""))
    return hits.withColumn("taken", taken).filter(initials == F.col("abbreviation")).select("doc", "abbreviation", F.array_join("taken", " ").alias("meaning")).distinct()


def merge_abbreviations(found: DataFrame) -> DataFrame:
    """One row per abbreviation: the meaning of the most trusted method (then position), and all its documents."""
    return found.groupBy("abbreviation").agg(F.min_by("meaning", F.struct("method", "pos")).alias("meaning"), F.array_sort(F.collect_set("doc")).alias("docs"))


def expand_abbreviations(rows: DataFrame, meanings: dict[str, str], column: str = "text") -> DataFrame:
    """Whole-word abbreviations replaced, longest first, in one pass over the words."""
    names = sorted(meanings, key=lambda n: (-len(n), n))
    table = F.create_map(*(F.lit(x) for n in names for x in (n, meanings[n])))
    pattern = r"\b(" + "|".join(re.escape(n) for n in names) + r")\b"
    text = F.col(column)
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern))
    swapped = F.transform(hits, lambda h: table[h])
    pairs = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(swapped, i), F.lit(""))))
    return rows.withColumn(column, F.array_join(pairs, ""))


CONNECTOR = r"(?i)\s+(with|and|or)\s+"


def connector_split(text) -> tuple[Column, Column]:
    """Pieces between connectors, and the connectors in order."""
    c = col(text)
    return F.split(c, CONNECTOR), F.transform(F.regexp_extract_all(c, F.lit(CONNECTOR), 1), lambda x: F.lower(x))


def candidates(expanded, raw, pieces, shortest: int = 2, longest: int = 150) -> Column:
    """Search texts in order: expanded form, raw form, pieces, lower case last; no repeats, bounded length."""
    every = F.concat(F.array(col(expanded), col(raw)), col(pieces), F.array(F.lower(col(raw))))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest)))


def surface_filter(rows: DataFrame, form: str, types: str, longest: int, dropped: list[str]) -> DataFrame:
    """Rows whose form is not too long and whose types are not all among those dropped."""
    other = F.array_except(types, F.array(*(F.lit(t) for t in dropped)))
    return rows.filter((F.length(form) <= longest) & ~((F.size(types) > 0) & (F.size(other) == 0)))


def clean_aliases(label, aliases) -> Column:
    """Folded aliases, sorted, without repeats and without the label."""
    folded = F.transform(col(aliases), lambda a: fold(a))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda a: a.isNotNull() & (a != "") & (a != fold(label)))))


def spell_initialisms(text, names: list[str]) -> Column:
    """Initialisms as separate letters, longest first, whole words only."""
    out = col(text)
    for n in sorted(names, key=lambda n: -len(n)):
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9]){re.escape(n)}(?![A-Za-z0-9])", " ".join(n))
    return out


def crossover(a, b) -> Column:
    """The first half of a and the second half of b, each cut at the next white space."""
    half = lambda c: F.ceil(F.length(c) / 2).cast("int")
    a, b = col(a), col(b)
    first = F.regexp_extract(F.substr(a, half(a) + 1), r"^\S*", 0)
    second = F.regexp_replace(F.substr(b, half(b) + 1), r"^\S*\s*", "")
    return F.trim(F.concat(F.substr(a, F.lit(1), half(a)), first, F.lit(" "), second))


def exchanges(turns: DataFrame) -> DataFrame:
    """Requests and responses of conversations: a user turn opens an exchange; previous is the response before it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(by)).filter("exchange > 0")
    join = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    out = numbered.groupBy("conv_id", "exchange").agg(join("user").alias("request"), F.nullif(join("assistant"), F.lit("")).alias("response"))
    return out.withColumn("previous", F.lag("response").over(Window.partitionBy("conv_id").orderBy("exchange")))


def strip_html(html) -> Column:
    """Text of a page: without comments, scripts, styles and tags; white space squeezed."""
    out = F.regexp_replace(col(html), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(out, r"<[^>]*>", " "))
