"""Readers of files that Spark's own readers do not take as they are: loose encodings, mixed JSON, documents, Turtle.

Files are listed and read by Spark (binaryFile), so any store that Spark reaches will do; a file is one
row, and files are spread over the tasks. A schema is always given or fixed, never guessed from data.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.terms import col

#: Tried in this order (fixed values); the last one takes every byte.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def decode_loosely(raw: bytes, encodings: Iterable[str] = ENCODINGS) -> str:
    """The text in the first encoding that takes all bytes."""
    for name in encodings:
        try:
            return raw.decode(name)
        except UnicodeError:
            continue
    return raw.decode("latin-1")


def read_files(spark: SparkSession, path: str, pattern: str = "*", encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """path and text of every file below path whose name fits the pattern, decoded loosely."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"path": part["path"], "text": [decode_loosely(bytes(x), encodings) for x in part["content"]]})

    return raw.select("path", "content").mapInPandas(run, "path string, text string")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every Markdown file below path, in the order of path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def require(rows: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """rows, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}; it has {', '.join(rows.columns)}")
    return rows


def read_table(spark: SparkSession, path: str, required: Iterable[str] = (), sep: str | None = None) -> DataFrame:
    """A table with a header, all columns as text, with an error where a required column is missing.

    The separator is a tab for .tsv, else a comma, unless given (";" for codebooks). The text "null" stays
    text; an empty field is null.
    """
    sep = sep or ("\t" if path.rstrip("/").endswith(".tsv") else ",")
    rows = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    rows = rows.toDF(*(c.strip().lstrip("﻿") for c in rows.columns))
    return require(rows.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns)), required, path)


def read_prior(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of an earlier run; where it does not exist, cannot be read or lacks a column, an empty one."""
    try:
        return read_table(spark, path, columns).select(*columns)
    except Exception as problem:  # noqa: BLE001 - whatever is wrong with it, the run begins anew
        if not re.search(r"PATH_NOT_FOUND|UNABLE_TO_INFER|lacks |Malformed|EMPTY", str(problem)):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def clean_rules(rows: DataFrame, measures: dict[str, list[str]]) -> DataFrame:
    """Rules (Body, Head) whose sides both begin with "?", with each measure from the first of its aliases there is."""
    good = rows.filter(F.trim("Body").startswith("?") & F.trim("Head").startswith("?"))
    found = [F.coalesce(*(F.col(f"`{a}`").try_cast("double") for a in names if a in rows.columns), F.lit(None).cast("double")).alias(c) for c, names in measures.items()]
    return good.select(F.trim("Body").alias("body"), F.trim("Head").alias("head"), *found)


def mined_lines(files: DataFrame) -> DataFrame:
    """path and value of the lines of rule-miner output (path, text) after the header line that names the head coverage."""
    body = F.regexp_replace("text", r"(?s)\A.*?[^\n]*Head Coverage[^\n]*\n", "")
    lines = files.select("path", F.explode(F.split(F.replace(body, F.lit("\r")), "\n")).alias("value"))
    return lines.filter(F.trim("value").startswith("?") & F.contains("value", F.lit("=>")))


# --- JSON ----------------------------------------------------------------------------------------------


def json_records(text: str) -> list[str] | None:
    """The records of a JSON text that is an array, a single object, or one object a line; None if it is none of these."""
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value = [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError:
            return None
    items = value if isinstance(value, list) else [value]
    return [json.dumps(x, ensure_ascii=False) for x in items] if all(isinstance(x, dict) for x in items) else None


def read_json(spark: SparkSession, path: str, schema: str, pattern: str = "*.json*", skip_broken: bool = False) -> DataFrame:
    """path and the fields of schema of every record of the JSON files below path: arrays, single objects, or lines.

    A file that is none of these is an error, or is left out if skip_broken; broken_files lists them.
    """
    files = read_files(spark, path, pattern, ("utf-8-sig", "latin-1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [(p, json_records(t)) for p, t in zip(part["path"], part["text"], strict=True)]
            if not skip_broken and (bad := [p for p, r in found if r is None]):
                raise ValueError(f"not JSON: {bad[0]}")
            yield pd.DataFrame([(p, x) for p, r in found for x in r or []], columns=["path", "record"])

    records = files.mapInPandas(run, "path string, record string")
    return records.select("path", F.from_json("record", schema).alias("r")).select("path", "r.*")


def broken_files(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """path of the files below path that read_json cannot read."""
    broken = F.udf(lambda t: json_records(t) is None, T.BooleanType())
    return read_files(spark, path, pattern, ("utf-8-sig", "latin-1")).filter(broken("text")).select("path")


# --- RDF -----------------------------------------------------------------------------------------------


def repair_nt(text: str) -> str:
    """N-Triples text in which line breaks inside literals are escapes; outside of them, and in IRIs and comments, they stay."""
    out, state, at = [], "outside", 0
    ends = {"literal": re.compile(r'\\.|["\r\n]', re.S), "iri": re.compile(r"[>\r\n]"), "comment": re.compile(r"[\r\n]"), "outside": re.compile(r'["<#]')}
    while m := ends[state].search(text, at):
        sign = m[0]
        out.append(text[at : m.start()])
        at = m.end()
        if state == "literal" and sign in "\r\n":
            out.append({"\r": "\\r", "\n": "\\n"}[sign])
            continue
        out.append(sign)
        if state == "outside":
            state = {'"': "literal", "<": "iri", "#": "comment"}[sign]
        elif len(sign) == 1:
            state = "outside"
    return "".join([*out, text[at:]])


def read_nt_files(spark: SparkSession, path: str, pattern: str = "*.nt") -> DataFrame:
    """The lines of all N-Triples files below path, decoded loosely, with line breaks inside literals repaired."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([(p, line) for p, t in zip(part["path"], part["text"], strict=True) for line in repair_nt(t).splitlines() if line.strip()], columns=["path", "value"])

    return read_files(spark, path, pattern).mapInPandas(run, "path string, value string")


TURTLE = re.compile(r'\s+|#[^\n]*|(<[^>\s]*>)|("""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")|(\^\^|@[A-Za-z-]+|[;,.\[\]()])|([+-]?\d+(?:\.\d+)?)|((?:[\w-]+)?:[\w.-]*[\w-]|[\w-]*:|\w+)')
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text: prefixes, "a", ";" and ",", literals without their tags, blank nodes in brackets, lists as their members.

    For ontologies, which are small: the text is read on the driver.
    """
    words, at = [], 0
    while at < len(text):
        m = TURTLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read Turtle at: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastindex:
            words.append(m[0])
    prefixes, base, triples, place, blank = {}, "", [], 0, 0

    def term(word: str) -> str:
        if word[0] == "<":
            return word[1:-1] if re.match(r"[\w+.-]+:", word[1:-1]) else base + word[1:-1]
        if word[0] == '"':
            edge = 3 if word.startswith('"""') else 1
            return word[edge:-edge].replace('\\"', '"').replace("\\n", "\n")
        if word == "a":
            return f"{RDF}type"
        if ":" in word and not word[0].isdigit():
            name, local = word.split(":", 1)
            return f"_:{local}" if name == "_" else prefixes.get(name, f"{name}:") + local
        return word

    def node() -> list[str]:
        nonlocal place, blank
        word = words[place]
        place += 1
        if word == "[":
            blank += 1
            name = f"_:b{blank}"
            pairs(name, "]")
            place += 1
            return [name]
        if word == "(":
            members: list[str] = []
            while words[place] != ")":
                members += node()
            place += 1
            return members
        while place < len(words) and (words[place] == "^^" or words[place][0] == "@"):
            place += 2 if words[place] == "^^" else 1
        return [term(word)]

    def pairs(subject: str, stop: str) -> None:
        nonlocal place
        while words[place] != stop:
            if words[place] == ";":
                place += 1
                continue
            predicate = node()[0]
            while True:
                triples.extend((subject, predicate, o) for o in node())
                if words[place] != ",":
                    break
                place += 1

    while place < len(words):
        word = words[place]
        if word.lower().lstrip("@") in ("prefix", "base"):
            if word.lower().endswith("prefix"):
                prefixes[words[place + 1][:-1]] = words[place + 2][1:-1]
                place += 3
            else:
                base = words[place + 1][1:-1]
                place += 2
            place += place < len(words) and words[place] == "."
            continue
        subject = node()[0]
        pairs(subject, ".")
        place += 1
    return triples


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of the Turtle files at path (an ontology: a few small files)."""
    texts = [r["text"] for r in read_files(spark, path, "*.ttl").orderBy("path").collect()]
    return spark.createDataFrame([t for text in texts for t in parse_turtle(text)], "s string, p string, o string").distinct()


def read_bindings(spark: SparkSession, payload: str) -> DataFrame:
    """A SPARQL endpoint's JSON answer as a table of text columns; an unbound variable is null."""
    answer = json.loads(payload)
    names = answer["head"]["vars"]
    rows = [tuple(b.get(v, {}).get("value") for v in names) for b in answer["results"]["bindings"]]
    return spark.createDataFrame(rows, T.StructType([T.StructField(v, T.StringType()) for v in names]))


# --- documents -----------------------------------------------------------------------------------------

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(raw: bytes) -> list[str]:
    """The paragraphs of a Word document."""
    with zipfile.ZipFile(io.BytesIO(raw)) as parts:
        root = ElementTree.fromstring(parts.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in root.iter(f"{WORD}p")]


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, paragraph (from 0) and text of the Word, Markdown and text files below path; other kinds are an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                if kind not in ("docx", "md", "txt"):
                    raise ValueError(f"cannot read a document of kind {kind}: {name}")
                found = docx_paragraphs(bytes(content)) if kind == "docx" else re.split(r"\n\s*\n", decode_loosely(bytes(content)))
                rows += [(name, i, text) for i, text in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "paragraph", "text"])

    return raw.mapInPandas(run, "path string, paragraph int, text string")


def speaker(text) -> tuple[Column, Column]:
    """Role (user, assistant or null) by the speaker's prefix of a chat paragraph, and the rest of the text."""
    c = col(text)
    role = F.when(c.rlike(r"^(P|Du):"), "user").when(c.rlike(r"^(O|ChatGPT):"), "assistant")
    return role, F.regexp_replace(c, r"^(?:P|Du|O|ChatGPT):\s*", "")
