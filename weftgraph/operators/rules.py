"""Horn rules over triple tables: parsing, grounding, labels, quality measures, contamination filters."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import bgp
from weftgraph.plans.bgp import Atom

#: The seven trailing numbers of a mined rule's line (fixed format).
STATS = ["head_coverage", "std_confidence", "pca_confidence", "positive_examples", "body_size", "pca_body_size", "functional_variable"]


def parse_mined(lines: DataFrame, column: str = "value") -> DataFrame:
    """rule, body, head and the measures of mined-rule lines ("?a p ?b ... => ?a q ?b  stats"); other lines are skipped."""
    words = F.split(F.trim(column), r"\s+")
    rows = lines.filter(F.trim(column).startswith("?") & F.contains(column, F.lit("=>"))).withColumn("w", words)
    n = F.size("w")
    rows = rows.withColumn("rule", F.array_join(F.slice("w", F.lit(1), n - 7), " "))
    sides = F.split("rule", r"\s*=>\s*")
    atoms = lambda text: F.transform(F.sequence(F.lit(0), (F.size(F.split(text, " ")) / 3).cast("int") - 1), lambda i: F.array_join(F.slice(F.split(text, " "), i * 3 + 1, 3), " "))
    stats = [F.element_at("w", i - 7) for i in range(7)]
    numbers = [s.try_cast("double").alias(c) if i < 3 else s.alias(c) for i, (s, c) in enumerate(zip(stats, STATS, strict=True))]
    return rows.select("rule", atoms(sides[0]).alias("body"), atoms(sides[1]).alias("head"), *numbers)


def parse_rule(text: str) -> tuple[list[Atom], Atom]:
    """Body atoms and head atom of "?a p ?b ... => ?a q ?c"."""
    body, head = (re.split(r"\s+", side.strip()) for side in text.split("=>"))
    triples = [tuple(body[i : i + 3]) for i in range(0, len(body), 3)]
    if any(len(t) != 3 for t in triples) or len(head) != 3:
        raise ValueError(f"not made of triples: {text}")
    return triples, tuple(head)


def value(term: str) -> Column:
    return F.col(bgp.name(term)) if bgp.is_var(term) else F.lit(term)


def head_triple(head: Atom) -> list[Column]:
    return [value(t).alias(c) for t, c in zip(head, ("hs", "hp", "ho"), strict=True)]


def groundings(graph: DataFrame, body: list[Atom], head: Atom) -> DataFrame:
    """Bindings whose body and head triples are all facts, except where the head is one of its own body's triples."""
    rows = bgp.match(graph, body)
    facts = graph.select(F.col("s").alias("hs"), F.col("p").alias("hp"), F.col("o").alias("ho"))
    variables = rows.columns
    found = rows.select("*", *head_triple(head)).join(facts, ["hs", "hp", "ho"], "left_semi")
    for atom in body:
        same = [value(a) == F.col(h) for a, h in zip(atom, ("hs", "hp", "ho"), strict=True)]
        found = found.filter(~(same[0] & same[1] & same[2]))
    return found.select(*variables).distinct()


def labelled(graph: DataFrame, body: list[Atom], head: Atom) -> DataFrame:
    """Distinct bindings of the body, with label yes where the head is a fact, else no."""
    rows = bgp.match(graph, body)
    variables = rows.columns
    facts = graph.select(F.col("s").alias("hs"), F.col("p").alias("hp"), F.col("o").alias("ho")).distinct().withColumn("there", F.lit(True))
    out = rows.distinct().select("*", *head_triple(head)).join(facts, ["hs", "hp", "ho"], "left")
    return out.select(*variables, F.when(F.col("there"), "yes").otherwise("no").alias("label"))


def quality(graph: DataFrame, body: list[Atom], head: Atom) -> DataFrame:
    """support, body_size, pca_body_size, head_coverage, std_confidence, pca_confidence of a rule whose head has two variables (functional in its subject)."""
    x, y = bgp.name(head[0]), bgp.name(head[2])
    pairs = bgp.match(graph, body).select(x, y).distinct()
    facts = graph.filter(F.col("p") == head[1]).select(F.col("s").alias(x), F.col("o").alias(y)).distinct()
    known = facts.groupBy(x).agg(F.collect_set(y).alias("known"))
    # the body is matched once: each pair knows whether its subject has the head's predicate, and whether with its object
    flagged = pairs.join(known, x, "left").select(F.col("known").isNotNull().alias("pca"), F.coalesce(F.array_contains("known", F.col(y)), F.lit(False)).alias("held"))
    count = lambda c: F.count(F.when(c, 1))
    sizes = flagged.agg(count(F.col("held")).alias("support"), F.count("*").alias("body_size"), count(F.col("pca")).alias("pca_body_size"))
    row = sizes.crossJoin(facts.agg(F.count("*").alias("head_size")))  # two rows of a few numbers
    ratio = lambda n, d: F.round(F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0), 6)
    return row.select("support", "body_size", "pca_body_size", ratio("support", "head_size").alias("head_coverage"), ratio("support", "body_size").alias("std_confidence"), ratio("support", "pca_body_size").alias("pca_confidence"))


def mine(graph: DataFrame, predicates: list[str], head_coverage: float = 0.1, std: float = 0.3, pca: float = 0.4) -> list[tuple[str, dict]]:
    """Closed rules of one or two body atoms over the predicates, with measures that reach the thresholds."""
    out = []
    for head in predicates:
        shapes = [[("?a", p, "?b")] for p in predicates if p != head] + [[("?b", p, "?a")] for p in predicates]
        shapes += [[("?a", p, "?c"), ("?c", q, "?b")] for p, q in itertools.product(predicates, repeat=2)]
        for body in shapes:
            q = quality(graph, body, ("?a", head, "?b")).first().asDict()
            if q["support"] and q["head_coverage"] >= head_coverage and q["std_confidence"] >= std and q["pca_confidence"] >= pca:
                out.append((" ".join(" ".join(a) for a in body) + f" => ?a {head} ?b", q))
    return out


def uncontaminated(rows: DataFrame) -> DataFrame:
    """Groundings (id, head, body: array of triples as text) whose head occurs in no other grounding's body."""
    bodies = rows.select(F.col("id").alias("other"), F.explode("body").alias("head"))
    hit = rows.select("id", "head").join(bodies, "head").filter("id <> other").select("id").distinct()
    return rows.join(hit, "id", "left_anti")


def complete_answers(asked: DataFrame, graph: DataFrame) -> DataFrame:
    """head, relation, answers: all distinct tails of each asked (head, relation), in order."""
    tails = graph.select(F.col("s").alias("head"), F.col("p").alias("relation"), F.col("o").alias("tail"))
    return asked.distinct().join(tails, ["head", "relation"], "left").groupBy("head", "relation").agg(F.array_sort(F.collect_set("tail")).alias("answers"))


def remove_heads(graph: DataFrame, heads: DataFrame) -> DataFrame:
    """The graph without the grounded head triples (s, p, o)."""
    return graph.join(heads.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def parse_groundings(texts, atom_separator: str = "|") -> Column:
    """Array of structs (body, head) of "s p o | s p o => s p o, ..."; malformed segments go."""
    segments = F.transform(F.split(texts, ","), lambda x: F.split(F.trim(x), r"\s*=>\s*"))
    triples = lambda side: F.filter(F.transform(F.split(side, re.escape(atom_separator).replace("\\|", "[|]")), lambda a: F.split(F.trim(a), r"\s+")), lambda t: F.size(t) == 3)
    good = F.filter(segments, lambda s: F.size(s) == 2)
    return F.transform(good, lambda s: F.struct(triples(s[0]).alias("body"), triples(s[1]).alias("head")))
