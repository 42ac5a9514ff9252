"""Declarative table-to-triple mappings: a spec of subject templates and predicate-object pairs.

Each predicate is one projection of its source, with the predicate as a constant, so a pattern that asks
for one predicate prunes all other branches of the graph and reads only the columns it needs. Null and
empty values give no triple. Columns that the source lacks are an error.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import terms


@dataclass(frozen=True)
class Template:
    """An IRI with {column} places, percent-encoded."""

    text: str

    def columns(self):
        return re.findall(r"\{(\w+)\}", self.text)

    def render(self, whole: Collection[str] = ()) -> Column:
        """The IRI; columns of whole numbers, which have nothing to encode, can be named."""
        pieces = re.split(r"\{(\w+)\}", self.text)
        place = lambda c: F.col(c).cast("string") if c in whole else terms.pct_encode(F.col(c).cast("string"))
        return F.concat(*(place(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p))


@dataclass(frozen=True)
class Literal:
    """A column's value; a language wins over a datatype."""

    column: str
    lang: str | None = None
    datatype: str | None = None

    def columns(self):
        return [self.column]


@dataclass(frozen=True)
class Constant:
    iri: str

    def columns(self):
        return []


@dataclass(frozen=True)
class Each:
    """One object for each element of an array column: template applied to the element as {it}."""

    column: str
    template: str

    def columns(self):
        return [self.column]


@dataclass(frozen=True)
class Reference:
    """The subjects of another mapping whose parent column equals this child column; every match counts."""

    parent: TripleMap
    child: str
    parent_column: str

    def columns(self):
        return [self.child]


@dataclass(frozen=True)
class TripleMap:
    source: str
    subject: Template
    cls: str | None = None
    pairs: tuple[tuple[str, object], ...] = field(default_factory=tuple)


def triples(spec: TripleMap, sources: dict[str, DataFrame], lenient: bool = False, once: bool = False) -> DataFrame:
    """All triples of one mapping (s, p, o, o_kind), with duplicates of the source's rows, or each once.

    Repeats are removed from the raw columns, before any IRI is made: they are shorter than the rendered
    text, and rendering is done for what is left only.
    """
    rows = sources[spec.source]
    used = {c for part in (spec.subject, *(o for _, o in spec.pairs)) for c in part.columns()}
    missing = used - set(rows.columns)
    if missing and not lenient:
        raise ValueError(f"{spec.source} has no column {sorted(missing)}")
    subject = spec.subject.render().alias("s")

    def entry(p: str, o: Column, kind: str, columns: list[str]) -> DataFrame:
        raw = rows.select(*dict.fromkeys([*spec.subject.columns(), *columns]))
        return (raw.distinct() if once else raw).select(subject, F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    made = [entry("type", F.lit(spec.cls), "iri", [])] if spec.cls else []
    for predicate, what in spec.pairs:
        if set(what.columns()) & missing:
            continue
        if isinstance(what, Template):
            made.append(entry(predicate, what.render(), "iri", what.columns()))
        elif isinstance(what, Literal):
            made.append(entry(predicate, F.col(what.column).cast("string"), "literal", what.columns()))
        elif isinstance(what, Constant):
            made.append(entry(predicate, F.lit(what.iri), "iri", []))
        elif isinstance(what, Each):
            head, tail = what.template.split("{it}")
            each = rows.select(subject, F.explode(what.column).alias("it")).withColumn("it", F.col("it").cast("string")).filter("it is not null and it <> ''")
            each = each.select("s", F.lit(predicate).alias("p"), F.concat(F.lit(head), terms.pct_encode("it"), F.lit(tail)).alias("o"), F.lit("iri").alias("o_kind"))
            made.append(each.distinct() if once else each)
        else:
            parent = sources[what.parent.source].select(what.parent.subject.render().alias("o"), F.col(what.parent_column).alias("__key"))
            joined = rows.select(subject, F.col(what.child).alias("__key")).join(parent, "__key")
            joined = joined.select("s", F.lit(predicate).alias("p"), "o", F.lit("iri").alias("o_kind"))
            made.append(joined.distinct() if once else joined)
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.filter("s is not null and o is not null and o <> ''")


def stars(specs: list[TripleMap], sources: dict[str, DataFrame]) -> DataFrame:
    """node and near: a subject and the IRIs that its predicates, but for type, lead to; with repeats, and null for what gives none.

    All predicates of a mapping are read from one scan of its source, so a join behind it runs once, not once for
    each predicate. Only a predicate that needs the subjects of another mapping is a scan of its own.
    """
    made = []
    for spec in specs:
        pairs = [what for p, what in spec.pairs if p != "type" and not isinstance(what, Literal)]
        missing = {c for part in (spec.subject, *pairs) for c in part.columns()} - set(sources[spec.source].columns)
        if missing:
            raise ValueError(f"{spec.source} has no column {sorted(missing)}")
        rows = sources[spec.source].dropna(subset=spec.subject.columns()) if spec.subject.columns() else sources[spec.source]
        node, own, lists = _iri(spec.subject, rows).alias("node"), [], []
        for what in pairs:
            if isinstance(what, Template):
                own.append(_iri(what, rows))
            elif isinstance(what, Constant):
                own.append(F.lit(what.iri))
            elif isinstance(what, Each):
                lists.append(F.coalesce(_each(what), F.array().cast("array<string>")))
            else:
                parent = sources[what.parent.source]
                parent = parent.select(_iri(what.parent.subject, parent).alias("o"), F.col(what.parent_column).alias("__key"))
                made.append(rows.select(node, F.col(what.child).alias("__key")).join(parent, "__key").select("node", F.array("o").alias("near")))
        if own or lists:  # not filtered here: that would take the arrays out of generated code
            near = F.array(*own).cast("array<string>")
            made.append(rows.select(node, F.concat(near, *lists).alias("near") if lists else near.alias("near")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _iri(template: Template, rows: DataFrame) -> Column:
    iri = template.render([c for c in rows.columns if _whole(rows, c)])
    return iri if re.sub(r"\{\w+\}", "", template.text) else F.nullif(iri, F.lit(""))


def _each(what: Each) -> Column:
    head, tail = what.template.split("{it}")
    return F.transform(what.column, lambda it: F.when(it.cast("string") != "", F.concat(F.lit(head), terms.pct_encode(it.cast("string")), F.lit(tail))))


def _whole(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def _one_to_one(template: Template, rows: DataFrame) -> bool:
    """Whether different values give different IRIs: at most one column is not a whole number, and places do not touch."""
    loose = [c for c in template.columns() if c in rows.columns and not _whole(rows, c)]
    return len(loose) == 0 or len(template.columns()) == 1 if "}{" not in template.text else False


def _apart(specs: list[TripleMap]) -> bool:
    """Whether no two entries of the mappings can give the same triple: where they share a predicate, their subjects
    begin differently or both objects are different constants."""
    entries: dict[str, list[tuple[str, str | None]]] = {}
    for spec in specs:
        head = spec.subject.text.split("{")[0]
        if spec.cls:
            entries.setdefault("type", []).append((head, spec.cls))
        for predicate, what in spec.pairs:
            entries.setdefault(predicate, []).append((head, what.iri if isinstance(what, Constant) else None))
    for some in entries.values():
        for i, (a, x) in enumerate(some):
            for b, y in some[:i]:
                if (a.startswith(b) or b.startswith(a)) and (x is None or y is None or x == y):
                    return False
    return True


def graph(specs: list[TripleMap], sources: dict[str, DataFrame]) -> DataFrame:
    """The set of triples of several mappings.

    Where the mappings cannot give a triple twice by different ways, each one drops its own repeats, in raw
    columns; else the whole is made distinct.
    """
    plain = _apart(specs) and all(_one_to_one(t, sources[s.source]) for s in specs for t in (s.subject, *(o for _, o in s.pairs)) if isinstance(t, Template))
    made = [triples(s, sources, once=plain) for s in specs]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out if plain else out.distinct()
