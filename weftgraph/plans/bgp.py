"""Graph patterns as DataFrame joins: atoms, optional parts, negation, inline values, paths.

An atom is (s, p, o); a term that starts with "?" is a variable. Each atom becomes one filtered scan;
atoms join on the variables they share, most selective first, and Catalyst orders the rest. Results are
bags of bindings, one column for each variable.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import shared

Atom = tuple[str, str, str]


def is_var(term: str) -> bool:
    return term.startswith("?")


def name(term: str) -> str:
    return term[1:]


def variables(atoms: Iterable[Atom]) -> list[str]:
    return list(dict.fromkeys(name(t) for a in atoms for t in a if is_var(t)))


def scan(graph: DataFrame, atom: Atom) -> DataFrame:
    """Bindings of one atom; a variable that occurs twice must have one value."""
    rows, columns = graph, {}
    for place, term in zip("spo", atom, strict=True):
        if not is_var(term):
            rows = rows.filter(F.col(place) == term)
        elif name(term) in columns:
            rows = rows.filter(F.col(columns[name(term)]) == F.col(place))
        else:
            columns[name(term)] = place
    return rows.select(*(F.col(place).alias(v) for v, place in columns.items())) if columns else rows.select(F.lit(1).alias("_")).limit(1)


def ordered(atoms: list[Atom]) -> list[Atom]:
    """Connected order that begins with the atom of most constants."""
    left, out, bound = list(atoms), [], set()
    while left:
        key = lambda a: (not out or bool(bound & set(variables([a]))) or not variables([a]), sum(not is_var(t) for t in a))
        best = max(left, key=key)
        left.remove(best)
        out.append(best)
        bound |= set(variables([best]))
    return out


def match(graph: DataFrame, atoms: list[Atom], start: DataFrame | None = None, cross: bool = False) -> DataFrame:
    """Bindings of all atoms together, joined with start if given. Unconnected parts need cross=True."""
    out = start
    for atom in ordered(atoms):
        rows = scan(graph, atom)
        if out is None:
            out = rows
            continue
        shared = [c for c in rows.columns if c in out.columns]
        if not shared and not cross and variables([atom]):
            raise ValueError(f"{atom} shares no variable with the atoms before it")
        out = out.join(rows, shared) if shared else out.crossJoin(rows)
    return out.drop("_") if "_" in out.columns else out


def optional(bindings: DataFrame, graph: DataFrame, atoms: list[Atom]) -> DataFrame:
    """OPTIONAL: all bindings, extended where the atoms match."""
    right = match(graph, atoms)
    return bindings.join(right, [c for c in right.columns if c in bindings.columns], "left")


def not_exists(bindings: DataFrame, graph: DataFrame, atoms: list[Atom]) -> DataFrame:
    """FILTER NOT EXISTS on the variables shared with the bindings."""
    right = match(graph, atoms)
    shared = [c for c in right.columns if c in bindings.columns]
    return bindings.join(right.select(shared), shared, "left_anti")


def exists(bindings: DataFrame, graph: DataFrame, atoms: list[Atom]) -> DataFrame:
    right = match(graph, atoms)
    shared = [c for c in right.columns if c in bindings.columns]
    return bindings.join(right.select(shared), shared, "left_semi")


def values(bindings: DataFrame, variable: str, items: list[str]) -> DataFrame:
    """VALUES of one variable."""
    return bindings.filter(F.col(variable).isin(items))


def path(graph: DataFrame, steps: list[str], start: str = "s", end: str = "o") -> DataFrame:
    """Distinct ends of a sequence path a/b/..."""
    atoms = [(f"?{start}" if i == 0 else f"?_m{i}", p, f"?{end}" if i + 1 == len(steps) else f"?_m{i + 1}") for i, p in enumerate(steps)]
    return match(graph, atoms).select(start, end).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """Distinct reachable pairs (child, ancestor) of edges (child, parent), whatever their depth.

    Pairs found so far are joined with themselves, so each round doubles the length of the paths covered
    and the rounds are the logarithm of the depth. They end when nothing new is reached. A node on a
    cycle reaches itself.
    """
    spark = edges.sparkSession
    path = shared.scratch(spark, "closure")
    now = shared.saved(edges.select("child", F.col("parent").alias("ancestor")).filter("child is not null and parent is not null").distinct(), f"{path}/0")
    n, round_ = now.count(), 0
    while n:
        far = now.select(F.col("child"), F.col("ancestor").alias("m")).join(now.select(F.col("child").alias("m"), "ancestor"), "m").select("child", "ancestor")
        round_ += 1
        grown = shared.saved(now.unionByName(far).distinct(), f"{path}/{round_}")
        size = grown.count()
        shared.remove(spark, f"{path}/{round_ - 1}")
        now = grown
        if size == n:
            break
        n = size
    return now
