"""SPARQL SELECT text to DataFrame plans.

Supported: basic patterns (with ";" and ","), sequence paths, OPTIONAL, UNION, VALUES, BIND, FILTER with
comparisons, arithmetic with the usual precedence, boolean operators, IN, BOUND, REGEX, STRSTARTS, CONTAINS, IF, CONCAT, STR, LCASE, UCASE and
[NOT] EXISTS, sub-selects, VALUES of one or several variables with UNDEF, DISTINCT, GROUP BY, HAVING, COUNT / SUM / AVG / MIN / MAX / SAMPLE, ORDER BY,
LIMIT and OFFSET-free slices, PREFIX. IRIs in angle brackets are looked up as they stand, prefixed names
by their prefix's IRI and the local part; a vocabulary can rename IRIs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import bgp

TOKEN = re.compile(r"""\s+|\#[^\n<>]*\n|(<[^<>\s]*>)|([?$]\w+)|("(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?)|(\w*:(?:[\w.-]*\w)?)|(&&|\|\||!=|<=|>=|[{}().;,=<>!*/+-])|(\w+(?:\.\d+)?)""")
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min}


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read query at: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastindex:
            out.append(m[m.lastindex])
    return out


class Parser:
    def __init__(self, graph: DataFrame, text: str, vocabulary: dict[str, str] | None = None):
        self.graph, self.words, self.at, self.vocabulary = graph, tokens(text), 0, vocabulary or {}
        self.prefixes: dict[str, str] = {}
        self.fresh, self.numeric = 0, False

    # -- tokens
    def peek(self, k: int = 0) -> str:
        return self.words[self.at + k] if self.at + k < len(self.words) else ""

    def is_word(self, *words: str) -> bool:
        return self.peek().upper() in words

    def take(self, *expected: str) -> str:
        word = self.peek()
        if expected and word.upper() not in expected:
            raise ValueError(f"expected {expected}, found {word!r}")
        self.at += 1
        return word

    # -- terms
    def term(self) -> str:
        word = self.take()
        if word[0] in "?$":
            return "?" + word[1:]
        if word[0] == "<":
            iri = word[1:-1]
        elif word[0] == '"':
            return re.sub(r"\\(.)", r"\1", word[1 : word.rindex('"')])
        elif word == "a":
            iri = "type"
        elif ":" in word:
            prefix, local = word.split(":", 1)
            iri = self.prefixes.get(prefix, prefix + ":") + local
        else:
            return word
        return self.vocabulary.get(iri, iri)

    # -- query
    def query(self) -> DataFrame:
        while self.is_word("PREFIX"):
            self.take()
            name = self.take().split(":")[0]
            self.prefixes[name] = self.take()[1:-1]
        out = self.select()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def select(self) -> DataFrame:
        self.take("SELECT")
        distinct = self.is_word("DISTINCT") and bool(self.take())
        wanted: list[tuple[str, int | None]] = []
        while not self.is_word("WHERE", "{"):
            if self.peek() == "*":
                self.take()
            elif self.peek() == "(":
                start = self.at
                self.skip()
                wanted.append((self.words[self.at - 2][1:], start))
            else:
                wanted.append((self.take()[1:], None))
        if self.is_word("WHERE"):
            self.take()
        rows = self.group(None)
        keys, having, grouped = [], None, False
        if self.is_word("GROUP"):
            self.take()
            self.take("BY")
            grouped = True
            while self.peek()[:1] in ("?", "$"):
                keys.append(self.take()[1:])
        if self.is_word("HAVING"):
            self.take()
            having = self.at
            self.skip()
        has_aggregate = any(s is not None and any(w.upper() in AGGREGATES for w in self.words[s : s + 4]) for _, s in wanted)
        after = self.at

        def parsed(start: int, aggregate: bool) -> Column:
            self.at = start + 1
            return self.expression(rows, aggregate)

        if grouped or has_aggregate:
            columns = [parsed(s, True).alias(n) for n, s in wanted if s is not None]
            if having is not None:
                columns.append(parsed(having, True).alias("__having"))
            out = rows.groupBy(*keys).agg(*columns) if columns else rows.select(*keys).distinct()
            if having is not None:
                out = out.filter("__having").drop("__having")
        else:
            out = rows
            for n, s in wanted:
                if s is not None:
                    out = out.withColumn(n, parsed(s, False))
        self.at = after
        order = []
        if self.is_word("ORDER"):
            self.take()
            self.take("BY")
            while self.is_word("ASC", "DESC") or self.peek()[:1] in ("?", "$"):
                if self.is_word("ASC", "DESC"):
                    down = self.take().upper() == "DESC"
                    self.take("(")
                    c = F.col(self.take()[1:])
                    self.take(")")
                    order.append(c.desc() if down else c.asc())
                else:
                    order.append(F.col(self.take()[1:]))
        names = [n for n, _ in wanted]
        if names:
            for n in names:
                if n not in out.columns:
                    out = out.withColumn(n, F.lit(None).cast("string"))
            extra = [] if distinct else [c for c in out.columns if c not in names]
            out = out.select(*names, *extra)
        if distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*order)
        if self.is_word("LIMIT"):
            self.take()
            out = out.limit(int(self.take()))
        return out.select(*names) if names else out

    def skip(self) -> None:
        """Over a parenthesised part."""
        depth = 0
        while True:
            word = self.take()
            depth += (word == "(") - (word == ")")
            if not depth:
                return

    # -- patterns
    def group(self, start: DataFrame | None, outer: list[str] | None = None) -> DataFrame | None:
        """Bindings of a group. Its filters that name variables of outer that the group lacks are left to the join: self.deferred."""
        self.take("{")
        if self.is_word("SELECT"):
            out = self.select()
            self.take("}")
            return out if start is None else self.join(start, out, "inner")
        rows, atoms, filters = start, [], []

        def flush():
            nonlocal rows, atoms
            if atoms:
                rows = bgp.match(self.graph, atoms, rows)
                atoms = []

        while self.peek() != "}":
            if self.is_word("OPTIONAL"):
                self.take()
                flush()
                rows = self.joined_group(rows, "left")
            elif self.is_word("FILTER"):
                self.take()
                negated = self.is_word("NOT") and bool(self.take())
                if self.is_word("EXISTS"):
                    self.take()
                    flush()
                    rows = self.joined_group(rows, "left_anti" if negated else "left_semi")
                else:
                    filters.append(self.at)
                    if self.peek() != "(":
                        self.take()
                    self.skip()
            elif self.is_word("VALUES"):
                self.take()
                names, many = [], self.peek() == "("
                if many:
                    self.take()
                while self.peek()[:1] in ("?", "$"):
                    names.append(self.term()[1:])
                    if not many:
                        break
                if many:
                    self.take(")")
                self.take("{")
                items = []
                while self.peek() != "}":
                    if many:
                        self.take("(")
                    row = tuple(None if self.is_word("UNDEF") and self.take() else self.term() for _ in names)
                    if many:
                        self.take(")")
                    items.append(row)
                self.take("}")
                flush()
                rows = self.values(rows, names, items)
            elif self.is_word("BIND"):
                self.take()
                flush()
                begin = self.at
                self.skip()
                end = self.at
                name = self.words[end - 2][1:]
                self.at = begin + 1
                rows = rows.withColumn(name, self.expression(rows, False))
                self.at = end
            elif self.peek() == "{":
                flush()
                part = self.group(None)
                while self.is_word("UNION"):
                    self.take()
                    part = part.unionByName(self.group(None), allowMissingColumns=True)
                rows = part if rows is None else self.join(rows, part, "inner")
            elif self.peek() == ".":
                self.take()
            else:
                self.triples(atoms)
        flush()
        end, deferred = self.at + 1, []
        for begin in filters:
            self.at = begin
            if self.named(begin) & set(outer or ()) - set(rows.columns):
                deferred.append(begin)
            else:
                rows = rows.filter(self.expression(rows, False))
        self.at, self.deferred = end, deferred
        return rows

    def named(self, begin: int) -> set[str]:
        """The variables of the filter that begins there."""
        at = self.at
        self.at = begin
        if self.peek() != "(":
            self.take()
        self.skip()
        end, self.at = self.at, at
        return {w[1:] for w in self.words[begin:end] if w[0] in "?$"}

    def joined_group(self, left: DataFrame, how: str) -> DataFrame:
        """left joined with the group that follows; filters of the group may name variables of left."""
        right = self.group(None, left.columns)
        deferred, end = self.deferred, self.at
        if not deferred:
            return self.join(left, right, how)
        shared = [c for c in right.columns if c in left.columns]
        right = right.select(*(F.col(c).alias(f"__{c}" if c in shared else c) for c in right.columns))
        both = left.columns + [c for c in right.columns if not c.startswith("__")]
        condition = F.lit(True)
        for c in shared:
            condition = condition & (F.col(c) == F.col(f"__{c}"))
        for begin in deferred:
            self.at = begin
            condition = condition & self.expression(self.graph.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in both)), False)
        self.at = end
        return left.join(right, condition, how).drop(*(f"__{c}" for c in shared))

    def values(self, rows: DataFrame | None, names: list[str], items: list[tuple]) -> DataFrame:
        """rows joined with inline data; UNDEF fits every value."""
        table = self.graph.sparkSession.createDataFrame(items, ", ".join(f"`{n}` string" for n in names))
        if rows is None:
            return F.broadcast(table)
        shared = [n for n in names if n in rows.columns]
        if not any(x is None for item in items for x in item):
            return self.join(rows, F.broadcast(table), "inner")
        renamed = table.toDF(*(f"__{n}" if n in shared else n for n in names))
        fits = F.lit(True)
        for n in shared:
            fits = fits & (F.col(f"__{n}").isNull() | (F.col(f"__{n}") == F.col(n)))
        return rows.join(F.broadcast(renamed), fits).drop(*(f"__{n}" for n in shared))

    def join(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if how in ("left_anti", "left_semi"):
            right = right.select(*shared)
        return left.join(right, shared, how)

    def triples(self, atoms: list[bgp.Atom]) -> None:
        subject = self.term()
        while True:
            steps = [self.term()]
            while self.peek() == "/":
                self.take()
                steps.append(self.term())
            while True:
                target, s = self.term(), subject
                for p in steps[:-1]:
                    self.fresh += 1
                    atoms.append((s, p, f"?_path{self.fresh}"))
                    s = f"?_path{self.fresh}"
                atoms.append((s, steps[-1], target))
                if self.peek() != ",":
                    break
                self.take()
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "}"):
                return

    # -- expressions
    def expression(self, rows: DataFrame, aggregate: bool) -> Column:
        out = self.conjunction(rows, aggregate)
        while self.peek() == "||":
            self.take()
            out = out | self.conjunction(rows, aggregate)
        return out

    def conjunction(self, rows, aggregate) -> Column:
        out = self.comparison(rows, aggregate)
        while self.peek() == "&&":
            self.take()
            out = out & self.comparison(rows, aggregate)
        return out

    def comparison(self, rows, aggregate) -> Column:
        left, numeric_left = self.sum(rows, aggregate)
        if self.is_word("IN"):
            self.take()
            self.take("(")
            items = []
            while self.peek() != ")":
                items.append(self.term())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return left.isin(items)
        if self.peek() not in ("=", "!=", "<", ">", "<=", ">="):
            return left
        sign = self.take()
        right, numeric_right = self.sum(rows, aggregate)
        if numeric_left != numeric_right:
            left, right = left.try_cast("double"), right.try_cast("double")
        self.numeric = False
        return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]

    def sum(self, rows, aggregate) -> tuple[Column, bool]:
        out, numeric = self.operations(("+", "-"), self.product, rows, aggregate)
        self.numeric = numeric
        return out, numeric

    def product(self, rows, aggregate) -> tuple[Column, bool]:
        return self.operations(("*", "/"), self.primary, rows, aggregate)

    def operations(self, signs: tuple[str, str], operand, rows, aggregate) -> tuple[Column, bool]:
        """Operands joined by signs of one precedence, from left to right."""
        out, numeric = operand(rows, aggregate)
        while self.peek() in signs:
            sign = self.take()
            right, _ = operand(rows, aggregate)
            a, b = out.try_cast("double"), right.try_cast("double")
            out, numeric = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0.0))}[sign](), True
        return out, numeric

    def arguments(self, rows, aggregate) -> list[Column]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression(rows, aggregate))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def primary(self, rows, aggregate) -> tuple[Column, bool]:
        word = self.peek()
        upper = word.upper()
        if word == "(":
            self.take()
            out = self.expression(rows, aggregate)
            self.take(")")
            return out, self.numeric  # of the last sum, or not after a comparison
        if word == "!":
            self.take()
            return ~self.primary(rows, aggregate)[0], False
        if upper in AGGREGATES and self.peek(1) == "(":
            self.take()
            self.take("(")
            distinct = self.is_word("DISTINCT") and bool(self.take())
            if self.peek() == "*":
                self.take()
                inner = F.lit(1)
            else:
                inner = self.expression(rows, False)
            self.take(")")
            if upper in ("SUM", "AVG"):
                inner = inner.try_cast("double")
            return (F.countDistinct(inner) if distinct and upper == "COUNT" else AGGREGATES[upper](inner)), True
        if self.peek(1) == "(" and re.fullmatch(r"\w+", word):
            self.take()
            a = self.arguments(rows, aggregate)
            simple = {
                "BOUND": lambda: a[0].isNotNull(), "STR": lambda: a[0], "LCASE": lambda: F.lower(a[0]), "UCASE": lambda: F.upper(a[0]),
                "STRSTARTS": lambda: F.startswith(a[0], a[1]), "STRENDS": lambda: F.endswith(a[0], a[1]), "CONTAINS": lambda: F.contains(a[0], a[1]),
                "REGEX": lambda: F.rlike(a[0], F.concat(F.lit("(?i)"), a[1]) if len(a) > 2 else a[1]), "CONCAT": lambda: F.concat(*a),
                "IF": lambda: F.when(a[0], a[1]).otherwise(a[2]), "COALESCE": lambda: F.coalesce(*a), "STRLEN": lambda: F.length(a[0]), "REPLACE": lambda: F.regexp_replace(a[0], a[1], a[2]),
            }
            if upper not in simple:
                raise ValueError(f"unknown function {word}")
            return simple[upper](), upper == "STRLEN"
        if re.fullmatch(r"\d+(\.\d+)?", word):
            self.take()
            return F.lit(float(word) if "." in word else int(word)), True
        term = self.term()
        if bgp.is_var(term):
            return (F.col(term[1:]) if term[1:] in rows.columns else F.lit(None).cast("string")), False
        return F.lit(term), False


def query(graph: DataFrame, text: str, vocabulary: dict[str, str] | None = None) -> DataFrame:
    """Runs SPARQL SELECT text over a triple table (s, p, o)."""
    return Parser(graph, text, vocabulary).query()
