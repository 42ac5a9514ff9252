"""Dataset building: reproducible splits, balancing, caps, audits, statistics.

Random order is the MD5 of a seed and the id, the same on every run and engine.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import shared
from weftgraph.functions.terms import stable_rank_key


def _ranked(rows: DataFrame, id_column: str, seed: int, by: list[str]) -> DataFrame:
    """rows with k, the random rank within by, and n, the size."""
    order = Window.partitionBy(*by).orderBy(stable_rank_key(seed, id_column), id_column)
    return rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in the order of all rows.

    Rows are dealt into ranges of the order and written; a place is the number of rows in the ranges before
    and the rank within its own, so no task sorts the whole table. Equal rows get one place each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    kept = shared.saved(dealt, shared.scratch(spark, "rank"))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return kept.join(F.broadcast(before), "_part").select(*rows.columns, k.cast("long").alias(name))


def split_811(rows: DataFrame, id_column: str, seed: int) -> DataFrame:
    """rows with part: train, val and test in 8:1:1, exact counts.

    The rank comes from counts of hash buckets and a rank within each, so no task sorts all rows.
    """
    keyed = rows.withColumn("h", stable_rank_key(seed, id_column)).withColumn("slot", F.substring("h", 1, 2))
    sizes = keyed.groupBy("slot").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("slot")) - F.col("size")).withColumn("n", F.sum("size").over(Window.partitionBy()))
    k = F.row_number().over(Window.partitionBy("slot").orderBy("h", id_column)) + F.col("before")
    train, val = F.floor(0.8 * F.col("n")), F.floor(0.1 * F.col("n"))
    ranked = keyed.join(F.broadcast(before), "slot").withColumn("k", k)
    return ranked.select(*rows.columns, F.when(F.col("k") <= train, "train").when(F.col("k") <= train + val, "val").otherwise("test").alias("part"))


def stratified_split(rows: DataFrame, id_column: str, label: str, share: float, seed: int) -> DataFrame:
    """part of each row: the share of each label in test, rounded half to even; at least one each where there are two."""
    held = F.least(F.greatest(F.bround(share * F.col("n"), 0), F.when(F.col("n") >= 2, 1).otherwise(0)), F.col("n") - 1)
    return _ranked(rows, id_column, seed, [label]).withColumn("part", F.when(F.col("k") <= held, "test").otherwise("train")).drop("k", "n")


def group_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """part of each row; rows of one group stay together."""
    ranked = global_rank(rows.select(group).distinct(), [stable_rank_key(seed, group), F.col(group)], "k")
    size = ranked.agg(F.count("*").alias("n"))
    part = F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(share * F.col("n"))), "test").otherwise("train")
    return rows.join(ranked.join(F.broadcast(size)).select(group, part.alias("part")), group)


def overlaps(frames: dict[str, DataFrame]) -> DataFrame:
    """a, b, overlap: the number of distinct rows that each pair of frames shares."""
    rows = [x.intersect(y).agg(F.count("*").alias("overlap")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "overlap") for (a, x), (b, y) in combinations(frames.items(), 2)]
    return reduce(DataFrame.unionByName, rows)


def imbalance(rows: DataFrame, label: str, limit: float = 1.5) -> DataFrame:
    """most, least, ratio and whether the ratio is above limit (a single label counts as infinite)."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    out = n.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("labels"))
    ratio = F.when(F.col("labels") > 1, F.col("most") / F.col("least")).otherwise(F.lit(float("inf")))
    return out.select("most", "least", F.round(ratio, 6).alias("ratio"), (ratio > limit).alias("imbalanced"))


def oversample(rows: DataFrame, label: str, id_column: str, seed: int) -> DataFrame:
    """Rows of smaller labels repeated whole times, and a random remainder once more, up to the largest label's number."""
    n = rows.groupBy(label).agg(F.count("*").alias("size"))
    most = n.agg(F.max("size").alias("most"))
    ranked = _ranked(rows, id_column, seed, [label]).join(F.broadcast(most))
    copies = (F.floor(F.col("most") / F.col("n")) + F.when(F.col("k") <= F.col("most") % F.col("n"), 1).otherwise(0)).cast("int")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*rows.columns)


def per_label(rows: DataFrame, label: str, id_column: str, n: int, seed: int) -> DataFrame:
    """n random rows of each label."""
    return _ranked(rows, id_column, seed, [label]).filter(F.col("k") <= n).drop("k", "n")


def balanced(rows: DataFrame, label: str, id_column: str, n: int, seed: int) -> DataFrame:
    """n random rows in all: as many of each label, the rest filled from what the larger labels have left, by random rank.

    Fewer only where the table itself has fewer.
    """
    labels = rows.select(label).distinct().agg(F.count("*").alias("labels"))
    ranked = _ranked(rows, id_column, seed, [label]).drop("n").filter(F.col("k") <= n).join(F.broadcast(labels))  # at most n of a label
    ranked = ranked.withColumn("extra", (F.col("k") > F.floor(F.lit(n) / F.col("labels"))).cast("int"))
    order = [F.col("extra"), stable_rank_key(seed, id_column), F.col(id_column)]
    return ranked.orderBy(*order).limit(n).select(*rows.columns)


def split_80_20(rows: DataFrame, columns: list[str], seed: int, share: float = 0.8) -> DataFrame:
    """part of each row: train for the first floor(share * n) in a random order, else test."""
    ranked = global_rank(rows, [stable_rank_key(seed, *columns), *(F.col(c) for c in columns)], "k")
    size = rows.agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(size)).select(*rows.columns, F.when(F.col("k") <= F.floor(F.lit(share) * F.col("n")), "train").otherwise("test").alias("part"))


def training_sample(rows: DataFrame, id_column: str, steps: int, batch: int, accumulation: int, seed: int, spare: float = 1.2) -> DataFrame:
    """As many random rows as the training steps take, and a fifth more; all of them where steps is not positive."""
    if steps <= 0:
        return rows
    return rows.orderBy(stable_rank_key(seed, id_column), id_column).limit(int(steps * batch * accumulation * spare))


def concat_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the frames; of those of equal keys, the one of the earliest frame, then the least."""
    every = reduce(DataFrame.unionByName, [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)])
    others = [c for c in frames[0].columns if c not in keys]
    first = every.groupBy(*keys).agg(F.min(F.struct("_frame", *others)).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others)).select(*frames[0].columns)


def preserved(source: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """rows, lost and added: whether the parts together are the source, as bags of rows."""
    whole = reduce(DataFrame.unionByName, parts)
    count = lambda x, c: x.agg(F.count("*").alias(c))
    return count(source, "rows").join(count(source.exceptAll(whole), "lost")).join(count(whole.exceptAll(source), "added"))


def round_robin(rows: DataFrame, order: str, parents: DataFrame, parent_order: str) -> DataFrame:
    """Each row with the parent of its turn: parents are dealt out in their order, again and again."""
    numbered = global_rank(parents, [F.col(parent_order)], "_turn")
    n = parents.agg(F.count("*").alias("_n"))
    ranked = global_rank(rows, [F.col(order)], "_k").join(F.broadcast(n)).withColumn("_turn", (F.pmod(F.col("_k") - 1, F.col("_n")) + 1).cast("long"))
    return ranked.join(numbered, "_turn").drop("_turn", "_k", "_n")


def claim_ranks(claims: DataFrame) -> DataFrame:
    """Claims (item, property, rank, value, kind) that count: the preferred ones of an item's property if it has any,
    else the normal ones; never those without a value."""
    some = F.max((F.col("rank") == "preferred").cast("int")).over(Window.partitionBy("item", "property"))
    wanted = F.when(some == 1, "preferred").otherwise("normal")
    return claims.withColumn("_wanted", wanted).filter((F.col("rank") == F.col("_wanted")) & (F.col("kind") != "novalue")).drop("_wanted")


def chosen_candidate(rows: DataFrame, candidates: str, key: str, predicted: str) -> DataFrame:
    """rows with chosen: the first of the candidates (structs) whose key is the predicted one, or null."""
    return rows.withColumn("chosen", F.get(F.filter(candidates, lambda c: c[key] == F.col(predicted)), F.lit(0)))


def flat_relations(rows: DataFrame, key: str, relations: str, types: str) -> tuple[DataFrame, DataFrame]:
    """Relations (array of structs) and types (array) of concepts, one distinct row each."""
    each = rows.select(F.col(key), F.explode(relations).alias("r")).select(key, "r.*").dropDuplicates()
    return each, rows.select(F.col(key), F.explode(types).alias("type")).dropDuplicates()


def provenance(candidates: DataFrame, text: str, finished: bool, mock: bool) -> dict:
    """The winner (greatest score, then least id) of a finished run that is no mock, if text is its prompt; else an error."""
    best = candidates.filter("score is not null").orderBy(F.desc("score"), "id").limit(1).collect()
    if not finished or mock:
        raise ValueError("the run is a mock or not finished")
    if not text.strip() or not best or best[0]["prompt"].strip() != text.strip():
        raise ValueError("the stored text is not the best candidate's prompt")
    return best[0].asDict()


def error_batch(rows: DataFrame, score: str, id_column: str, below: float, n: int, seed: int) -> DataFrame:
    """Up to n random rows of a score below the threshold."""
    return rows.filter(F.col(score) < below).orderBy(stable_rank_key(seed, id_column), id_column).limit(n)


def trajectory(rows: DataFrame, score: str, id_column: str, n: int = 20, keep: float = 1.0, seed: int = 0) -> DataFrame:
    """The n best rows, some left out at random, the worst first; the best one where all are left out."""
    top = rows.orderBy(F.desc(score), id_column).limit(n)
    slot = F.conv(F.substring(stable_rank_key(seed, id_column), 1, 4), 16, 10).cast("int") / 65536
    kept = top.filter(slot < keep)
    best = top.orderBy(F.desc(score), id_column).limit(1)
    return kept.unionByName(best.join(kept.agg(F.count("*").alias("_n")), F.col("_n") == 0).drop("_n")).orderBy(score, F.desc(id_column))


def bandit(rewards: dict[str, list[float]], budget: int, exploration: float = 1.0) -> list[tuple[str, int, float]]:
    """(arm, pulls, mean) after budget pulls by the upper confidence bound mean + sqrt(exploration / pulls), each arm once first.

    Pulls of an arm take its rewards in turn. Arms are few; scoring them is the engine's work.
    """
    names = sorted(rewards)
    if budget < len(names):
        raise ValueError("the budget does not reach each arm once")
    total, pulls = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
    for step in range(budget):
        arm = names[step] if step < len(names) else max(names, key=lambda a: total[a] / pulls[a] + (exploration / pulls[a]) ** 0.5)
        total[arm] += rewards[arm][pulls[arm] % len(rewards[arm])]
        pulls[arm] += 1
    return [(a, pulls[a], total[a] / pulls[a]) for a in names]


def elitist(population: list[str], score, mutate, generations: int, elite: int) -> list[list[tuple[float, str]]]:
    """The ranked population of each generation: the elite stays, parents from it in turn are mutated to fill the rest."""
    out = []
    for generation in range(generations):
        ranked = sorted(((score(p), p) for p in population), key=lambda x: (-x[0], x[1]))
        out.append(ranked)
        best = [p for _, p in ranked[:elite]]
        population = best + [mutate(best[i % len(best)], generation, i) for i in range(len(population) - len(best))]
    return out


#: Metrics by name: a Column of a frame with output and example, from 0 to 1.
METRICS: dict[str, object] = {}


def metric(name: str):
    """Registers a function that gives a metric's Column."""

    def add(function):
        METRICS[name] = function
        return function

    return add


@metric("exact")
def _exact() -> Column:
    return (F.trim("output") == F.trim("example")).cast("double")


@metric("not_empty")
def _not_empty() -> Column:
    return (F.length(F.trim(F.coalesce("output", F.lit("")))) > 0).cast("double")


def weighted_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with each named metric and score, their weighted mean; a metric outside 0 to 1, or null, is an error."""
    if not weights or min(weights.values()) < 0 or not 0 < sum(weights.values()) < float("inf"):
        raise ValueError("weights must be finite, not negative, and not all zero")
    checked = {n: F.when(METRICS[n]().between(0, 1), METRICS[n]()).otherwise(F.raise_error(F.lit(f"metric {n} is not in [0, 1]"))).cast("double") for n in weights}
    out = rows.select("*", *(c.alias(n) for n, c in checked.items()))
    return out.withColumn("score", sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)) / sum(weights.values()))


def rules_from_config(text: str) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Lexical rules and classes by code for classify, from JSON: {"rules": [{"search" or "exact": pattern, "class": c}], "codes": {code: class}}."""
    import json

    config = json.loads(text)
    rules = []
    for r in config.get("rules", []):
        how = next((h for h in ("search", "exact") if h in r), None)
        if how is None or "class" not in r:
            raise ValueError(f"a rule needs search or exact, and class: {r}")
        rules.append((how, r[how], r["class"]))
    return rules, config.get("codes", {})


def answer_cap(rows: DataFrame, answer: str, id_column: str, ratio: float, seed: int) -> DataFrame:
    """At most max(1, floor(ratio * total)) random rows of each answer."""
    total = rows.agg(F.count("*").alias("total"))
    ranked = _ranked(rows, id_column, seed, [answer]).join(F.broadcast(total))
    return ranked.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(ratio * F.col("total")))).select(*rows.columns)


def relation_skew(rows: DataFrame, relation: str, yes: str, limit: float) -> DataFrame:
    """n, yes_pct, no_pct of each relation, and whether the larger share reaches limit."""
    share = F.avg(yes)
    r = lambda c: F.round(100.0 * c, 4)
    return rows.groupBy(relation).agg(F.count("*").alias("n"), r(share).alias("yes_pct"), r(F.avg(1 - F.col(yes))).alias("no_pct"), (F.greatest(share, F.avg(1 - F.col(yes))) >= limit).alias("skewed"))


def audit(rows: DataFrame, label: str) -> DataFrame:
    """n, yes, no, and labels that are neither."""
    count = lambda c: F.count(F.when(c, 1))
    y = F.col(label)
    return rows.agg(F.count("*").alias("n"), count(y == 1).alias("yes"), count(y == 0).alias("no"), count(y.isNull() | ~y.isin(0, 1)).alias("bad"))


def sorted_ids(rows: DataFrame) -> DataFrame:
    """id and k, its place: in numeric order if all ids are numbers, else as text."""
    numeric = rows.agg(F.bool_and(F.col("id").try_cast("double").isNotNull()).alias("numeric")).first()["numeric"]
    order = [F.col("id").try_cast("double"), F.col("id")] if numeric else [F.col("id")]
    return global_rank(rows.select("id"), order, "k")


def length_stats(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """n, median, p95, p99, longest, over (share above limit), with exact interpolated quantiles."""
    q = lambda p: F.percentile(column, F.lit(p))
    return rows.agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(column).alias("longest"), F.round(F.avg((F.col(column) > limit).cast("int")), 6).alias("over"))


def recommended_length(stats: DataFrame, base: int, least: int, most: int) -> DataFrame:
    """max_length: the 95th percentile rounded up to base, within bounds."""
    return stats.select(F.least(F.greatest(F.ceil(F.col("p95") / base) * base, F.lit(least)), F.lit(most)).cast("long").alias("max_length"))


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean, sd of b - a, and the numbers of positive and negative differences."""
    d = F.col(b) - F.col(a)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("sd"), F.count(F.when(d > 0, 1)).alias("plus"), F.count(F.when(d < 0, 1)).alias("minus"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of a share; null for no trials."""
    p, spread = hits / n, z * z / n
    middle = (p + spread / 2) / (1 + spread)
    half = z / (1 + spread) * F.sqrt(p * (1 - p) / n + spread / (4 * n))
    given = lambda c: F.when(n > 0, c)
    return given(F.greatest(F.lit(0.0), middle - half)), given(F.least(F.lit(1.0), middle + half))


def sign_test(plus: Column, minus: Column) -> Column:
    """Exact two-sided p-value of the sign test (ties left out): twice the smaller tail of the binomial, at most one.

    The tail's terms are built from one another in logarithms, so large counts do not overflow.
    """
    n, k = (plus + minus).cast("int"), F.least(plus, minus).cast("int")
    start = F.struct(n * -F.log(F.lit(2.0)), F.exp(n * -F.log(F.lit(2.0))))
    step = lambda a, i: F.struct(a["col1"] + F.log((n - i + 1) / i), a["col2"] + F.exp(a["col1"] + F.log((n - i + 1) / i)))
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda a: a["col2"])))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check_name and n, the number of offending rows, of each check."""
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n") for name, x in checks.items()])


def classify(text: str, code: str, rules: list[tuple[str, str, str]], by_code: dict[str, str]) -> Column:
    """Class of the first rule that fits (how, pattern, class), else of the code, else unmapped."""
    t = F.col(text)
    found = [F.when(t.rlike(p) if how == "search" else t == p, c) for how, p, c in rules]
    codes = [F.when(F.col(code) == k, c) for k, c in sorted(by_code.items())]
    return F.coalesce(*found, *codes, F.lit("unmapped"))


def sync(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """k, v (prior value where there is one), status of the full reconciliation of two tables (k, v)."""
    a, b = fresh.select("k", F.col("v").alias("a"), F.lit(True).alias("in_a")), prior.select("k", F.col("v").alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("b", "a").alias("v"), status.alias("status"))


def halving(rows: DataFrame, candidate: str, score: str, id_column: str, rounds: int) -> DataFrame:
    """candidate, round, mean: each round scores the candidates left on twice the share of rows and keeps the better half."""
    spark, left, out = rows.sparkSession, None, None
    slot = F.conv(F.substring(stable_rank_key(1, id_column), 1, 4), 16, 10).cast("int") / 65536
    for r in range(rounds):
        part = rows.filter(slot < 1 / 2 ** (rounds - 1 - r))
        if left is not None:
            part = part.join(left, candidate, "left_semi")
        means = part.groupBy(candidate).agg(F.round(F.avg(score), 6).alias("mean"))
        ranked = means.orderBy(F.desc("mean"), candidate).collect()  # a row for each candidate
        left = spark.createDataFrame([(x[candidate],) for x in ranked[: max(1, (len(ranked) + 1) // 2)]], f"{candidate} string")
        now = means.withColumn("round", F.lit(r))
        out = now if out is None else out.unionByName(now)
    return out.select(F.col(candidate).alias("candidate"), "round", "mean")
