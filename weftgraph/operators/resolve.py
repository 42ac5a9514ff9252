"""Entity resolution and IRI rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import terms


def rescope(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Subjects of rows (file, s, p, o) below the scope of their file; a file of no or several scopes is an error."""
    scopes = units.groupBy("file").agg(F.min("scope").alias("scope"), F.countDistinct("scope").alias("n"))
    joined = rows.join(scopes, "file", "left")
    one = F.when(F.col("n") == 1, F.col("scope")).otherwise(F.raise_error(F.concat(F.lit("not one scope in file "), F.col("file"))))
    done = F.col("s").startswith("unit/")
    return joined.select(F.when(done, F.col("s")).otherwise(F.concat(one, F.lit("/"), "s")).alias("s"), "p", "o").distinct()


def canonical_keys(rows: DataFrame, form: str, plurals: DataFrame | None = None) -> DataFrame:
    """rows with key (folded form) and root: the singular's key where the corpus has both, or plurals (plural, singular) names it.

    Singulars are found by an equi join of keys with candidate singulars; no pairs of forms are made.
    """
    keyed = rows.withColumn("key", terms.fold_hyphen(form))
    keys = keyed.select("key").distinct()
    pairs = keys.select("key", terms.singular_of("key").alias("single")).filter("single is not null")
    known = pairs.join(keys.withColumnRenamed("key", "single"), "single", "left_semi").select("key", "single")
    if plurals is not None:
        explicit = plurals.select(terms.fold_hyphen("plural").alias("key"), terms.fold_hyphen("singular").alias("single"))
        known = explicit.unionByName(known.join(explicit, "key", "left_anti"))
    return keyed.join(known, "key", "left").withColumn("root", F.coalesce("single", "key")).drop("single")


def clean_local(c) -> Column:
    """A local name: decoded, white space and control characters as "_", trimmed of "_", the rest percent-encoded."""
    plain = F.regexp_replace(terms.pct_decode(terms.pct_encode(terms.col(c))), r"(?U)[\s\p{Cntrl}]+", "_")
    return terms.pct_encode(F.regexp_replace(plain, "^_+|_+$", ""))


def collisions(mapping: DataFrame) -> DataFrame:
    """new, olds: new names that several old names map to."""
    return mapping.groupBy("new").agg(F.countDistinct("old").alias("olds")).filter("olds > 1")


def humanize(iris: DataFrame, names: DataFrame) -> DataFrame:
    """IRIs with lu_<12 hex digits> replaced by the slug of that hash, where names (hash, slug) has it."""
    keyed = iris.withColumn("hash", F.regexp_extract("iri", "lu_([0-9a-f]{12})", 1))
    joined = keyed.join(names, "hash", "left")
    return joined.select(F.when(F.col("slug").isNotNull(), F.replace("iri", F.concat(F.lit("lu_"), F.col("hash")), F.col("slug"))).otherwise(F.col("iri")).alias("iri"))


def preferred_label(rows: DataFrame, languages: list[str]) -> DataFrame:
    """node, label, lang: the label of the first language there is, then the least text."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in languages)), F.col("lang")), F.lit(0)), F.lit(len(languages) + 1))
    return rows.groupBy("node").agg(F.min_by(F.struct("label", "lang"), F.struct(rank, "label")).alias("b")).select("node", "b.label", "b.lang")


def expand(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """node and hop: nodes first reached after 0, 1, ... hops along edges (a, b)."""
    known = front = start.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = front.select(F.col("node").alias("a")).join(edges, "a").select(F.col("b").alias("node")).distinct()
        front = reached.join(known, "node", "left_anti").withColumn("hop", F.lit(hop))
        known = known.unionByName(front)
    return known
