"""Writers with a fixed layout: ordered and quoted CSV, files by key, id files with counts, reports, checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import shared
from weftgraph.sources.files import read_table


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Puts the finished folder new in the place of path: readers see the old content or the new, never a part."""
    fs, target = _fs(spark, path)
    _, source = _fs(spark, new)
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not move {new} to {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside its place and moved there when it is whole."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not move {path}.part")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and these columns in this order."""
    rows.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_audited(rows: DataFrame, path: str) -> dict:
    """All fields quoted, read back, compared row by row, and only then moved to path; the audit goes to path.audit.json.

    Columns are written as text. An empty text is read as null, which the comparison takes as the same.
    """
    spark = rows.sparkSession
    text = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns))
    new = f"{path}.new"
    text.write.mode("overwrite").csv(new, header=True, quoteAll=True, escape='"')
    back = read_table(spark, new, rows.columns, sep=",").select(*rows.columns)
    given = text.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))
    audit = {"rows": given.count(), "lost": given.exceptAll(back).count(), "added": back.exceptAll(given).count(), "columns": rows.columns}
    if audit["lost"] or audit["added"]:
        raise ValueError(f"{path} does not read as written: {audit}")
    replace_folder(spark, new, path)
    write_text(spark, f"{path.rstrip('/')}.audit.json", json.dumps(audit))
    return audit


def write_by_key(rows: DataFrame, path: str, key: str) -> DataFrame:
    """A folder key=<value> for each key that has rows; gives the summary: key, n."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; reports have a row for each check or key, not for each datum."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_predictions(rows: DataFrame, path: str, key: str, run: str) -> int:
    """Adds the rows whose key path does not have yet, as the folder run=<run>, written whole or not at all; gives their number.

    The same run again replaces what it wrote, so a run that was cut off can be repeated.
    """
    spark = rows.sparkSession
    fs, where = _fs(spark, path)
    if fs.exists(where):
        done = spark.read.parquet(path)
        done = done.filter(F.col("run") != run) if "run" in done.columns else done
        rows = rows.join(done.select(key).distinct(), key, "left_anti")
    new = f"{shared.scratch(spark, 'predictions')}/part"
    rows.write.parquet(new)
    replace_folder(spark, new, f"{path}/run={run}")
    return spark.read.schema(rows.schema).parquet(f"{path}/run={run}").count()


# --- integer ids ---------------------------------------------------------------------------------------


def dense_ids(names: DataFrame, column: str) -> DataFrame:
    """name and id (from 0, in the order of name) of the distinct values."""
    from weftgraph.operators.datasets import global_rank

    ranked = global_rank(names.select(F.col(column).alias("name")).filter("name is not null").distinct(), [F.col("name")], "k")
    return ranked.select("name", (F.col("k") - 1).alias("id"))


def id_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (name, id), relations (name, id), and the triples as h, t, r."""
    entities = dense_ids(triples.select(F.explode(F.array("s", "o")).alias("e")), "e")
    relations = dense_ids(triples, "p")
    named = lambda ids, c, to: ids.select(F.col("name").alias(c), F.col("id").alias(to))
    rows = triples.select("s", "p", "o").join(named(entities, "s", "h"), "s").join(named(entities, "o", "t"), "o").join(named(relations, "p", "r"), "p")
    return entities, relations, rows.select("h", "t", "r")


def write_counted(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """Lines of the columns joined by sep, with the number of lines before them in the file count.

    The lines stay spread over many files; read_counted, or a plain concatenation in the order of the
    names, gives the classic file with its count as the first line.
    """
    rows.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in rows.columns)).alias("line")).write.mode("overwrite").text(f"{path}/lines")
    n = rows.sparkSession.read.text(f"{path}/lines").count()
    write_text(rows.sparkSession, f"{path}/count", f"{n}\n")


def read_counted(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """The rows of write_counted as text columns; an error if their number is not the count."""
    want = int(spark.read.text(f"{path}/count").first()["value"])
    lines = spark.read.text(f"{path}/lines")
    if (n := lines.count()) != want:
        raise ValueError(f"{path} has {n} lines, its count says {want}")
    parts = F.split("value", sep)
    return lines.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))
