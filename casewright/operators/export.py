"""Exports: adjacency in compressed form, dense numbering, a columnar graph document, and its reader."""

from __future__ import annotations

import gzip
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, position): ids numbered from 0 in ascending order.

    Numbers are counted within ranges of ids and shifted by the ranges' counts, so no task sees all ids.
    """
    width = 1 << 16
    rows = ids.select("id").distinct().withColumn("part", F.floor(F.col("id") / width))
    counts = rows.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    shift = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return rows.withColumn("n", inside).join(shift, "part").select("id", (F.col("shift") + F.col("n")).cast("int").alias("position"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, cites, position): sorted cited ids of every citing id, and its dense number."""
    lists = edges.groupBy(F.col("citing").alias("id")).agg(F.array_sort(F.collect_set("cited")).alias("cites"))
    return lists.join(dense_ids(lists), "id")


#: Columns of the graph document, in order, where the nodes have them: (name in the document, column).
DOCUMENT = [("ids", "id"), ("names", "name"), ("cites", "cite"), ("years", "year"), ("dates", "date"), ("cited_all", "cited_all"), ("cited_scotus", "cited_scotus"), ("has_text", "has_text"), ("real", "is_real"), ("text", "text"), ("cap_ids", "cap_ids")]


def columnar_graph(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph document of parallel arrays (those of ``DOCUMENT`` that the nodes have) and a flat edge list of
    positions, for a browser.

    The document is one JSON text on the driver, so it is meant for game-sized graphs.
    """
    position = dense_ids(nodes)
    named = [(name, c) for name, c in DOCUMENT if c in nodes.columns]
    rows = nodes.join(position, "id").orderBy("position").select(*[c for _, c in named]).collect()
    a, b = position.select(F.col("id").alias("citing"), F.col("position").alias("a")), position.select(F.col("id").alias("cited"), F.col("position").alias("b"))
    pairs = edges.join(a, "citing").join(b, "cited").orderBy("a", "b").select("a", "b").collect()
    doc = {name: [r[c] for r in rows] for name, c in named} | {"edges": [x for p in pairs for x in (p.a, p.b)]}
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def write_modes(routes: DataFrame, path: str) -> None:
    """Writes routes by mode; modes that ``routes`` does not hold keep what is there."""
    routes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(path)


def append_new(cache_path: str, rows: DataFrame, key: str) -> None:
    """Adds the rows whose key the cache (Parquet, made if missing) doesn't hold yet."""
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(cache_path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.write.parquet(cache_path)
        return
    rows.join(held, key, "left_anti").write.mode("append").parquet(cache_path)


def packed_size(document: str) -> dict:
    """Bytes of a document, plain and gzipped."""
    raw = document.encode()
    return {"bytes": len(raw), "gzip": len(gzip.compress(raw, 9))}


def write_table(table: DataFrame, path: str) -> int:
    """Writes a table as Parquet (readers see all of it or none: the committer renames) and returns its row count,
    which is counted while it is written."""
    seen = Observation("rows")
    table.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def write_with_side(table: DataFrame, path: str, side: DataFrame, side_path: str) -> tuple[int, int]:
    """Writes two results of one computation (say, edges and the counts from the same pairs); ``side`` should be built
    from a cut table that ``table`` is built from as well, so nothing is computed twice."""
    return write_table(table, path), write_table(side, side_path)


def write_index(tables: dict[str, DataFrame], path: str, version: int) -> dict[str, int]:
    """Writes tables under a version of their own, then the manifest that names it: a reader follows the manifest, so
    it never sees half an index.  Returns the row counts."""
    counts = {name: write_table(t, f"{path}/v{version}/{name}") for name, t in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    rows = [(version, name, n) for name, n in counts.items()]
    spark.createDataFrame(rows, "version long, name string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return counts


def read_index(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame] | None:
    """The tables of an index, or None if there is none or it has another version."""
    try:
        rows = spark.read.parquet(f"{path}/manifest").where(F.col("version") == version).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {r.name: spark.read.parquet(f"{path}/v{version}/{r.name}") for r in rows} or None


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a markdown table; a report of more than ``most`` rows is refused."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no markdown table")
    cell = lambda x: "" if x is None else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x).replace("|", "\\|")
    lines = [report.columns, ["---"] * len(report.columns), *[[cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
