"""Readers: dump CSV, loosely formed key files, keyed supplements, zip volumes of case JSON, columnar graph JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FIELDS = (
    "id:bigint,name:string,name_abbreviation:string,decision_date:string,docket_number:string,first_page:string,last_page:string,"
    "file_name:string,citations:array<struct<type:string,cite:string>>,court:struct<id:bigint,name:string,name_abbreviation:string>,"
    "analysis:struct<word_count:int,pagerank:struct<raw:double,percentile:double>>,"
    "cites_to:array<struct<cite:string,category:string,reporter:string,case_ids:array<bigint>,weight:int,year:int,opinion_index:int>>"
)


def read_dump(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A database dump as CSV (plain or .bz2): header, quotes escaped by a backslash, line breaks inside quotes.

    Columns are picked by the header's names.  Such files can't be split, so land the result as Parquet once.
    """
    names = spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").option("quote", '"').csv(path)
    return raw.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in names.schema])


def read_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """The first two columns of a loosely formed CSV, where both are digits; whatever follows is ignored."""
    raw = spark.read.text(path).select(F.split("value", ",").alias("c"))
    clean = lambda i: F.trim(F.try_element_at("c", F.lit(i)))
    rows = raw.select(clean(1).alias("a"), clean(2).alias("b")).where("a rlike '^[0-9]+$' and b rlike '^[0-9]+$'")
    return rows.select(F.col("a").cast("bigint").alias(first), F.col("b").cast("bigint").alias(second))


def with_supplement(primary: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; the supplement's row wins where both have a key."""
    return supplement.unionByName(primary.join(supplement.select(key), key, "left_anti"))


def last_of_each(rows: DataFrame, key: str, ordinal: str, first: bool = False) -> DataFrame:
    """One row of each key, the last (or first) by ``ordinal``."""
    order = F.col(ordinal).asc() if first else F.col(ordinal).desc()
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def latest(spark: SparkSession, pattern: str) -> str:
    """The lexically last path that a glob matches (dated dumps), on any file system that Spark reads."""
    names = spark.read.format("binaryFile").load(pattern).select("path")
    found = names.agg(F.max("path").alias("path")).first().path
    if found is None:
        raise FileNotFoundError(pattern)
    return found


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON document (one value or an array of rows); an empty table where there is none."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _volumes(spark: SparkSession, path: str, member: str, keep: Callable[[str], bool]) -> DataFrame:
    """(path, name, content, problem): the members of zip volumes that ``keep`` accepts, or what is wrong with a volume.

    ``member``: one that each volume must hold, or empty.  One task reads one volume at a time.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for place, content in zip(b.path, b.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = z.namelist()
                        if member and member not in names:
                            raise KeyError(f"no {member}")
                        for name in filter(keep, names):
                            yield pd.DataFrame({"path": [place], "name": [name], "content": [z.read(name).decode("utf-8", "replace")], "problem": [None]})
                except (zipfile.BadZipFile, KeyError) as e:
                    yield pd.DataFrame({"path": [place], "name": [None], "content": [None], "problem": [f"{type(e).__name__}: {e}"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(task, "path string, name string, content string, problem string")


_PART = r"([^/]+)/(\d+)\.zip$"
_METADATA = "metadata/CasesMetadata.json"


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Cases of zip volumes ``<reporter>/<volume>.zip``: reporter, volume, and the case's fields.

    Broken volumes have no rows here; :func:`broken_volumes` names them.  A volume whose metadata are no JSON fails.
    """
    rows = _volumes(spark, path, _METADATA, lambda name: name == _METADATA).where("problem is null")
    cases = F.explode(F.from_json("content", f"array<struct<{_FIELDS}>>", {"mode": "FAILFAST"})).alias("c")
    part = lambda i: F.regexp_extract("path", _PART, i)
    return rows.select(part(1).alias("reporter"), part(2).try_cast("int").alias("volume"), cases).select("reporter", "volume", "c.*")


def broken_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the volumes that can't be read; a caller warns and counts them."""
    return _volumes(spark, path, _METADATA, lambda name: False).where("problem is not null").select("path", "problem")


def read_opinions(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Opinion pages of zip volumes: reporter, volume, member, html and cites_to (of the page's sidecar; null without).

    ``keys`` (reporter, volume, member) limits the pages.
    """
    raw = _volumes(spark, path, "", lambda name: name.startswith(("html/", "cases/"))).where("problem is null")
    part = lambda i: F.regexp_extract("path", _PART, i)
    rows = raw.select(part(1).alias("reporter"), part(2).try_cast("int").alias("volume"), F.col("name").alias("member"), "content", F.regexp_extract("name", r"([^/]+)\.\w+$", 1).alias("stem"))
    html = rows.where("member like 'html/%.html'").withColumnRenamed("content", "html")
    if keys is not None:
        html = html.join(keys.select("reporter", "volume", "member").distinct(), ["reporter", "volume", "member"], "left_semi")
    cites = F.from_json("content", f"struct<{_FIELDS}>").getField("cites_to").alias("cites_to")
    side = rows.where("member like 'cases/%.json'").select("reporter", "volume", "stem", cites)
    return html.join(side, ["reporter", "volume", "stem"], "left").select("reporter", "volume", "member", "html", "cites_to")


def court_counts(volumes: DataFrame, court: str = "U.S.") -> DataFrame:
    """(reporter, volume, cases, of_court): how many of a volume's cases are the court's."""
    own = F.coalesce(F.col("court.name_abbreviation") == court, F.lit(False))
    return volumes.groupBy("reporter", "volume").agg(F.count(F.lit(1)).alias("cases"), F.count_if(own).alias("of_court"))


def selected(cases: DataFrame, us_only: bool = False, orders: bool = True) -> DataFrame:
    """Cases of one reporter alone, with or without short orders."""
    if us_only:
        cases = cases.where("reporter = 'us'")
    return cases if orders else cases.where("not is_order_like")


def case_table(volumes: DataFrame, court: str = "U.S.") -> DataFrame:
    """The case table of one court: id, name, cites by kind, date, year, pages, words, order-like flag, cites_to."""
    words = F.coalesce("analysis.word_count", F.lit(0))
    rows = volumes.where(F.col("court.name_abbreviation") == court).where(F.size("citations") >= 0)
    safe = lambda word: F.try_element_at(F.filter(F.transform("citations", lambda c: c.cite), lambda c: F.contains(c, F.lit(word))), F.lit(1))
    return rows.select(
        "id", F.coalesce("name_abbreviation", "name").alias("name"), safe(" U.S. ").alias("us_cite"), safe(" S. Ct. ").alias("sct_cite"), safe(" L. Ed. ").alias("led_cite"),
        F.transform("citations", lambda c: c.cite).alias("cites"), F.col("decision_date").alias("date"), F.substring("decision_date", 1, 4).try_cast("int").alias("year"),
        "first_page", "last_page", words.alias("words"), (words < 300).alias("is_order_like"), F.round("analysis.pagerank.percentile", 6).alias("pagerank"), "cites_to", "reporter", "volume",
    )


#: Arrays of a columnar graph document, with the column that each makes.
ARRAYS = {
    "ids": ("id", "bigint"), "names": ("name", "string"), "cites": ("cite", "string"), "years": ("year", "int"), "dates": ("date", "string"), "cited_all": ("cited_all", "bigint"),
    "cited_scotus": ("cited_scotus", "bigint"), "has_text": ("has_text", "boolean"), "real": ("is_real", "boolean"), "cap_ids": ("cap_ids", "array<bigint>"),
}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (a column for each known array; null where the document has none) and edges (citing, cited)."""
    schema = ", ".join(f"{name} array<{kind}>" for name, (_, kind) in ARRAYS.items())
    doc = spark.read.schema(f"{schema}, edges array<int>").json(path, multiLine=True)
    empty = lambda kind: F.transform("ids", lambda _: F.lit(None).cast(kind))
    present = doc.select(*[F.coalesce(F.col(name), empty(kind)).alias(name) for name, (_, kind) in ARRAYS.items()])
    nodes = present.select(F.explode(F.arrays_zip(*ARRAYS)).alias("z")).select(*[F.col(f"z.{name}").alias(column) for name, (column, _) in ARRAYS.items()])
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("edges") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("ids", F.element_at("edges", 2 * i + 1) + 1).alias("citing"), F.element_at("ids", F.element_at("edges", 2 * i + 2) + 1).alias("cited")))
    edges = doc.where(F.size("edges") > 0).select(F.explode(pairs).alias("e")).select("e.*")
    return nodes, edges
