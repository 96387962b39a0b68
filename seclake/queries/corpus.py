"""The driver's test tables read as the tables this package works on, in Spark and in SQL.

Every corpus covers whole tables and whole texts. `code` derives source files from documents: an
invented snippet (one of a fixed list, by document) followed by the document's text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import listed
from ..sources.files import EXTENSION_LANGUAGE, spread
from .snippets import SNIPPETS


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stored table; text tables are spread over the cores."""
    read = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(read) if name in TEXTS else read


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files: one repository per source."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("language"),
        F.col("text").alias("content"),
    )


DOCUMENTS = """
  files AS (SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path, 'text' AS language, text AS content
            FROM documents)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as files: one repository per host."""
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("repo"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.lit("html").alias("language"),
        F.col("html").alias("content"),
    )


PAGES = """
  files AS (SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS repo, 'pages/' || page_id || '.html' AS path,
                   'html' AS language, html AS content FROM pages)"""


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns as files."""
    return table(spark, sf, "conversations").select(
        F.col("role").alias("repo"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("language"),
        F.col("text").alias("content"),
    )


CONVERSATIONS = """
  files AS (SELECT role AS repo, conv_id || '/' || turn || '.txt' AS path, 'text' AS language, text AS content
            FROM conversations)"""


def _place(name: str, extension: str) -> tuple[str, str, str]:
    """(path before the number, path after it, language)"""
    if extension == "Dockerfile":
        return f"app/{name}_", "/Dockerfile", "dockerfile"
    folder = {"js": "src/routes", "py": "scripts", "java": "lib/internal", "kt": "app", "yaml": "deploy"}.get(
        extension, "config"
    )
    return f"{folder}/{name}_", "." + extension, EXTENSION_LANGUAGE.get(extension, extension)


_PARTS = [(i, *_place(n, e), t) for i, (n, e, t) in enumerate(SNIPPETS)]


def code(spark: SparkSession, sf: str) -> DataFrame:
    """Source files derived from documents."""
    return code_from(spark, table(spark, sf, "documents"))


def code_from(spark: SparkSession, docs: DataFrame) -> DataFrame:
    parts = listed(spark, _PARTS, "part int, before string, after string, language string, snippet string")
    docs = docs.withColumn("part", (F.col("doc_id") % len(_PARTS)).cast("int"))
    return docs.join(F.broadcast(parts), "part").select(
        F.col("source").alias("repo"),
        F.concat("before", F.col("doc_id").cast("string"), "after").alias("path"),
        "language",
        F.concat("snippet", F.lit("\n"), "text").alias("content"),
    )


CODE = """
  parts(part, before, after, language, snippet) AS (VALUES %s),
  files AS (SELECT source AS repo, before || doc_id || after AS path, p.language,
                   snippet || chr(10) || text AS content
            FROM documents JOIN parts p ON p.part = doc_id %% %d)""" % (
    ",\n".join("(%d, %s, %s, %s, %s)" % (i, lit(b), lit(a), lit(l), lit(t)) for i, b, a, l, t in _PARTS),
    len(_PARTS),
)

def lines_sql(prefix: str = "") -> str:
    """CTEs from `files` to `lines`, numbered from 0."""
    return f"""
  {prefix}numbered AS (SELECT repo, path, language, string_split(content, chr(10)) AS all_lines FROM {prefix}files),
  {prefix}lines AS MATERIALIZED (
    SELECT repo, path, language, unnest(all_lines) AS text,
           (generate_subscripts(all_lines, 1) - 1)::INT AS line FROM {prefix}numbered)"""


STORED = ("documents", "pages", "conversations", "labels", "events", "customer", "orders", "part", "supplier", "benchmark", "nation")
_views = itertools.count()


def sql_table(spark: SparkSession, sf: str, text: str, **tables: DataFrame) -> DataFrame:
    """Run portable SQL; names in braces are stored tables or the frames given."""
    for name in (*tables, *STORED):
        if "{%s}" % name in text:
            view = f"seclake_{name}_{next(_views)}"
            (tables[name] if name in tables else table(spark, sf, name)).createOrReplaceTempView(view)
            text = text.replace("{%s}" % name, view)
    return spark.sql(text)


def duck(text: str, *names: str) -> str:
    """The same SQL for the oracle, where stored tables are views and frames are CTEs."""
    for name in (*names, *STORED):
        text = text.replace("{%s}" % name, name)
    return text
