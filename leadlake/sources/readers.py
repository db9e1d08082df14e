"""Reading lead records: CSV, sheet exports, JSON records and CRM contact pages.

Every value arrives as text; typing happens by coercion after the mapping.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.sources.pages import LandedPages, PageReader, register_pages

# Contact properties requested from the CRM.
CONTACT_PROPERTIES = (
    "firstname", "lastname", "email", "jobtitle", "company", "industry", "city", "country",
    "lifecyclestage", "hs_lead_status", "hs_analytics_num_page_views",
    "hs_analytics_num_visits", "hs_analytics_average_page_views", "hs_analytics_source",
    "hs_analytics_source_data_1", "hs_email_open", "hs_email_click", "num_conversion_events",
    "hs_object_id", "createdate", "notes_last_updated", "hs_email_optout",
)


def _named(df: DataFrame) -> DataFrame:
    """Strip a byte order mark from the first name and drop columns without a name."""
    names = [c.lstrip("﻿").strip('"') for c in df.columns]
    kept = [F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, names)
            if new and not (new.startswith("_c") and new[2:].isdigit())]
    return df.select(*kept)


def read_leads_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Header CSV, all text. Files without line breaks in values can be split further by
    passing ``multiline=False``; one large multi-line file is read by one task."""
    return _named(
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("inferSchema", False).csv(path)
    )


def sheet_export_scan(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejected files): an export that starts with an HTML page is not a sheet.

    The first 200 characters decide. Line numbers find the files with a page tag near the
    top; only for those are the lengths of the lines before it summed. No file is read whole
    into one value.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    ).where(F.col("start") == 0)
    tag = F.locate("<html", F.lower("value"))
    suspects = lines.groupBy("file").agg(
        F.min(F.when(tag > 0, F.col("at"))).alias("tag_at"), F.min("at").alias("first_at"),
    ).where(F.col("tag_at") - F.col("first_at") < 200).drop("first_at")
    before = F.when(F.col("at") < F.col("tag_at"), F.length("value") + 1).otherwise(tag + 4)
    rejected = (
        lines.join(suspects, "file").where(F.col("at") <= F.col("tag_at"))
        .groupBy("file").agg(F.sum(before).alias("chars")).where(F.col("chars") <= 200)
        .select("file", F.lit("the sheet returned HTML, not CSV").alias("error"))
    )
    # Files may differ in their columns: each group of files with one header is read by it.
    # Paths come to the driver, which lists the files for any read; lines do not.
    headers = (
        lines.join(rejected.select("file"), "file", "left_anti").groupBy("file").agg(F.min_by("value", "at").alias("header"))
        .groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    )
    groups = []
    for found in headers:
        names = next(csv.reader([found["header"] or ""]))
        fields = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
        groups.append(_named(
            spark.read.schema(fields).option("header", True).option("multiLine", multiline)
            .option("escape", '"').csv(found["files"])))
    if not groups:
        return spark.createDataFrame([], T.StructType([])), rejected
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), groups), rejected


def read_leads_inline(spark: SparkSession, records: Sequence[dict] | str, columns: Sequence[str]) -> DataFrame:
    """Records handed in as dictionaries, or landed as JSON lines under a path; all text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if isinstance(records, str):
        return spark.read.schema(schema).json(records)
    rows = [tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in records]
    return spark.createDataFrame(rows, schema)


def contact_schema() -> T.StructType:
    contact = T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ])
    return T.StructType([T.StructField("results", T.ArrayType(contact))])


def flatten_contacts(pages: DataFrame, extra_properties: Sequence[str] = ()) -> DataFrame:
    """One row per contact; the page's contact id is ``hs_object_id``."""
    wanted = list(dict.fromkeys([*CONTACT_PROPERTIES, *extra_properties]))
    contacts = pages.select(F.explode("results").alias("c"))
    values = [
        (F.col("c.id") if p == "hs_object_id" else F.col("c.properties")[p]).alias(p) for p in wanted
    ]
    return contacts.select(*values)


def crm_contact_pages(spark: SparkSession, path: str, extra_properties: Sequence[str] = ()) -> DataFrame:
    return flatten_contacts(spark.read.schema(contact_schema()).json(path), extra_properties)


Reader = Callable[..., DataFrame]
_READERS: dict[str, tuple[Reader, bool]] = {
    "csv": (read_leads_csv, False),
    "google_sheet": (lambda spark, path, **kw: sheet_export_scan(spark, path, **kw)[0], False),
    "inline": (read_leads_inline, False),
    "hubspot": (crm_contact_pages, True),
}


def register_source(kind: str, reader: Reader, supports_writeback: bool = False) -> None:
    """Add a kind of source. A reader may itself use a registered Python data source."""
    _READERS[kind] = (reader, supports_writeback)


def register_paged_source(spark: SparkSession, kind: str, made: Callable[[Mapping[str, str]], PageReader] = LandedPages,
                          supports_writeback: bool = False) -> None:
    """Add a kind that hands out pages: a Spark data source of that name, for reads and streams,
    and a kind of ``read_source`` (columns, then the reader's options)."""
    register_pages(spark, kind, made)

    def read(session: SparkSession, columns: Sequence[str], **options: str) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return session.read.format(kind).schema(schema).options(**options).load()

    register_source(kind, read, supports_writeback)


def source_kinds() -> list[tuple[str, bool]]:
    return sorted((kind, writeback) for kind, (_, writeback) in _READERS.items())


def read_source(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    if kind not in _READERS:
        raise ValueError(f"Unknown source kind '{kind}'. Available: {', '.join(sorted(_READERS))}")
    return _READERS[kind][0](spark, *args, **options)
