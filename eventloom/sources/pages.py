"""Pages as tables: files with a fallback charset, file names of addresses, look-ups by address, and the JSON document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text, or EUC-KR where the bytes aren't UTF-8 (a charset Spark's decode doesn't take)."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("euc-kr", "replace")

    return content.map(one)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, html) of the files below a path."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), decoded("content"))
    return rows.select(F.regexp_extract("path", r"[^/]+\z", 0).alias("file"), text.alias("html"))


def file_name(u: Column) -> Column:
    """The file of an address: its path and query in URL-safe base64."""
    return F.concat(F.rtrim(F.translate(F.base64(F.concat(u["path"], u["query"])), "+/", "-_"), F.lit("=")), F.lit(".html"))


def loaded(seeds: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds (url) with html, looked up by exact address in index (url, file) and pages (file, html); `skip` says which is
    missing."""
    rows = seeds.join(index, "url", "left").join(pages, "file", "left")
    return rows.withColumn("skip", F.when(F.col("file").isNull(), "missing-mapping").when(F.col("html").isNull(), "missing-file"))


def _field(name: str, c: Column, nullable: bool) -> Column:
    """A JSON member; an unknown optional one is left out, an unknown nullable one is null."""
    value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    member = F.concat(F.lit(f'"{name}":'), F.regexp_extract(value, r'(?s)\A\{"v":(.*)\}\z', 1))
    return member if nullable else F.when(c.isNotNull(), member)


def document_lines(events: DataFrame, also: list[str | Column] | None = None) -> DataFrame:
    """One JSON object per event: deadline, verification and prices may be null, other unknown fields are left out; with columns
    beside it that are asked for."""
    c = F.col
    names = {"name": ("name", True), "event_date": ("eventDate", True), "registration_deadline": ("registrationDeadline", True), "venue": ("venue", True), "region": ("region", False)}
    late = {"application_url": ("applicationUrl", True), "official_site_url": ("officialSiteUrl", False), "logo_url": ("logoUrl", False), "notes": ("notes", False), "sources": ("sources", True), "verified": ("verified", True), "last_verified": ("lastVerified", True), "updated_at": ("updatedAt", True), "generated_at": ("generatedAt", True), "registration_status": ("registrationStatus", True)}
    course = F.transform("courses", lambda x: F.concat(F.lit("{"), F.concat_ws(",", _field("name", x["name"], True), _field("price", x["price"], True), _field("priceSource", x["price_source"], False)), F.lit("}")))
    parts = [_field(n, c(k), null) for k, (n, null) in names.items()] + [F.concat(F.lit('"courses":['), F.array_join(course, ","), F.lit("]"))] + [_field(n, c(k), null) for k, (n, null) in late.items()]
    return events.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"), *(also or []))


def write_events(events: DataFrame, metadata: DataFrame, path: str, live: bool = True) -> None:
    """Writes the lines over those of before, unless every live source failed: then the old ones stay and this raises."""
    if live and not (metadata.agg(F.coalesce(F.bool_or("succeeded"), F.lit(False))).first()[0]):
        raise RuntimeError("every source failed; the events of before are kept")
    document_lines(events).write.mode("overwrite").text(path)


def run_summary(metadata: DataFrame) -> DataFrame:
    """id and status (OK, FAIL, SKIP) of each source."""
    return metadata.select("id", F.when(~F.col("attempted"), "SKIP").when(F.col("succeeded"), "OK").otherwise("FAIL").alias("status"))
