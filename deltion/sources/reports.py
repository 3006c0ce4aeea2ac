"""Landed JSON: candidate reports, notice pages, feed payloads (A1-A3), files (A8), state reads (A12), reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltion import schemas, vocab
from deltion.functions.extract import official_reference, official_url
from deltion.functions.numbers import first_amount
from deltion.functions.text import clean, html_text
from deltion.operators.filters import is_document_url, notice_status


def _ddl(struct: str) -> str:
    """Top-level fields of a declared struct, for a reader."""
    return struct[len("struct<") : -1]


def filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def candidate_rows(reports: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A1: one row per candidate of a parsed report (`candidates` array); rows without an id are dropped."""
    c = reports.select(*keep, F.posexplode("candidates").alias("position", "c")).filter(F.coalesce("c.eshidis_id", F.lit("")) != "")
    item = F.col("c")
    return c.select(
        *keep, "position", F.lit("ESHIDIS").alias("source"), F.lit("ESHIDIS").alias("record_type"), item["eshidis_id"].alias("official_id"),
        filled(item["title"]).alias("title"), filled(item["authority_name"]).alias("authority"),
        F.coalesce(
            filled(item["budget"], item["totalCostWithVAT"], item["totalCostWithoutVAT"], item["totalCost"], item["estimatedValue"]),
            first_amount(item["row_text"]),
        ).alias("budget"),
        filled(item["published_at"]).alias("published_at"), filled(item["submission_deadline"]).alias("submission_deadline"),
        F.coalesce(filled(item["status"]), F.lit("DISCOVERED_ACTIVE_CANDIDATE")).alias("status"), official_url(item["eshidis_id"]).alias("source_url"),
    )


def scan_candidate_report(spark: SparkSession, path: str) -> DataFrame:
    """A1: candidate reports on disk."""
    return candidate_rows(spark.read.schema(_ddl(schemas.CANDIDATE_REPORT)).option("multiLine", True).json(path))


def candidates_from_json(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """A1: reports held in a text column."""
    return candidate_rows(df.select(*keep, F.from_json(payload, schemas.CANDIDATE_REPORT)["candidates"].alias("candidates")), keep)


def notice_rows(pages: DataFrame, as_of: Column) -> DataFrame:
    """A2: notices of parsed feed pages (source_id, page, content array) of the three families."""
    kind, endpoint = F, F
    for source, record, path in vocab.NOTICE_FAMILIES:
        kind, endpoint = kind.when(F.col("source_id") == source, record), endpoint.when(F.col("source_id") == source, path)
    items = pages.select("source_id", "page", kind.alias("record_type"), endpoint.alias("_endpoint"), F.explode("content").alias("n"))
    n = F.col("n")
    url = F.concat(F.lit(vocab.FEED_URL), F.col("_endpoint"), F.lit("/attachment/"), n["referenceNumber"])
    return items.filter(F.coalesce("n.referenceNumber", F.lit("")) != "").select(
        F.lit("KIMDIS").alias("source"), "record_type", n["referenceNumber"].alias("official_id"), filled(n["title"]).alias("title"),
        filled(n["organization"]["value"], n["organization"]["name"], n["organizationName"], n["authorityName"]).alias("authority"),
        filled(n["budget"], n["totalCostWithVAT"], n["totalCostWithoutVAT"], n["totalCost"], n["estimatedValue"], n["estTotalCost"], n["awardTotalCost"]).alias("budget"),
        filled(n["submissionDate"], n["signedDate"]).alias("published_at"), filled(n["finalSubmissionDate"]).alias("submission_deadline"),
        notice_status(F.col("record_type"), n["cancelled"], n["finalSubmissionDate"], as_of).alias("status"), url.alias("attachment_url"), "source_id", "page",
    )


def page_stats(pages: DataFrame) -> DataFrame:
    """A2: items returned per source and page; null items where the page failed."""
    return pages.select("source_id", "page", F.when(F.col("error").isNull(), F.coalesce(F.size("content"), F.lit(0))).alias("items_returned"), "error")


def scan_notice_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A2: landed pages; source and page come from the folder names `source_id=.../page=...`."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{_ddl(schemas.NOTICE_PAGE)}, source_id string, page int, error string").option("multiLine", True).json(path)


def _feed(items: DataFrame, keep: Sequence[str], title: Column, published: Column, text: Column, detail: Column, links: Column, fallback: Column | None) -> DataFrame:
    ref = official_reference(text, detail, fallback)
    return items.select(
        *keep, ref["official_id"].alias("official_id"), ref["record_type"].alias("record_type"), title.alias("title"), published.alias("published_at"),
        detail.alias("detail_url"), F.try_element_at(links, F.lit(1)).alias("attachment_url"), F.size(links).alias("attachments"), clean(text).alias("row_text"),
    )


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("""(?i)<a\\b[^>]*href=["']([^"']+)["']"""), F.lit(1))


def scan_feed_items(df: DataFrame, payload: str, adapter: str, source_url: str, keep: Sequence[str] = ()) -> DataFrame:
    """A3: posts, act-registry decisions or EU notices in a text column -> candidate rows."""
    url = F.col(source_url)
    if adapter == "posts":
        items = df.select(*keep, source_url, F.explode(F.from_json(payload, schemas.POSTS)).alias("i"))
        i = F.col("i")
        body = filled(i["content"]["rendered"], i["excerpt"]["rendered"])
        title = F.nullif(html_text(i["title"]["rendered"]), F.lit(""))
        text = F.concat_ws(" ", title, html_text(i["excerpt"]["rendered"]), F.substring(html_text(i["content"]["rendered"]), 1, 5000))
        links = F.array_distinct(F.filter(F.coalesce(hrefs(body), F.array().cast("array<string>")), lambda u: is_document_url(u)))
        return _feed(items, keep, title, filled(i["date"]), text, F.coalesce(filled(i["link"]), url), links, None)
    if adapter == "decisions":
        items = df.select(*keep, source_url, F.explode(F.from_json(payload, schemas.DECISIONS)["decisions"]).alias("i"))
        i = F.col("i")
        ada = F.coalesce(i["ada"], F.lit(""))
        detail = F.coalesce(filled(i["documentUrl"]), F.when(ada != "", F.concat(F.lit("https://diavgeia.gov.gr/doc/"), ada)))
        links = F.filter(F.array(detail), lambda x: F.coalesce(is_document_url(x), F.lit(False)))
        return _feed(items, keep, filled(i["subject"]), filled(i["issueDate"], i["submissionTimestamp"]), F.to_json(i), F.coalesce(detail, url), links, ada)
    if adapter == "eu_notices":
        items = df.select(*keep, source_url, F.explode(F.from_json(payload, schemas.EU_NOTICES)["notices"]).alias("i"))
        i = F.col("i")
        names = i["notice-title"]
        title = F.coalesce(*[filled(F.try_element_at(names, F.lit(k))) for k in ("ell", "ELL", "el", "eng", "ENG", "en")], filled(F.try_element_at(F.map_values(names), F.lit(1))))
        none = F.array().cast("array<string>")
        links = F.array_distinct(F.concat(*[F.coalesce(F.map_values(i["links"][f]), none) for f in ("html", "htmlDirect", "pdf", "xml")]))
        number = F.coalesce(i["publication-number"], F.lit(""))
        detail = F.coalesce(F.try_element_at(links, F.lit(1)), url)
        return _feed(items, keep, title, filled(i["publication-date"]), F.to_json(i), detail, F.slice(links, 2, 10**9), number)
    raise ValueError(f"unknown adapter {adapter}")


def scan_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Path, name, size and sha256 of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def scan_state(df: DataFrame, filters: dict[str, object] | None = None, order: Sequence[Column] = (), metadata: str | None = None) -> DataFrame:
    """State table by equality filters (pushed into the scan), ordered; JSON metadata as a map."""
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    if metadata:
        df = df.withColumn(metadata, F.from_json(metadata, "map<string,string>"))
    return df.orderBy(*order) if order else df


def write_report(df: DataFrame, path: str) -> None:
    """JSON report."""
    df.write.mode("overwrite").json(path)
