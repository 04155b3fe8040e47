"""Reading captured search pages, crawled pages and event logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions import urls

#: A captured search page; country and language are the folders it lies in (``country=US/language=en``).
SERP_SCHEMA = ("serp_id string, query string, page int, results_per_page int, html string, broken string, country string, language string")
CRAWL_SCHEMA = ("url string, success boolean, title string, markdown string, cleaned_html string, error string, "
                "execution_time double")
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Batch or streaming scan of a folder of captured files."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(schema).load(path)


def search_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured search pages as JSON lines below ``country=…/language=…`` folders, batch or stream, with their request context.

    ``broken`` holds a line that is no JSON object (the other fields are null then, the context is known all the same),
    ``file_name`` and ``captured_at`` say where and when it was captured. A filter on country or language reads only their folders.
    """
    reader = (spark.readStream if stream else spark.read).schema(SERP_SCHEMA).option("columnNameOfCorruptRecord", "broken")
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("captured_at"))


def request_outcomes(pages: DataFrame, request: str) -> DataFrame:
    """Per request the pages attempted, crawled and failed, the sources found, and the errors by type (``url``, ``problem`` of ``usable_pages``)."""
    n, problem = F.count(F.lit(1)), F.col("problem")
    kinds = {"crawl_failed": "crawl_errors", "insufficient_content": "insufficient_content_errors"}
    found = F.array_sort(F.collect_list(F.when(problem.isNull(), F.col("url"))))  # a request asks for few pages
    return pages.groupBy(request).agg(n.alias("attempted"), F.count_if(problem.isNull()).alias("crawled"), F.count("problem").alias("failed"),
                                      found.alias("sources_found"), *[F.count_if(problem == k).alias(c) for k, c in kinds.items()])


def usable_pages(crawled: DataFrame, least_chars: int = 100) -> DataFrame:
    """Successful crawls with enough content: HTML if there is any, else the text form."""
    some = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    content = F.coalesce(some("cleaned_html"), some("markdown"), F.lit(""))
    return (crawled.withColumn("content", content)
            .withColumn("problem", F.when(~F.col("success"), "crawl_failed")
                        .when(F.length(F.trim("content")) <= least_chars, "insufficient_content")))


def crawl_facts(pages: DataFrame) -> DataFrame:
    """Word count of the text and links inside and outside the page's own host."""
    links = F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))
    away = F.filter(links, lambda u: u.rlike("^https?://") & (urls.host(u) != urls.host(F.col("url"))))
    images = F.regexp_extract_all("html", F.lit(r'<img[^>]*src="([^"]*)"'), F.lit(1))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return pages.select("page_id", "url", words.alias("words"), (F.size(links) - F.size(away)).alias("internal_links"),
                        F.size(away).alias("external_links"), F.size(images).alias("images"))
