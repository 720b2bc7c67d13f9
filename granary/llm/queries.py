"""Queries and SQL of the operators on text; the driver's entry adds them where this package is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.urls import site
from granary.llm import boilerplate as p1
from granary.llm import mixing as p9
from granary.llm import packing as p8
from granary.llm import repeated_lines as p6
from granary.llm import scans as p3
from granary.llm import shared_spans as p10
from granary.llm import splitting as p7
from granary.llm.tokens import count_tokens
from granary.plans.staging import stage
from granary.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_articles").select(
        F.col("page_id").alias("doc"), site(F.col("url")).alias("site"), F.col("content").alias("text")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that aren't main body."""
    pages = table(spark, d, "web_articles").select(
        F.col("page_id").alias("page"), site(F.col("url")).alias("site"), "title", "author", F.col("content").alias("text")
    )
    return p1.boilerplate_lines(pages).withColumnRenamed("page", "page_id")


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    """Each page's content with its article body alone."""
    gone = p1_found(spark, d).withColumnRenamed("page_id", "doc")
    out = p6.without_lines(_pages(spark, d).where("text is not null"), gone)
    body = F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    return out.select(F.col("doc").alias("page_id"), "site", body.alias("body"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    pubs = table(spark, d, "publications")
    fields = [
        pubs.select(F.col("pub_id").alias("item"), F.lit(f).alias("field"), "title", F.col(f).alias("text"))
        for f in ("content", "pdf_data.content")
    ]
    return fields[0].unionByName(fields[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Faults of scanned texts by line."""
    return p3.faults(_scans(spark, d)).withColumnsRenamed({"item": "pub_id", "field": "field_name"})


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts as continuous readable paragraphs."""
    return p3.repair(_scans(spark, d)).withColumnsRenamed({"item": "pub_id", "field": "field_name"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in at least 8 pages of their site."""
    return p6.repeated_lines(_pages(spark, d), 8).withColumnRenamed("doc", "page_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Passages that a site repeats in at least 8 pages, however their lines are broken: characters from start to before end."""
    return p6.repeated_spans(_pages(spark, d), 8).withColumnRenamed("doc", "page_id")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each page's content without the passages and lines its site repeats in at least 8 pages."""
    pages = _pages(spark, d).where("text is not null")
    out = p6.without_repetitions(pages, *p6.repetitions(pages, 8))
    return out.select(F.col("doc").alias("page_id"), "site", F.col("text").alias("content"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text longer than its limit, with the stated overlap."""
    pages = table(spark, d, "web_articles").select(
        F.lit("web_articles").alias("table_name"), F.col("page_id").cast("string").alias("item_id"),
        F.lit("content").alias("field_name"), F.col("content").alias("text"),
    )
    pubs = table(spark, d, "publications")
    texts = [
        pubs.select(
            F.lit("publications").alias("table_name"), F.col("pub_id").alias("item_id"), F.lit(f).alias("field_name"),
            F.col(f).alias("text"),
        )
        for f in ("content", "pdf_data.content")
    ]
    limits = table(spark, d, "size_limits").where("purpose = 'split' and size_unit = 'characters'")
    return p7.split(pages.unionByName(texts[0]).unionByName(texts[1]), limits)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that had to be split."""
    return p7_pieces(spark, d).where("piece_no = 2").select("table_name", "item_id", "field_name").distinct()


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    return stage(count_tokens(docs), "document-tokens")


def _capacities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "size_limits").where("purpose = 'pack' and table_name = 'documents' and size_unit = 'tokens'")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents assigned to containers of each pack size."""
    return p8.pack(_tokens(spark, d), _capacities(spark, d)).withColumnRenamed("doc", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each pack size are."""
    return p8.fill_report(p8_pack(spark, d))


def p8_pack_targets(spark: SparkSession, d: str) -> DataFrame:
    """Documents assigned to containers, the windows filled by the target shares of the sources as long as these last."""
    return p8.pack(_tokens(spark, d), _capacities(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("doc", "doc_id")


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """The share of each source with a target in each window of p8_pack_targets."""
    items, targets = _tokens(spark, d), table(spark, d, "mix_targets")
    return p8.window_shares(p8.pack(items, _capacities(spark, d), targets), items, targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents combined so that each source has its target share of all tokens."""
    return p9.mix(_tokens(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    items, targets = _tokens(spark, d), table(spark, d, "mix_targets")
    return p9.shares(items, targets, p9.mix(items, targets))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a span of at least 200 characters."""
    return p10.shared_pairs(_documents(spark, d), 200)


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The passages of each document that stand in others too: characters from start (0 is the first) to before end."""
    return p10.merged_spans(_documents(spark, d), 200).withColumnRenamed("doc", "doc_id")


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a shared passage, by passage, with its place in each: membership without pairs."""
    return p10.groups(_documents(spark, d), 200).withColumnRenamed("doc", "doc_id")


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each document, how much of its text is shared with others."""
    return p10.coverage(_documents(spark, d), 200).withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Query]:
    """All queries of this package by name."""
    own = (p1_found, p1_body, p3_found, p3_repaired, p6_found, p6_spans, p6_cleaned, p7_found, p7_pieces, p8_pack, p8_fill, p8_pack_targets, p8_windows, p9_mix, p9_shares, p10_found, p10_spans, p10_groups, p10_coverage)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express over whole tables."""
    site_sql = (
        "regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(trim(url), "
        "'^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '^([^/?#]*)', 1), ':[0-9]*$', '')), '^((www|m)\\.)+', '')"
    )
    return {
        "p7_found": """
with texts as (
  select 'web_articles' as table_name, cast(page_id as varchar) as item_id, 'content' as field_name, content as t from web_articles
  union all select 'publications', pub_id, 'content', content from publications
  union all select 'publications', pub_id, 'pdf_data.content', pdf_data.content from publications)
select distinct table_name, item_id, field_name from texts join size_limits using (table_name, field_name)
where purpose = 'split' and length(t) > max_size""",
        "p6_found": f"""
with pages as (select distinct page_id, {site_sql} as site, content from web_articles
               where url is not null and content is not null),
lines as (select page_id, site, unnest(string_split(content, chr(10))) as line,
                 generate_subscripts(string_split(content, chr(10)), 1) as line_no from pages),
keyed as (select page_id, site, line_no, lower(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) as k from lines),
often as (select site, k from keyed where k <> '' group by site, k having count(distinct page_id) >= 8)
select distinct page_id, cast(line_no as integer) as line_no from keyed join often using (site, k)""",
    }
