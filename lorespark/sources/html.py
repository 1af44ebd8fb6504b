"""Elements of HTML pages by regular expressions in the JVM: tables, blocks by class, anchors, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import decode_entities


def text_of(html: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded, outer white space off."""
    return F.regexp_replace(decode_entities(F.regexp_replace(html, "<[^>]+>", "")), r"^\s+|\s+$", "")


def elements(html: Column, tag: str) -> Column:
    """All elements of a tag, with their tags; they hold none of their own kind."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})\b[^>]*>.*?</(?:{tag})>"), 0)


def cells(row: Column) -> Column:
    """Text of the data cells of a table row."""
    return F.transform(elements(row, "td"), text_of)


def tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, table_no, head, rows): the text of a table's header cells, and its rows of data cells with and without tags."""
    each = pages.select("page_id", F.posexplode(elements(F.col(html), "table")).alias("table_no", "table"))
    lines = each.withColumn("lines", elements(F.col("table"), "tr"))
    data = F.filter(F.transform("lines", lambda r: F.struct(cells(r).alias("cells"), elements(r, "td").alias("html"))), lambda r: F.size(r["cells"]) > 0)
    head = F.upper(F.array_join(F.transform(elements(F.col("table"), "th"), text_of), " "))
    first = F.upper(F.coalesce(text_of(F.get("lines", F.lit(0))), F.lit("")))
    return lines.select("page_id", "table_no", head.alias("head"), first.alias("first"), text_of(F.col("table")).alias("text"), data.alias("rows"))


def blocks(pages: DataFrame, opener: str, html: str = "html") -> DataFrame:
    """(page_id, at, block): what stands from each opening tag that a pattern finds up to the next one."""
    parts = F.filter(F.split(html, f"(?i)(?={opener})"), lambda x: x.rlike(f"(?i)^{opener}"))
    return pages.select("page_id", F.posexplode(parts).alias("at", "block"))


def of_class(block: Column, name: str, tag: str = "div|span|p") -> Column:
    """Text of the first element of a class in a fragment; empty for none. The element holds no other one of its tag."""
    return text_of(F.regexp_extract(block, rf'(?is)<({tag})\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</\1>', 2))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, at, anchor, section): named anchors in order, each with the page up to the next one."""
    each = blocks(pages, r'<a\b[^>]*\bname="', html)
    return each.select("page_id", "at", F.regexp_extract("block", r'(?i)^<a\b[^>]*\bname="([^"]*)"', 1).alias("anchor"), F.col("block").alias("section")).filter("anchor <> ''")
