"""Rows from HTML pages: cache keys, links, headed sections, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import clean, decode_entities, links, readable
from lorespark.sources import elements as el


def cached(pages: DataFrame) -> DataFrame:
    """pages with the key of their URL, the hash of their content and their class by URL."""
    url = F.col("url")
    kind = F.when(url.contains("/datasheets"), "datasheet").when(url.contains("/factions/"), "faction").when(url.contains("?"), "query").otherwise("page")
    return pages.select("page_id", "url", F.md5("url").alias("url_hash"), F.sha2("html", 256).alias("content_hash"), kind.alias("kind"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, at, target): each link of a page once, relative ones on the page's site."""
    site = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    each = pages.select("page_id", site.alias("site"), F.posexplode(links(F.col("html"))).alias("at", "href"))
    return each.select("page_id", "at", F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.concat_ws("/", "site", "href")).alias("target"))


# Pictures before the names of units that a list of contents shows but that are left out.
LEFT_OUT = ["Legends_logo", "FW_logo"]


def toc_entries(pages: DataFrame, part: str = "/datasheets#") -> DataFrame:
    """(page_id, at, name, slug): units that a list of contents links to, each anchor once, the first.

    An entry is a link whose target holds ``part``; its slug is the anchor
    behind that, escapes decoded, with hyphens for spaces. A link whose
    neighbour before it, or before the element that it opens, is a picture of
    LEFT_OUT is passed over, and so is one without a text.
    """
    told = el.spans(el.tokens(pages))
    order = Window.partitionBy("page_id").orderBy("at")
    tags = told.filter("tag is not null").withColumns({"b1": F.lag("token", 1).over(order), "s1": F.lag("step", 1).over(order), "b2": F.lag("token", 2).over(order)})
    picture = lambda c: F.coalesce(F.col(c).rlike("(?i)^<img") & el.attribute(F.col(c), "src").rlike("|".join(LEFT_OUT)), F.lit(False))
    target = el.attribute(F.col("token"), "href")
    escaped = F.substring_index(target, part, -1)
    anchor = F.trim(F.coalesce(F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), escaped))
    links = tags.filter((F.col("tag") == "a") & (F.col("step") == 1)).filter(target.contains(part))
    shown = links.filter(~picture("b1") & ~((F.col("s1") == 1) & picture("b2"))).select("page_id", "at", "until", anchor.alias("anchor")).filter("anchor <> ''")
    inside = told.filter(F.col("tag").isNull() & ~F.startswith("token", F.lit("<"))).select("page_id", F.col("at").alias("t"), "token").alias("x").join(shown.alias("s"), "page_id").filter("x.t > s.at and x.t < coalesce(s.until, s.at + 2)")
    named = inside.groupBy("page_id", "at", "anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "token"))), lambda x: x["token"]), "").alias("name"))
    clean_name = F.trim(F.regexp_replace(decode_entities(F.col("name")), r"\s+", " "))
    first = named.select("page_id", "at", "anchor", clean_name.alias("name")).withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "anchor").orderBy("at")))
    return first.filter("_n = 1 and name <> ''").select("page_id", "at", "name", F.regexp_replace("anchor", r"\s+", "-").alias("slug"))


def headed_sections(pages: DataFrame, levels: str = "1-6", least: int = 0) -> DataFrame:
    """(page_id, at, level, title, body): the text from each heading to the next."""
    parts = F.filter(F.split("html", rf"(?i)(?=<h[{levels}][ >])"), lambda x: x.rlike(rf"(?i)^<h[{levels}][ >]"))
    each = pages.select("page_id", F.posexplode(parts).alias("at", "part"))
    head = rf"(?is)^<h([{levels}])[^>]*>(.*?)</h[{levels}]>"
    title = clean(F.regexp_replace(F.regexp_extract("part", head, 2), "<[^>]+>", ""))
    body = readable(F.regexp_replace("part", head, ""))
    out = each.select("page_id", "at", F.regexp_extract("part", head, 1).alias("level"), title.alias("title"), body.alias("body"))
    # A filter on the body is pushed below the projection and evaluates its expressions once more.
    return out.filter(F.length("body") >= least) if least else out


def questions(pages: DataFrame) -> DataFrame:
    """(page_id, at, question, answer, slug) of texts written as Q: ... A: ..."""
    text = readable(F.col("html"))
    each = pages.select("page_id", F.posexplode(F.split(text, r"(?=Q:)")).alias("at", "part")).filter(F.col("part").startswith("Q:") & F.col("part").contains("A:"))
    q = F.trim(F.regexp_extract("part", r"(?s)^Q:\s*(.*?)\s*A:", 1))
    a = F.trim(F.regexp_extract("part", r"(?s)A:\s*(.*)$", 1))
    return each.select("page_id", "at", clean(q).alias("question"), clean(a).alias("answer"), F.concat(F.lit("faq-"), F.substring(F.md5(clean(q)), 1, 8)).alias("slug"))


def effective_date(c: Column) -> Column:
    """The first date in a text, of the forms 12 June 2025, June 12, 2025, June 2025, 12/06/2025, 2025-06-12."""
    forms = [(r"(\d{1,2} [A-Z][a-z]+ \d{4})", "d MMMM yyyy"), (r"([A-Z][a-z]+ \d{1,2}, \d{4})", "MMMM d, yyyy"), (r"([A-Z][a-z]+ \d{4})", "MMMM yyyy"), (r"(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd")]
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit(f)) for p, f in forms])
