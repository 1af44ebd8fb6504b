"""Nested elements of HTML pages as rows.

A page becomes a stream of tokens: tags, texts, comments. How deep a tag lies
among those of its own name is a running sum over opening and closing tags; at
each depth they take turns, so an element ends at the next tag of its name and
depth. All of it is windows over a page's tokens: no element is searched for
by a pattern that its own contents could break, and tables may hold tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import decode_entities

#: Scripts and styles whole, comments and declarations, tags (attributes may hold ">" in quotes), texts, and a stray "<".
TOKEN = r"""(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->|<![^>]*>|</?[a-z][^\s/>]*(?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
# Elements that have no end.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def tokens(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, at, token, tag, step, level) of a page's tokens; step is 1 for an opening tag, -1 for a closing one, 0 for others.

    level tells how deep an opening or closing tag lies among those of its
    name (others: null); tag is null for texts, comments, scripts and styles.
    A null page has no tokens.
    """
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), 0)).alias("at", "token"))
    raw = F.col("token").rlike(r"(?is)^<(?:script|style)\b.*</")
    tag = F.when(~raw, F.lower(F.nullif(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1), F.lit(""))))
    alone = F.col("tag").isin(VOID) | F.col("token").rlike(r"/>$")
    step = F.when(F.col("tag").isNull() | alone, 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1)
    named = each.withColumn("tag", tag).withColumn("step", step)
    depth = F.sum("step").over(Window.partitionBy(key, "tag").orderBy("at"))
    return named.withColumn("level", F.when(F.col("step") == 1, depth).when(F.col("step") == -1, depth + 1))


def spans(told: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of tokens() with until: of an opening tag the place of the tag that ends its element, null where none does, of a void one its own place."""
    turn = Window.partitionBy(key, "tag", "level").orderBy("at")
    end = F.when(F.lead("step").over(turn) == -1, F.lead("at").over(turn))
    return told.withColumn("until", F.when(F.col("step") == 1, end).when((F.col("step") == 0) & F.col("tag").isNotNull(), F.col("at")))


def attribute(token: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, entities decoded; null without it."""
    has = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(token, has, i) for i in (1, 2, 3)])
    return F.when(token.rlike(has), decode_entities(value))


def has_class(token: Column, names: list[str]) -> Column:
    """Whether a tag has one of some classes."""
    given = F.split(F.coalesce(attribute(token, "class"), F.lit("")), r"\s+")
    return F.arrays_overlap(given, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def without(pages: DataFrame, classes: list[str], html: str = "html", key: str = "page_id") -> DataFrame:
    """pages with the elements of some classes taken out, whatever they hold; one without an end goes up to the end of the page.

    Rows are told apart by ``key``, which must be unique. Null pages stay null.
    """
    told = spans(tokens(pages, html, key), key)
    gone = (F.col("step") >= 0) & F.col("tag").isNotNull() & has_class(F.col("token"), classes)
    begun = told.withColumn("gone", F.coalesce(gone, F.lit(False)))
    far = F.lit((1 << 31) - 1)
    # A token is inside if it lies before the furthest end of the removed elements that begin at or before it.
    reach = F.max(F.when(F.col("gone"), F.coalesce("until", far))).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    left = begun.withColumn("reach", reach).filter("reach is null or at > reach")
    joined = left.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "").alias("_left"))
    kept = F.when(F.col(html).isNotNull(), F.coalesce("_left", F.lit("")))
    return pages.join(joined, key, "left").withColumn(html, kept).drop("_left")


def inner_of(told: DataFrame, tag: str, name: str, key: str = "page_id") -> DataFrame:
    """told with the place of the innermost element of a tag that each token lies in, itself counted in; null outside of all."""
    deep = F.sum(F.when(F.col("tag") == tag, F.col("step")).otherwise(0)).over(Window.partitionBy(key).orderBy("at"))
    # A closing tag still belongs to what it closes.
    depth = told.withColumn("_d", F.when((F.col("tag") == tag) & (F.col("step") == -1), deep + 1).otherwise(deep))
    opened = F.last(F.when((F.col("tag") == tag) & (F.col("step") == 1), F.col("at")), ignorenulls=True)
    return depth.withColumn(name, F.when(F.col("_d") > 0, opened.over(Window.partitionBy(key, "_d").orderBy("at")))).drop("_d")


def outer_of(told: DataFrame, tag: str, key: str = "page_id") -> DataFrame:
    """(key, at, outer): for each opening tag of a name the place of the element of that name around it; null for none."""
    opened = told.filter((F.col("tag") == tag) & (F.col("step") == 1))
    # Each asks at the level above its own for what was opened there last: that is still open.
    roles = opened.select(key, "at", "level", F.lit(True).alias("opens")).union(opened.select(key, "at", F.col("level") - 1, F.lit(False)))
    last = F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(Window.partitionBy(key, "level").orderBy("at"))
    return roles.withColumn("outer", last).filter("not opens").select(key, "at", F.when(F.col("level") > 0, F.col("outer")).alias("outer"))


def cells(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, table_at, outer_at, row_no, cell_no, is_head, text): cells of all tables, of those inside others too.

    table_at and outer_at are the places of a cell's table and of the table
    around it (null for none); text is what the cell holds outside the tables
    in it, entities decoded, white space as one space.
    """
    told = inner_of(inner_of(tokens(pages, html, key), "table", "table_at", key), "tr", "row_at", key)
    outer = outer_of(told, "table", key).select(key, F.col("at").alias("table_at"), F.col("outer").alias("outer_at"))
    begins = F.col("tag").isin("td", "th") & (F.col("step") == 1)
    # A cell holds what follows in its row and table until the next cell begins.
    last = lambda c: F.last(F.when(begins, c), ignorenulls=True).over(Window.partitionBy(key, "table_at", "row_at").orderBy("at"))
    inside = told.filter("table_at is not null and row_at > table_at").withColumns({"cell_at": last(F.col("at")), "head": last(F.col("tag") == "th")}).filter("cell_at is not null")
    closed = F.max(F.when(F.col("tag").isin("td", "th") & (F.col("step") == -1), F.col("at"))).over(Window.partitionBy(key, "table_at", "row_at", "cell_at"))
    texts = inside.withColumn("closed", closed).filter("closed is null or at <= closed")
    is_text = F.col("tag").isNull() & ~F.startswith("token", F.lit("<!")) & ~F.col("token").rlike(r"(?is)^<(?:script|style)\b.*</")
    row = F.struct("at", F.when(is_text, F.col("token")).otherwise("").alias("t"))
    each = texts.groupBy(key, "table_at", "row_at", "cell_at").agg(F.first("head").alias("is_head"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "").alias("t"))
    in_table = Window.partitionBy(key, "table_at").orderBy("row_at")
    in_row = Window.partitionBy(key, "table_at", "row_at").orderBy("cell_at")
    clean = F.trim(F.regexp_replace(decode_entities(F.col("t")), r"\s+", " "))
    placed = each.select(key, "table_at", (F.dense_rank().over(in_table) - 1).alias("row_no"), (F.row_number().over(in_row) - 1).alias("cell_no"), "is_head", clean.alias("text"))
    return placed.join(outer, [key, "table_at"]).select(key, "table_at", "outer_at", "row_no", "cell_no", "is_head", "text")
