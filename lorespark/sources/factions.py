"""Faction pages as rows: the faction, its detachments, stratagems and enhancements, by named anchors in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import rules
from lorespark.functions.text import cp_cost, phase_of, points_cost, readable, slugify
from lorespark.sources import html as h

# Anchors of a page's own sections; none is a detachment's.
SECTIONS = [
    "detachment-rule", "enhancements", "stratagems", "army-rules", "datasheets", "books", "introduction", "contents", "boarding-actions",
    "crusade-rules", "allied-units", "requisitions", "agendas", "battle-traits", "faq", "keywords", "faction-pack",
]
HIDDEN = r'(?is)<(div|span|p)\b[^>]*style="[^"]*display:\s*none[^"]*"[^>]*>.*?</\1>'


def _base(anchor: Column) -> Column:
    return F.lower(F.regexp_replace(anchor, r"-\d+$", ""))


def sections(pages: DataFrame) -> DataFrame:
    """Anchors in order with the detachment that each belongs to: an anchor is a detachment's if the next one is its rule;
    the ones behind it, up to the next such anchor, are its own. Sections before any detachment have a null parent."""
    order = Window.partitionBy("page_id").orderBy("at")
    follows = F.lead("anchor").over(order)
    a = h.anchors(pages).withColumn("is_detachment", ~_base(F.col("anchor")).isin(SECTIONS) & F.coalesce(_base(follows) == "detachment-rule", F.lit(False)))
    name = F.trim(F.regexp_replace(F.replace("anchor", F.lit("-"), F.lit(" ")), r"\s+\d+$", ""))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("parent", F.last(F.when(F.col("is_detachment"), name), ignorenulls=True).over(before))


def faction(pages: DataFrame) -> DataFrame:
    """(page_id, army_rules, lore): the army rule without its legend, or else the first coloured heading and what follows it; the introduction of over 100 characters, or else the first block."""
    rule = readable(F.regexp_replace(F.regexp_extract("html", r'(?is)<a\b[^>]*name="Army-Rules"[^>]*>.*?(<div\b[^>]*class="[^"]*\bColumns2\b.*?)(?=<div\b[^>]*class="[^"]*\bclFl\b|<a\b[^>]*name="(?:Detachment|Enhancements|Stratagems)|$)', 1), r'(?is)<(p|div|span)\b[^>]*class="[^"]*\b(?:ShowFluff|legend2?)\b[^"]*"[^>]*>.*?</\1>', ""))
    heading = h.text_of(F.regexp_extract("html", r'(?is)<h3\b[^>]*class="[^"]*dsColorBg[^"]*"[^>]*>(.*?)</h3>', 1))
    below = h.text_of(F.regexp_extract("html", r'(?is)<h3\b[^>]*class="[^"]*dsColorBg[^"]*"[^>]*>.*?</h3>\s*<(\w+)[^>]*>(.*?)</\1>', 2))
    intro = h.text_of(F.regexp_extract("html", r'(?is)<a\b[^>]*name="Introduction"[^>]*>.*?<(div|p)\b[^>]*>(.*?)</\1>', 2))
    block = F.left(h.of_class(F.col("html"), "BreakInsideAvoid", "div"), F.lit(1000))
    long = lambda c: F.when(F.length(c) > 100, c)
    either = F.coalesce(F.nullif(rule, F.lit("")), F.when((heading != "") & (below != ""), F.concat_ws("\n\n", heading, below)))
    return pages.select("page_id", either.alias("army_rules"), F.coalesce(long(intro), long(block)).alias("lore"))


def detachments(pages: DataFrame) -> DataFrame:
    """(page_id, at, slug, name, rule_name, rule_text, lore): names equal but for case count once, the first."""
    order = Window.partitionBy("page_id").orderBy("at")
    two = sections(pages).withColumns({"rule": F.lead("section").over(order), "more": F.lead("section", 2).over(order), "next_base": _base(F.lead("anchor", 2).over(order))})
    d = two.filter("is_detachment")
    heading = h.text_of(F.regexp_extract("section", r"(?is)<h2\b[^>]*>(.*?)</h2>", 1))
    name = rules.detachment_name(F.coalesce(F.nullif(heading, F.lit("")), F.replace("anchor", F.lit("-"), F.lit(" "))))
    # The rule's own anchor may stand between the heading "Detachment Rule" and its text.
    whole = F.concat("rule", F.when(F.col("next_base").isin(SECTIONS), "").otherwise(F.coalesce("more", F.lit(""))))
    h3 = r"(?is)<h3\b[^>]*>(.*?)</h3>"
    after = F.regexp_extract(whole, r"(?is)<h3\b[^>]*>.*?</h3>(.*?)(?=<h2\b|$)", 1)
    lore = F.nullif(F.left(h.of_class(F.col("section"), "ShowFluff"), F.lit(1000)), F.lit(""))
    out = d.select("page_id", "at", name.alias("name"), F.nullif(h.text_of(F.regexp_extract(whole, h3, 1)), F.lit("")).alias("rule_name"), F.nullif(readable(F.regexp_replace(after, HIDDEN, "")), F.lit("")).alias("rule_text"), lore.alias("lore")).filter("name is not null")
    once = Window.partitionBy("page_id", F.lower("name")).orderBy("at")
    return out.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("page_id", "at", slugify(F.col("name")).alias("slug"), "name", "rule_name", "rule_text", "lore")


def _cards(pages: DataFrame, opener: str) -> DataFrame:
    """(page_id, at, i, parent, block) of the cards inside a page's sections."""
    parts = F.filter(F.split("section", f"(?i)(?={opener})"), lambda x: x.rlike(f"(?i)^{opener}"))
    return sections(pages).select("page_id", "at", "parent", F.posexplode(parts).alias("i", "block"))


def stratagems(pages: DataFrame, fixes: dict[str, str] | None = None) -> DataFrame:
    """(page_id, parent, slug, name, cp_cost, phase, when, target, effect, restrictions) of the cards with a name and an effect; equal names count once a page."""
    part = lambda label, stop: F.nullif(rules.replace_fixes(h.text_of(F.regexp_extract("block", rf"(?is)<b>{label}:</b>\s*(.*?)(?={stop}|$)", 1)), fixes or {}, True), F.lit(""))
    end = r"<br>\s*<br>|<b>EFFECT:|<b>RESTRICTIONS:|</div>"
    c = _cards(pages, r'<div\b[^>]*class="[^"]*\bstr10Wrap\b')
    told = c.select("page_id", "at", "i", "parent", h.of_class(F.col("block"), "str10Name").alias("name"), cp_cost(h.of_class(F.col("block"), "str10CP")).alias("cp_cost"), part("WHEN", "<").alias("when"), part("TARGET", end).alias("target"), part("EFFECT", r"<br>\s*<br>\s*<b>RESTRICTIONS:|<b>RESTRICTIONS:|</div>").alias("effect"), part("RESTRICTIONS", "</div>").alias("restrictions"))
    once = Window.partitionBy("page_id", "name").orderBy("at", "i")
    kept = told.filter("name <> '' and effect is not null").withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.select("page_id", "parent", slugify(F.col("name")).alias("slug"), "name", "cp_cost", phase_of(F.coalesce("when", F.lit(""))).alias("phase"), "when", "target", "effect", "restrictions")


def enhancements(pages: DataFrame) -> DataFrame:
    """(page_id, parent, slug, name, points_cost, description, restrictions): name and points in two spans, the description behind them; names equal but for case count once a page."""
    spans = F.regexp_extract_all("block", F.lit(r"(?is)<span\b[^>]*>(.*?)</span>"), 1)
    c = _cards(pages, r'<ul\b[^>]*class="[^"]*\bEnhancementsPts\b').filter(F.size(spans) >= 2)
    rest = h.text_of(F.regexp_extract("block", r"(?is)</ul>(.*)$", 1))
    told = c.select("page_id", "at", "i", "parent", h.text_of(spans[0]).alias("name"), points_cost(h.text_of(spans[1])).alias("points_cost"), rest.alias("description"))
    once = Window.partitionBy("page_id", F.lower("name")).orderBy("at", "i")
    kept = told.filter("name <> ''").withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.select("page_id", "parent", slugify(F.col("name")).alias("slug"), "name", "points_cost", "description", rules.restrictions(F.col("description")).alias("restrictions"))


def attach_children(parents: DataFrame, children: DataFrame, by: list[str], parent_name: str, child_parent: str) -> DataFrame:
    """children with the name of their parent, met by slug; those whose parent is not there stay, with a null one."""
    p = parents.select(*by, slugify(F.col(parent_name)).alias("_slug"), F.col(parent_name).alias("_name")).groupBy(*by, "_slug").agg(F.min("_name").alias("detachment"))
    return children.withColumn("_slug", slugify(F.col(child_parent))).join(p, [*by, "_slug"], "left").drop("_slug")


def section_html(pages: DataFrame) -> DataFrame:
    """(page_id, anchor, html): each detachment's part of the page, up to the next detachment."""
    s = sections(pages)
    own = F.coalesce(F.when(F.col("is_detachment"), F.col("anchor")), F.col("parent"))
    named = s.withColumn("anchor_of", F.last(F.when(F.col("is_detachment"), F.col("anchor")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("at"))).filter(own.isNotNull())
    return named.groupBy("page_id", F.col("anchor_of").alias("anchor")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]), "").alias("html"))
