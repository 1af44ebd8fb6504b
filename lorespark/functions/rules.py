"""Rules over game texts as column expressions.

Word lists and tables of a game are parameters. The patterns, labels and
numbers inside the functions are fixed values: they say what the rules are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _safe(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_fixes(c: Column, fixes: dict[str, str], whole_words: bool = False) -> Column:
    """Spellings replaced in the order of the table, in letters of either case; as whole words if asked."""
    for wrong, right in fixes.items():
        quoted = "".join(f"\\{x}" if not x.isalnum() and x != " " else x for x in wrong)
        c = F.regexp_replace(c, f"(?i)\\b{quoted}\\b" if whole_words else f"(?i){quoted}", _safe(right))
    return c


def split_joined_words(c: Column, small: tuple[str, ...] = ("in", "of", "to", "from")) -> Column:
    """A space where a capital follows a lower-case letter, and between a small word and "the" that are written as one."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    for word in small:
        c = F.regexp_replace(c, rf"(?i)\b({word})(the)\b", "$1 $2")
    return c


def normalize_text(c: Column, fixes: dict[str, str]) -> Column:
    return split_joined_words(replace_fixes(c, fixes))


def repeated_keywords(c: Column) -> Column:
    """A phrase of capitals that follows itself once or more, and a word of capitals twice or more, once."""
    phrase = F.regexp_replace(c, r"\b([A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+)+)(\1)+", "$1")
    return F.regexp_replace(phrase, r"\b([A-Z][A-Z'-]{2,})(\1){2,}", "$1")


def truncate(c: Column, longest: int) -> Column:
    return F.left(c, F.lit(longest))


def valid_points(c: Column) -> Column:
    """Points of a unit are 20 to 500."""
    return c.between(20, 500)


def restrictions(c: Column) -> Column:
    """The clause that tells who may take something ("... model only."); null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i)([A-Z][A-Z\s'-]+(?:model|INFANTRY|PSYKER)[^.]*only\.?)", 1)), F.lit(""))


def keyword_type(c: Column, kinds: dict[str, list[str]], default: str = "ability") -> Column:
    """The first kind that has a word which the keyword holds, in letters of either case."""
    up, out = F.upper(c), F.lit(default)
    for kind, words in reversed(kinds.items()):
        out = F.when(F.exists(F.array(*[F.lit(w.upper()) for w in words]), lambda w: F.contains(up, w)), kind).otherwise(out)
    return out


def keyword_name(c: Column) -> Column:
    """A keyword without brackets and their escapes, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\\?[\[\]]", ""), r"\s+", " "))


def video_id(c: Column) -> Column:
    """The id of eleven characters that a text is, or that a link to a video holds; null otherwise."""
    ident = "([a-zA-Z0-9_-]{11})"
    found = F.regexp_extract(c, rf"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/|youtube\.com/v/){ident}", 1)
    return F.when(c.rlike(f"^{ident}$"), c).otherwise(F.nullif(found, F.lit("")))


def boost_confidence(level: Column, score: Column) -> Column:
    """From 0.9 on a level becomes high, from 0.7 on low becomes medium."""
    return F.when(score >= 0.9, "high").when((score >= 0.7) & (level == "low"), "medium").otherwise(level)


def lower_confidence(level: Column) -> Column:
    return F.when(level == "high", "medium").otherwise("low")


def clean_ability_name(c: Column) -> Column:
    """Spaces at changes of case, before digits (but after D, as in D6) and between small words and "the"."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([a-ce-zA-CE-Z])([0-9])", "$1 $2")
    return F.trim(F.regexp_replace(split_joined_words(spaced, ("in", "of", "to")), r"\s+", " "))


# Abilities of weapons, in the order in which they are looked for in a text without commas.
WEAPON_ABILITIES = [
    "Assault", "Heavy", "Rapid Fire", "Pistol", "Blast", "Melta", "Torrent", "Hazardous", "Precision", "Lethal Hits", "Sustained Hits", "Devastating Wounds",
    "Ignores Cover", "Indirect Fire", "One Shot", "Psychic", "Twin-linked", "Lance", "Extra Attacks", "Anti-Infantry", "Anti-Vehicle", "Anti-Monster", "Anti-Titan", "Anti-Fly",
]


def weapon_abilities(c: Column, known: list[str] = WEAPON_ABILITIES) -> Column:
    """Array of the abilities in a text: between commas, or else the known ones that it holds without spaces, in their order; the
    last one takes the numbers left over. A text of none is an ability of its own; empty and null texts hold none."""
    listed = F.transform(F.split(c, ","), lambda x: clean_ability_name(F.trim(x)))
    words = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(re.sub(r"[\s-]", "", k.lower())).alias("joined")) for k in known])

    def take(acc: Column, k: Column) -> Column:
        at, size = F.call_function("instr", acc["rest"], k["joined"]), F.length(k["joined"])
        rest = F.concat(F.substring(acc["rest"], F.lit(1), at - 1), F.substring(acc["rest"], at + size, F.length(acc["rest"])))
        return F.when(at > 0, F.struct(rest.alias("rest"), F.concat(acc["found"], F.array(k["name"])).alias("found"))).otherwise(acc)

    told = F.aggregate(words, F.struct(F.lower(c).alias("rest"), F.array().cast("array<string>").alias("found")), take)
    values = F.upper(F.array_join(F.regexp_extract_all(told["rest"], F.lit(r"(\d+\+|d\d+)"), 1), " "))
    n = F.size(told["found"])
    last = F.when(values != "", F.concat_ws(" ", F.element_at(told["found"], -1), values)).otherwise(F.element_at(told["found"], -1))
    joined = F.when(n > 0, F.concat(F.slice(told["found"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(F.array(clean_ability_name(c)))
    return F.filter(F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(c.contains(","), listed).otherwise(joined), lambda x: x != "")


def clean_composition(c: Column) -> Column:
    """A unit's composition without what is left of tables and points."""
    c = F.regexp_replace(c, r"\s*---\s*\d+(\s+\d+)*\s*", " ")
    c = F.regexp_replace(c, r"(?m)\s+\d{2,3}\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\|\s*-+\s*\|", ""), r"\|[^|]*\|", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def from_first_rule(c: Column, patterns: list[str]) -> Column:
    """The text from its first paragraph that matches one of the patterns; all of it where none does."""
    paragraphs = F.split(c, r"\n\n+")
    first = F.array_position(F.transform(paragraphs, lambda p: matches_any(p, patterns)), True)
    return F.when(first == 0, c).otherwise(F.array_join(F.slice(paragraphs, first.cast("int"), F.size(paragraphs)), "\n\n"))


def without_suffix(c: Column, suffixes: list[str]) -> Column:
    """The text without the first of the suffixes that it ends with."""
    out = c
    for s in reversed(suffixes):
        out = F.when(F.endswith(c, F.lit(s)), F.trim(F.substring(c, F.lit(1), F.length(c) - len(s)))).otherwise(out)
    return out


def detachment_name(c: Column) -> Column:
    """A detachment's name without images, links, markers and trailing numbers; null where nothing fit for one is left."""
    for pattern in (r"!\[[^\]]*\]\([^)]+\)", r"https?://[^\s]+", r"(?i)#+\s*Not\s*Found", r"\s+\d+$"):
        c = F.regexp_replace(c, pattern, "")
    c = F.trim(c)
    bad = F.lower(c).contains("not found") | c.contains("![") | c.startswith("#") | (F.length(c) < 2)
    # Headings that look like a detachment's and are none.
    return F.when(~bad & ~F.lower(c).isin("army rule", "army rules", "rules adaptations"), c)


def mission_name(c: Column) -> Column:
    """Whether a text may be a mission's name: three characters or more, its letters all capitals."""
    return (F.length(c) >= 3) & F.regexp_replace(c, r"[^A-Za-z\s]", "").rlike(r"^[A-Z\s]+$")


def is_legends(c: Column) -> Column:
    return c.contains("[Legends]")


def first_kind(c: Column, kinds: list[tuple[str, str]], default: str) -> Column:
    """The kind of the first (part, kind) whose part the text holds."""
    out = F.lit(default)
    for part, kind in reversed(kinds):
        out = F.when(c.contains(part), kind).otherwise(out)
    return out


# Mission packs by what their URLs hold, in order.
MISSION_PACKS = [("chapter-approved-2025-26", "chapter_approved_2025"), ("chapter-approved", "chapter_approved"), ("pariah-nexus", "pariah_nexus"), ("leviathan", "leviathan")]


def mission_pack(url: Column) -> Column:
    return first_kind(url, MISSION_PACKS, "matched_play")


def mentioned_units(c: Column) -> Column:
    """Names with capitals that a number, "the" or the like stands before, or "squad" behind; longer than three letters, each once."""
    name = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
    found = [F.regexp_extract_all(c, F.lit(p), 1) for p in (rf"\d+\s*x?\s*{name}", rf"(?i){name}\s+(?:squad|unit|team)", rf"(?:the|a|my)\s+{name}")]
    return F.array_distinct(F.transform(F.filter(F.concat(*found), lambda x: F.length(x) > 3), lambda x: F.trim(x)))


def first_label(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first (pattern, label) that occurs in the lower-case text; null for none."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for p, label in reversed(patterns):
        out = F.when(low.rlike(p), label).otherwise(out)
    return out


def all_labels(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The labels of all patterns that occur in the lower-case text, in order, each once."""
    low = F.lower(c)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), label) for p, label in patterns])))


def unit_variants(c: Column, kinds: list[str]) -> Column:
    """Names that a phrase may mean: a kind of character named before its own name; "x with y" as x, its plural and singular."""
    low = F.lower(F.trim(c))
    kind = F.regexp_extract(low, rf"^({'|'.join(kinds)})\s+\S", 1)
    base = F.regexp_extract(low, r"^(.+?)\s+with\s+", 1)
    return F.array_distinct(F.filter(F.array(kind, base, F.when(base != "", F.concat(base, F.lit("s"))), F.regexp_replace(base, "s$", "")), lambda x: x != ""))


def segments(c: Column) -> Column:
    """A description as (kind, content, target) in order: text, links [text](target), keywords in brackets, words in capitals."""
    token = r"\[[^\]]+\]\([^)]+\)|\\?\[[A-Z][A-Z\s\d+-]*\]\\?|\b[A-Z][A-Z-]+(?:\s+[A-Z][A-Z-]+)*\b"
    marked = F.regexp_replace(c, f"({token})", "\u0001$1\u0002")
    parts = F.filter(F.split(F.regexp_replace(marked, "\u0002", "\u0001\u0002"), "\u0001"), lambda x: (x != "") & (x != "\u0002"))
    bare = lambda x: F.replace(x, F.lit("\u0002"), F.lit(""))
    link, bracket, capitals = r"^\[([^\]]+)\]\(([^)]+)\)$", r"^\\?\[([A-Z][A-Z\s\d+-]*)\]\\?$", r"^[A-Z][A-Z-]+(?:\s+[A-Z][A-Z-]+)*$"

    def told(x: Column) -> Column:
        x = bare(x)
        kind = F.when(x.rlike(link), "link").when(x.rlike(bracket), "keyword").when(x.rlike(capitals), "unit-keyword").otherwise("text")
        content = F.when(x.rlike(link), F.regexp_extract(x, link, 1)).when(x.rlike(bracket), F.regexp_extract(x, bracket, 1)).otherwise(x)
        return F.struct(kind.alias("kind"), content.alias("content"), F.nullif(F.regexp_extract(x, link, 2), F.lit("")).alias("target"))

    return F.transform(parts, told)


def army_rule(markdown: Column, patterns: list[str]) -> Column:
    """name, lore and effect of a rule written as "### name", paragraphs of lore, paragraphs of rules, tables."""
    name = F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^###\s+(.+?)$", 1)), F.lit(""))
    paragraphs = F.split(F.regexp_replace(F.regexp_replace(markdown, r"(?m)^###\s+.+?\n+", ""), r"^\s+|\s+$", ""), r"\n\n+")
    first = F.array_position(F.transform(paragraphs, lambda p: matches_any(p, patterns) & ~F.startswith(p, F.lit("|"))), True).cast("int")
    rest = F.slice(paragraphs, F.greatest(first, F.lit(1)), F.size(paragraphs))
    table = F.array_position(F.transform(rest, lambda p: F.startswith(p, F.lit("|"))), True).cast("int")
    text = lambda parts: F.nullif(F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+$", ""), F.lit(""))
    lore = F.when(first > 1, text(F.slice(paragraphs, F.lit(1), F.greatest(first - 1, F.lit(0)))))
    effect = text(F.when(table > 0, F.slice(rest, F.lit(1), F.greatest(table - 1, F.lit(0)))).otherwise(rest))
    return F.struct(name.alias("name"), lore.alias("lore"), effect.alias("effect"))


def sub_abilities(markdown: Column) -> Column:
    """Array of (name, lore, effect) of the cells of a rule's tables: lines parted by <br>, the first the name, of two or more lines
    behind it the first lore and the others effect; a single one is effect if it names an ability or a keyword in brackets."""
    cells = F.filter(F.regexp_extract_all(markdown, F.lit(r"\|\s*([^|]+?)\s*\|(?!\s*---)"), 1), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[-:\s]+$"))
    lines = lambda x: F.filter(F.transform(F.split(x, r"(?i)<br\s*/?>"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def told(parts: Column) -> Column:
        n, second = F.size(parts), F.get(parts, F.lit(1))
        is_effect = (n == 2) & (second.contains("[") | F.lower(second).contains("ability"))
        effect = F.when(n > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 2, F.lit(0))), " ")).when(is_effect, second).otherwise(F.lit(""))
        return F.struct(F.get(parts, F.lit(0)).alias("name"), F.when((n > 1) & ~is_effect, second).alias("lore"), effect.alias("effect"))

    return F.transform(F.filter(F.transform(cells, lines), lambda p: F.size(p) > 0), told)


def replace_spans(c: Column, spans: Column) -> Column:
    """The text with spans (start from 0, end, text; none overlap) replaced, from the last to the first."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))))
    return F.aggregate(ordered, c, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), s["text"], F.substring(acc, s["end"] + 1, F.length(acc))))
