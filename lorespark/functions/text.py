"""String rules as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_string(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def normalize_term(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\s+", " ")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def slug_variants(c: Column) -> Column:
    """The slugs under which a name may be stored: spaces to hyphens, apostrophes to hyphens or dropped."""
    low = F.lower(c)
    return F.array_distinct(F.array(F.regexp_replace(low, r"\s+", "-"), F.regexp_replace(low, r"[\s']+", "-"), F.regexp_replace(F.replace(low, F.lit("'"), F.lit("")), r"\s+", "-")))


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def normalize_apostrophes(c: Column) -> Column:
    return F.regexp_replace(c, "[‘’`´]", "'")


def dedupe_keywords(c: Column) -> Column:
    """A phrase written twice or more in a row, or a word three times or more, once."""
    words = F.regexp_replace(c, r"^([A-Z]+?)\1{2,}$", "$1")
    return F.regexp_replace(words, r"^([A-Z]+(?: [A-Z]+)+)(?:\s*\1)+$", "$1")


def strip_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)", ""), r"\s+", " "))


def strip_last_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def contains_ci(c: Column, part: str | Column) -> Column:
    """Case-insensitive contains, without wildcards."""
    return F.contains(F.lower(c), F.lower(F.lit(part) if isinstance(part, str) else part))


def parse_int(c: Column) -> Column:
    """The integer that a text starts with; null for none and for 0."""
    return F.nullif(F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int"), F.lit(0))


def first_number(c: Column, pattern: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(default))


def cp_cost(c: Column) -> Column:
    return first_number(c, r"(?i)(\d+)\s*CP", "1")


def points_cost(c: Column) -> Column:
    return first_number(c, r"(?i)(\d+)\s*pts?", "0").cast("int")


def seconds_of(c: Column) -> Column:
    """Seconds of h:mm:ss, mm:ss or ss."""
    return F.aggregate(F.split(c, ":"), F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def round2(c: Column) -> Column:
    """Two decimals, halves up, as floor(x * 100 + 0.5) / 100."""
    return F.floor(c * 100 + 0.5) / 100


def cascade(c: Column, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first label of which a needle occurs in the lower-case text."""
    low, out = F.lower(c), None
    for label, needles in rules.items():
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


# Phases and rule categories, with the words that tell them, in order of precedence.
PHASES = {p: (p,) for p in ("command", "movement", "shooting", "charge", "fight")}
RULE_CATEGORIES = {
    "command_phase": ("command phase",),
    "movement_phase": ("movement phase",),
    "shooting_phase": ("shooting phase",),
    "charge_phase": ("charge phase",),
    "fight_phase": ("fight phase",),
    "combat": ("attacks", "hit roll", "wound roll"),
    "morale": ("morale", "battle-shock"),
    "transports": ("transport",),
    "terrain": ("terrain", "cover"),
    "psychic": ("psychic", "psyker"),
    "stratagems": ("stratagem",),
    "objectives": ("objective", "victory"),
    "deployment": ("deployment", "reserves"),
    "units": ("unit", "datasheet"),
    "weapons": ("weapon", "wargear"),
    "abilities": ("ability", "abilities"),
    "keywords": ("keyword",),
    "leaders": ("leader", "attached"),
}
# HTML entities that readable text decodes, in order.
ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'",
    "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"', "&mdash;": "—", "&ndash;": "–",
}


def phase_of(c: Column) -> Column:
    return cascade(c, PHASES, "any")


def rule_category(c: Column) -> Column:
    return cascade(c, RULE_CATEGORIES, "general")


def decode_entities(c: Column, names: list[str] | None = None) -> Column:
    for name in names or ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ENTITIES[name]))
    return c


def readable(html: Column) -> Column:
    """Text of a page: blocks part paragraphs, list items get bullets, other tags go, entities are decoded."""
    breaks = F.regexp_replace(html, r"(?i)</?h[1-6][^>]*>|</?p(?:\s[^>]*)?>|<table[^>]*>|<div[^>]*class=\"[^\"]*BreakInside[^\"]*\"[^>]*>", "\n\n")
    lines = F.regexp_replace(breaks, r"(?i)<br\s*/?>|</table>|</tr>", "\n")
    items = F.regexp_replace(F.regexp_replace(lines, r"(?i)<li[^>]*>", "\n• "), r"<[^>]+>", "")
    spaced = F.regexp_replace(F.regexp_replace(decode_entities(items), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.array_join(F.transform(F.split(spaced, "\n"), lambda x: F.trim(x)), "\n"), r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))


def links(markdown: Column) -> Column:
    """Targets of markdown links and href attributes, each once, in order."""
    return F.array_distinct(F.concat(F.regexp_extract_all(markdown, F.lit(r"\]\(([^)\s]+)\)"), 1), F.regexp_extract_all(markdown, F.lit(r'href="([^"]+)"'), 1)))


def any_word_match(query: Column, text: Column) -> Column:
    """Whether the query is part of the text, or every word of it part of some word of the text."""
    low_q, low_t = F.lower(query), F.lower(text)
    words = lambda c: F.split(c, r"\s+")
    return F.contains(low_t, low_q) | F.forall(words(low_q), lambda q: F.exists(words(low_t), lambda t: F.contains(t, q)))
