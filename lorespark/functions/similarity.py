"""Dice similarity on bigram sets, with containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def bigrams(bare_text: Column) -> Column:
    """Distinct bigrams of a text of a-z and 0-9; empty below two characters."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare_text) - 1, F.lit(1))), lambda i: F.substring(bare_text, i, F.lit(2)))
    return F.when(F.length(bare_text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def dice_of(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Similarity of two bare texts whose bigrams are at hand: equal 1, empty 0, containment length ratio, else Dice."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)).cast("double")
    dice = F.try_divide(2.0 * F.size(F.array_intersect(grams_a, grams_b)), (F.size(grams_a) + F.size(grams_b)).cast("double"))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(F.contains(a, b) | F.contains(b, a), ratio).otherwise(dice)


def dice(a: Column, b: Column) -> Column:
    return dice_of(bare(a), bare(b), bigrams(bare(a)), bigrams(bare(b)))
