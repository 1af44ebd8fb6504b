"""Read functions of the rules catalogue, one per tool; each is a plan over its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.operators.match import similarity_join, top_matches


class Catalog:
    """The tables of lorespark.schemas, from a folder or given as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str | None = None, **tables: DataFrame):
        self.spark, self.folder, self.given = spark, folder, tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Lookups -----------------------------------------------------------------

    def _faction_rows(self, q: str) -> DataFrame:
        """The faction of a name: slug, then exact name, then part of a name; the first by id."""
        slugs = F.array(*[F.lit(x) for x in dict.fromkeys([q.lower().replace(" ", "-"), q.lower().replace("'", "-").replace(" ", "-"), q.lower().replace("'", "").replace(" ", "-")])])
        tier = F.when(F.array_contains(slugs, F.col("slug")), 0).when(F.lower("name") == q.lower(), 1).when(text.contains_ci(F.col("name"), q), 2)
        return self.factions.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "id").limit(1).drop("tier")

    def _in_faction(self, rows: DataFrame, q: str | None) -> DataFrame:
        """Rows of a faction; all rows where none is named. One faction row at most is broadcast."""
        if q is None:
            return rows
        one = self._faction_rows(q).select(F.col("id").alias("_fid"))
        return rows.join(F.broadcast(one), F.col("faction_id") == F.col("_fid"), "left_semi")

    def _with_faction(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(self.factions.select(F.col("id").alias("faction_id"), F.col("name").alias("faction")), "faction_id", how)

    @staticmethod
    def _any(columns: list[str], q: str) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(text.contains_ci(F.col(c), q), F.lit(False)) for c in columns])

    # Tools -------------------------------------------------------------------

    def get_core_rules(self, category: str | None = None, search: str | None = None) -> DataFrame:
        rows = self.core_rules
        if category:
            rows = rows.filter(F.col("category") == category)
        if search:
            rows = rows.filter(self._any(["title", "content"], search))
        return rows.orderBy(F.asc_nulls_last("order_index"), "id")

    def list_factions(self) -> DataFrame:
        return self.factions.select("slug", "name", "is_subfaction").orderBy("name", "slug")

    def list_chapters(self) -> DataFrame:
        """Keywords of type faction with their number of units and three sample units."""
        links = self.unit_keywords.join(self.keywords.filter("keyword_type = 'faction'").select(F.col("id").alias("keyword_id"), F.col("name").alias("chapter")), "keyword_id")
        named = links.join(self.units.select(F.col("id").alias("unit_id"), F.col("name").alias("unit")), "unit_id")
        return named.groupBy("chapter").agg(F.countDistinct("unit_id").alias("n_units"), F.slice(F.array_sort(F.collect_set("unit")), 1, 3).alias("samples")).orderBy(F.col("n_units").desc(), "chapter")

    def get_faction(self, q: str) -> DataFrame:
        n = lambda t, c: self.__getattr__(t).groupBy("faction_id").agg(F.count(F.lit(1)).alias(c)).withColumnRenamed("faction_id", "id")
        one = self._faction_rows(q)
        return one.join(n("units", "n_units"), "id", "left").join(n("detachments", "n_detachments"), "id", "left").fillna(0, ["n_units", "n_detachments"])

    def get_detachments(self, faction: str) -> DataFrame:
        return self._in_faction(self.detachments, faction).orderBy("name", "id")

    def get_detachment_details(self, faction: str, detachment: str) -> DataFrame:
        """The detachment with its stratagems and enhancements as nested lists."""
        one = self._in_faction(self.detachments, faction).filter(text.contains_ci(F.col("name"), detachment)).orderBy("id").limit(1)
        lists = lambda t, *c: self.__getattr__(t).groupBy("detachment_id").agg(F.array_sort(F.collect_list(F.struct("name", *c))).alias(t)).withColumnRenamed("detachment_id", "id")
        return one.join(lists("stratagems", "cp_cost", "phase"), "id", "left").join(lists("enhancements", "points_cost"), "id", "left")

    def search_units(self, q: str, faction: str | None = None, keyword: str | None = None, limit: int = 20) -> DataFrame:
        rows = self._in_faction(self.units, faction).filter(text.contains_ci(F.col("name"), q))
        if keyword:
            having = self.unit_keywords.join(self.keywords.filter(F.lower("name") == keyword.lower()).select(F.col("id").alias("keyword_id")), "keyword_id")
            rows = rows.join(having, rows["id"] == having["unit_id"], "left_semi")
        return self._with_faction(rows).orderBy("name", "id").limit(limit)

    def get_unit(self, q: str, faction: str | None = None) -> DataFrame:
        """The unit with its weapons, abilities and keywords as nested lists."""
        tier = F.when(F.lower("name") == q.lower(), 0).when(text.contains_ci(F.col("name"), q), 1)
        one = self._in_faction(self.units, faction).withColumn("tier", tier).filter("tier is not null").orderBy("tier", "id").limit(1).drop("tier")

        def nested(table: str, link: str, key: str, *columns: str) -> DataFrame:
            links = self.__getattr__(link).join(F.broadcast(one.select(F.col("id").alias("unit_id"))), "unit_id", "left_semi")
            items = links.join(self.__getattr__(table).withColumnRenamed("id", key), key).groupBy(F.col("unit_id").alias("id"))
            return items.agg(F.array_sort(F.collect_set(F.struct("name", *columns))).alias(table))

        full = one.join(nested("weapons", "unit_weapons", "weapon_id", "weapon_type", "range", "attacks", "damage"), "id", "left").join(nested("abilities", "unit_abilities", "ability_id", "ability_type", "description"), "id", "left").join(nested("keywords", "unit_keywords", "keyword_id", "keyword_type"), "id", "left")
        stats = F.struct("movement", "toughness", "save", "wounds", "leadership", "objective_control").alias("stats")
        return self._with_faction(full, "left").select("id", "name", "faction", stats, "points_cost", "weapons", "abilities", "keywords")

    def get_stratagems(self, faction: str | None = None, detachment: str | None = None, phase: str | None = None) -> DataFrame:
        """Of a faction, with the detachment's name; those without a detachment are kept unless one is asked for."""
        named = self._in_faction(self.stratagems, faction).join(self.detachments.select(F.col("id").alias("detachment_id"), F.col("name").alias("detachment")), "detachment_id", "left")
        if detachment:
            named = named.filter(text.contains_ci(F.col("detachment"), detachment))
        if phase:
            named = named.filter(F.col("phase").isin(phase, "any"))
        return named.orderBy("name", "id")

    def get_enhancements(self, faction: str | None = None, detachment: str | None = None) -> DataFrame:
        of = self._in_faction(self.detachments, faction).select(F.col("id").alias("detachment_id"), F.col("name").alias("detachment"))
        named = self.enhancements.join(of, "detachment_id")
        return (named.filter(text.contains_ci(F.col("detachment"), detachment)) if detachment else named).orderBy("name", "id")

    def search_weapons(self, q: str, weapon_type: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.weapons.filter(text.contains_ci(F.col("name"), q))
        return (rows.filter(F.col("weapon_type") == weapon_type) if weapon_type else rows).orderBy("name", "id").limit(limit)

    def search_abilities(self, q: str, ability_type: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.abilities.filter(self._any(["name", "description"], q))
        return (rows.filter(F.col("ability_type") == ability_type) if ability_type else rows).orderBy("name", "id").limit(limit)

    def get_keyword_info(self, keyword: str) -> DataFrame:
        return self.keywords.filter(F.lower("name") == keyword.lower()).orderBy("id").limit(1)

    def get_missions(self, mission_type: str | None = None) -> DataFrame:
        return (self.missions.filter(F.col("mission_type") == mission_type) if mission_type else self.missions).orderBy("name", "id")

    def search_faqs(self, q: str, faction: str | None = None, limit: int = 10) -> DataFrame:
        return self._in_faction(self.faqs, faction).filter(self._any(["question", "answer", "category"], q)).orderBy("id").limit(limit)

    # Names -------------------------------------------------------------------

    def candidates(self, categories: list[str], factions: list[str] | None = None) -> DataFrame:
        """(name, category, faction) of the categories; factions, keywords and weapons belong to no faction."""
        by_faction = {"units": self.units, "detachments": self.detachments, "stratagems": self.stratagems, "abilities": self.abilities}
        out = None
        for c in categories:
            if c in by_faction:
                rows = self._with_faction(by_faction[c], "left").select("name", F.lit(c).alias("category"), "faction")
            elif c == "enhancements":
                of = self.detachments.select(F.col("id").alias("detachment_id"), "faction_id")
                rows = self._with_faction(self.enhancements.join(of, "detachment_id", "left"), "left").select("name", F.lit(c).alias("category"), "faction")
            else:
                rows = self.__getattr__(c).select("name", F.lit(c).alias("category"), F.lit(None).cast("string").alias("faction"))
            if factions and (c in by_faction or c == "enhancements"):
                rows = rows.filter(F.lower("faction").isin([f.lower() for f in factions]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def list_valid_names(self, category: str, faction: str | None = None) -> DataFrame:
        return self.candidates([category], [faction] if faction else None).select("name").distinct().orderBy("name")

    def validate_terms(self, terms: DataFrame, categories: list[str], factions: list[str] | None = None, least: float = 0.6) -> DataFrame:
        """The best name of each term (column term), null where none reaches the threshold."""
        names = self.candidates(categories, factions)
        best = top_matches(similarity_join(terms, names, "term", "name", least), "term", "name", 1)
        one = names.groupBy("name").agg(F.min("category").alias("category"), F.min("faction").alias("faction"))
        return terms.select("term").distinct().join(best.join(one, "name"), "term", "left").select("term", "name", "category", "faction", text.round2(F.col("score")).alias("confidence"))

    def fuzzy_search(self, q: str, categories: list[str], least: float = 0.3, limit: int = 10) -> DataFrame:
        names = self.candidates(categories)
        found = similarity_join(self.spark.createDataFrame([(q,)], "term string"), names, "term", "name", least)
        return found.join(names.distinct(), "name").select("name", "category", "faction", text.round2(F.col("score")).alias("confidence")).orderBy(F.col("confidence").desc(), "name", "category", "faction").limit(min(limit, 20))

    def resolve_ambiguous_term(self, term: str, hints: list[str] = (), context: str = "") -> DataFrame:
        """The ten best names with relevance: similarity, 0.2 more for a hinted faction, 0.15 for one that the context names."""
        found = self.fuzzy_search(term, ["units", "stratagems", "abilities", "factions", "detachments", "enhancements"], 0.4, 10)
        faction = text.normalize_string(F.col("faction"))
        plain = [text.normalize_string(F.lit(h)) for h in hints]
        hinted = reduce(lambda a, b: a | b, [F.contains(faction, h) | F.contains(h, faction) for h in plain], F.lit(False))
        named = F.contains(text.normalize_string(F.lit(context)), faction) if context else F.lit(False)
        boost = F.when(F.coalesce(hinted, F.lit(False)), 0.2).otherwise(0.0) + F.when(F.coalesce(named, F.lit(False)), 0.15).otherwise(0.0)
        scored = found.withColumn("relevance", F.least(F.lit(1.0), text.round2(F.col("confidence") + boost)))
        from pyspark.sql import Window

        high = F.count_if(F.col("relevance") >= 0.7).over(Window.partitionBy(F.lit(1)))
        return scored.select("name", "category", "faction", "relevance", (high > 1).alias("ambiguous")).orderBy(F.col("relevance").desc(), "name", "category")
