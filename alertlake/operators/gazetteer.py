"""Place names in posts, by an equi-join of word n-grams with an alias table.

A normalised text holds an alias as a phrase iff one of its word n-grams equals the alias.
So words meet the first words of aliases, and where they do the n-grams meet the aliases
themselves, in hash joins; the planner broadcasts a table below its threshold and shuffles
it above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.inflection import REGION_NOUNS, alias_forms_of, head_forms_of
from alertlake.functions.rules import MINISTRY_PHRASES, REGION_PHRASES, found
from alertlake.functions.text import contained, loose_name, normalize, phrase_hits, strict_name
from alertlake.operators.stage import staged

MOST_PLACES = 120
ADMIN_TYPES = ("district", "municipality", "okrug")
# The nouns that must stand near the adjective of a district, and near that of a region.
DISTRICT_NEAR = (r"\b(?:район|округ|муниципалитет)(?:ы|ов|ах|ам|ами|е|а|у|ом)?\b", r"\bмуниципальн\w*\s+(?:район|округ)\w*", r"\bгородск\w*\s+округ\w*", r"\bмо\b")
REGION_NEAR = (r"\bобласт(?:ь|и|ей|ям|ями|ях)\b", r"\bкра(?:й|я|е|ев|ям|ями|ях)\b", r"\bреспублик(?:а|и|е|у|ой|ами|ах)?\b", r"\bокруг(?:а|е|ов|ам|ами|ах)?\b")
BEFORE, AFTER = 40, 180


def alias_table(places: DataFrame) -> DataFrame:
    """places (id, name, label, region, type, lat, lon, aliases, rank) -> a row per (region, phrase, place).

    `head` tells a district's bare adjective, which counts only near an administrative noun.
    """
    own = F.transform(alias_forms_of()("aliases"), normalize)
    heads = F.when(F.col("type").isin(*ADMIN_TYPES), F.transform(head_forms_of()("aliases"), normalize)).otherwise(F.array().cast("array<string>"))
    tagged = F.concat(F.transform(own, lambda a: F.struct(a.alias("phrase"), F.lit(False).alias("head"))), F.transform(heads, lambda a: F.struct(a.alias("phrase"), F.lit(True).alias("head"))))
    rows = places.withColumn("a", F.explode(F.array_distinct(tagged))).where("a.phrase <> ''")
    return rows.select("a.phrase", "a.head", F.struct(F.col("rank"), F.col("name"), F.coalesce("label", "name").alias("label"), F.coalesce("type", F.lit("city")).alias("type"), "lat", "lon").alias("place"), F.col("region").alias("place_region"))


def near(text: Column, at: Column, phrase: Column, patterns) -> Column:
    """Whether a pattern is found around the phrase that begins at word `at` of the text."""
    start = F.length(F.array_join(F.slice(F.split(text, " "), 1, at), " ")) + F.when(at > 0, 1).otherwise(0)
    low = F.greatest(F.lit(0), start - BEFORE)
    return found(F.substring(text, low + 1, start + F.length(phrase) + AFTER - low), patterns)


def places_of(posts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(post_key, places): the places that each post of (post_key, region, text) names in its region, in gazetteer order.

    Of places with one name the first counts. Posts that name none have no row.
    """
    texts = posts.select("post_key", "region", normalize(F.col("text")).alias("n"))
    hits = phrase_hits(texts, ["post_key"], "n", aliases.withColumnRenamed("place_region", "region"), on=["region"])
    hits = staged(hits.select("post_key", "at", "phrase", "head", "place"), "alias-hits")
    # Only bare adjectives need the words around them.
    heads = hits.where("head").join(texts.select("post_key", "n"), "post_key").where(near(F.col("n"), F.col("at"), F.col("phrase"), DISTRICT_NEAR))
    met = hits.where("not head").select("post_key", "place").unionByName(heads.select("post_key", "place"))
    named = met.groupBy("post_key", F.col("place.name")).agg(F.min("place").alias("place"))
    # A post names at most as many places as its region has; the list is cut where records show it.
    return named.groupBy("post_key").agg(F.sort_array(F.collect_list("place")).alias("places"))


def with_places(posts: DataFrame, aliases: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<rank:int,name:string,label:string,type:string,lat:double,lon:double>>")
    return posts.join(places_of(posts, aliases), "post_key", "left").withColumn("places", F.coalesce("places", none))


def is_region_wide() -> Column:
    """Whether a post is about its whole region; needs default_scope, region_label, region_aliases, text, places."""
    n, none = normalize(F.col("text")), F.size("places") == 0
    label = normalize(F.coalesce("region_label", F.lit("")))
    aliases = F.transform(F.coalesce("region_aliases", F.array().cast("array<string>")), normalize)
    everywhere = n.contains("на всей территории") & found(n, ("област", "республик", "кра", "округ", "регион"))
    named = ((label != "") & n.contains(label)) | F.exists(aliases, lambda a: (a != "") & n.contains(a))
    return F.coalesce(((F.col("default_scope") == "region") & none), F.lit(False)) | found(n, REGION_PHRASES) | everywhere | (named & none)


def region_phrases(sources: DataFrame) -> DataFrame:
    """(region, phrase, head): names of the regions of sources, and the adjectives of their labels."""
    names = F.filter(F.concat(F.array("region_label"), F.coalesce("region_aliases", F.array().cast("array<string>"))), lambda a: a.isNotNull())
    heads = head_forms_of(REGION_NOUNS)(F.array(F.coalesce("region_label", F.lit(""))))
    tagged = F.concat(F.transform(names, lambda a: F.struct(normalize(a).alias("phrase"), F.lit(False).alias("head"))), F.transform(heads, lambda a: F.struct(normalize(a).alias("phrase"), F.lit(True).alias("head"))))
    return sources.select(F.col("region").alias("named"), F.explode(tagged).alias("a")).select("named", "a.*").where("phrase <> ''").distinct()


def in_scope(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Posts of shared feeds kept for the regions that they are about.

    A feed that needs no region match keeps all. Else the post stays if it names its own
    region; goes if it names another; and if it names none stays iff it names a place.
    """
    asked = posts.where(F.coalesce("require_region_match", F.lit(False)))
    texts = asked.select("post_key", "region", normalize(F.col("text")).alias("n"))
    hits = staged(phrase_hits(texts, ["post_key", "region"], "n", phrases), "region-hits")
    heads = hits.where("head").join(texts.select("post_key", "n"), "post_key").where(found(F.col("n"), REGION_NEAR))
    met = hits.where("not head").select("post_key", "region", "named").unionByName(heads.select("post_key", "region", "named"))
    own = met.groupBy("post_key").agg(F.bool_or(F.col("named") == F.col("region")).alias("own"))
    free = ~F.coalesce("require_region_match", F.lit(False))
    return posts.join(own, "post_key", "left").where(free | F.coalesce("own", F.size("places") > 0)).drop("own")


def is_repost_of_ministry() -> Column:
    """Forwarded ministry posts, and texts that quote one without local context; needs text, forwarded_from, places, region_wide."""
    forwarded = normalize(F.coalesce("forwarded_from", F.lit("")))
    quoted = found(normalize(F.col("text")), MINISTRY_PHRASES) & ~F.col("region_wide") & (F.size("places") == 0)
    return found(forwarded, ("минобороны", "министерство обороны")) | quoted


def scope_of(kind: Column) -> Column:
    """The scope of a record at a place of a type; null: the region."""
    return F.when(kind.isNull(), "region").when(kind == "city", "city").when(kind.isin(*ADMIN_TYPES), "municipality").otherwise(kind)


def without_fallback(rows: DataFrame, layer: str = "source_layer", only_if: str = "fallback_only_if_no_local_activity") -> DataFrame:
    """Rows of fallback sources go where their region has rows of a local one."""
    local = rows.where(F.col(layer) == "monitoring_local").select("region").distinct()
    fallback = F.coalesce(F.col(only_if), F.lit(False))
    return rows.where(~fallback).unionByName(rows.where(fallback).join(local, "region", "left_anti").select(rows.columns))


def first_place(*layers: DataFrame) -> DataFrame:
    """(region, name, lat, lon) of places from several tables; the first table that knows one wins."""
    rows = [d.select("region", "name", "lat", "lon", F.lit(i).alias("layer")) for i, d in enumerate(layers)]
    all_ = rows[0]
    for more in rows[1:]:
        all_ = all_.unionByName(more)
    best = F.min_by(F.struct("lat", "lon"), F.struct("layer", "lat", "lon"))
    return all_.where("lat is not null and lon is not null").groupBy("region", "name").agg(best.alias("p")).select("region", "name", "p.lat", "p.lon")


def code_of_region(codes: DataFrame, regions: DataFrame) -> DataFrame:
    """(code, region): for each named code the region that it fits best.

    Equal names score 100; a name inside the other scores the shorter length, where the
    region's has 4 letters or more. Names meet by what they begin with, not by a product.
    """
    own = codes.select("code", normalize(F.col("code_name")).alias("a")).where("a <> ''").distinct()
    named = regions.select("region", F.col("rank").alias("region_rank"), F.explode("aliases").alias("b")).withColumn("b", normalize(F.col("b"))).where("b <> ''").distinct()
    long = named.where(F.length("b") >= 4)
    score = F.when(F.col("a") == F.col("b"), 100).otherwise(F.least(F.length("a"), F.length("b")))
    both = ["code", "a", "region", "region_rank", "b"]
    met = own.join(named, F.col("a") == F.col("b")).select(both).unionByName(contained(own, "a", long, "b", 4).select(both)).unionByName(contained(long, "b", own, "a", 1).select(both))
    return met.groupBy("code").agg(F.max_by("region", F.struct(score, -F.col("region_rank"))).alias("region"))


def re_enriched(reports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Archived reports with the places that today's gazetteer finds in their texts, and `changed`.

    A report without a text or a region, or whose text names no place, stays as it is; else
    its place, scope, point and mentioned places become those found. `changed` tells whether
    place, scope or the names of the mentioned places differ from before.
    """
    keyed = reports.withColumn("post_key", F.xxhash64("id"))
    asked = keyed.where(F.coalesce(F.trim("text"), F.lit("")) != "").where("region is not null").select("post_key", "region", "text")
    placed = keyed.join(places_of(asked, aliases), "post_key", "left")
    first, seen = F.get("places", 0), F.col("places").isNotNull()
    shown = F.transform(F.slice("places", 1, MOST_PLACES), lambda p: F.struct(p["name"].alias("name"), p["label"].alias("label"), p["type"].alias("type"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,label:string,type:string,lat:double,lon:double>>")), lambda p: p["name"])
    new = {"place": first["name"], "scope": scope_of(first["type"]), "lat": first["lat"], "lon": first["lon"], "mentioned_places": shown}
    same = first["name"].eqNullSafe(F.col("place")) & scope_of(first["type"]).eqNullSafe(F.col("scope")) & (names(shown) == names(F.col("mentioned_places")))
    changed = placed.withColumn("changed", seen & ~same)
    return changed.withColumns({c: F.when(seen, v).otherwise(F.col(c)) for c, v in new.items()}).drop("post_key", "places")


def looked_up(rows: DataFrame, places: DataFrame, names: list[str]) -> DataFrame:
    """rows (region, the columns `names`) with `found`: struct(name, lat, lon) of the place that the first name with a match has, else null.

    A name matches a place (region, name, label, lat, lon) of its region by its exact name,
    else by its strict name, which may be that of the place's label. Of several places with
    one strict name the first by name counts. rows need a column row_id.
    """
    point = F.struct("name", "lat", "lon")
    exact = places.groupBy("region", F.col("name").alias("key")).agg(F.min(point).alias("p")).withColumn("how", F.lit(0))
    strict = places.select("region", F.explode(F.array_distinct(F.array(strict_name(F.col("name")), strict_name(F.col("label"))))).alias("key"), "name", "lat", "lon").where("key <> ''")
    strict = strict.groupBy("region", "key").agg(F.min(point).alias("p")).withColumn("how", F.lit(1))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(how).alias("how"), (strict_name(F.col(n)) if how else F.col(n)).alias("key")) for i, n in enumerate(names) for how in (0, 1)])
    asked = rows.select("row_id", "region", F.explode(keys).alias("k")).select("row_id", "region", "k.*").where("key is not null and key <> ''")
    met = asked.join(exact.unionByName(strict), ["region", "key", "how"])
    best = met.groupBy("row_id").agg(F.min_by("p", F.struct("i", "how")).alias("found"))
    return rows.join(best, "row_id", "left")


def regions_of_shapes(shapes: DataFrame, regions: DataFrame) -> DataFrame:
    """(shape_id, region): the region that a shape's names (shape_id, names array) fit, null where none or several do.

    regions: (region, aliases array). Names are compared strictly, with the words that tell a
    region's kind; only shapes that match none so are compared without those words, where a
    name of 5 letters or more may also lie inside the other.
    """
    named = shapes.select("shape_id", F.explode("names").alias("name")).where("name is not null")
    known = regions.select("region", F.explode(F.concat(F.array("region"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    strict = named.select("shape_id", strict_name(F.col("name")).alias("k")).where("k <> ''").join(known.select("region", strict_name(F.col("alias")).alias("k")), "k").select("shape_id", "region").distinct()
    rest = named.join(strict.select("shape_id").distinct(), "shape_id", "left_anti").select("shape_id", loose_name(F.col("name")).alias("a")).where("a <> ''").distinct()
    loose = known.select("region", loose_name(F.col("alias")).alias("b")).where("b <> ''").distinct()
    same = rest.join(loose, F.col("a") == F.col("b"))
    inside = contained(rest, "a", loose, "b", 5).unionByName(contained(loose, "b", rest, "a", 5), allowMissingColumns=True)
    fits = same.unionByName(inside).select("shape_id", "region").distinct()
    of = strict.unionByName(fits).groupBy("shape_id").agg(F.count("*").alias("n"), F.min("region").alias("region"))
    return shapes.select("shape_id").join(of, "shape_id", "left").select("shape_id", F.when(F.col("n") == 1, F.col("region")).alias("region"))
