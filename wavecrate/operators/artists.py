"""Artist names: matching, disambiguation, clusters and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions.text import artist_parts, ascii_fold, collapse, looks_acronym, normalize, punct_fold, strip_artist_noise
from wavecrate.params import NOT_FOUND
from wavecrate.patterns import FLAT_ARTISTS
from wavecrate.plans.topk import one_per
from wavecrate.shipping import ship

FAN_FLOOR = 1000
FAN_RATIO = 10


def folded(df: DataFrame, name: str, out: str = "fold") -> DataFrame:
    """Adds the accent fold; names in plain ASCII don't go through Python."""
    ship(df.sparkSession)
    plain = F.lower(F.trim(name))
    return df.withColumn(out, F.when(F.col(name).rlike(r"[^\x00-\x7F]"), ascii_fold(F.col(name))).otherwise(plain))


def dominant(high: Column, low: Column) -> Column:
    return high >= F.greatest(F.lit(FAN_FLOOR), low * FAN_RATIO)


def classify(strings: DataFrame, known: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, rule, outcome, tokens): ``split`` locally, ``needs_lookup`` by rule comma or ampersand, or ``single``.

    A pair with a token among ``known`` (name) is split without a lookup.
    """
    parts = strings.select(raw, artist_parts(F.col(raw)).alias("p")).select(raw, "p.rule", F.transform("p.parts", lambda x: x["token"]).alias("tokens"))
    each = parts.filter(F.col("rule").isin("comma", "ampersand")).select(raw, F.explode("tokens").alias("t")).withColumn("name", normalize(F.col("t")))
    hit = each.join(known.select("name").distinct(), "name", "left_semi").select(raw).distinct().withColumn("hit", F.lit(True))
    out = parts.join(hit, raw, "left")
    outcome = F.when(F.col("rule") == "single", "single").when((F.col("rule") == "local") | F.col("hit"), "split").otherwise("needs_lookup")
    return out.select(raw, "rule", outcome.alias("outcome"), "tokens")


def disambiguate(lookups: DataFrame) -> DataFrame:
    """(raw, outcome) from what a lookup found: raw, rule, full (whole name found), found (tokens found), tokens (their number).

    Comma: split if all tokens were found, else flag. Ampersand: whole name only is
    a duo, tokens only a split, both or neither flag.
    """
    all_found = F.col("found") == F.col("tokens")
    amp = F.when(F.col("full") & ~all_found, "duo").when(~F.col("full") & all_found, "split").otherwise("flag")
    return lookups.select("raw", F.when(F.col("rule") == "comma", F.when(all_found, "split").otherwise("flag")).otherwise(amp).alias("outcome"))


def clusters(artists: DataFrame, fans: bool = False) -> DataFrame:
    """(key, decision, reason, canonical, members): what to do with each group of names that differ in punctuation only.

    ``artists``: id, name, deezer_id, fans. Acronyms and groups without a single
    confirmed anchor are flagged, never merged; blank keys match nothing.
    """
    keyed = folded(artists, "name").withColumn("key", punct_fold(F.col("fold"))).filter("key <> ''")
    linked = F.col("deezer_id").isNotNull() & (F.col("deezer_id") != NOT_FOUND)
    g = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"),
        F.max(looks_acronym(F.col("name"))).alias("acronym"),
        F.count(F.when(linked, True)).alias("linked"),
        F.count(F.when(F.col("deezer_id").isNull(), True)).alias("nulls"),
        F.min(F.when(linked, F.col("id"))).alias("anchor"),
        F.slice(F.sort_array(F.collect_list(F.when(linked, F.struct(F.coalesce("fans", F.lit(0)).alias("fans"), (-F.col("id")).alias("minus")))), asc=False), 1, 2).alias("top"),
    )
    g = g.filter("members > 1")
    ahead = F.lit(fans) & (F.col("linked") >= 2) & dominant(F.try_element_at("top", F.lit(1))["fans"], F.try_element_at("top", F.lit(2))["fans"])
    pure = (F.col("linked") == 1) & (F.col("nulls") > 0) & (F.col("linked") + F.col("nulls") == F.col("members"))
    reason = F.when(F.col("acronym"), "acronym").when(pure, "one_linked_nulls").when(F.col("linked") == 0, "no_linked").when(ahead, "fan_dominant").when(F.col("linked") >= 2, "multi_linked").otherwise("one_linked_mixed")
    g = g.withColumn("reason", reason)
    merge = F.col("reason").isin("one_linked_nulls", "fan_dominant")
    canonical = F.when(F.col("reason") == "one_linked_nulls", F.col("anchor")).when(F.col("reason") == "fan_dominant", -F.try_element_at("top", F.lit(1))["minus"])
    return g.select("key", F.when(merge, "merge").otherwise("flag").alias("decision"), "reason", canonical.alias("canonical"), "members")


def orphans(artists: DataFrame) -> DataFrame:
    """(id, holder): artists without an id whose fold exactly one holder of an id shares."""
    keyed = folded(artists, "name").filter("fold <> ''")
    linked = F.col("deezer_id").isNotNull() & (F.col("deezer_id") != NOT_FOUND)
    holders = keyed.filter(linked).groupBy("fold").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return keyed.filter(F.col("deezer_id").isNull()).join(holders, "fold").select("id", "holder")


def hits_ranked(artists: DataFrame, hits: DataFrame) -> DataFrame:
    """(artist_id, hit_id, how, rank): lookup hits that name the artist, most fans first, as they came on ties.

    ``hits``: artist_id, hit_id, hit_name, fans, seq. Exact names, then accent folds,
    then punctuation folds, the last only for popular hits and no acronyms.
    """
    a = folded(artists.select(F.col("id").alias("artist_id"), "name"), "name", "fa")
    h = folded(hits, "hit_name", "fh")
    both = h.join(a, "artist_id")
    exact = F.lower("hit_name") == F.lower("name")
    accent = (F.col("fa") != "") & (F.col("fa") == F.col("fh"))
    punct = (punct_fold(F.col("fa")) != "") & (punct_fold(F.col("fa")) == punct_fold(F.col("fh"))) & ~looks_acronym(F.col("name")) & ~looks_acronym(F.col("hit_name")) & (F.coalesce("fans", F.lit(0)) >= FAN_FLOOR)
    matched = both.withColumn("how", F.when(exact, "exact").when(accent, "accent").when(punct, "punct")).filter("how is not null")
    order = Window.partitionBy("artist_id").orderBy(F.desc(F.coalesce("fans", F.lit(0))), "seq")
    return matched.select("artist_id", "hit_id", "how", F.row_number().over(order).alias("rank"))


def link_or_merge(ranked: DataFrame, held: DataFrame) -> DataFrame:
    """(artist_id, action, hit_id, holder): the first free hit links; else the first held one merges into its holder.

    ``held``: hit_id, holder. Two artists of one run that want one hit: the least id links, the other merges into it.
    """
    h = ranked.join(held, "hit_id", "left")
    pick = one_per(h, ["artist_id"], [F.col("holder").isNotNull(), F.col("rank")])
    first = Window.partitionBy("hit_id", F.col("holder").isNull()).orderBy("artist_id")
    owner = F.first("artist_id").over(first)
    claimed = pick.withColumn("owner", F.when(F.col("holder").isNull(), owner))
    merged = F.col("holder").isNotNull() | (F.col("owner") != F.col("artist_id"))
    return claimed.select("artist_id", F.when(merged, "merge").otherwise("link").alias("action"), "hit_id", F.when(merged, F.coalesce("holder", "owner")).alias("holder"))


def new_links(unlinked: DataFrame, names: DataFrame) -> DataFrame:
    """(catalog_id, artist_id, role, position): links for flat artist texts, by name, artists before aliases.

    ``unlinked``: id, artist; ``names``: name (normalised), artist_id, alias.
    """
    parts = unlinked.select(F.col("id").alias("catalog_id"), F.inline(artist_parts(F.col("artist"))["parts"]))
    named = parts.withColumn("name", normalize(F.col("token"))).join(names, "name")
    best = one_per(named, ["catalog_id", "position"], [F.col("alias"), F.col("artist_id")])
    return one_per(best, ["catalog_id", "artist_id"], [F.col("position")]).select("catalog_id", "artist_id", "role", "position")


def flat_from_links(links: DataFrame, artists: DataFrame) -> DataFrame:
    """(catalog_id, flat): linked names in order, positions unknown last."""
    named = links.join(artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").filter(F.trim("name") != "")
    order = F.struct(F.col("position").isNull().alias("none"), F.coalesce("position", F.lit(0)).alias("position"), F.lower("name").alias("fold"), F.trim("name").alias("name"))
    return named.groupBy("catalog_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]), ", ").alias("flat"))


def resync(catalog: DataFrame, links: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, artist, flat, outcome): coherent, ambiguous (shares some names and would lose others) or resync."""
    both = catalog.filter(F.trim("artist") != "").select("id", "artist").join(flat_from_links(links, artists).withColumnRenamed("catalog_id", "id"), "id")
    both = folded(folded(both, "artist", "a"), "flat", "b").withColumn("a", collapse(F.col("a"))).withColumn("b", collapse(F.col("b")))
    apart = (F.col("a") != "") & (F.col("b") != "") & ~F.contains("a", "b") & ~F.contains("b", "a")
    toks = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, FLAT_ARTISTS), lambda t: F.trim(t)), lambda t: t != ""))
    mixed = (F.size(F.array_intersect(toks("a"), toks("b"))) > 0) & (F.size(F.array_except(toks("a"), toks("b"))) > 0)
    return both.select("id", "artist", "flat", F.when(~apart, "coherent").when(mixed, "ambiguous").otherwise("resync").alias("outcome"))


def cleaned_names(artists: DataFrame) -> DataFrame:
    """(id, name, clean, twin): names with noise, and the artist that already has the clean name."""
    noisy = artists.withColumn("clean", strip_artist_noise(F.col("name"))).filter("clean <> name")
    twins = artists.groupBy(normalize(F.col("name")).alias("n")).agg(F.min("id").alias("twin"))
    return noisy.withColumn("n", normalize(F.col("clean"))).join(twins, "n", "left").select("id", "name", "clean", "twin")


def aliases(catalog: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, alias): catalog spellings that differ from the artist's, one a normalised alias, the most frequent first."""
    spelled = catalog.filter("artist is not null").groupBy("artist").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", normalize(F.col("artist")))
    known = artists.select(F.col("id").alias("artist_id"), "name", normalize(F.col("name")).alias("norm"))
    return one_per(spelled.join(known, "norm").filter("artist <> name"), ["norm"], [F.desc("n"), F.col("artist")]).select("artist_id", F.col("artist").alias("alias"))


def slug_names(artists: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, name, repaired): slug-like names with the catalog spelling that they come from, the most frequent first."""
    slugs = artists.filter((F.col("name") == F.lower("name")) & ~F.contains("name", F.lit(" ")))
    spelled = catalog.filter("artist is not null").groupBy("artist").agg(F.count(F.lit(1)).alias("n")).withColumn("slug", F.replace(F.lower("artist"), F.lit(" "), F.lit("")))
    both = slugs.join(spelled, F.col("name") == F.col("slug")).filter("artist <> name")
    return one_per(both, ["id"], [F.desc("n"), F.col("artist")]).select("id", "name", F.col("artist").alias("repaired"))


def name_from_title(title: Column, slug: Column) -> Column:
    """The part of a title that the channel's slug stands for, else the slug in title case."""
    parts = F.filter(F.transform(F.split(title, r"\s+[-–—|@]\s+"), lambda t: F.trim(t)), lambda t: F.replace(F.lower(t), F.lit(" "), F.lit("")) == F.lower(slug))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.initcap(F.regexp_replace(slug, "[-_]", " ")))


def contributors(payload: DataFrame) -> DataFrame:
    """(catalog_id, contributor, role, position): first occurrence of each contributor; ``payload``: catalog_id, contributors (array of id, role)."""
    each = payload.select("catalog_id", F.posexplode("contributors").alias("pos", "c"))
    first = one_per(each.select("catalog_id", "pos", F.col("c.id").alias("contributor"), F.col("c.role").alias("r")), ["catalog_id", "contributor"], [F.col("pos")])
    role = F.when(F.col("r") == "Featured", "featured").otherwise("primary")
    return first.select("catalog_id", "contributor", role.alias("role"), (F.row_number().over(Window.partitionBy("catalog_id").orderBy("pos")) - 1).alias("position"))
