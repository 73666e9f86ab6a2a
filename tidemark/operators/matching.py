"""Resolving charted songs against pages: universe, variants, the artist gate, learned ids and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions import text as X

# Scores from which a title is accepted or reviewed and an artist is the same.
TITLE_ACCEPT, TITLE_REVIEW, ARTIST_ACCEPT = 92, 80, 85
RANKS = {"accept": 2, "review": 1, "reject": 0}
#: Songs of artists' lists that are broadcast at most; more are joined by a shuffle.
LISTED = 200_000


def song_universe(charts: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a song in scope: its first names in chart order, streams, best rank, weeks, and why it is in.

    In scope are songs with a Hebrew title, and songs of an artist who has a Hebrew name, a mapping or a Hebrew-titled
    song. charts need (week_date, rank) as their order; streams decide the order of the result, then uri.
    """
    order = F.struct("week_date", "rank")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    songs = charts.groupBy("uri").agg(
        first("track_name"), first("artist_names"), F.sum("streams").alias("total_streams"), F.min("rank").alias("peak_rank"),
        F.min("week_date").alias("first_week"), F.countDistinct("week_date").alias("n_weeks"),
    )
    songs = songs.withColumn("hebrew_title", X.has_hebrew(F.col("track_name")))
    names = songs.select("uri", "hebrew_title", F.explode(X.split_artists(F.col("artist_names"))).alias("artist"))
    ours = names.where("hebrew_title").select("artist").union(mapping.select("original_artist")).distinct()
    known = names.where(X.has_hebrew(F.col("artist"))).select("uri").union(names.join(ours, "artist", "left_semi").select("uri")).distinct().withColumn("known", F.lit(True))
    picked = songs.join(known, "uri", "left").withColumn("selection", F.when(F.col("hebrew_title"), "hebrew_title").when(F.col("known"), "israeli_artist"))
    return picked.where("selection IS NOT NULL").drop("hebrew_title", "known").orderBy(F.desc("total_streams"), "uri")


def artist_variants(songs: DataFrame, mapping: DataFrame, key: str = "uri", names: str = "artist_names") -> DataFrame:
    """songs with variants: credited performers, each followed by its mapped names, then the whole credit's; repeats go."""
    listed = songs.select(key, F.col(names).alias("whole"), F.posexplode(X.performers(X.split_artists(F.col(names)))).alias("i", "artist"))
    by = mapping.select(F.col("original_artist").alias("artist"), X.split_artists(F.col("hebrew_artist")).alias("mapped"))
    own = listed.join(by, "artist", "left").select(key, "i", F.concat(F.array("artist"), F.coalesce("mapped", F.array().cast("array<string>"))).alias("v"))
    own = own.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])).alias("own"))
    whole = songs.select(key, F.col(names).alias("artist")).join(by, "artist").groupBy(key).agg(F.first("mapped").alias("all"))
    empty = F.array().cast("array<string>")
    joined = F.array_distinct(F.concat(F.coalesce("own", empty), F.coalesce("all", empty)))
    return songs.join(own, key, "left").join(whole, key, "left").withColumn("variants", joined).drop("own", "all")


def decision(title: Column, artist: Column, known: Column) -> Column:
    """The artist gate: a matching title needs a matching artist or a known artist id to be accepted."""
    same = (artist >= ARTIST_ACCEPT) | F.coalesce(known, F.lit(False))
    return F.when((title >= TITLE_ACCEPT) & same, "accept").when((title >= TITLE_ACCEPT) | ((title >= TITLE_REVIEW) & same), "review").otherwise("reject")


def old_rule(title: Column, artist: Column) -> Column:
    """The rule without a gate: a weighted sum that a title alone can pass."""
    return 0.8 * title + 0.2 * artist > 70


def prepared_parts(parts: DataFrame) -> DataFrame:
    """parts (part, variants) with their cleaned forms, made once a part and not once a candidate."""
    return parts.withColumn("part_clean", X.clean(F.col("part"))).withColumn("variants_clean", F.transform("variants", lambda v: X.clean(v, compose=False)))


def prepared_pages(pages: DataFrame) -> DataFrame:
    """pages (title, artist) with their cleaned forms."""
    return pages.withColumn("title_clean", X.clean(F.col("title"))).withColumn("artist_clean", X.clean(F.coalesce("artist", F.lit(""))))


def score_candidates(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (part, variants, title, artist, prfid, credited) with scores, prfid_known and decision.

    known: (credited, prfid) pairs; credited is the array of the song's artists. A null prfid is never known. Cleaned
    columns of prepared_parts and prepared_pages are used where rows have them.
    """
    if known is not None and "credited" in rows.columns:
        pairs = known.where("prfid IS NOT NULL").groupBy("prfid").agg(F.collect_set("credited").alias("_of"))
        rows = rows.join(pairs, "prfid", "left").withColumn("prfid_known", F.coalesce(F.arrays_overlap("_of", "credited"), F.lit(False))).drop("_of")
    else:
        rows = rows.withColumn("prfid_known", F.lit(False)) if "prfid_known" not in rows.columns else rows
    x = rows if "part_clean" in rows.columns else prepared_parts(rows)
    x = x if "title_clean" in x.columns else prepared_pages(x)
    x = x.withColumn("_t", S.title_score("part_clean", "title_clean")).withColumn("_a", S.artist_score("variants_clean", "artist_clean"))
    x = x.withColumn("decision", decision(F.col("_t"), F.col("_a"), F.col("prfid_known")))
    x = x.withColumn("title_score", F.bround("_t", 1)).withColumn("artist_score", F.bround("_a", 1))
    return x.drop("_t", "_a", "part_clean", "variants_clean", "title_clean", "artist_clean")


def search_queries(parts: DataFrame, more: int = 2) -> DataFrame:
    """(uri, part_no, tier, query): a part is searched by its title, then with each of its first `more` variants that have
    Hebrew letters. Tier 0 is for artists' song lists; searches are tiers 1, 2 and so on."""
    hebrew = F.slice(F.filter("variants", lambda v: X.has_hebrew(v)), 1, more)
    queries = F.concat(F.array("part"), F.transform(hebrew, lambda v: F.concat_ws(" ", "part", v)))
    return parts.select("uri", "part_no", F.posexplode(queries).alias("tier", "query")).withColumn("tier", F.col("tier") + 1)


def candidates_by_tier(parts: DataFrame, known: DataFrame, works: DataFrame, searches: DataFrame) -> DataFrame:
    """The candidates of each part in the order in which they are tried: uri, part_no, tier, ord and the pages' columns.

    parts: uri, part_no, part, variants, credited. known: (credited, prfid). works: prfid, ord and the songs of an artist's
    list; searches: query, ord and a search's hits. Tier 0 has the lists of all known ids of the credited artists, by id;
    then come the searches of search_queries. The columns of both are the same but for the key.

    The lists of artists credited together are joined and numbered once, whatever the number of their parts, and go to the
    parts where those lie: a part's candidates are neither sorted nor shuffled.
    """
    cols = [c for c in works.columns if c not in ("prfid", "ord")]
    n = parts.sparkSession.sparkContext.defaultParallelism
    n = max(n, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = parts.repartition(n, "uri", "part_no").groupBy("uri", "part_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("credited")))).alias("credited"))
    names = named.select("credited").distinct()
    ids = names.select("credited", F.explode("credited").alias("name")).join(known.where("prfid IS NOT NULL").select(F.col("credited").alias("name"), "prfid").distinct(), "name")
    by_id = Window.partitionBy("credited").orderBy("prfid", "ord")
    lists = ids.select("credited", "prfid").distinct().join(works, "prfid").select("credited", "prfid", F.row_number().over(by_id).cast("long").alias("ord"), *cols)
    if lists.limit(LISTED + 1).count() <= LISTED:
        lists = F.broadcast(lists)
    listed = named.join(lists, "credited").select("uri", "part_no", F.lit(0).alias("tier"), "ord", "prfid", *cols)
    found = search_queries(parts).join(searches, "query").select("uri", "part_no", "tier", F.col("ord").cast("long").alias("ord"), "prfid", *cols)
    return listed.unionByName(found)


def seeded(old: DataFrame, mapping: DataFrame, same: float = 90) -> tuple[DataFrame, DataFrame]:
    """What an earlier run's matches are worth under the artist gate: (lyrics by url, known (credited, prfid) pairs).

    old: uri, track_name, artist_names, title, artist, url, lyrics. Rows without lyrics or url are left out. The first part
    of a title decides, and no id is known beforehand. Of accepted rows the lyrics are kept by url, one row a url, and each
    credited performer whose own names score `same` or more against the page's artist learns the id in the url.
    """
    rows = old.where("lyrics IS NOT NULL AND url IS NOT NULL").withColumn("prfid", X.query_value(F.col("url"), "prfid"))
    rows = artist_variants(
        rows.withColumn("_row", F.monotonically_increasing_id()), mapping, key="_row",
    ).withColumn("part", F.element_at(X.title_parts(F.col("track_name")), 1))
    taken = score_candidates(rows).where("decision = 'accept'")
    lyrics = taken.groupBy("url").agg(F.max_by("lyrics", "uri").alias("lyrics"))
    single = taken.select(F.explode(X.performers(X.split_artists(F.col("artist_names")))).alias("credited"), "artist", "prfid").distinct()
    own = artist_variants(
        single.select("credited").distinct().withColumn("names", F.col("credited")), mapping, key="credited", names="names",
    ).select("credited", F.transform("variants", lambda v: X.clean(v, compose=False)).alias("own"))
    known = single.join(own, "credited").where(S.artist_score("own", X.clean(F.coalesce("artist", F.lit("")))) >= same)
    return lyrics, known.where("prfid IS NOT NULL").select("credited", "prfid").distinct()


def best(decided: DataFrame, by: list[str], order: str) -> DataFrame:
    """The best candidate of each group: by decision, then the sum of scores, then the first."""
    rank = F.when(F.col("decision") == "accept", 2).when(F.col("decision") == "review", 1).otherwise(0)
    cols = [c for c in decided.columns if c not in by]
    top = F.max_by(F.struct(*cols), F.struct(rank, F.col("title_score") + F.col("artist_score"), -F.col(order)))
    return decided.groupBy(*by).agg(top.alias("b")).select(*by, "b.*")


def first_tier(decided: DataFrame, by: list[str], tier: str = "tier") -> DataFrame:
    """Candidates as an early stop would have left them: nothing beyond the first tier that has an accepted one."""
    stop = F.min(F.when(F.col("decision") == "accept", F.col(tier))).over(Window.partitionBy(*by))
    return decided.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(tier) <= F.col("_stop"))).drop("_stop")


def learn_ids(hits: DataFrame, least: int = 2) -> DataFrame:
    """(credited, prfid) of artist ids that title hits of `least` songs or more share. hits: credited, song, prfid, and where
    a song stands for several their number `songs`."""
    if "songs" not in hits.columns:
        hits = hits.withColumn("songs", F.lit(1))
    each = hits.where("prfid IS NOT NULL AND song IS NOT NULL").groupBy("credited", "prfid", "song").agg(F.max("songs").alias("songs"))
    return each.groupBy("credited", "prfid").agg(F.sum("songs").alias("songs")).where(F.col("songs") >= least).select("credited", "prfid")


def overridden(rows: DataFrame, overrides: DataFrame, status: Column, key: str = "uri") -> DataFrame:
    """rows with status and manual_url: a person's decision of action none or url wins over `status`; other actions and all
    but the first row of a key count for nothing."""
    manual = overrides.where(F.col("action").isin("none", "url")).groupBy(F.col("spotify_uri").alias(key)).agg(
        F.first("action").alias("_action"), F.first("shironet_url").alias("manual_url"),
    )
    return rows.join(manual, key, "left").withColumn("status", F.coalesce(F.concat(F.lit("manual_"), "_action"), status)).drop("_action")


def resolve(
    songs: DataFrame, candidates: DataFrame, mapping: DataFrame, known: DataFrame, overrides: DataFrame, uncached: DataFrame | None = None,
    alike: str | None = None,
) -> DataFrame:
    """Songs with status, part count and the chosen pages, in two passes over one set of candidates.

    songs: uri, track_name, artist_names. candidates: uri, part_no, tier, ord, title, artist, prfid, wrkid, url,
    lyrics. The ids that pass 1 learns from title hits are known in pass 2, as a snapshot. Overrides (spotify_uri,
    action, shironet_url) of action none or url win over any match. uncached (uri): songs of which a page that was to be
    read is not in the cache; they have no pages and the status not_cached. alike: a column of songs that is the same for
    songs of the same names and candidates, which are then matched once; candidates have it as their uri.
    """
    one = F.col(alike or "uri")
    heads = songs.groupBy(one.alias("uri")).agg(F.first("track_name").alias("track_name"), F.first("artist_names").alias("artist_names"), F.countDistinct(songs["uri"]).alias("songs")) if alike else songs.withColumn("songs", F.lit(1))
    parts = artist_variants(heads, mapping).withColumn("credited", X.split_artists(F.col("artist_names"))).select(
        "uri", "songs", "variants", "credited", F.posexplode(X.title_parts(F.col("track_name"))).alias("part_no", "part"),
    )
    rows = prepared_parts(parts).join(prepared_pages(candidates), ["uri", "part_no"])
    hits = score_candidates(rows, known).where(F.col("title_score") >= TITLE_ACCEPT)
    learned = learn_ids(hits.select(F.explode("credited").alias("credited"), F.concat_ws("|", "uri", "part").alias("song"), "prfid", "songs"))
    decided = score_candidates(rows, known.select("credited", "prfid").union(learned).distinct())
    chosen = best(first_tier(decided, ["uri", "part_no"]), ["uri", "part_no"], "ord")
    picked = parts.select("uri", "part_no").join(chosen, ["uri", "part_no"], "left")
    d = F.col("decision")
    ordered = lambda c: F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("part_no", F.col(c).alias("x")))), lambda s: s["x"]))
    song = picked.groupBy("uri").agg(
        F.count("*").alias("n_parts"),
        F.count_if(d.isNull() | (d == "reject")).alias("missing"),
        F.count_if(d == "review").alias("reviews"),
        F.count_if(F.col("lyrics").isNull()).alias("unread"),
        F.count_if(F.trim("lyrics") == "").alias("blank"),
        F.array_join(ordered("url"), " | ").alias("shironet_urls"),
        F.array_join(ordered("title"), " | ").alias("shironet_titles"),
        F.min("title_score").alias("title_score"),
        F.min("artist_score").alias("artist_score"),
        F.array_join(ordered("lyrics"), "\n\n").alias("lyrics"),
    )
    x = songs.join(song.withColumnRenamed("uri", alike), alike, "left") if alike else songs.join(song, "uri", "left")
    if uncached is not None:
        x = x.join(uncached.select("uri").distinct().withColumn("_miss", F.lit(True)), "uri", "left")
        x = x.withColumns({c: F.when(F.col("_miss").isNull(), F.col(c)) for c in ("shironet_urls", "shironet_titles", "title_score", "artist_score", "lyrics")})
    else:
        x = x.withColumn("_miss", F.lit(None).cast("boolean"))
    automatic = (
        F.when(F.col("_miss"), "not_cached")
        .when(F.coalesce("missing", F.lit(1)) > 0, "not_found")
        .when(F.col("reviews") > 0, "review")
        .when(F.col("unread") > 0, "lyrics_not_fetched")
        .when(F.col("blank") > 0, "page_without_lyrics")
        .otherwise("accepted")
    )
    x = overridden(x, overrides, automatic)
    return x.withColumn("lyrics", F.when(F.col("status") == "accepted", F.col("lyrics"))).drop("missing", "reviews", "unread", "blank", "_miss")


def review_queue(matches: DataFrame) -> DataFrame:
    """Songs that a person should look at, the most streamed first, with empty columns for the answer."""
    return matches.where(~F.col("status").isin("accepted", "manual_none")).withColumn("reviewer_action", F.lit("")).withColumn("reviewer_url", F.lit("")).orderBy(F.desc("total_streams"), "uri")


def audit(matches: DataFrame, mapping: DataFrame, cleared: list[str], below: float = 70) -> DataFrame:
    """Matched songs whose artist differs: raw name variants score under `below`, and not cleared by hand."""
    scored = artist_variants(matches, mapping).withColumn("similarity", S.audit_score("variants", "matched_artist"))
    return scored.where((F.col("similarity") < below) & ~F.col("uri").isin(cleared))
