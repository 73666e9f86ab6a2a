"""Queries over texts, titles, pages and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import similarity as Y
from tidemark.functions import text as X
from tidemark.operators import lexicon as L
from tidemark.operators import matching as M
from tidemark.operators import scoring
from tidemark.operators import series as S
from tidemark.sources import readers, sinks

from .analogues import CHARTS_SQL, HALF_YEARS, charts, six_digits, table
from .weekly import CASES_SQL, R, rounded

# Stand-in word lists of the test languages, with the hits that make a theme.
WORDS = {"english": (("the", "and", "of", "to"), 3), "german": (("der", "die", "das", "und"), 3), "french": (("les", "des", "que", "une"), 2)}
ANY_LETTER = r"\p{L}"
WIN, STEP = 50, 25


def themes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return L.code_themes(docs, WORDS, joined="", letters=ANY_LETTER).drop("text")


def theme_hits(spark: SparkSession, d: str) -> DataFrame:
    return themes(spark, d).select("doc_id", *[f"{k}_hits" for k in WORDS])


def theme_flags(spark: SparkSession, d: str) -> DataFrame:
    return themes(spark, d).agg(*[F.round(F.avg(k), 6).alias(k) for k in WORDS])


def weekly_theme_share(spark: SparkSession, d: str) -> DataFrame:
    songs = L.code_themes(
        table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("text")),
        {"tool": (("gear", "bolt", "gizmo"), 1), "look": (("red", "blue", "hot"), 1)}, joined="", letters=ANY_LETTER,
    )
    return rounded(S.weighted_means(charts(spark, d), songs, ["tool", "look"]).drop("stream_coverage"))


def script_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    share = docs.select("doc_id", six_digits(X.letter_share(F.col("text"), "[A-Za-z]")).alias("share"))
    return share.withColumn("kept", (F.col("share") >= 0.95).cast("int"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.split("text", "[ \n]+").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), X.windows(F.col("w"), WIN, STEP).alias("wins"))


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    return w.select("doc_id", "n_words", F.size("wins").alias("n_windows"), F.size(F.element_at("wins", -1)).alias("last_size"))


def window_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Of each text, the mean over its windows of their share of long words, weighted by their lengths.

    A word counts once for each window it lies in, so the sums are taken over words and no window is made.
    """
    words = table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.split("text", "[ \n]+").alias("w"))
    n = F.size("w")
    x = words.select("uri", n.alias("n"), F.transform("w", lambda x: F.length(x) > 5).alias("long"), X.in_windows(F.col("w"), WIN, STEP).alias("c"))
    pairs = F.zip_with("long", "c", lambda l, c: F.when(l, c).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    wins = (F.ceil(F.greatest(F.lit(0), F.col("n") - WIN) / STEP) + 1).cast("long")
    return rounded(x.select("uri", wins.alias("n_windows"), F.try_divide(total(pairs).cast("double"), total("c").cast("double")).alias("p")), "p")


def _share_of(n: int):
    """A stand-in model: the share of a window's words with more than n letters."""

    def make():
        return lambda windows: [[sum(len(w) > n for w in x) / len(x)] for x in windows]

    return make


def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """Texts scored window by window in batches by a model given as a function, here a count of long words."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.split("text", "[ \n]+").alias("tokens"))
    return rounded(scoring.score_texts(words, _share_of(5), ["p"], size=WIN, stride=STEP), "p")


def split_artists(spark: SparkSession, d: str) -> DataFrame:
    credit = F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(" ,, "), F.col("c_name"))
    names = table(spark, d, "customer").select("c_custkey", X.split_artists(credit).alias("names"))
    return names.select("c_custkey", F.size("names").alias("n"), F.array_join(F.array_distinct("names"), "|").alias("names"))


def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as titles are normalised."""
    t = table(readers.small_batches(spark), d, "documents").select("doc_id", F.col("text").alias("t"))
    return t.select("doc_id", X.clean(F.col("t")).alias("clean"), X.squash(F.col("t")).alias("squashed"))


def title_parts(spark: SparkSession, d: str) -> DataFrame:
    """Medleys of two part names with version endings, back to their parts."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" (bonus) & "), F.col("p_type"), F.lit(" - Live")).alias("t"))
    return p.select("p_partkey", F.array_join(X.title_parts(F.col("t")), "|").alias("parts"))


def url_params(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.query_value(u, "page").alias("page"), X.query_value(u, "utm_source").alias("utm_source"))


def sha1_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha1("url").alias("key"))


def page_cache(spark: SparkSession, d: str) -> DataFrame:
    """Wanted pages against those fetched: the rest is not cached. Of pages fetched for one url the first counts."""
    p = table(spark, d, "pages")
    got = readers.cached_pages(p.select("page_id", "url"), p.where("page_id % 3 <> 0").select("page_id", "url", "html"), "page_id")
    return got.select("page_id", "key", "status", F.coalesce(F.length("html"), F.lit(0)).alias("html_chars"))


def medley_concat(spark: SparkSession, d: str) -> DataFrame:
    got = sinks.joined_parts(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return got.select("conv_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def decide_cases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 2.0).alias("t"), (F.col("p_partkey") % 101 + 0.0).alias("a"), (F.col("p_partkey") % 7 == 0).alias("k"),
    )
    return p.select(
        "p_partkey", M.decision(F.col("t"), F.col("a"), F.col("k")).alias("decision"), M.old_rule(F.col("t"), F.col("a")).cast("int").alias("old_rule"),
    )


def learn_ids_having(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").where("l_quantity >= 49").select(
        (F.col("l_suppkey") % 10).alias("credited"), F.col("l_partkey").alias("song"), F.col("l_suppkey").alias("prfid"),
    )
    return M.learn_ids(hits, least=12)


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord"), (F.col("l_quantity") * 2).alias("title_score"),
        (F.col("l_partkey") % 101 + 0.0).alias("artist_score"), F.col("l_partkey").alias("page"),
    )
    decided = l.withColumn("decision", M.decision(F.col("title_score"), F.col("artist_score"), F.lit(False)))
    return M.best(decided, ["l_orderkey"], "ord").select("l_orderkey", "ord", "page", "decision")


def first_accepting_tier(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("tier"), F.when(F.col("l_quantity") >= 40, "accept").otherwise("review").alias("decision"),
    )
    return M.first_tier(l, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.max("tier").alias("last_tier"))


def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand in more than one row, by hash; nulls count as equal."""
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    many = t.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return t.join(many, t["h"].eqNullSafe(many["h"])).select("doc_id", "n")


def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = readers.first_wins(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return o.select("o_custkey", "o_orderkey")


def last_wins_mapping(spark: SparkSession, d: str) -> DataFrame:
    o = readers.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", F.col("o_orderkey"))
    return o.select("o_custkey", "o_orderpriority")


def union_queue(spark: SparkSession, d: str) -> DataFrame:
    """Two review queues in one, with their reason, places and running share of the streams."""
    p = table(spark, d, "part")
    a = p.where("p_size < 10").select(
        F.col("p_partkey").alias("uri"), F.lit("artist_differs").alias("reason"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("streams"),
    )
    b = p.where("p_size > 45").select(
        F.col("p_partkey").alias("uri"), F.lit("not_found").alias("reason"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("streams"),
    )
    return S.cumulative_share(a.unionByName(b), "streams", "uri").withColumn("cum_share", F.round("cum_share", 3))


def labels_joins(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels by how they meet."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "toxic")
    both = docs.join(labels, "doc_id", "full_outer")
    kind = F.when(F.col("lang").isNull(), "label_only").when(F.col("toxic").isNull(), "document_only").otherwise("both")
    return both.groupBy(F.coalesce("lang", F.lit("-")).alias("lang"), kind.alias("kind")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def manual_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Statuses after hand-made decisions: those of two actions win, others are ignored, the first row of a key counts."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "uri")
    acts = o.where("uri % 5 = 0").select(
        F.col("uri").alias("spotify_uri"), F.when(F.col("uri") % 3 == 0, "none").when(F.col("uri") % 3 == 1, "url").otherwise("ask").alias("action"),
        F.lit("").alias("shironet_url"),
    )
    return M.overridden(o, acts, F.col("o_orderstatus")).groupBy("status").agg(F.count("*").alias("n"))


def formatted(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("p_partkey") % 1000) / 1000.0
    x = table(spark, d, "part").select("p_partkey", X.apa_p(p).alias("p"), X.percent(p).alias("pct"))
    return x


def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of the titles that stand side by side in a brand and size, and how many pairs of parts have them.

    Parts are counted by title first, so the join grows with the titles of a brand and size and not with the square of
    its parts; each pair of titles is cleaned and scored once.
    """
    p = table(spark, d, "part").groupBy("p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("a")).agg(F.count("*").alias("n"))
    pairs = p.join(p.toDF("p_brand", "p_size", "b", "m"), ["p_brand", "p_size"]).where("a <= b")
    met = pairs.groupBy("a", "b").agg(F.sum(F.when(F.col("a") == F.col("b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("m"))).alias("pairs")).where("pairs > 0")
    scored = met.select("a", "b", "pairs", Y.all_scores(X.clean(F.col("a")), X.clean(F.col("b"))).alias("s"))
    return scored.select("a", "b", "pairs", "s.title", "s.artist", "s.ratio")


def title_scores(spark: SparkSession, d: str) -> DataFrame:
    """The title score of part names that have a word in common: glued or in order of words, whichever is better."""
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    words = names.select("a", F.explode(F.array_distinct(F.split("a", " "))).alias("word"))
    pairs = words.join(words.withColumnRenamed("a", "b"), "word").where("a < b").select("a", "b").distinct()
    return rounded(pairs.select("a", "b", Y.title_score(X.clean(F.col("a")), X.clean(F.col("b"))).alias("score")), "score")


def resolved_songs(spark: SparkSession, d: str) -> DataFrame:
    """Two-pass resolution of parts as songs. The pages are the distinct names of a brand: an artist's list has all of a
    brand's, a search all of a name's, so songs of one name and brand are matched once. Some songs are decided by hand and
    some have pages that are not in the cache."""
    p = table(spark, d, "part")
    uri = F.col("p_partkey").cast("string")
    songs = p.select(
        uri.alias("uri"), F.concat("p_name", F.lit(" - Live")).alias("track_name"), F.col("p_brand").alias("artist_names"),
        F.col("p_retailprice").alias("total_streams"), "p_name", "p_brand", "p_partkey", F.to_json(F.array("p_name", "p_brand")).alias("kind"),
    )
    page = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("ord"), F.min_by("p_type", "p_partkey").alias("lyrics"))
    page = page.select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_brand").alias("prfid"), "ord", F.col("ord").cast("string").alias("wrkid"),
        F.col("ord").cast("string").alias("url"), "lyrics",
    )
    kinds = songs.select(F.col("kind").alias("uri"), "p_name", "p_brand").distinct()
    works = kinds.select("uri", F.col("p_brand").alias("artist")).join(page, "artist").withColumn("tier", F.lit(0))
    found = kinds.select("uri", F.col("p_name").alias("title")).join(page, "title").withColumn("tier", F.lit(1))
    candidates = works.unionByName(found).withColumn("part_no", F.lit(0))
    known = p.where("p_size > 25").select(F.col("p_brand").alias("credited"), F.col("p_brand").alias("prfid")).distinct()
    mapping = spark.createDataFrame([("Brand#3", "מותג שלוש"), ("Brand#5", "Brand five, מותג חמש")], readers.MAPPING)
    manual = songs.where("p_partkey % 40 = 1").select(
        F.col("uri").alias("spotify_uri"), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise("url").alias("action"), F.lit("by hand").alias("shironet_url"),
    )
    got = M.resolve(songs, candidates, mapping, known, manual, uncached=songs.where("p_partkey % 50 = 7").select("uri"), alike="kind")
    return got.select("uri", "status", "n_parts", "title_score", "artist_score", "shironet_urls", "lyrics", "manual_url")


def audit_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Matched songs whose page's artist is unlike every credited name, not cleared by hand."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("uri"), F.col("p_name").alias("artist_names"),
        F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("matched_artist"),
    )
    return M.audit(
        p, spark.createDataFrame([("hot bolt", "cold bolt")], readers.MAPPING), ["1", "2"],
    ).select("uri", "artist_names", "matched_artist", "similarity")


def html_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.page_summary("html").alias("s")).select("page_id", "s.title", "s.n_links", "s.n_words")


def israeli_share_months(spark: SparkSession, d: str) -> DataFrame:
    """A set's share of the weekly streams, averaged by bucket, from a flag that a left join leaves."""
    ours = table(spark, d, "part").where("p_type LIKE '%SMALL%'").select(F.col("p_partkey").alias("uri"), F.lit(1).alias("hit"))
    w = charts(spark, d).join(ours, "uri", "left").groupBy("week_date").agg((F.sum(F.when(F.col("hit").isNotNull(), F.col("streams")).otherwise(0)) / F.sum("streams")).alias("share"))
    return rounded(S.bucket_means(S.to_long(w, ["share"]), HALF_YEARS))


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best line items of an order as a nested list."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey")
    t = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    best = F.array_sort(F.collect_list(F.struct("rn", "l_partkey")))
    return t.groupBy("l_orderkey").agg(F.array_join(F.transform(best, lambda s: s["l_partkey"].cast("string")), ",").alias("parts"))


def _hits(words: tuple[str, ...]) -> str:
    names = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(string_split_regex(text, '[^\\p{{L}}]+'), lambda x: x IN ({names})))::BIGINT"


SPLIT = "string_split_regex(text, '[ \\n]+')"

ORACLES = {
    "theme_hits": "SELECT doc_id, " + ", ".join(f"{_hits(w)} AS {k}_hits" for k, (w, _) in WORDS.items()) + " FROM documents",
    "theme_flags": "SELECT " + ", ".join(f"round(avg(({_hits(w)} >= {n})::INT), 6) AS {k}" for k, (w, n) in WORDS.items()) + " FROM documents",
    "weekly_theme_share": f"""WITH {CHARTS_SQL}, s AS (SELECT p_partkey AS uri, list_has_any(string_split(p_name, ' '), ['gear', 'bolt', 'gizmo'])::INT AS tool, list_has_any(string_split(p_name, ' '), ['red', 'blue', 'hot'])::INT AS look FROM part)
SELECT week_date, {R('sum(tool * streams)::DOUBLE / sum(streams) AS tool', 'sum(look * streams)::DOUBLE / sum(streams) AS look')} FROM charts JOIN s USING (uri) GROUP BY 1""",
    "script_share": r"WITH x AS (SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(1, len(regexp_extract_all(text, '\p{L}'))), 6) AS share FROM documents) SELECT doc_id, share, (share >= 0.95)::INT AS kept FROM x",
    "text_windows": f"WITH w AS (SELECT doc_id, len({SPLIT})::INT AS n_words FROM documents), c AS (SELECT *, (ceil(greatest(0, n_words - {WIN}) / {STEP}.0) + 1)::INT AS n_windows FROM w) SELECT doc_id, n_words, n_windows, least({WIN}, n_words - (n_windows - 1) * {STEP})::INT AS last_size FROM c",
    "window_weighted_mean": f"""WITH w AS (SELECT doc_id, {SPLIT} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(0, (ceil(greatest(0, len(w) - {WIN}) / {STEP}.0) * {STEP})::INT, {STEP})) AS a FROM w),
p AS (SELECT doc_id, list_slice(w, a + 1, a + {WIN}) AS win FROM s),
q AS (SELECT doc_id, len(win) AS n, len(list_filter(win, lambda x: length(x) > 5))::DOUBLE / len(win) AS p FROM p)
SELECT doc_id AS uri, count(*) AS n_windows, {R('sum(p * n) / sum(n) AS p')} FROM q GROUP BY 1""",
    "resolved_songs": """WITH pg AS (SELECT p_name, p_brand, min(p_partkey) AS ord, arg_min(p_type, p_partkey) AS lyrics FROM part GROUP BY 1, 2),
s AS (SELECT p.*, p_partkey % 40 = 1 AS manual, p_partkey % 50 = 7 AS miss, ord, lyrics FROM part p JOIN pg USING (p_name, p_brand))
SELECT p_partkey::VARCHAR AS uri, CASE WHEN manual AND p_partkey % 3 = 0 THEN 'manual_none' WHEN manual THEN 'manual_url' WHEN miss THEN 'not_cached' ELSE 'accepted' END AS status, 1::BIGINT AS n_parts,
  CASE WHEN NOT miss THEN 100.0::DOUBLE END AS title_score, CASE WHEN NOT miss THEN 100.0::DOUBLE END AS artist_score, CASE WHEN NOT miss THEN ord::VARCHAR END AS shironet_urls,
  CASE WHEN NOT manual AND NOT miss THEN lyrics END AS lyrics, CASE WHEN manual THEN 'by hand' END AS manual_url FROM s""",
    "split_artists": "SELECT c_custkey, 3 AS n, c_name || '|' || c_mktsegment AS names FROM customer",
    "url_params": r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages",
    "sha1_key": "SELECT page_id, sha1(url) AS key FROM pages",
    "page_cache": "WITH g AS (SELECT url, any_value(html) AS html FROM pages WHERE page_id % 3 <> 0 GROUP BY 1) SELECT page_id, sha1(p.url) AS key, CASE WHEN g.html IS NULL THEN 'not_cached' ELSE 'ok' END AS status, coalesce(length(g.html), 0)::INT AS html_chars FROM pages p LEFT JOIN g ON g.url = p.url",
    "medley_concat": "WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1) SELECT conv_id, length(text)::INT AS chars, md5(text) AS md5 FROM t",
    "decide_cases": """WITH p AS (SELECT p_partkey, p_size * 2.0::DOUBLE AS t, p_partkey % 101 AS a, p_partkey % 7 = 0 AS k FROM part)
SELECT p_partkey, CASE WHEN t >= 92 AND (a >= 85 OR k) THEN 'accept' WHEN t >= 92 OR (t >= 80 AND (a >= 85 OR k)) THEN 'review' ELSE 'reject' END AS decision, (0.8::DOUBLE * t + 0.2::DOUBLE * a > 70)::INT AS old_rule FROM p""",
    "learn_ids_having": "SELECT l_suppkey % 10 AS credited, l_suppkey AS prfid FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 12",
    "best_candidate": """WITH l AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS ord, l_quantity * 2 AS t, l_partkey % 101 AS a, l_partkey AS page FROM lineitem),
d AS (SELECT *, CASE WHEN t >= 92 AND a >= 85 THEN 'accept' WHEN t >= 92 OR (t >= 80 AND a >= 85) THEN 'review' ELSE 'reject' END AS decision FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE decision WHEN 'accept' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, t + a DESC, ord) AS rn FROM d)
SELECT l_orderkey, ord, page, decision FROM r WHERE rn = 1""",
    "first_accepting_tier": """WITH l AS (SELECT l_orderkey, l_linenumber AS tier, min(CASE WHEN l_quantity >= 40 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem)
SELECT l_orderkey, count(*) AS kept, max(tier) AS last_tier FROM l WHERE stop IS NULL OR tier <= stop GROUP BY 1""",
    "duplicate_pages": "SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1",
    "keep_first_dedup": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "last_wins_mapping": "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
    "union_queue": """WITH q AS (SELECT p_partkey AS uri, 'artist_differs' AS reason, round(p_retailprice * 100)::BIGINT AS streams FROM part WHERE p_size < 10
  UNION ALL SELECT p_partkey, 'not_found', round(p_retailprice * 100)::BIGINT FROM part WHERE p_size > 45)
SELECT uri, reason, streams, row_number() OVER (ORDER BY streams DESC, uri) AS place, round((sum(streams) OVER (ORDER BY streams DESC, uri))::DOUBLE / (sum(streams) OVER ())::DOUBLE, 3) AS cum_share FROM q""",
    "labels_joins": "SELECT coalesce(lang, '-') AS lang, CASE WHEN lang IS NULL THEN 'label_only' WHEN toxic IS NULL THEN 'document_only' ELSE 'both' END AS kind, count(*) AS n, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents FULL JOIN labels USING (doc_id) GROUP BY 1, 2",
    "manual_overrides": "SELECT CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'manual_none' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 1 THEN 'manual_url' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
    "formatted": "SELECT p_partkey, CASE WHEN p_partkey % 1000 < 1 THEN '< .001' ELSE '= .' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END AS p, ((p_partkey % 1000) // 10)::VARCHAR || '.' || ((p_partkey % 10))::VARCHAR || '%' AS pct FROM part",
    "title_parts": "SELECT p_partkey, p_name || '|' || p_type AS parts FROM part",
    "israeli_share_months": f"""WITH {CHARTS_SQL}, w AS (SELECT week_date, coalesce(sum(streams) FILTER (WHERE uri IN (SELECT p_partkey FROM part WHERE p_type LIKE '%SMALL%')), 0)::DOUBLE / sum(streams)::DOUBLE AS value FROM charts GROUP BY 1)
SELECT 'share' AS series, CASE {CASES_SQL} END AS period, {R('avg(value) AS mean')} FROM w GROUP BY 2 HAVING period IS NOT NULL""",
    "top_candidates": "WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS parts FROM r WHERE rn <= 3 GROUP BY 1",
}
ORACLES["batch_scores"] = ORACLES["window_weighted_mean"]
# the longest common subsequence, a row of its table for each letter of the left string
ORACLES["title_scores"] = """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part),
p AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON a.x < b.x WHERE list_has_any(string_split(a.x, ' '), string_split(b.x, ' '))),
forms AS (SELECT a, b, replace(a, ' ', '') AS l, replace(b, ' ', '') AS r FROM p
  UNION ALL SELECT a, b, list_aggregate(list_sort(string_split(a, ' ')), 'string_agg', ' '), list_aggregate(list_sort(string_split(b, ' ')), 'string_agg', ' ') FROM p),
dp AS (SELECT a, b, l, r, 0 AS i, list_transform(range(length(r) + 1), lambda k: 0) AS row FROM forms
  UNION ALL SELECT a, b, l, r, i + 1,
    list_transform(range(length(r) + 1), lambda k: list_max(list_transform(range(k + 1), lambda j: greatest(row[j + 1], CASE WHEN j > 0 AND substr(r, j, 1) = substr(l, i + 1, 1) THEN row[j] + 1 ELSE 0 END))))
  FROM dp WHERE i < length(l))
SELECT a, b, round(max(200.0::DOUBLE * row[length(r) + 1] / (length(l) + length(r))), 6) + 0.0 AS score FROM dp WHERE i = length(l) GROUP BY 1, 2"""
TRANSLATED = "translate(x, '׳’`״“”', chr(39) || chr(39) || chr(39) || '\"\"\"')"
ORACLES["title_normalise"] = (
    r"WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '[\x{0591}-\x{05C7}]', '', 'g'), '[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g') AS x FROM documents), b AS (SELECT doc_id, "
    + TRANSLATED
    + r" AS x FROM a), c AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}_\p{Z}\s'']', ' ', 'g'), '[\p{Z}\s]+', ' ', 'g'))) AS clean FROM b) SELECT doc_id, clean, replace(clean, ' ', '') AS squashed FROM c"
)

QUERIES = {f.__name__: f for f in (
    theme_hits, theme_flags, weekly_theme_share, script_share, text_windows, window_weighted_mean, batch_scores, split_artists, title_normalise, title_parts, url_params, sha1_key,
    page_cache, medley_concat, decide_cases, learn_ids_having, best_candidate, first_accepting_tier, duplicate_pages, keep_first_dedup, last_wins_mapping, union_queue,
    labels_joins, manual_overrides, formatted, fuzzy_scores, title_scores, resolved_songs, audit_suspects, html_parse, israeli_share_months, top_candidates,
)}
