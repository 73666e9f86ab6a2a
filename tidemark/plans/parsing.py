"""Queries over pages, links and texts: the parsers run on pages built from the tables, so SQL knows what they must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as X
from tidemark.operators import matching as M
from tidemark.operators import scoring

from .analogues import six_digits, table

SITE = "https://songs.example.org"
REAL = '<form id="headerSearchForm0"></form></HTML>'


def _ordered(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text a key of its rows' lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda s: s["x"]), "\n").alias("body"))


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Search pages, one a nation with its suppliers as songs: each twice, and with a play link that is no hit."""
    s = table(spark, d, "supplier")
    ids = F.concat(F.lit("prfid="), F.col("s_nationkey").cast("string"), F.lit("&wrkid="), F.col("s_suppkey").cast("string"))
    hit = F.concat(
        F.lit('<a class="search_link_name_big" href="/artist?type=lyrics&lang=1&'), ids, F.lit('"><span>Song</span>\n <b>'), "s_name", F.lit("</b></a>"),
    )
    play = F.concat(F.lit('<a class="search_link_name_big" href="/artist?type=lyrics&play=true&'), ids, F.lit('">play</a>'))
    artist = F.concat(
        F.lit('<a class="search_link_name_big" href="/artist?prfid='), F.col("s_nationkey").cast("string"), F.lit('">Nation '),
        F.col("s_nationkey").cast("string"), F.lit("</a>"),
    )
    row = F.concat(F.lit("<tr><td>"), play, hit, F.lit("<br>"), artist, F.lit("</td><td>"), hit, F.lit("</td></tr>"))
    pages = _ordered(s, "s_nationkey", "s_suppkey", row).select("s_nationkey", F.concat(F.lit("<html><table>"), "body", F.lit("</table></html>")).alias("html"))
    got = pages.select("s_nationkey", F.posexplode(H.parse_search("html", F.lit(SITE))).alias("pos", "hit"))
    return got.select("s_nationkey", "pos", "hit.title", "hit.artist", "hit.prfid", "hit.wrkid", "hit.url")


def works_pages(spark: SparkSession, d: str) -> DataFrame:
    """Artists' song lists, one a nation, with its name in a header, links without words, and each song twice."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    link = F.concat(
        F.lit('<a href="artist?type=lyrics&prfid='), F.col("s_nationkey").cast("string"), F.lit("&wrkid="), F.col("s_suppkey").cast("string"), F.lit('">'),
    )
    line = F.concat(link, F.lit(" </a>"), link, "s_name", F.lit("</a>"), link, F.lit("again</a>"))
    named = _ordered(s.withColumn("page", F.concat_ws("|", F.col("s_nationkey").cast("string"), "n_name")), "page", "s_suppkey", line)
    key, name = F.split("page", r"\|")[0], F.split("page", r"\|")[1]
    inside = F.when(
        key.cast("int") % 2 == 0, F.concat(F.lit('<h1 class="artist_singer_title">שירים שבוצעו ע"י '), name, F.lit("</h1>")),
    ).otherwise(F.concat(F.lit("<title>"), name, F.lit(" - שירונט</title>")))
    pages = named.select(key.alias("prfid"), F.concat(F.lit("<html>"), inside, "body", F.lit("</html>")).alias("html"))
    got = pages.select(F.posexplode(H.parse_works("html", "prfid", F.lit(SITE + "/x/y"))).alias("pos", "hit"))
    return got.select("pos", "hit.title", "hit.artist", "hit.prfid", "hit.wrkid", "hit.url")


def lyrics_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lyrics pages, one a conversation, with breaks for its lines; a page without lyrics gives nulls."""
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pages = _ordered(c, "conv_id", "turn", F.concat(safe, F.lit("<br><br/><br>")))
    body = F.replace(F.col("body"), F.lit("\n"), F.lit("<br>"))
    span = F.when(F.col("conv_id") % 5 == 0, F.lit("<p>none</p>")).otherwise(F.concat(F.lit('<div><span class="x artist_lyrics_text">'), body, F.lit("</span></div>")))
    html = F.concat(
        F.lit('<h1 class="artist_song_name_txt">Talk <i>'), F.col("conv_id").cast("string"), F.lit('</i></h1><a class="artist_singer_title">Two</a>'), span,
    )
    got = pages.select("conv_id", H.parse_lyrics(html).alias("p"))
    return got.select("conv_id", "p.found", "p.page_title", "p.page_artist", F.md5("p.lyrics").alias("md5"))


def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pages by whether they are real ones or a block, their words outside tags, and a test of their links."""
    page = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit(REAL))).otherwise(F.col("html"))
    p = table(spark, d, "pages").withColumn("page", page)
    linked = F.col("html").contains('href="/the') & ~F.col("html").contains("play=true")
    return p.select("page_id", X.is_real_page(F.col("page")).alias("is_real"), X.word_count(F.col("html")).alias("n_words"), linked.alias("linked"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Search and works urls, and references of five kinds resolved against a page's address."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 5
    ref = F.when(kind == 0, F.concat(F.lit("../up/./"), key)).when(kind == 1, F.concat(F.lit("?q="), key)).when(kind == 2, F.concat(F.lit("//cdn.example.org/"), key)).when(kind == 3, F.concat(F.lit("/top/../"), key)).otherwise(F.concat(F.lit("#"), key))
    query = F.concat("p_name", F.lit(" & א/"), "p_type")
    return p.select(
        "p_partkey", X.search_url(SITE, query).alias("search"), X.works_url(SITE, key).alias("works"), X.absolute(ref, SITE + "/a/b/c?d=e#f").alias("link"),
    )


def page_headers(spark: SparkSession, d: str) -> DataFrame:
    """Artists' names out of the headers of their pages."""
    n = table(spark, d, "nation")
    header = F.when(
        F.col("n_nationkey") % 3 == 0, F.concat(F.lit('שירים שבוצעו ע"י  '), "n_name"),
    ).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(" -  שירונט "))).otherwise(F.col("n_name"))
    return n.select("n_nationkey", X.without_header(header).alias("name"))


def song_names(spark: SparkSession, d: str) -> DataFrame:
    """Ids out of uris, titles with Hebrew letters, and credited names less those that are no performers."""
    p = table(spark, d, "part")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " שיר").otherwise(""))
    names = X.split_artists(F.concat("p_brand", F.lit(", Kids Choir,"), "p_type", F.lit(" ,הכוכב הבא")))
    return p.select(
        X.last_segment(F.concat(F.lit("spotify:track:"), F.col("p_partkey").cast("string"))).alias("id"), X.has_hebrew(title).alias("hebrew"),
        F.array_join(X.performers(names), "|").alias("performers"),
    )


def lyrics_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Lyrics without section labels, repeat marks, notes and long gaps."""
    p = table(spark, d, "part")
    raw = F.concat(F.lit("Chorus:\n"), "p_name", F.lit(" x2\n[spoken note]\n\n\n\nפזמון 2\n"), "p_type", F.lit("\nverse of mine (3x)\n OUTRO \nend\n\n"))
    return p.select("p_partkey", X.clean_lyrics(raw).alias("lyrics"))


def language_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether half of their letters are of the first half of the alphabet, in one reading of the texts."""
    both = scoring.gated(table(spark, d, "documents").select("doc_id", "text"), letters="[A-Ma-m]")
    return both.select("doc_id", F.when(F.col("scored"), "scored").otherwise("skipped").alias("result"), six_digits(F.col("share")).alias("share"))


def candidate_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of parts as songs in the order in which they are tried: lists of known ids, then searches."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string"))
    parts = p.select(
        F.col("p_partkey").alias("uri"), F.lit(0).alias("part_no"), F.col("p_name").alias("part"),
        F.array("p_brand", F.concat("p_brand", F.lit("ש"))).alias("variants"), F.array("p_brand").alias("credited"),
    )
    known = s.where("s_suppkey % 10 < 3").select(brand.alias("credited"), F.col("s_suppkey").cast("string").alias("prfid"))
    works = s.select(
        F.col("s_suppkey").cast("string").alias("prfid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), "s_name",
    ).select("prfid", "ord", F.concat("s_name", F.lit("/"), F.col("ord").cast("string")).alias("title"))
    names = p.select("p_name", "p_brand").distinct()
    searches = names.select(F.explode(F.array("p_name", F.concat("p_name", F.lit(" "), "p_brand", F.lit("ש")))).alias("query")).distinct()
    searches = searches.select("query", F.lit(0).alias("ord"), F.lit("p").alias("prfid"), F.upper("query").alias("title"))
    got = M.candidates_by_tier(parts, known, works, searches)
    return got.select("uri", "tier", "ord", "prfid", "title")


def seeded_run(spark: SparkSession, d: str) -> DataFrame:
    """Lyrics and artist ids that parts as an earlier run's matches leave under the artist gate."""
    p = table(spark, d, "part")
    title = F.when(F.col("p_partkey") % 3 == 0, "zzzz qqqq").otherwise(F.col("p_name"))
    artist = F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_brand"))
    url = F.concat(F.lit(SITE + "/artist?type=lyrics&prfid="), F.col("p_size").cast("string"), F.lit("&wrkid="), F.col("p_partkey").cast("string"))
    lyrics = F.when(F.col("p_partkey") % 7 > 0, F.col("p_type"))
    old = p.select(
        F.col("p_partkey").cast("string").alias("uri"), F.concat("p_name", F.lit(" (Live) - Remix")).alias("track_name"),
        F.col("p_brand").alias("artist_names"), title.alias("title"), artist.alias("artist"), url.alias("url"), lyrics.alias("lyrics"),
    )
    found, known = M.seeded(old, spark.createDataFrame([], "original_artist string, hebrew_artist string"))
    return found.select(
        F.lit("lyrics").alias("what"), F.col("url").alias("key"), F.col("lyrics").alias("value"),
    ).union(known.select(F.lit("known"), "credited", "prfid"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as matches that a person should look at, after decisions already made."""
    o = table(spark, d, "orders")
    matches = o.select(
        F.col("o_orderkey").cast("string").alias("uri"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("review").alias("found"),
        F.col("o_totalprice").alias("total_streams"),
    )
    made = o.where("o_orderkey % 5 = 0").select(
        F.col("o_orderkey").cast("string").alias("spotify_uri"),
        F.when(F.col("o_orderkey") % 3 == 0, "none").when(F.col("o_orderkey") % 3 == 1, "url").otherwise("ask").alias("action"),
        F.lit("u").alias("shironet_url"),
    )
    done = M.overridden(matches, made, F.col("found")).drop("found")
    return M.review_queue(done).select("uri", "status", "manual_url", "reviewer_action", "reviewer_url")


ORACLES = {
    "search_pages": f"""SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS pos, 'Song ' || s_name AS title, 'Nation ' || s_nationkey AS artist,
  s_nationkey::VARCHAR AS prfid, s_suppkey::VARCHAR AS wrkid, '{SITE}/artist?type=lyrics&lang=1&prfid=' || s_nationkey || '&wrkid=' || s_suppkey AS url FROM supplier""",
    "works_pages": f"""SELECT (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS pos, s_name AS title, n_name AS artist, s_nationkey::VARCHAR AS prfid, s_suppkey::VARCHAR AS wrkid,
  '{SITE}/x/artist?type=lyrics&prfid=' || s_nationkey || '&wrkid=' || s_suppkey AS url FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "lyrics_pages": r"""WITH b AS (SELECT conv_id, string_agg(text || repeat(chr(10), 3), chr(10) ORDER BY turn, text) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1),
s AS (SELECT conv_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\p{Z}\s]+|[\p{Z}\s]+$', '', 'g') AS t FROM b)
SELECT conv_id, conv_id % 5 <> 0 AS found, CASE WHEN conv_id % 5 <> 0 THEN 'Talk ' || conv_id END AS page_title, CASE WHEN conv_id % 5 <> 0 THEN 'Two' END AS page_artist, CASE WHEN conv_id % 5 <> 0 THEN md5(t) END AS md5 FROM s""",
    "page_checks": r"""SELECT page_id, page_id % 2 = 0 OR (contains(html, 'id="headerSearchForm0"') AND contains(lower(html), '</html>')) AS is_real,
  len(list_filter(string_split_regex(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\p{Z}\s]+'), lambda x: x <> ''))::INT AS n_words, contains(html, 'href="/the') AND NOT contains(html, 'play=true') AS linked FROM pages""",
    "page_links": f"""SELECT p_partkey, '{SITE}/search?q=' || replace(p_name, ' ', '%20') || '%20%26%20%D7%90/' || replace(p_type, ' ', '%20') AS search, '{SITE}/artist?type=works&lang=1&prfid=' || p_partkey AS works,
  CASE p_partkey % 5 WHEN 0 THEN '{SITE}/a/up/' || p_partkey WHEN 1 THEN '{SITE}/a/b/c?q=' || p_partkey WHEN 2 THEN 'https://cdn.example.org/' || p_partkey WHEN 3 THEN '{SITE}/' || p_partkey ELSE '{SITE}/a/b/c?d=e#' || p_partkey END AS link FROM part""",
    "page_headers": "SELECT n_nationkey, n_name AS name FROM nation",
    "song_names": "SELECT p_partkey::VARCHAR AS id, p_partkey % 3 = 0 AS hebrew, p_brand || '|' || p_type AS performers FROM part",
    "lyrics_cleaned": "SELECT p_partkey, p_name || chr(10) || chr(10) || p_type || chr(10) || 'verse of mine ' || chr(10) || chr(10) || 'end' AS lyrics FROM part",
    "language_gate": r"WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Ma-m]'))::DOUBLE / greatest(1, len(regexp_extract_all(text, '\p{L}'))) AS share FROM documents) SELECT doc_id, CASE WHEN share >= 0.5 THEN 'scored' ELSE 'skipped' END AS result, round(coalesce(share, 0), 6) AS share FROM x".replace('\\"', '"'),
    "candidate_tiers": """WITH known AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS credited, s_suppkey::VARCHAR AS prfid, s_name FROM supplier WHERE s_suppkey % 10 < 3),
w AS (SELECT p_partkey AS uri, 0 AS tier, prfid, s_name || '/' || o AS title, o FROM part JOIN known ON credited = p_brand, (VALUES (0), (1)) AS v(o))
SELECT uri, tier, row_number() OVER (PARTITION BY uri ORDER BY prfid, o) AS ord, prfid, title FROM w
UNION ALL SELECT p_partkey, 1, 0, 'p', upper(p_name) FROM part UNION ALL SELECT p_partkey, 2, 0, 'p', upper(p_name || ' ' || p_brand) || 'ש' FROM part""",
    "seeded_run": f"""WITH t AS (SELECT * FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 3 > 0 AND p_partkey % 4 > 0)
SELECT 'lyrics' AS what, '{SITE}/artist?type=lyrics&prfid=' || p_size || '&wrkid=' || p_partkey AS key, p_type AS value FROM t UNION ALL SELECT DISTINCT 'known', p_brand, p_size::VARCHAR FROM t""",
    "review_queue": """WITH x AS (SELECT o_orderkey::VARCHAR AS uri, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'manual_none' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 1 THEN 'manual_url'
  WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'review' END AS status, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 < 2 THEN 'u' END AS manual_url FROM orders)
SELECT uri, status, manual_url, '' AS reviewer_action, '' AS reviewer_url FROM x WHERE status NOT IN ('accepted', 'manual_none')""",
}

QUERIES = {f.__name__: f for f in (
    search_pages, works_pages, lyrics_pages, page_checks, page_links, page_headers, song_names, lyrics_cleaned, language_gate, candidate_tiers, seeded_run, review_queue,
)}
