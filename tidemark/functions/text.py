"""Text functions as Spark expressions; only Unicode composition needs a pandas UDF."""

from __future__ import annotations

import unicodedata
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character ranges and signs.
HEBREW = "[\\u0590-\\u05FF]"
POINTS = "[\\u0591-\\u05C7]"
BIDI = "[\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
QUOTES, PLAIN = "׳’`״“”", "'''\"\"\""
# Endings that name another recording of the same words.
VERSIONS = (
    "live", "לייב", "אקוסטי", "גרסה.*", "גרסת.*", "רמיקס", "remix.*", "radio edit", "acoustic.*", "bonus.*", "מתוך.*", "sped up", "slowed.*", "ביצוע.*", "קאבר",
    "cover",
)
# Credited names that are shows or labels.
NON_PERFORMERS = ("הכוכב הבא", "כאן - תאגיד השידור הישראלי", "Participants of Festigal", "Kids Choir")
# What stands before an artist's name in a works page's header, and behind it in the page's title.
HEADER_FRONT, HEADER_BACK = r'^שירים שבוצעו ע"י\s*', r"\s*-\s*שירונט\s*$"
# Repeat marks in lyrics, and bracketed notes.
REPEATS, NOTES = r"\(?\s*[xX×]\s*\d+\s*\)?|\(?\s*\d+\s*[xX×]\s*\)?", r"\[[^\]]*\]"
# Labels of sections in lyrics.
SECTIONS = ("פזמון", "בית", "גשר", "מעבר", "chorus", "verse", "bridge", "intro", "outro")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """c in composed form. What is under U+0300 only is composed as it is and does not go through Python."""
    return F.coalesce(nfc(F.when(c.rlike(r"[\x{300}-\x{10FFFF}]"), c)), c)


def has_hebrew(c: Column) -> Column:
    return F.coalesce(c.rlike(HEBREW), F.lit(False))


def strip_bidi(c: Column) -> Column:
    return F.regexp_replace(c, BIDI, "")


def clean(c: Column, compose: bool = True) -> Column:
    """For comparison: composed, without points, direction marks and punctuation, single spaces, lower case."""
    c = composed(c) if compose else c
    c = F.translate(strip_bidi(F.regexp_replace(c, POINTS, "")), QUOTES, PLAIN)
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\p{Z}\s']", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " ")))


def squash(c: Column, compose: bool = True) -> Column:
    return F.replace(clean(c, compose), F.lit(" "), F.lit(""))


def base_title(c: Column) -> Column:
    """A title without version endings and brackets, however many; of two sides of a bar, the first with Hebrew letters, else
    the first.

    One pass is a fixpoint: a bracket goes from its first opening sign to the next closing one, so what is left has no
    opening sign before a closing one, and all endings in a row go together.
    """
    sides = F.transform(F.split(F.trim(strip_bidi(c)), r"\|"), lambda x: F.trim(x))
    hebrew = F.filter(sides, lambda x: x.rlike(HEBREW))
    t = F.coalesce(F.get(hebrew, F.lit(0)), F.get(sides, F.lit(0)))
    endings = r"(?i)(?:\s*[-–—]\s*(?:" + "|".join(VERSIONS) + r")\s*)+$"
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s*[(\[][^)\]]*[)\]]", "")), endings, ""))


def title_parts(c: Column) -> Column:
    """The titles of a medley, each without its ending; the whole title if it has no parts."""
    t = base_title(c)
    parts = F.filter(F.split(t, r"\s+&\s+|\s+/\s+|/"), lambda x: F.trim(x) != "")
    parts = F.transform(parts, lambda x: base_title(x))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


def split_artists(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def performers(names: Column) -> Column:
    return F.array_except(names, F.array(*[F.lit(x) for x in NON_PERFORMERS]))


def clean_lyrics(c: Column) -> Column:
    """Lyrics without section labels, repeat marks and bracketed notes; at most one blank line in a row."""
    c = F.regexp_replace(c, r"(?im)^\s*(?:" + "|".join(SECTIONS) + r")\s*\d*\s*:?\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, REPEATS, ""), NOTES, "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def letter_share(c: Column, letters: str = HEBREW) -> Column:
    """The share of a text's letters that are of a class; 0 without letters."""
    inside = letters[:-1] + r"&&\p{L}]"
    count = lambda kind: F.length(c) - F.length(F.regexp_replace(c, kind + "+", ""))  # noqa: E731  whole runs go at once
    return count(inside) / F.greatest(F.lit(1), count(r"\p{L}"))


def search_url(base: str, q: Column) -> Column:
    encoded = F.replace(F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(base + "/search?q="), encoded)


def works_url(base: str, artist_id: Column) -> Column:
    return F.concat(F.lit(base + "/artist?type=works&lang=1&prfid="), artist_id)


def query_value(url: Column, name: str) -> Column:
    """The first value of a url's query parameter; null without one or for what is no url."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def _dotless(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    empty = F.array().cast("array<string>")
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//+$", "/")


def absolute(url: Column, base: str) -> Column:
    """A url reference resolved against an absolute http base, as RFC 3986 has it; an empty one is the base."""
    parts = urlsplit(base)
    origin, path = f"{parts.scheme}://{parts.netloc}", parts.path or "/"
    folder = path[: path.rfind("/") + 1]
    whole = origin + parts.path + (f"?{parts.query}" if parts.query else "")
    head, tail = F.regexp_extract(url, r"(?s)^([^?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(url == "", base)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.lit(parts.scheme + ":"), url))
        .when(url.startswith("?"), F.concat(F.lit(origin + parts.path), url))
        .when(url.startswith("#"), F.concat(F.lit(whole), url))
        .when(url.startswith("/"), F.concat(F.lit(origin), _dotless(head), tail))
        .otherwise(F.concat(F.lit(origin), _dotless(F.concat(F.lit(folder), head)), tail))
    )


def without_header(c: Column) -> Column:
    """A works page's artist: without the words before the name and the site's name behind it."""
    return F.regexp_replace(c, f"{HEADER_FRONT}|{HEADER_BACK}", "")


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, ":"), -1)


def is_real_page(html: Column) -> Column:
    return F.coalesce(html.contains('id="headerSearchForm0"') & F.lower(html).contains("</html>"), F.lit(False))


def word_count(html: Column) -> Column:
    """Words of a page outside its tags."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[\p{Z}\s]+", " "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def windows(ids: Column, size: int = 510, stride: int = 255) -> Column:
    """Overlapping runs of at most `size` tokens every `stride`; the last may be shorter, and none is left out."""
    last = F.ceil(F.greatest(F.lit(0), F.size(ids) - size) / stride).cast("int") * stride
    return F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.slice(ids, s + 1, F.lit(size)))


def in_windows(ids: Column, size: int = 510, stride: int = 255) -> Column:
    """For each token, in how many of `windows` it lies, without making them."""
    n = F.size(ids)
    last = F.ceil(F.greatest(F.lit(0), n - size) / stride)
    low = lambda i: F.greatest(F.lit(0), F.ceil((i - (size - 1)) / stride))
    return F.transform(ids, lambda x, i: (F.least(last, F.floor(i / stride)) - low(i) + 1).cast("long"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def apa_p(p: Column) -> Column:
    """A p value in APA style: no leading zero, and < .001 below that."""
    return F.when(p < 0.001, "< .001").otherwise(F.concat(F.lit("= "), F.regexp_replace(F.format_number(p, 3), r"^0(?=\.)", "")))


def signed(c: Column, digits: int = 2) -> Column:
    """Without a leading zero and with a true minus sign."""
    return F.replace(F.regexp_replace(F.format_number(c, digits), r"^(-?)0(?=\.)", "$1"), F.lit("-"), F.lit("\u2212"))
