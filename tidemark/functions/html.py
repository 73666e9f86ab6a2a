"""HTML pages to rows with the standard library's parser, in pandas UDFs over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import HEADER_BACK, HEADER_FRONT

# The pages' format. Classes of a search hit, a song's title and lyrics and an artist's name, and the parts of a song's link.
HIT_CLASS, SONG_CLASS, LYRICS_CLASS = "search_link_name_big", "artist_song_name_txt", "artist_lyrics_text"
NAME_CLASSES = ("artist_singer_title", "artist_name_txt")
SONG_LINK, NOT_LINK, ARTIST_KEY, SONG_KEY = ("type=lyrics", "wrkid="), "play=true", "prfid", "wrkid"
_FRONT, _BOTH = re.compile(HEADER_FRONT), re.compile(f"{HEADER_FRONT}|{HEADER_BACK}")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_record = lambda **kinds: T.StructType([T.StructField(k, t) for k, t in kinds.items()])
HIT = _record(**dict.fromkeys(("title", "artist", "prfid", "wrkid", "url"), T.StringType()))


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self):
        for x in self.items:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def strings(self):
        for x in self.items:
            if isinstance(x, str):
                yield x
            elif x.tag == "br":
                yield "\n"
            else:
                yield from x.strings()

    def words(self) -> str:
        """The stripped strings below, joined by spaces."""
        return " ".join(filter(None, (s.strip() for s in self.strings())))

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        at = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        self.at.items.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _ids(href: str) -> dict[str, str]:
    return {k: v[0] for k, v in parse_qs(urlparse(href).query).items()}


def _song_link(node: Node) -> bool:
    href = node.attrs.get("href", "")
    return node.tag == "a" and all(x in href for x in SONG_LINK) and NOT_LINK not in href


def _names_artist(node: Node) -> bool:
    href = node.attrs.get("href", "")
    return node.tag == "a" and node.has_class(HIT_CLASS) and f"{ARTIST_KEY}=" in href and SONG_KEY not in href


def search_hits(html: str, base: str = "") -> list[dict]:
    """The songs of a search page in order, once for each artist and work; their links are resolved against `base`."""
    found: dict[tuple, dict] = {}
    for a in tree(html).walk():
        if not (_song_link(a) and a.has_class(HIT_CLASS)):
            continue
        ids, cell = _ids(a.attrs["href"]), a.parent
        while cell is not None and cell.tag != "td":
            cell = cell.parent
        artist = next((x.words() for x in cell.walk() if _names_artist(x)), "") if cell else ""
        key = ids.get(ARTIST_KEY), ids.get(SONG_KEY)
        row = {"title": re.sub(r"\s+", " ", a.words()), "artist": artist, "prfid": key[0], "wrkid": key[1], "url": urljoin(base, a.attrs["href"])}
        found.setdefault(key, row)
    return list(found.values())


def artist_works(html: str, prfid: str, base: str = "") -> list[dict]:
    """The songs of an artist's page in order, once for each work; links without words do not count."""
    page = list(tree(html).walk())
    name = next((x.words() for cls in NAME_CLASSES for x in page if x.has_class(cls)), "")
    name = _FRONT.sub("", name) or next((_BOTH.sub("", "".join(x.strip() for x in n.strings())) for n in page if n.tag == "title"), "")
    found: dict[str | None, dict] = {}
    for a in page:
        if _song_link(a) and f"{ARTIST_KEY}={prfid}" in a.attrs["href"] and (title := a.words()):
            work = _ids(a.attrs["href"]).get(SONG_KEY)
            found.setdefault(work, {"title": title, "artist": name, "prfid": prfid, "wrkid": work, "url": urljoin(base, a.attrs["href"])})
    return list(found.values())


def lyrics_page(html: str) -> dict | None:
    """A song's lyrics, title and artist; None without lyrics."""
    page = list(tree(html).walk())
    body = next((x for x in page if x.tag == "span" and x.has_class(LYRICS_CLASS)), None)
    if body is None:
        return None
    first = lambda cls: next((x.words() for x in page if x.has_class(cls)), "")
    return {"lyrics": re.sub(r"\n{3,}", "\n\n", "".join(body.strings())).strip(), "page_title": first(SONG_CLASS), "page_artist": first(NAME_CLASSES[0])}


@F.pandas_udf(T.ArrayType(HIT))
def parse_search(html: pd.Series, base: pd.Series) -> pd.Series:
    """search_hits of pages, links resolved against the column base; a null page has no hits."""
    return pd.Series([search_hits(h or "", b or "") for h, b in zip(html, base)])


@F.pandas_udf(T.ArrayType(HIT))
def parse_works(html: pd.Series, prfid: pd.Series, base: pd.Series) -> pd.Series:
    """artist_works of pages, links resolved against the column base; a null page has none."""
    return pd.Series([artist_works(h or "", p or "", b or "") for h, p, b in zip(html, prfid, base)])


@F.pandas_udf(_record(found=T.BooleanType(), lyrics=T.StringType(), page_title=T.StringType(), page_artist=T.StringType()))
def parse_lyrics(html: pd.Series) -> pd.DataFrame:
    rows = [lyrics_page(h or "") for h in html]
    return pd.DataFrame(
        [{"found": r is not None} | (r or {"lyrics": None, "page_title": None, "page_artist": None}) for r in rows],
        columns=["found", "lyrics", "page_title", "page_artist"],
    )


@F.pandas_udf(_record(title=T.StringType(), n_links=T.IntegerType(), n_words=T.IntegerType()))
def page_summary(html: pd.Series) -> pd.DataFrame:
    """A page's title, links and visible words."""
    rows = []
    for h in html:
        nodes = list((root := tree(h or "")).walk())
        hidden = {id(x) for n in nodes if n.tag in ("script", "style", "title") for x in [n, *n.walk()]}
        words = sum(len(s.split()) for n in [root, *nodes] if id(n) not in hidden for s in n.items if isinstance(s, str))
        rows.append((next((n.words() for n in nodes if n.tag == "title"), ""), sum(n.tag == "a" and "href" in n.attrs for n in nodes), words))
    return pd.DataFrame(rows, columns=["title", "n_links", "n_words"])
