"""HTML: the text of pages as one expression over their tokens, and structured download metadata by an Arrow UDF over the
standard library's parser."""

from __future__ import annotations

import re
from html import entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that stand on lines of their own, and tags without an end.
BLOCKS = frozenset(("p", "br", "div", "li", "blockquote", "h1", "h2", "h3"))
# Fixed values of HTML: tags whose start or end also ends an open paragraph.
ENDING = ("address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "pre", "search", "section", "summary", "table", "ul")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def after(self) -> list[Node]:
        own = self.parent.elements() if self.parent else []
        return own[own.index(self) + 1 :]

    def has(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


#: A start tag that ends an open one of these.
IMPLIED = {"p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "li": {"li"}}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag in IMPLIED.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def clean(text: str) -> str:
    return " ".join(text.split())


# Labels of the statistics line, and of the tag groups in their order.
STATS = ("Published", "Completed", "Words", "Chapters")
GROUPS = {"rating": "rating", "warnings": "archive warning", "category": "category", "fandoms": "fandom", "relationships": "relationship", "characters": "characters", "additional": "additional tags"}


def work_id(url: str | None) -> str | None:
    """Digits after the first /works/."""
    tail = (url or "").partition("/works/")[2]
    digits = re.match("[0-9]+", tail)
    return digits[0] if digits else None


def relation_kind(label: str) -> str | None:
    low = label.lower()
    for start, kind in (("a translation of", "translation_of"), ("translation of", "translation_of"), ("translation into", "translation_into"), ("remix of", "remix_of"), ("inspired by", "inspired_by")):
        if low.startswith(start):
            return kind
    return None


def first_text(nodes: list[Node]) -> str | None:
    """Text of the first node, if it has any."""
    return (clean(nodes[0].text()) or None) if nodes else None


def within(node: Node, tag: str, name: str) -> bool:
    """Whether node lies in an element of the tag and class."""
    while node.parent:
        node = node.parent
        if node.tag == tag and node.has(name):
            return True
    return False


def work_link(nodes: list[Node]) -> str | None:
    """The first link to a work in a message paragraph."""
    links = (a.attrs.get("href") for n in nodes if n.tag == "p" and n.has("message") for a in n.walk() if a.tag == "a")
    return next((x for x in links if work_id(x)), None)


def related_item(item: Node) -> dict | None:
    """A line of the list of related works: its kind, the first link to a work, the first author and language in it."""
    kind = relation_kind(clean(item.text()))
    if not kind:
        return None
    inside = list(item.walk())
    links = [a for a in inside if a.tag == "a" and a.attrs.get("href")]
    work = next((a for a in links if work_id(a.attrs["href"])), None)
    author = next((a for a in links if not work_id(a.attrs["href"]) and a.attrs.get("rel") == "author"), None)
    span = next((n for n in inside if n.tag == "span" and n.attrs.get("lang")), None)
    return {
        "kind": kind, "work_id": work_id(work.attrs["href"]) if work else None, "url": work.attrs["href"] if work else None, "title": clean(work.text()) if work else None,
        "author": clean(author.text()) if author else None, "language": span.attrs["lang"] if span else None, "language_label": clean(span.text()) if span else None,
    }


def summary_of(nodes: list[Node]) -> str | None:
    """The quotation after the paragraph "Summary"; another paragraph before it means that there is none."""
    for n in nodes:
        if n.tag == "p" and clean(n.text()).lower() == "summary":
            follower = next((a for a in n.after() if a.tag in ("blockquote", "p")), None)
            if follower and follower.tag == "blockquote":
                return clean(follower.text()) or None
            return None
    return None


def parse_download(html: str) -> dict | None:
    """Metadata of a downloaded work page, or None unless its message links to a work and it has a title."""
    tree = _Tree()
    tree.feed(html)
    nodes = list(tree.root.walk())
    url = work_link(nodes)
    if not url:
        return None
    heads, authors = [n for n in nodes if n.tag == "h1"], [n for n in nodes if n.tag == "a" and n.attrs.get("rel") == "author"]
    title = first_text([n for n in heads if within(n, "div", "meta")]) or first_text(heads)
    if not title:
        return None
    author = first_text([n for n in authors if within(n, "div", "byline")]) or first_text(authors)
    labels: dict[str, list[str]] = {}
    related: list[dict] = []
    box = next((n for n in nodes if n.tag == "dl" and n.has("tags")), None)
    if box:
        label = None
        for n in box.elements():
            if n.tag == "dt":
                label = clean(n.text()).rstrip(":").lower()
            elif n.tag == "dd" and label:
                links = [clean(a.text()) for a in n.walk() if a.tag == "a"]
                labels.setdefault(label, []).extend(links or [clean(n.text())])
            else:
                label = None
        listed = next((n for n in box.after() if n.tag in ("ul", "ol") or n.attrs.get("id") == "chapters"), None)
        if listed and listed.tag in ("ul", "ol"):
            related = [r for n in listed.walk() if n.tag == "li" and (r := related_item(n))]
    get = lambda name: [v for v in labels.get(name, []) if v]
    prose = (get("stats") or [""])[0]
    stat = {}
    for name in STATS:
        m = re.search(rf"{name}:(.*?)(?={'|'.join(s + ':' for s in STATS)}|$)", prose, re.S)
        stat[name] = m[1].strip() if m and m[1].strip() else None
    digits = re.sub("[^0-9]", "", stat["Words"] or "")
    groups = {field: get(label) for field, label in GROUPS.items()}
    return {
        "work_id": work_id(url), "url": url, "title": title, "author": author, "summary": summary_of(nodes), "language_label": (get("language") or [None])[0], "tags": [t for values in groups.values() for t in values], **groups, "collections": get("collections"),
        "published": stat["Published"], "completed": stat["Completed"], "words": int(digits) if digits else None, "chapters": stat["Chapters"], "related": related,
    }


LISTS = (*GROUPS, "collections")
PARSED = f"work_id string, url string, title string, author string, summary string, language_label string, tags array<string>, {', '.join(f'{g} array<string>' for g in LISTS)}, published string, completed string, words bigint, chapters string, related array<struct<kind:string,work_id:string,url:string,title:string,author:string,language:string,language_label:string>>"
EMPTY = dict.fromkeys(("work_id", "url", "title", "author", "summary", "language_label", "tags", *LISTS, "published", "completed", "words", "chapters", "related"))


#: One token of a page: a comment, a script or style with what is in it, a declaration, a tag, text, or a sign left over.
TOKEN = r"""(?is)<!--.*?(?:-->|$)|<(script|style)(?=[\s>/])[^>]*+>.*?</\1(?=[\s>/])[^>]*+>|<[!?][^>]*+>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>|[^<]++|<"""
#: Marks of a paragraph's start and end, of another block's edge, and of an edge that only ends a paragraph.
START, END, EDGE, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
RAW = r"(?is)<(?:script|style)(?=[\s>/])[^>]*+>(.*?)</(?:script|style)(?=[\s>/])[^>]*+>"
#: White space at the ends of a line, as Unicode has it.
ENDS = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
#: Names that count without a semicolon, longest first.
BARE = sorted((n for n in entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers from 128 to 159 stand for: the signs of the Western code page.
WESTERN = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _number(code: Column) -> Column:
    """The character of a code point given as a number; a replacement sign where there is none."""
    sound = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), _table(WESTERN)[code.cast("int")]).when(sound, own).otherwise("\ufffd")


def unescaped(text: Column) -> Column:
    """text with its character references resolved: numbers, names with a semicolon, and the old ones without."""
    named, bare = _table({n[:-1]: c for n, c in entities.html5.items() if n.endswith(";")}), _table({n: entities.html5[n] for n in BARE})

    def resolved(piece: Column) -> Column:
        number = lambda pattern, base: F.conv(F.regexp_extract(piece, pattern, 1), base, 10).cast("decimal(20,0)").cast("long")
        rest = lambda pattern: F.regexp_replace(piece, pattern, "")
        hexed, decimal, name, old = "^&#[xX]([0-9a-fA-F]{1,12})[0-9a-fA-F]*;?", "^&#([0-9]{1,15})[0-9]*;?", "^&([A-Za-z][A-Za-z0-9]*);", f"^&({'|'.join(BARE)})"
        known = named[F.regexp_extract(piece, name, 1)]
        return (
            F.when(~F.startswith(piece, F.lit("&")), piece)
            .when(F.rlike(piece, F.lit(hexed)), F.concat(_number(number(hexed, 16)), rest(hexed)))
            .when(F.rlike(piece, F.lit(decimal)), F.concat(_number(number(decimal, 10)), rest(decimal)))
            .when(known.isNotNull(), F.concat(known, rest(name)))
            .when(F.rlike(piece, F.lit(old)), F.concat(bare[F.regexp_extract(piece, old, 1)], rest(old)))
            .otherwise(piece)
        )

    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(F.split(text, "(?=&)"), resolved), ""))


def html_text(html: Column) -> Column:
    """Text of a page: a line break at the start and at the end of each block element, lines trimmed, one blank line in a
    row at most. A paragraph that is not ended ends where the next block starts or ends. Scripts and styles count as text,
    comments and declarations do not. A tag that does not end is text."""
    tag = lambda names: F.lit(rf"(?is)^(?:{names})(?:[\s/>].*)?$")

    def shown(token: Column) -> Column:
        return (
            F.when(~F.startswith(token, F.lit("<")) | (token == "<"), unescaped(token))
            .when(F.startswith(token, F.lit("<!")) | F.startswith(token, F.lit("<?")), "")
            .when(F.rlike(token, F.lit(RAW)), F.regexp_extract(token, RAW, 1))
            .when(F.rlike(token, tag("<p")), START)
            .when(F.rlike(token, tag("</p")), END)
            .when(F.rlike(token, tag("</?br")), "\n\n")
            .when(F.rlike(token, tag(f"</?(?:{'|'.join(sorted(BLOCKS - {'p', 'br'}))})")), EDGE)
            .when(F.rlike(token, tag(f"</?(?:{'|'.join(ENDING)})")), CLOSE)
            .otherwise("")
        )

    marked = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), shown), "")
    # an end without a start is a paragraph of its own
    ended = F.regexp_replace(F.regexp_replace(marked, f"{START}([^{START}-{CLOSE}]*+){END}?", "\n$1\n"), END, "\n\n")
    whole = F.translate(ended, f"{EDGE}{CLOSE}", "\n")
    lines = F.array_join(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, f"^{ENDS}|{ENDS}$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def _parse(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(parse_download(p) if p else None) or EMPTY for p in pages], columns=list(EMPTY))


#: Without one of these no attribute can hold a link to a work, not even by character references.
MAY_LINK = "/works/|&#|&sol"


def parse(html: Column) -> Column:
    """The parsed work; null unless its id is there. Pages that can't link to a work stay in the JVM."""
    got = F.pandas_udf(_parse, PARSED)(F.when(F.rlike(html, F.lit(MAY_LINK)), html))
    return F.when(got["work_id"].isNotNull(), got)


def translation_role(related: Column) -> Column:
    has = lambda kind: F.exists(related, lambda r: r["kind"] == kind)
    return F.when(has("translation_of"), "translation").when(has("translation_into"), "original")
