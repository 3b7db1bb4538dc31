"""Main text of web pages: a template deduced from each host's pages, whose remaining slots are read."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, columns, stage

# Kinds of elements, and words that name what is no main text.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rb", "rt", "rp"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUT = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea", "title", "svg", "menu", "dialog", "object", "canvas", "noembed", "noframes"}
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "banner", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "skip", "hidden"}
#: Words that say where an element is, beside one of OUT_WORDS in the same name.
PLACES = {"area", "bar", "bottom", "box", "buttons", "container", "global", "icons", "inner", "left", "links", "list", "primary", "right", "secondary", "site", "top", "wrap", "wrapper"}
#: Those of them that hold whatever their share: a thread can be longer than what it is about.
THREADS = {"comment", "comments", "disqus", "replies", "respond"}
#: Elements whose class or id never makes them boilerplate.
NAMED_FREELY = {"html", "body", "main", "article"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}

#: Containers that can hold a page's main text; the last element of a path.
CONTAINER = r"(^|/)(article|main|section|div|body|td|center)([.#@][^/]*)?$"

#: Parts that a host's pages are dealt into.
SALTS = 64

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_PARTS = re.compile("[a-z]+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("open", name, attributes) and ("close", name, "") in page order; references are not decoded."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith("</", lt) or page[lt + 1 : lt + 2].isalpha():  # a tag that never ends, or an end tag without a name
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = name.lower()
        at = m.end()
        if close:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            stop = n if end is None else end.start()
            if stop > at:
                yield "text", page[at:stop], ""
            at = stop


def _marks(name: str) -> bool:
    """Does a whole class name or id say that an element is no main text: one of OUT_WORDS, or such words and places only."""
    parts = _PARTS.findall(name)
    return "".join(parts) in OUT_WORDS or any(x in OUT_WORDS for x in parts) and all(x in OUT_WORDS or x in PLACES or len(x) == 1 for x in parts)


def _label(name: str, attributes: str) -> tuple[str, bool, bool]:
    """What an element is called in a path, is it by its name, role or as a thread of comments no main text, and is it so by its class or id."""
    out = name in OUT
    named = False
    shown = name
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        words = set(_PARTS.findall(value))
        if m[1].lower() == "role":
            out |= bool(words & OUT_ROLES)
        else:
            marks = [x for x in value.split() if name not in NAMED_FREELY and _marks(x)]
            named |= bool(marks)
            out |= any(THREADS & set(_PARTS.findall(x)) for x in marks)
        shown += {"class": ".", "id": "#", "role": "@"}[m[1].lower()] + " ".join(sorted(words))
    return shown + "!" * named, out, named


class Block:
    """A run of text between block tags: where it stands, the paths around it that classes or ids mark, its pieces, and how many of its characters are in links."""

    __slots__ = ("inside", "links", "marked", "out", "path", "pieces")

    def __init__(self, path: str, out: bool, inside: frozenset, marked: frozenset):
        self.path, self.out, self.inside, self.marked, self.pieces, self.links = path, out, inside, marked, [], 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.pieces)).split())


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The page's blocks and the paths of its opened containers, in order. Elements that are left open end where they must."""
    stack: list[tuple[str, str, bool, frozenset, frozenset]] = [("", "", False, frozenset(), frozenset())]
    found: list[Block] = []
    opened: list[str] = []
    current: Block | None = None
    in_link = 0
    for kind, name, attributes in events(page):
        if kind == "text":
            if current is None:
                current = Block(*stack[-1][1:])
                found.append(current)
            current.pieces.append(name)
            current.links += len(name) if in_link else 0
            continue
        if name == "br":
            if current:
                current.pieces.append(" ")
            continue
        if name == "a":
            in_link = int(kind == "open")
        if kind == "close":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                del stack[depth:]
                current = None
            elif name not in INLINE:
                current = None
            continue
        label, out, named = _label(name, attributes)
        if name in INLINE and not out and not named:
            continue
        current = None
        if name in CLOSES_P and stack[-1][0] == "p":
            stack.pop()
        if name in SIBLINGS:
            same, scope = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in same:
                    del stack[k:]
                    break
        if name == "header" and stack[-1][3]:
            out = named = False  # of an article, not of the page
        _, path, above, inside, marked = stack[-1]
        path = f"{path}/{label}" if len(stack) < 200 else path
        opened.append(path)
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        stack.append((name, path, above or out or (name == "header" and not inside), inside | {name} if name in ("article", "main") else inside, marked | {path} if named else marked))
    return found, opened


def host_of(url: Column) -> Column:
    """The url's host in lower case, '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#\s]*@)?([^/?#\s@]*)", 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and container path of a batch's pages: pages, sums that stand for the occurrence vector, the text's least and greatest hash, the characters in it and below that can be main text, and for marked paths, and '' for all, those that could be it but for classes and ids."""
    schema = pa.schema([("host", pa.string()), ("token", pa.string()), *((x, pa.int64()) for x in ("pages", "sum_a", "sum_b", "low", "high", "chars", "named"))])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            held: dict[tuple[str, str], list[int]] = {}
            for key, host, page in zip(*columns(batch, "key", "host", "html"), strict=True):
                got, opened = blocks(page or "")
                n: dict[str, int] = {"": 1}
                for path in opened:
                    n[path] = n.get(path, 0) + 1
                text: dict[str, list[str]] = {}
                under: dict[str, int] = {}
                named: dict[str, int] = {}
                for b in got:
                    text.setdefault(b.path, []).append(shown_text := b.text())
                    for at in () if b.out else b.marked | {""}:
                        named[at] = named.get(at, 0) + len(shown_text)
                    at = b.path
                    while not b.out and not b.marked:
                        under[at] = under.get(at, 0) + len(shown_text)
                        if not at:
                            break
                        at = at.rpartition("/")[0]
                for path, times in n.items():
                    vector = xxhash.xxh3_64_intdigest(f"{key} {times}")
                    shown = xxhash.xxh3_64_intdigest("\n".join(x for x in text.get(path, ()) if x)) >> 1
                    old = held.setdefault((host, path), [0, 0, 0, shown, shown, 0, 0])
                    old[0] += 1
                    old[1] += vector >> 32
                    old[2] += vector & 0xFFFFFFFF
                    old[3], old[4] = min(old[3], shown), max(old[4], shown)
                    old[5] += under.get(path, 0)
                    old[6] += named.get(path, 0)
            for (host, path), values in held.items():
                yield host, path, *values

    return batches_of(rows(), schema)


def deduce_templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, content (the container that holds the slots of main text), constant (containers with the same own text on all pages),
    freed (elements that a class or id marks as no main text, but that hold more than half of the host's text).

    A token is a container's path, which tells its roles apart. Tokens with the same occurrence vector over a host's pages are
    an equivalence class; vectors are compared by sums of hashes of (page, times), which Spark adds up before and after the
    shuffle. A class is valid if it is on half of the host's pages or more and one of its tokens lies in a container that is a
    token of the template, or of the class; nested so, from the page itself down, the valid classes are the template. Its
    content is the outermost article or main element around the deepest container that has nine tenths of the text that can be
    main text; without such an element, the deepest container that has all of it. Only tokens on half of the pages are gathered
    by host, at most twice as many as a page has.
    """
    picked = pages.select(F.col(key).cast("string").alias("key"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    counted = picked.mapInArrow(_count, "host string, token string, pages bigint, sum_a bigint, sum_b bigint, low bigint, high bigint, chars bigint, named bigint")
    tokens = stage(counted.groupBy("host", "token").agg(*(F.sum(x).alias(x) for x in ("pages", "sum_a", "sum_b", "chars", "named")), F.min("low").alias("low"), F.max("high").alias("high")), "tokens")
    whole = tokens.where("token = ''").select("host", F.col("pages").alias("of"), F.col("chars").alias("all_chars"), F.col("named").alias("all_named"))
    freed = (F.col("token") != "") & (2 * F.col("named") > F.col("all_named"))
    common = tokens.join(whole, "host").where((2 * F.col("pages") >= F.col("of")) | freed)
    same = (F.col("low") == F.col("high")) & (F.col("of") > 2) & (F.col("pages") == F.col("of"))
    most = F.col("token").rlike(CONTAINER) & (10 * F.col("chars") >= 9 * F.col("all_chars")) & (2 * F.col("pages") >= F.col("of"))
    every = F.col("token").rlike(CONTAINER) & (F.col("chars") == F.col("all_chars")) & (2 * F.col("pages") >= F.col("of"))
    # an equivalence class is what shares host and vector; its tokens are in the template together
    classes = common.groupBy("host", "pages", "sum_a", "sum_b").agg(F.collect_list(F.struct("token", same.alias("same"), most.alias("most"), every.alias("every"), freed.alias("freed"), F.size(F.split("token", "/")).alias("depth"))).alias("class"))
    listed = classes.groupBy("host").agg(F.collect_list("class").alias("classes"))
    paths = F.transform(F.flatten("classes"), lambda t: t["token"])
    parent = lambda t: F.regexp_replace(t["token"], "/[^/]*$", "")
    valid = F.filter("classes", lambda c: F.exists(c, lambda t: (t["token"] == "") | F.array_contains(paths, parent(t))))
    template = listed.select("host", F.flatten(valid).alias("tokens"), F.flatten("classes").alias("every_token"))
    deepest = lambda which: F.array_max(F.transform(F.filter("tokens", lambda t: t[which]), lambda t: F.struct(t["depth"], t["token"])))["token"]
    article = F.regexp_extract(deepest("most"), r"^(.*?/(?:article|main)(?:[.#@][^/]*)?)(?:/.*)?$", 1)
    listed_where = lambda which: F.transform(F.filter("every_token" if which == "freed" else "tokens", lambda t: t[which]), lambda t: t["token"])
    # text under a freed path was counted for no container: such a host has none
    content = F.when(F.size(listed_where("freed")) > 0, F.lit(None)).when(article != "", article).otherwise(deepest("every"))
    return template.select("host", content.alias("content"), listed_where("same").alias("constant"), listed_where("freed").alias("freed"))


def main_text(page: str | None, content: str | None = None, constant: frozenset | set = frozenset(), freed: frozenset | set = frozenset()) -> str:
    """Texts of the template's slots in its content, in page order; of a page that departs from the template, what its own elements give."""
    found, _ = blocks(page or "")
    kept = [(b, t) for b in found if not b.out and b.marked <= freed and (t := b.text())]
    if content and (slots := [(b, t) for b, t in kept if b.path == content or b.path.startswith(content + "/")]):
        if "article" in slots[0][0].inside or "main" in slots[0][0].inside:
            return " ".join(t for _, t in slots)
        kept = slots
    for name in ("article", "main"):
        if any(name in b.inside for b, _ in kept):
            return " ".join(t for b, t in kept if name in b.inside)
    # what the template itself says on every page, and lists of links, are no content
    return " ".join(t for b, t in kept if b.path not in constant and b.links <= 0.5 * max(1, sum(map(len, b.pieces))))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every whole page by its host's template.

    One row per input row: `key`, `url`, text, n_chars (code points). Slots in menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments are left out by their elements and roles, and by whole
    class names and ids unless these are on html, body, main or article or, comments aside, hold more than half of the host's text; the rest is kept as far
    as it lies in the content of the host's template, and there, unless that is an article or main element, as far as its text is
    not the same on all pages and not mostly links. A page without the template's content gives what its own article (else main)
    elements, or all its slots, hold. References are decoded, white space in a block becomes one space, blocks are joined by one space. Null and empty
    pages have the empty text; a null or odd url belongs to the host ''. Repeated rows count as often as they occur.
    """
    kind = pages.schema[key].dataType.simpleString()
    # a host can have a third of all pages: they are dealt out by a salt, and its template, one row, goes with each
    picked = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    salted = picked.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)))
    held = deduce_templates(pages, key, url, html).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = salted.join(held, ["host", "salt"], "left").select("key", "url", "html", "content", "constant", "freed")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

            def rows(batch=batch) -> Iterator[tuple]:
                for k, u, page, content, constant, freed in zip(*columns(batch, "key", "url", "html", "content", "constant", "freed"), strict=True):
                    text = main_text(page, content, set(constant or ()), set(freed or ()))
                    yield k, u, text, len(text)

            yield from batches_of(rows(), schema)

    return joined.mapInArrow(extract, f"key {kind}, url string, text string, n_chars bigint").select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
