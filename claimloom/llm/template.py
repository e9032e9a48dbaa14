"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its block tags and its text, each told apart by the path of elements around it: a block of up to
``SHORT`` words gives its words (template and slot share such lines), a longer one is one token. Tokens of one host
that occur equally often on every one of its pages share an occurrence vector and form an equivalence class. A class
needs ``LEAST_TOKENS`` tokens, ``LEAST_PAGES`` pages and the share ``LEAST_SHARE`` of the host's pages, so each layout of
a host has classes of its own; text needs ``TEXT_SHARE``, as articles quote each other. A class is valid if its tokens stand in one order on every page, and if its instances
and those of every other class are nested: each lies in one gap of the other. The valid classes, nested, are the
host's template; what stands in its slots is what remains of a page.

The slots decide the text. Every block belongs to a container (its nearest article, main, division, cell or body); the
words that all pages of the host have in a container's slots, without links, are its mass. A page's text is what its
heaviest container holds in slots. Slots of a class that stands several times on a page are records (reader comments,
teasers) and left out, unless they hold most of the heaviest container. Elements that HTML itself or their label name
as menus, footers, adverts, forms or comments are left out everywhere: no vector can tell an advert that changes from
an article. Pages of a host without a template, and pages whose slots are empty (copies of one page), are read by
their elements alone.

Vectors are sums of hashes of (page, count), keyed by what the page holds, so a host of any size is added up in every
task, and repeated rows and null ids count. Pages never move while the templates are below ``BROADCAST`` bytes, which is
measured; beyond that they meet in a join salted by the number of the host's pages.

Defined results: a null or empty page has no text; a null url is a host of its own; repeated pages count and are
returned as often as they stand; broken or cut markup is read as far as it goes; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, small

#: A class needs so many tokens, and to stand on so many pages and on this share of the host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE, TEXT_SHARE = 3, 6, 0.1, 0.3
#: Words of a block that are tokens each; share of a block's words that are template from which on it is no slot's.
SHORT, TEMPLATE_SHARE = 8, 0.6
#: Tokens that a task gathers before it hands them on; bytes of templates that are broadcast; pages of a salted part.
HELD, BROADCAST, SALTED = 150_000, 64 << 20, 5_000

#: Names of HTML elements, and words in class or id that name what is no article.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noframes")
#: Left out with what they hold, where their end tag is the next tag of that name.
INSTEAD = ("noscript", "template", "object", "svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button select menu dialog head search fieldset audio video canvas".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROPPED_WORDS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot masthead topbar comment comments comentarios kommentare commentaires reply replies respond disqus notice cookie cookies consent gdpr popup modal newsletter subscribe subscription form".split())
ARTICLE_WORDS = frozenset("article articlebody post postbody entry story storybody content maincontent main text body".split())
#: First words of labels that tell of the layout around, and words that say nothing.
LAYOUT, SET_ASIDE = frozenset("has with no without is js".split()), frozenset("wrapper container inner outer box block".split())
CONTAINERS = frozenset("article main div td th body".split())
_BARRIERS = frozenset("ul ol table div section article body".split())
#: What a start tag closes, by the element that is open.
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option", "optgroup"})}

CLOSES = {name: tuple(sorted(o for o, by in CLOSED_BY.items() if name in by)) for name in sorted(BLOCK)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_NEXT_OF = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in INSTEAD}
_WORDS, _LABELS = re.compile(r"[a-z]+"), re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """A run of text between block elements: words, path, and what it lies in."""

    __slots__ = ("article", "at", "container", "dropped", "linked", "path", "rank", "words")

    def __init__(self, words: list[str], path: int, dropped: bool, article: int, linked: int, container: int, rank: int, at: int):
        self.words, self.path, self.dropped, self.article, self.linked, self.container, self.rank, self.at = words, path, dropped, article, linked, container, rank, at

    def tokens(self) -> list[int]:
        """The block's tokens: its words where it is short, else all of it."""
        return [_token(self.path, x) | 1 for x in (self.words if len(self.words) <= SHORT else [" ".join(self.words)])]


def _token(path: int, text: str) -> int:
    """A path's or token's number, as a signed 64-bit hash; tokens of text are odd, those of tags even."""
    return xxhash.xxh64_intdigest(f"{path}\x1f{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


class _Tag:
    """What a start or end tag means, worked out once for each spelling."""

    __slots__ = ("aside", "block", "closing", "header", "heading", "marks", "name", "named", "next_of", "proper", "raw", "void")

    def __init__(self, closing: str, name: str, rest: str):
        self.name = name = name.lower()
        self.closing, self.block, self.void, self.raw = bool(closing), name in BLOCK, name in VOID, name in RAW
        self.next_of = None if closing else _NEXT_OF.get(name)
        self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest and not closing else {}
        labels = [set(_WORDS.findall(x)) - SET_ASIDE if (x := _CAMEL.sub("-", y).lower()).partition("-")[0] not in LAYOUT else set() for y in f"{own.get('class', '')} {own.get('id', '')}".split()]
        names = set().union(*labels)
        role = own.get("role", "").lower()
        plain = any(x and x <= ARTICLE_WORDS for x in labels)
        self.aside = (
            name in DROPPED or role in DROPPED_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
            or (name not in ("html", "body", "article", "main", "h1", "h2", "h3", "p") and bool(names & DROPPED_WORDS) and not plain)
            or (name == "article" and bool(names & {"comment", "comments", "reply", "teaser", "related", "promo", "ad", "sponsored"}))
        )
        self.header = name == "header" or (name in ("div", "section") and bool(names & {"header", "head"}))
        self.proper = name == "article" or own.get("itemprop", "").lower() == "articlebody"
        self.named = name == "main" or role == "main" or (name in ("div", "section", "td") and bool(names & ARTICLE_WORDS))
        # numbers of posts and the like differ from page to page, so a label of digits alone tells nothing
        marks = {x for x in _LABELS.findall(own.get("class", "").lower()) if not x.isdigit()} | set(_WORDS.findall(own.get("id", "").lower()))
        self.marks = f"{name}.{'.'.join(sorted(marks))}" if marks else name


_known_tags: dict[str, _Tag] = {}


def _tag(m: re.Match) -> _Tag:
    found = _known_tags.get(m[0])
    if found is None:
        if len(_known_tags) > 20_000:
            _known_tags.clear()
        found = _known_tags[m[0]] = _Tag(m[1], m[2], m[3])
    return found


_known_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, marks: str) -> int:
    """The number of the path of ``marks`` below ``parent``: no path is cut, however deep."""
    found = _known_paths.get((parent, marks))
    if found is None:
        if len(_known_paths) > 100_000:
            _known_paths.clear()
        found = _known_paths[parent, marks] = _token(parent, marks)
    return found


_NO_RANK = 1 << 30


def blocks(page: str, ranks: dict[int, int] | None = None) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a page in order, and (place, path) of its block elements, in one count of places.

    ``article`` is 0 outside, else the number of the innermost element that may hold the article: odd for article
    elements proper, even for main elements and those named so. ``ranks`` of containers give a block the best one of
    those it lies in.
    """
    ranks = ranks or {}
    out: list[Block] = []
    tags: list[tuple[int, int]] = []
    # open elements: name, path, dropped, article, inside a header, container, rank
    stack: list[tuple[str, int, bool, int, bool, int, int]] = [("", 0, False, 0, False, 0, _NO_RANK)]
    open_at: dict[str, list[int]] = {}  # places of open elements in the stack, by name
    held: list[str] = []
    aside: list[str] = []  # what stands in elements within the block that are left out
    endless: set[str] = set()  # elements of which no further tag comes
    linked = links = proper = named = at = place = 0
    heading = False

    def put(words: list[str], dropped: bool, links_in: int) -> None:
        nonlocal place
        _, path, _, article, _, container, rank = stack[-1]
        out.append(Block(words, path, dropped, article, links_in, container, rank, place))
        place += len(words) if len(words) <= SHORT else 1

    def flush() -> None:
        nonlocal linked
        for texts, dropped in ((held, False), (aside, True)):
            text = "".join(texts)
            texts.clear()
            if words := (entities.unescape(text) if "&" in text else text).split():
                put(words, dropped or (stack[-1][4] and not heading), 0 if dropped else linked)
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for name, *_ in stack[depth:]:
            open_at[name].pop()
            links -= name == "a"
        del stack[depth:]

    def last(names) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            if stack[-1][2]:
                aside.append(page[at:end])
            else:
                held.append(page[at:end])
                if links:
                    linked += end - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = _tag(m)
        name = tag.name
        if tag.closing:
            if tag.block:
                if held or aside:
                    flush()
                heading = False
            if depth := last((name,)):
                close(depth)
            continue
        if tag.raw:
            found = None if name in endless else _END_OF[name].search(page, at)
            at = found.end() if found else size
            held.append(" ")
            continue
        if name == "br":
            (aside if stack[-1][2] else held).append(" ")
            continue
        instead = False
        if tag.next_of:
            if m[3].endswith("/") or name in endless:
                held.append(" ")
                continue
            after = tag.next_of.search(page, at)
            if not after:
                endless.add(name)
            if not after or not after[1]:  # nothing ends it
                held.append(" ")
                continue
            instead = True
            held.append(" ")
        if tag.block:
            if held or aside:
                flush()
            heading = tag.heading
            if (depth := last(CLOSES[name])) and depth > last(_BARRIERS - {name, stack[depth][0]}):
                close(depth)
        if tag.void:
            continue
        _, path, dropped, article, header, container, rank = stack[-1]
        dropped = dropped or instead or tag.aside or (name == "header" and not article)
        if tag.proper:
            proper += 2
            article = article if article % 2 else proper - 1
        elif tag.named and not article:
            named += 2
            article = named
        path = _path(path, tag.marks)
        if tag.block:
            tags.append((place, path))
            place += 1
        elif name == "a":
            links += 1
        if name in CONTAINERS:
            container = path
            rank = min(rank, ranks.get(path, _NO_RANK))
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, path, dropped, article, header or tag.header, container, rank))
    if held or aside:
        flush()
    return out, tags


def page_tokens(found: list[Block], tags: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, token) of a page in order of place."""
    out = [(at, path & ~1) for at, path in tags]
    for b in found:
        out += [(b.at + k, token) for k, token in enumerate(b.tokens())]
    return sorted(out)


def _vectors(batches):
    """Task: (host, token, low, high, pages, total): the token's vector is the pair of sums, added up over tasks."""
    held: dict[tuple[str, int], list[int]] = {}

    def out():
        hosts, tokens = zip(*held, strict=True)
        low, high, pages, total = zip(*held.values(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (tokens, low, high, pages, total)]], ["host", "token", "low", "high", "pages", "total"])
        held.clear()

    for batch in small(batches, 200):
        for host, page in zip(batch["_host"].to_pylist(), batch["_html"].to_pylist(), strict=True):
            page = page or ""
            key = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            hashes: dict[int, tuple[int, int]] = {}
            for token, n in Counter([token for _, token in page_tokens(*blocks(page))]).items():
                mark = hashes.get(n)
                if mark is None:
                    mixed = xxhash.xxh64_intdigest(f"{key}:{n}")
                    mark = hashes[n] = (mixed & 0xFFFFFFFF, mixed >> 32)
                cell = held.get((host, token))
                if cell is None:
                    held[host, token] = [mark[0], mark[1], 1, n]
                else:
                    cell[0] += mark[0]
                    cell[1] += mark[1]
                    cell[2] += 1
                    cell[3] += n
            if len(held) > HELD:
                yield from out()
    if held:
        yield from out()


class _ByHost:
    """What a host's list of rows is turned into, worked out once for each of the last hosts."""

    def __init__(self, make):
        self.make, self.known = make, {}

    def __call__(self, host: str, value):
        if host not in self.known:
            if len(self.known) >= 200:
                self.known.clear()
            self.known[host] = self.make(value.as_py())
        return self.known[host]


class Classes:
    """The classes of a host: token to class number; of each class, its tokens and whether it repeats on pages."""

    def __init__(self, listed):
        self.of: dict[int, int] = {x["token"]: x["number"] for x in listed or ()}
        self.size = Counter(self.of.values())
        self.repeats = {x["number"] for x in listed or () if x["repeats"]}


def _slot(b: Block, of: dict[int, int]) -> bool:
    """Whether most of the block's words are no class's."""
    tokens = b.tokens()
    return sum(t in of for t in tokens) < TEMPLATE_SHARE * len(tokens)


def _records(places: dict[int, list[int]], repeats, other: list[int]) -> list[tuple[int, int, int]]:
    """(first place, end, class) of the instances here of classes that stand several times on some page.

    What follows the last token of the last instance belongs to it, up to the next token of a class that stands once.
    """
    out = []
    for number in repeats:
        at = places.get(number, ())
        if at:
            k = bisect_left(other, at[-1])
            out.append((at[0], other[k] if k < len(other) else 1 << 60, number))
    return out


def _in_records(b: Block, regions: list[tuple[int, int, int]]) -> list[int]:
    return [number for first, end, number in regions if first <= b.at < end]


def _places(tokens: list[tuple[int, int]], classes: Classes) -> tuple[dict[int, list[int]], dict[int, list[int]], list[int]]:
    """For each class its positions in a page and its tokens there in order; the positions of those that never repeat."""
    places: dict[int, list[int]] = {}
    order: dict[int, list[int]] = {}
    once: list[int] = []
    for at, token in tokens:
        number = classes.of.get(token)
        if number is not None:
            places.setdefault(number, []).append(at)
            order.setdefault(number, []).append(token)
            if number not in classes.repeats:
                once.append(at)
    return places, order, once


def _nested(a: list[int], size_a: int, b: list[int], size_b: int) -> bool:
    """Whether every instance of b lies in one gap of a, or every instance of a in one gap of b."""

    def inside(outer: list[int], inner: list[int], size: int) -> bool:
        return all(bisect_left(outer, inner[k]) == bisect_left(outer, inner[k + size - 1]) for k in range(0, len(inner), size))

    return inside(a, b, size_b) or inside(b, a, size_a)


#: Kinds of rows of ``_validated``: a class with its order, a container's words, a record class's words.
CLASS, CONTAINER, RECORD = 0, 1, 2


def _validated(batches):
    """Task: (host, kind, at, low, high, valid, words), folded.

    A class (kind CLASS, at its number): least and largest order over pages, and whether it is valid on all of them. A
    container or record class: the words that pages have in its slots, without links.
    """
    held: dict[tuple[str, int, int], list] = {}
    classes_of = _ByHost(Classes)
    for batch in small(batches, 200):
        for host, page, listed in zip(batch["_host"].to_pylist(), batch["_html"].to_pylist(), batch["template"], strict=True):
            if not page or not listed.is_valid:
                continue
            classes = classes_of(host, listed)
            size = classes.size
            found, tags = blocks(page)
            places, order, once = _places(page_tokens(found, tags), classes)
            first = {n: seen[: size[n]] for n, seen in order.items()}
            fine = {n for n, seen in order.items() if len(seen) % size[n] == 0 and first[n] * (len(seen) // size[n]) == seen}
            nested: list[int] = []
            for n in sorted(fine, key=lambda n: (-size[n], n)):  # the larger class stays
                if all(_nested(places[m], size[m], places[n], size[n]) for m in nested):
                    nested.append(n)
            for n in order:
                mark = xxhash.xxh64_intdigest(str(first[n])) - (1 << 63)
                row = held.setdefault((host, CLASS, n), [mark, mark, True, 0])
                row[0], row[1], row[2] = min(row[0], mark), max(row[1], mark), row[2] and n in nested
            regions = _records({n: places[n] for n in nested}, classes.repeats, once)
            for b in found:
                if not b.dropped and _slot(b, classes.of):
                    words = len(b.words) if b.linked * 2 < sum(map(len, b.words)) + len(b.words) else 0
                    inside = _in_records(b, regions)
                    for kind, at in [(RECORD, n) for n in inside] or [(CONTAINER, b.container)]:
                        held.setdefault((host, kind, at), [0, 0, True, 0])[3] += words
            if len(held) > HELD:
                yield _rows_of(held)
                held.clear()
    if held:
        yield _rows_of(held)


def _rows_of(held: dict) -> pa.RecordBatch:
    hosts, kinds, at = zip(*held, strict=True)
    low, high, valid, words = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(at, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(valid, pa.bool_()), pa.array(words, pa.int64())], ["host", "kind", "at", "low", "high", "valid", "words"])


class Template:
    """A host's valid classes, its containers from the heaviest on, and the classes whose slots are records."""

    def __init__(self, row):
        self.classes = Classes(row["classes"] if row else None)
        mass = {x["at"]: x["words"] for x in (row["masses"] or () if row else ()) if x["kind"] == CONTAINER and x["words"]}
        self.ranks = {at: k for k, at in enumerate(sorted(mass, key=lambda at: (-mass[at], at)))}
        most = max(mass.values(), default=0)
        heavy = {x["at"] for x in (row["masses"] or () if row else ()) if x["kind"] == RECORD and x["words"] > most}
        self.records = self.classes.repeats - heavy


def by_elements(found: list[Block]) -> list[Block]:
    """The article by its elements, or text without links where no element tells."""
    kept = [b for b in found if not b.dropped]
    return [b for b in kept if b.article] or [b for b in kept if b.linked * 2 < sum(map(len, b.words)) + len(b.words)]


def main_text(page: str, template: Template | None = None) -> str:
    """The article: what the page's heaviest container holds in slots, in page order."""
    found, tags = blocks(page, template.ranks if template else None)
    chosen: list[Block] = []
    if template and template.classes.of:
        places, _, once = _places(page_tokens(found, tags), template.classes)
        regions = _records(places, template.records, once)
        kept = [b for b in found if not b.dropped and _slot(b, template.classes.of) and not _in_records(b, regions)]
        best = min((b.rank for b in kept if b.rank < _NO_RANK and b.linked * 2 < sum(map(len, b.words)) + len(b.words)), default=None)
        if best is not None:
            # an article that its elements name is whole: all such elements of the page
            named = any(b.article for b in kept if b.rank == best)
            chosen = [b for b in kept if (b.article if named else b.rank == best)]
    return "\n\n".join(" ".join(b.words) for b in chosen or by_elements(found))


def host_of(url: Column) -> Column:
    """The host in lower case; the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _with_host(pages: DataFrame, hosts: DataFrame, column: str) -> DataFrame:
    """``pages`` (with _host) and each host's ``column`` of the stored table ``hosts`` (host, host_pages, ``column``), null without.

    A table of up to ``BROADCAST`` bytes is broadcast. Beyond, both sides are salted: a host's row is repeated for every
    ``SALTED`` of its pages, so no host is more than a part.
    """
    size = hosts.agg(F.coalesce(F.sum(F.length(F.to_json(column)) + F.length("host")), F.lit(0))).first()[0]
    if size <= BROADCAST:
        return pages.join(F.broadcast(hosts.drop("host_pages")), pages["_host"] == hosts["host"], "left").drop("host")
    parts = F.ceil(F.col("host_pages") / SALTED).cast("int")
    large = materialize(hosts.where(F.col("host_pages") > SALTED).select(F.col("host").alias("_large"), parts.alias("_parts")), "large-hosts")
    salt = F.pmod(F.xxhash64(*pages.columns), F.coalesce("_parts", F.lit(1))).cast("int")  # of what the row holds: a task that runs again salts alike
    salted = pages.join(large, pages["_host"] == large["_large"], "left").withColumn("_salt", salt).drop("_large", "_parts")
    spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("host_pages").withColumnRenamed("host", "_host")
    return salted.join(spread, ["_host", "_salt"], "left").drop("_salt")


def templates(pages: DataFrame) -> DataFrame:
    """(host, host_pages, template) from ``pages`` (_host, _html, and what tells rows apart): the valid classes and the containers' masses of each host."""
    hosts = pages.groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    vectors = pages.select("_host", "_html").mapInArrow(_vectors, "host string, token long, low long, high long, pages long, total long")
    sums = vectors.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("low", "high", "pages", "total")]).where(F.col("pages") >= LEAST_PAGES)
    share = F.when(F.col("token").bitwiseAND(1) == 1, TEXT_SHARE).otherwise(LEAST_SHARE)
    # the numbers of pages go to a host's tokens in sixteen parts, so a host of very many words is not one task
    spread = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    every = sums.withColumn("part", F.pmod("token", F.lit(16)).cast("int")).join(spread, ["host", "part"]).where(F.col("pages") >= F.col("host_pages") * share)
    # no host's template has more tokens than 1 / LEAST_SHARE of its mean page, so a host's list is bounded by its pages' size
    classes = every.groupBy("host", "host_pages", "low", "high", "pages", "total").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    listed = classes.groupBy("host", "host_pages").agg(F.sort_array(F.collect_list(F.struct("tokens", (F.col("total") > F.col("pages")).alias("repeats")))).alias("all"))
    flat = F.flatten(F.transform("all", lambda c, k: F.transform(c["tokens"], lambda t: F.struct(k.alias("number"), t.alias("token"), c["repeats"].alias("repeats")))))
    numbered = materialize(listed.select("host", "host_pages", flat.alias("template")), "classes")
    seen = _with_host(pages, numbered, "template").select("_host", "_html", "template").mapInArrow(_validated, "host string, kind int, at long, low long, high long, valid boolean, words long")
    folded = seen.groupBy("host", "kind", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("valid").alias("valid"), F.sum("words").alias("words"))
    is_class = F.col("kind") == CLASS
    judged = folded.groupBy("host").agg(
        F.collect_set(F.when(is_class & F.col("valid") & (F.col("low") == F.col("high")), F.col("at"))).alias("numbers"),
        F.collect_list(F.when(~is_class, F.struct("kind", "at", "words"))).alias("masses"),
    )
    valid = F.filter("template", lambda c: F.array_contains("numbers", c["number"].cast("long")))
    return materialize(numbered.join(judged, "host").select("host", "host_pages", F.struct(valid.alias("classes"), "masses").alias("template")), "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    rows = lean(pages).select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    joined = _with_host(rows, templates(rows.select("_id", "_host", "_html")), "template").select("_id", "_url", "_host", "_html", "template")

    def work(batches):
        template = _ByHost(Template)
        for batch in small(batches, 200):
            rows = zip(batch["_host"].to_pylist(), batch["_html"].to_pylist(), batch["template"], strict=True)
            texts = [main_text(page, template(host, listed)) if page else "" for host, page, listed in rows]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_url"], pa.array(texts, pa.string())], [id_col, url_col, "text"])

    kinds = joined.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col)).schema.fields
    return joined.mapInArrow(work, T.StructType([*kinds, T.StructField("text", T.StringType())]))
