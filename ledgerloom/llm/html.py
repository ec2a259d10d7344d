"""Main text of web pages by consensus paths of their host.

Each page names the container that holds its article best: its score is the text below
it that is not a link and not in a part that is a menu, notice, advert and so on by tag,
class, id or role. The container is written as a generalised path, tags and classes from
the root with digits made equal, so pages of one template name the same path. A part that
only its class, id or role calls a menu, advert and so on is kept all the same if it holds
most of the page's text that is not a link (and lies in an <article> or <main>, or the page
has none outside such parts), or an <article> or <main> with more of it than those outside
such parts; words as in "with-sidebar" or "comments-open" say nothing. Notices, adverts and
dialogs never wrap a page: with nothing else on it, its text is empty. The pages
of a host vote, and every page is extracted again from the first winning path that is its
own: the container holds a fair share of the page's score, or what lies elsewhere lies in
containers that the voters of that path have text in as well (a page of their template).

A path wins with at least ``LEAST_SHARE`` of its host's votes, so a host has at most
1 / LEAST_SHARE of them. A page without a winning path of its own keeps its own choice. A
winning container that is empty on a page of its template gives an empty text, not the
next best one.

Without an <article> or <main> the container is found from the root down, and the way ends
where text would be left behind, so title and lead stay in. Only boxes right below the body
are left behind, if they have no heading and together less than a tenth of the score.

Blocks: block-level elements part blocks, a table row is one block, <br> is white space.
Character references are decoded, white space (also no-break space) becomes one space,
empty blocks go, blocks are joined by an empty line.

Edge cases: a null or empty page, or one without article, gives an empty text; broken
markup is read as far as it goes, whatever is left open ends with its parent; pages
without a host vote for nobody and keep their own choice; pages of any length are read
whole; repeated pages are rows (and votes) like others; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.scale import materialise

LEAST_SHARE = 0.1
# A container is chosen while one child holds this share of its score.
MOST_OF_IT = 0.9
# A winning container with this share of a page's score is that page's article.
FAIR_SHARE = 0.3
# A page is of a template if this share of its score lies where the template has text.
SAME_TEMPLATE = 0.5
# A template has text where this share of the pages that voted for its path have some.
MOST_VOTERS = 0.5
# An <article> or <main> is chosen if it holds this share of the page's score.
NAMED_SHARE = 0.5

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Everything up to their end tag is not markup and not text.
_RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
_SKIP = frozenset("nav footer aside form button select dialog menu head".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody "
    "tfoot thead tr ul caption".split())
_CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
           "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# html and body: what lies right below them may be left behind.
_PAGE_LEVELS = 2
_LISTS = frozenset("ul ol dl table".split())
# Words of a class, id or role that say a part is not the article.
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer contentinfo banner complementary cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup share sharing social related recommended comments comment disqus replies reply respond "
    "pagination pager widget toolbar login search alert dialog".split())
# Those that only count outside an article: inside, they may hold its title.
_HEADS = frozenset("header masthead topbar".split())
# What follows the first ones, or comes before the others, is a state of a wrapper.
_WITH = frozenset("with without no not has have hide hides show shows".split())
_STATES = frozenset("open opened closed enabled disabled on off".split())
# Parts of these names never wrap a page: they are left out even where there is little else.
_NEVER_WRAPS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr "
    "notice notices popup modal overlay dialog alert newsletter subscribe subscription signup login".split())
# A part of another name is no aside if it holds more than this share of the page's text
# outside links.
MOST_OF_PAGE = 0.5
# Names of deeper containers are digests: a path of any depth has a short name.
SPELT_DEPTH = 64


def _named(value: str) -> set[str]:
    """Words of a class, id or role that name the element itself."""
    found = set()
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if words and words[-1] not in _STATES:
            found.update(takewhile(lambda w: w not in _WITH, words))
    return found


def _place(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, int]:
    """Step of the path for an element, whether it is left out, and whether it is an aside
    by its class, id or role, which is left out unless it holds the article: 1, or 2 for
    one that cannot be a wrapper."""
    skip, aside = tag in _SKIP or (tag == "header" and not in_article), 0
    if not attributes or attributes.isspace():
        return tag, skip, aside
    step = tag
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words = _named(value)
            if tag not in ("body", "html", "main") and (
                    words & _ASIDE or (words & _HEADS and not in_article)):
                aside = max(aside, 2 if words & _NEVER_WRAPS else 1)
            if name == "class" and value:
                step = tag + "." + ".".join(sorted(_DIGITS.sub("#", value).replace(">", "#").split()))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            skip = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            skip = True
    return step, skip, aside


class Tree:
    """Nodes by number, each with its parent's, which is smaller; 0 is the root."""

    def __init__(self):
        self.parent = [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        return len(self.parent) - 1

    def summed(self, own: dict[int, float]) -> list[float]:
        """For each node the sum over itself and all below it."""
        out = [0] * len(self.parent)
        for node, value in own.items():
            out[node] += value
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def covered(self, tops) -> list[bool]:
        """Whether each node is one of ``tops`` or below one."""
        out = [False] * len(self.parent)
        for node in tops:
            out[node] = True
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parent[node]]
        return out


class Page(Tree):
    """Containers of a page as nodes (elements with the same steps to them are one node), and
    its kept ``found`` blocks: node of the enclosing container, text, characters in links."""

    def __init__(self):
        super().__init__()
        self.step, self.depth, self._known = [""], [0], {}
        self.found: list[tuple[int, str, int]] = []
        self.seen: set[int] = set()  # containers kept
        self.heads: set[int] = set()  # containers with a heading right in them

    def at(self, parent: int, step: str) -> int:
        node = self._known.get((parent, step))
        if node is None:
            node = self._known[parent, step] = self.add(parent)
            self.step.append(step)
            self.depth.append(self.depth[parent] + 1)
        return node

    def path(self, node: int) -> str:
        """Name of a container: its generalised steps, or their digest below SPELT_DEPTH."""
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        steps.append("")
        if len(steps) <= SPELT_DEPTH + 1:
            return ">".join(reversed(steps))
        digest = b""
        for step in reversed(steps[:-1]):
            digest = hashlib.blake2b(digest + step.encode(), digest_size=16).digest()
        return f"#{len(steps) - 1}#{digest.hex()}"

    def named(self, path: str) -> int | None:
        """The container of a name, if the page has it."""
        if path.startswith("#"):
            depth = int(path.split("#")[1])
            # Digests of all nodes, each from its parent's.
            digests = [b""]
            for node in range(1, len(self.parent)):
                digests.append(hashlib.blake2b(
                    digests[self.parent[node]] + self.step[node].encode(), digest_size=16).digest())
                if self.depth[node] == depth and path.endswith(digests[node].hex()):
                    return node
            return None
        node = 0
        for step in path.split(">")[1:]:
            node = self._known.get((node, step))
            if node is None:
                return None
        return node

    def weights(self) -> dict[int, int]:
        """Characters outside links right in each container with a block."""
        out: dict[int, int] = {}
        for node, text, linked in self.found:
            out[node] = out.get(node, 0) + len(text) - linked
        return out

    def choice(self) -> tuple[int, float]:
        """The container that holds the article by the page alone, and its score."""
        weights = self.weights()
        score = self.summed(weights)
        own = {n for n, w in weights.items() if w}
        present = self.summed({n: 1 for n in weights})
        nodes = [n for n in range(1, len(score)) if present[n]]
        total = max((score[n] for n in nodes), default=0)
        if total <= 0:
            return 0, 0.0
        tags = {n: self.step[n].split(".")[0] for n in nodes}
        named = [n for n in nodes if score[n] >= NAMED_SHARE * total and tags[n] in ("article", "main")]
        if named:
            articles = [n for n in named if self.step[n].startswith("article")]
            rank = lambda n: (self.depth[n], -score[n])
            first = min(map(rank, articles or named))
            best = min((n for n in articles or named if rank(n) == first), key=self.path)
            return best, float(score[best])
        children: dict[int, list[int]] = {}
        for n in nodes:
            if tags[n] in _CONTAINER:
                children.setdefault(self.parent[n], []).append(n)
        headed = self.summed({n: 1 for n in own & self.heads})
        best, all_ = 0, total
        while True:
            next_ = max(children.get(best, ()), key=lambda n: (score[n], self.step[n]), default=0)
            if not next_ or score[next_] < MOST_OF_IT * all_ or best in own:
                return best, float(all_)
            if score[next_] < all_ and (self.depth[next_] > _PAGE_LEVELS + 1 or headed[0] > headed[next_]):
                return best, float(all_)
            best, all_ = next_, score[next_]

    def of_template(self, node: int, shell: list[str]) -> bool:
        """Whether a winning container is the article of this page, ``shell`` being the
        other containers its voters have text in."""
        weights = self.weights()
        inside = self.covered([node])
        total = sum(weights.values())
        held = sum(w for n, w in weights.items() if inside[n])
        others = {self.named(path) for path in shell}
        known = sum(w for n, w in weights.items() if n in others and not inside[n])
        return held >= FAIR_SHARE * total or held + known >= SAME_TEMPLATE * total

    def text(self, node: int) -> str:
        inside = self.covered([node])
        return "\n\n".join(t for n, t, _ in self.found if inside[n])


class _Asides(Tree):
    """Nested asides: which of them to leave out. Node 0 is the page outside of them."""

    def __init__(self):
        super().__init__()
        self.never_wraps, self.holds, self.within = {0}, set(), set()

    def gone(self, pieces, own_article: bool) -> list[bool]:
        """Asides left out, with what is in them: those without most of the page's text,
        where that counts for them, and without the page's article."""
        weight: dict[int, int] = {}
        articles = 0
        for piece, link, aside, in_article in pieces:
            size = 0 if link else len("".join(piece.split()))
            weight[aside] = weight.get(aside, 0) + size
            if in_article and not aside:
                articles += size
        inside, present = self.summed(weight), self.summed({a: 1 for a in weight})
        holds = self.summed({a: 1 for a in self.holds})

        def stays(a):
            wraps = a not in self.never_wraps and (a in self.within or not own_article)
            return (wraps and inside[a] > MOST_OF_PAGE * inside[0]) or (holds[a] and inside[a] > articles)

        return self.covered([a for a in range(1, len(inside)) if present[a] and not stays(a)])


def blocks(page: str) -> tuple[list[tuple[str, str, int]], set[str]]:
    """(path of the enclosing container, text, characters in links) of the kept blocks in
    page order, and the paths of all containers kept."""
    tree = parsed(page)
    return [(tree.path(n), t, linked) for n, t, linked in tree.found], {tree.path(n) for n in tree.seen}


def parsed(page: str) -> Page:
    """The containers and kept blocks of a page, in time and memory in proportion to it."""
    tree, asides = Page(), _Asides()
    # Blocks as pieces: text, in a link, innermost aside around it, in an article.
    raw: list[tuple[int, list[tuple[str, bool, int, bool]]]] = []
    places: list[tuple[int, int]] = []
    # Open elements: tag, node, node of the container it belongs to, left out, in an article,
    # innermost aside around it.
    stack = [("", 0, 0, False, False, 0)]
    # Where in the stack elements of a tag are, and blocks, and what ends a look upwards.
    where: dict[str, list[int]] = {}
    blocks_at, stops_at = [0], [0]
    parts: list[tuple[str, bool, int, bool]] = []
    links, at = 0, 0
    own_article = False
    titles: set[int] = set()

    def last(*tags):
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def flush():
        nonlocal parts
        if parts:
            raw.append((stack[-1][2], parts))
            if any(entry[0] in ("h1", "h2") for entry in stack[-3:]):
                titles.add(len(raw) - 1)
            parts = []

    def close(depth):
        nonlocal links
        if any(entry[0] in _BLOCK for entry in stack[depth:]):
            flush()
        for tag, *_ in stack[depth:]:
            where[tag].pop()
            if tag == "a":
                links -= 1
        while blocks_at[-1] >= depth:
            blocks_at.pop()
        while stops_at[-1] >= depth:
            stops_at.pop()
        del stack[depth:]

    def text(a, b):
        if a < b and not stack[-1][3]:
            piece = page[a:b]
            if "&" in piece:
                piece = unescape(piece)
            parts.append((piece, links > 0, stack[-1][5], stack[-1][4]))

    length = len(page)
    while at < length:
        hit = _MARKUP.search(page, at)
        if hit is None:
            text(at, length)
            break
        text(at, hit.start())
        at = hit.end()
        tag = hit[2] or hit[5]
        if tag is None:
            continue
        tag = tag.lower()
        if hit[1] or hit[4]:
            # The end of an inline element does not reach beyond a block.
            depth = last(tag)
            if depth and (tag in _BLOCK or tag in ("td", "th") or depth > blocks_at[-1]):
                close(depth)
            continue
        attributes = hit[3] if hit[3] is not None else hit[6]
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1][3]:
                parts.append((" ", False, stack[-1][5], False))
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{tag}", re.I).search(page, at)
                if end is None:
                    break
                at = end.start()
            continue
        if tag in _BLOCK:
            # A block ends an open paragraph, a list item the one before it.
            depth = last("p", *_CLOSES.get(tag, ()))
            if depth and depth >= stops_at[-1]:
                close(depth)
            flush()
        elif tag in ("td", "th"):
            depth = last(*_CLOSES[tag])
            if depth and depth > last("tr", "table"):
                close(depth)
            if not stack[-1][3]:
                parts.append((" ", False, stack[-1][5], False))
        elif tag == "a":
            links += 1
        _, node, container, out, in_article, aside = stack[-1]
        step, skip, named = _place(tag, attributes, in_article)
        node = tree.at(node, step)
        out = out or skip
        if named and not out:
            aside = asides.add(aside)
            if in_article:
                asides.within.add(aside)
            if named == 2:
                asides.never_wraps.add(aside)
        if tag in ("article", "main") and not out:
            in_article = True
            if aside:
                asides.holds.add(aside)
            own_article = own_article or not aside
        if tag in _CONTAINER and not out:
            container = node
            places.append((node, aside))
        where.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            blocks_at.append(len(stack))
        if tag in _CONTAINER or tag in _LISTS:
            stops_at.append(len(stack))
        stack.append((tag, node, container, out, in_article, aside))
    flush()
    gone = asides.gone([p for _, pieces in raw for p in pieces], own_article)
    for i, (node, pieces) in enumerate(raw):
        pieces = [p for p in pieces if not gone[p[2]]]
        text_ = " ".join("".join([p[0] for p in pieces]).split())
        if text_:
            tree.found.append((node, text_, min(sum([len(p[0]) for p in pieces if p[1]]), len(text_))))
            if i in titles:
                tree.heads.add(node)
    tree.seen = {node for node, aside in places if not gone[aside]}
    return tree


def host(url):
    """Host of a URL in lower case, null where there is none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(name, F.lit(""))


def _votes(df: DataFrame, url: str, html: str) -> DataFrame:
    """``host``, ``path`` and ``score`` of each page that votes, and ``others``, the
    containers beside the path, below the body, that hold text outside links."""
    def vote(batches):
        for batch in batches:
            paths, scores, others = [], [], []
            for page in batch.column(1).to_pylist():
                tree = parsed(page)
                node, score = tree.choice()
                inside = tree.covered([node])
                paths.append(tree.path(node))
                scores.append(score)
                others.append(sorted({tree.path(p) for p in {p for p, t, n in tree.found if len(t) > n}
                                      if tree.depth[p] > _PAGE_LEVELS and not inside[p]}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(others, pa.list_(pa.string()))], names=["host", "path", "score", "others"])

    pages = df.select(host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return (pages.filter(F.col("host").isNotNull())
            .mapInArrow(vote, "host string, path string, score double, others array<string>")
            .filter("score > 0"))


def votes(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``path``, ``n`` and ``score``: what the pages of each host voted for."""
    return _votes(df, url, html).groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"))


def winners(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and ``won``, its winning paths with their ``shell``, most votes first.

    A shell holds the other containers that most voters of the path have text in.
    """
    # The empty name counts the voters themselves.
    other = F.explode(F.concat(F.array(F.lit("")), "others"))
    told = materialise(_votes(df, url, html).select("host", "path", other.alias("other"))
                       .groupBy("host", "path", "other").agg(F.count("*").alias("n")), "host_votes")
    counted = told.filter("other = ''").select("host", "path", F.col("n").alias("voters"))
    every = counted.groupBy("host").agg(F.sum("voters").alias("all"))
    won = counted.join(every, "host").filter(F.col("voters") >= LEAST_SHARE * F.col("all"))
    usual = told.join(won.select("host", "path", "voters"), ["host", "path"]).filter(
        F.col("n") >= MOST_VOTERS * F.col("voters"))
    shells = usual.groupBy("host", "path", "voters").agg(
        F.collect_list(F.when(F.col("other") != "", F.col("other"))).alias("shell"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("voters")).alias("n"), "path", "shell")))
    return shells.groupBy("host").agg(
        F.transform(order, lambda s: F.struct(s["path"].alias("path"), s["shell"].alias("shell"))).alias("won"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` and ``path``, the path the text was taken from."""
    won = materialise(winners(df, url, html), "host_paths")
    pages = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"),
                      F.coalesce(F.col(html), F.lit("")).alias("_html"),
                      host(F.col(url)).alias("host"))
    asked = pages.join(won, "host", "left").select("_key", "_url", "_html", "won")

    def take(batches):
        for batch in batches:
            texts, places = [], []
            for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tree = parsed(page)
                won = ((tree.named(w["path"]), w["shell"]) for w in paths or ())
                node = next((n for n, shell in won if n in tree.seen and tree.of_template(n, shell)), None)
                if node is None:
                    node = tree.choice()[0]
                texts.append(tree.text(node) if node else "")
                places.append(tree.path(node))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(places, pa.string())], names=["_key", "_url", "text", "path"])

    schema = T.StructType([
        T.StructField("_key", df.schema[key].dataType), T.StructField("_url", df.schema[url].dataType),
        T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])
    return asked.mapInArrow(take, schema).select(
        F.col("_key").alias(key), F.col("_url").alias(url), "text",
        F.length("text").cast("long").alias("n_chars"), "path")
