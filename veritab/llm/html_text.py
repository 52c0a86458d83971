"""Main text of web pages, with site templates found by counting element subtrees per host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import slices, stage, texts_of

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot".split())
IMPLIED = {k: (tuple(a.split()), tuple(b.split())) for k, a, b in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))}
P_STOPS = tuple("article section div table td th li blockquote button".split())
# Elements, roles and class or id words of what is not the article; those that may be laid around a whole page.
DROPPED = frozenset("nav footer script style template svg iframe button select textarea head title object canvas menu".split())
WRAPPERS = frozenset("aside form noscript dialog".split())
DROPPED_ROLES = frozenset("navigation contentinfo".split())
WRAPPER_ROLES = frozenset("banner complementary search dialog alert".split())
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
CONTENT = frozenset(("article", "main"))
#: Only these, never prose, can be a template; outside articles these sections of a page, too.
CONTAINERS = frozenset("div section ul ol table figure dl".split())
SECTIONS = CONTAINERS | frozenset("address aside center details dialog fieldset footer form header menu nav".split())
#: Furniture without text that a page shows is not counted.
UNSEEN = RAW | frozenset("head template object canvas svg select button".split())
#: A subtree on so many different pages of a host, and on one in so many of all of them, is its template.
LEAST_PAGES = 3
ONE_IN_OUTSIDE, ONE_IN_ARTICLES = 4, 2
#: Keys over which the pages of one template are dealt.
SPREAD = 32

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: A whole attribute, so that neither data-role nor words in another one's value count.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What an element is by itself: content, furniture, furniture unless it holds most of the page, or the article as well,
#: or more than a quarter of the text.
PLAIN, GONE, WRAPPER, NAMED, COMPOUND = range(5)


_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}


class Node:
    """An element: tag, whether it is page furniture by itself, and its text and child nodes in order."""

    __slots__ = ("children", "dropped", "tag")

    def __init__(self, tag: str, dropped: bool):
        self.tag, self.dropped, self.children = tag, dropped, []


def _furniture(tag: str, attributes: str, inside: bool) -> int:
    """GONE or WRAPPER by tag or role, NAMED by a whole word of class or id, COMPOUND for a container by a word's first part."""
    if tag in DROPPED:
        return GONE
    kind = WRAPPER if tag in WRAPPERS or tag == "header" and not inside else PLAIN
    unsaid = DROPPED_WORDS - {"header"} if inside else DROPPED_WORDS
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        words = set("".join(values).lower().split())
        if name == "role":
            if DROPPED_ROLES & words:
                return GONE
            kind = WRAPPER if WRAPPER_ROLES & words else kind
        elif tag == "article":
            kind = NAMED if {"comment", "comments"} & words else kind
        elif tag not in ("html", "body", "main"):
            if unsaid & words:
                kind = NAMED
            elif kind == PLAIN and tag in CONTAINERS and any(re.split("[-_]", w, maxsplit=1)[0] in unsaid for w in words):
                kind = COMPOUND
    return kind


def _measure(root: Node, ids: frozenset[int], free: bool) -> dict[int, tuple[int, bool, bool]]:
    """By id(node): characters of text, whether the node is or holds the main part or the article, and whether any article."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            order.append(node)
            todo += [c for c in node.children if isinstance(c, Node)]
    found: dict[int, tuple[int, bool, bool]] = {}
    for node in reversed(order):
        chars, content, holds = 0, node.tag in CONTENT, node.tag == "main" or node.tag == "article" and not free and id(node) not in ids
        for c in node.children:
            if isinstance(c, str):
                chars += len("".join(html.unescape(c).split()))
            elif id(c) in found:
                below = found[id(c)]
                chars, holds, content = chars + below[0], holds or below[1], content or below[2]
        found[id(node)] = (chars, holds, content)
    return found


def _drop(root: Node, kinds: list[tuple[Node, int]]) -> None:
    """Mark what is furniture among the nodes of kinds, but never the article, its main part or most of the page's text.

    First by class and id: where an article stands outside such elements, those in them are teasers or comments and go
    with them. Compound words take only small parts of the text. Then wrappers go that hold at most half of what is left.
    """
    named = [(n, k) for n, k in kinds if k != WRAPPER]
    ids = frozenset(id(n) for n, _ in named)
    free, todo = False, [(root, False)]
    while todo and not free:
        node, under = todo.pop()
        if not node.dropped:
            under = under or id(node) in ids
            free = node.tag == "article" and not under
            todo += [(c, under) for c in node.children if isinstance(c, Node)]
    found = _measure(root, ids, free)
    total = found[id(root)][0]
    for node, kind in named:
        chars, holds, content = found.get(id(node), (0, False, False))
        node.dropped = not holds and not (kind == COMPOUND and content) and (4 if kind == COMPOUND else 2) * chars <= total
    wrappers = [n for n, k in kinds if k == WRAPPER]
    if wrappers:
        found = _measure(root, ids, free)
        total = found[id(root)][0]
        for node in wrappers:
            node.dropped = 2 * found.get(id(node), (0, False, False))[0] <= total


def _tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(from, to, tag, whether it ends an element, attributes) of each tag; tag is None for comments and declarations.

    One pass forward: a quote without a partner is an ordinary character, a tag without an end takes the rest.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    at, n = 0, len(source)
    while (at := source.find("<", at)) >= 0:
        m = _NAME.match(source, at)
        if m is None:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), at):
                end = source.find(">", at + 2)
                end = n if end < 0 else end + 1
            else:
                at += 1
                continue
            yield at, end, None, False, ""
            at = end
            continue
        end = m.end()
        while stop := _STOP.search(source, end):
            end = stop.end()
            if stop[0] == ">":
                break
            if last[stop[0]] >= end:
                end = source.find(stop[0], end) + 1
        else:
            end = n
        to = yield at, end, m[2].lower(), bool(m[1]), source[m.end() : end - 1]
        at = end if to is None else to


class _Stack:
    """Open elements, with the places of each tag, so that closing looks at no other elements."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks, self.content = [root], {}, [], 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.content += node.tag in CONTENT
        self.nodes.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.content -= node.tag in CONTENT

    def close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the last open element of tags, unless one of stops was opened after it."""
        place = self.last(tags)
        if place > self.last(stops):
            self.cut(place)

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element doesn't end a block."""
        place = self.last((tag,))
        if place and (tag in BLOCK or not self.blocks or place > self.blocks[-1]):
            self.cut(place)


def parse(source: str) -> Node:
    """The page's element tree; unclosed and misnested tags are closed as browsers do for these cases.

    Time grows with the source's length, whatever it holds.
    """
    root = Node("html", False)
    stack, kinds = _Stack(root), []
    done = 0
    tokens = _tokens(source)
    token = next(tokens, None)
    while token is not None:
        start, at, tag, ends, attributes = token
        if start > done:
            stack.nodes[-1].children.append(source[done:start])
        done = at
        if tag is None:
            pass
        elif ends:
            stack.end(tag)
        else:
            if tag in CLOSES_P:
                stack.close(("p",), P_STOPS)
            elif tag in IMPLIED:
                stack.close(*IMPLIED[tag])
            if tag not in ("html", "body"):
                kind = _furniture(tag, attributes, stack.content > 0)
                node = Node(tag, kind == GONE)
                if kind > GONE:
                    kinds.append((node, kind))
                stack.nodes[-1].children.append(node)
                if tag in RAW:
                    end = _RAW_END[tag].search(source, at)
                    node.children.append(source[at : end.start() if end else len(source)])
                    done = end.end() if end else len(source)
                elif tag not in VOID and not attributes.endswith("/"):
                    stack.push(node)
        try:
            token = tokens.send(done) if tag is not None else next(tokens)
        except StopIteration:
            token = None
    if done < len(source):
        stack.nodes[-1].children.append(source[done:])
    if kinds:
        _drop(root, kinds)
    return root


def _walk(node: Node, inside: bool = False) -> Iterator[tuple[Node, bool]]:
    """Nodes that are not furniture, each with whether it is in an article; without recursion, as pages nest deeply."""
    todo = [(node, inside)]
    while todo:
        node, inside = todo.pop()
        if node.dropped:
            continue
        yield node, inside
        inside = inside or node.tag in CONTENT
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]


def subtree_hashes(root: Node) -> dict[int, tuple[int, bool, bool]]:
    """By id(node): signed 64-bit hash of the element's tag, text and children's hashes, if it has text, if it holds an article.

    Furniture has a hash of its own whole subtree, but counts for nothing in the elements around it.
    """
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, under = todo.pop()
        under = under or node.dropped
        order.append((node, under))
        if node.tag not in UNSEEN:
            todo += [(c, under) for c in node.children if isinstance(c, Node)]
    found: dict[int, tuple[int, bool, bool]] = {}
    for node, under in reversed(order):
        h, has_text, has_content = xxhash.xxh64(node.tag), False, node.tag in CONTENT
        for c in node.children if node.tag not in UNSEEN else ():
            if isinstance(c, Node):
                below = found[id(c)] if under or not c.dropped else (0, False, False)
                h.update(below[0].to_bytes(8, "little", signed=True))
                has_text, has_content = has_text or below[1], has_content or below[2]
            elif text := " ".join(html.unescape(c).split()):
                h.update(text)
                has_text = True
        value = h.intdigest()
        found[id(node)] = (value - (1 << 64) if value >= 1 << 63 else value, has_text, has_content)
    return found


def main_text(root: Node, templates: frozenset[tuple[int, bool]] = frozenset()) -> str:
    """Blocks of the articles (of the whole page, if it has none) without furniture and templates, joined by newlines.

    templates are (hash, in an article): what recurs beside articles is no template in them.
    """
    articles = [n for n, inside in _walk(root) if n.tag in CONTENT and not inside]
    gone = {h for h, inside in templates if inside == bool(articles)}
    hashes = subtree_hashes(root) if gone else {}
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if block := " ".join(html.unescape("".join(now)).split()):
            blocks.append(block)
        now.clear()

    for top in articles or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x.dropped or x is not top and hashes.get(id(x), (None,))[0] in gone:
                if x.tag in BLOCK:
                    end()
                else:
                    now.append(" ")
            else:
                if x.tag in BLOCK:
                    end()
                    todo.append(None)
                elif x.tag in ("br", "wbr"):
                    now.append(" " if x.tag == "br" else "")
                todo += reversed(x.children)
        end()
    return "\n".join(blocks)


def _candidates(root: Node) -> set[tuple[int, bool]]:
    """(hash, in an article) of the subtrees that could be a template: containers with text, furniture too, and outside articles sections."""
    hashes = subtree_hashes(root)
    out = set()
    for node, inside in _walk(root):
        furniture = [c for c in node.children if isinstance(c, Node) and c.dropped and c.tag not in UNSEEN]
        for x, within in [(node, inside), *((c, inside or node.tag in CONTENT) for c in furniture)]:
            value, has_text, has_content = hashes[id(x)]
            if has_text and not has_content and x.tag in (CONTAINERS if within else SECTIONS):
                out.add((value, within))
    return out


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _subtrees(pages: DataFrame) -> DataFrame:
    """(__page, __host, hash, inside, page): each page's own candidates, and one row of null hash; page is its text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, sources = batch.column("__page").to_pylist(), batch.column("__host").to_pylist(), texts_of(batch.column("html"))
            for a, b in slices(sources):
                rows = []
                for i, host, source in zip(ids[a:b], hosts[a:b], sources[a:b], strict=True):
                    root = parse(source)
                    page = xxhash.xxh64(main_text(root)).intdigest() >> 1
                    rows += [(i, host, h, inside, page) for h, inside in _candidates(root)] + [(i, host, None, None, page)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["__page", "__host", "hash", "inside", "page"])

    return pages.select("__page", "__host", "html").mapInArrow(run, "__page long, __host string, hash long, inside boolean, page long")


def site_templates(subtrees: DataFrame) -> DataFrame:
    """(__host, hash, inside): subtrees on LEAST_PAGES or more and a share of a host's different pages, from rows of _subtrees().

    Pages of a host with the same main text are copies and count once. Counting is two partial aggregates, so a host
    with a third of all pages is spread over its subtrees.
    """
    seen = subtrees.select("__host", "hash", "inside", "page").distinct()
    counts = stage(seen.groupBy("__host", "hash", "inside").agg(F.count(F.lit(1)).alias("n")), "counts")
    hosts = counts.filter("hash IS NULL").select("__host", F.col("n").alias("pages"))
    often = counts.filter(F.col("hash").isNotNull() & (F.col("n") >= LEAST_PAGES))
    return often.join(hosts, "__host").filter(F.col("n") * F.when(F.col("inside"), ONE_IN_ARTICLES).otherwise(ONE_IN_OUTSIDE) >= F.col("pages")).select("__host", "hash", "inside")


def _extract(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Main text of each page; the column __templates holds the (hash, inside) to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = texts_of(batch.column("html"))
            deleted = batch.column("__templates").to_pylist()
            for a, b in slices(sources):
                texts = [main_text(parse(s), frozenset((x["hash"], x["inside"]) for x in d or ())) for s, d in zip(sources[a:b], deleted[a:b], strict=True)]
                cols = [batch.column(k).slice(a, b - a) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys) + ", text string, n_chars long"
    return pages.mapInArrow(run, schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    Furniture (menus, adverts, comments and the like) goes by element, role and class; templates of a site go by the
    counts of site_templates(). Every page is joined to its host's templates: each with the hashes of its own subtrees,
    never a host's whole list. Null html is empty; a null or odd url has the host ''. Repeated rows come out alike;
    other columns are not read.
    """
    pages = pages.select("page_id", "url", "html").withColumn("__host", host_of(F.col("url"))).withColumn("__page", F.xxhash64("page_id", "url", "html"))
    subtrees = stage(_subtrees(pages), "subtrees")
    # A template of a large host is on many pages: its rows are dealt by page over SPREAD keys.
    templates = stage(site_templates(subtrees), "templates").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    own = subtrees.filter("hash IS NOT NULL").withColumn("__part", F.pmod("__page", F.lit(SPREAD)).cast("int"))
    own = own.join(templates, ["__host", "hash", "inside", "__part"]).groupBy("__page").agg(F.collect_set(F.struct("hash", "inside")).alias("__templates"))
    return _extract(pages.join(stage(own, "own"), "__page", "left"), ["page_id", "url"])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
