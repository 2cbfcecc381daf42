"""Main text of web pages by a site style tree.

Pages are parsed into element trees by a tolerant tokenizer, in linear time and memory whatever is left open or nested. The whole trees of
a host are merged: an element is known by its path of tags, classes and ids, in which longer numbers count as one. Its presentation importance is the
entropy, over the host's distinct pages, of the shapes of the branches below it, its content importance that of their texts, both from
0 (the same on every page) to 1 (different on every page); the composite weighs presentation the more the more kids an element has.
What an element tells is its content importance times its length. The host's main region is the deepest element that tells half of all.
Removed are branches whose composite importance is under LIMIT, and, outside the main region, those that are not
important by it, scaled down where a branch tells less than SHARE of what the region does: menus, adverts, notices, sidebars and footers,
whatever they are called. Headings are measured without that scale, and nothing below an article element goes, as edited copies and series
share headings and passages.

By the meaning of their tags and roles, scripts, styles, forms, nav, aside and footer elements and headers outside articles go too. Inside
articles, containers (never paragraphs, headings or inline elements) go that are named as adverts and the like by a whole class or id.

Reader comments differ from page to page like main text, so they are found by what they are, everywhere: articles in articles; containers with
a word for comments in a class or id, if they hold no main text; and runs of like siblings after the main text that are signed each, by
a date, a time or an author (see `Talk`). Paths that are such runs on two pages of a judged host are comments on its other pages too,
where there may be one only.
Hosts with less than MIN_PAGES pages of different text tell nothing: there, article elements, else main elements, else the body are
taken, without what is named as above. A page that would lose all its text is taken that way as well.

Statistics are counts by (host, path, digest) with partial aggregation, so a host with a third of the pages is no
single task; the table of removed branches is joined back by broadcast if its bytes are few, else by a shuffled join with salted hosts.

Defined results: null or blank html -> empty text; pages with a null url, or one without a host, are no host's. A tag that is never closed by
`>` ends the page. Every row gets a row, repeated or null ids included; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_BYTES, limit_batches, materialise, release

LIMIT, DECAY, SHARE, MIN_PAGES = 0.2, 0.9, 0.6, 4
#: Parts that a host's pages are joined in where its removed branches are too many to broadcast.
SALTS = 64

# fixed values: kinds of HTML elements, and names of branches that are no article text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HIDDEN = frozenset("head form script style noscript template iframe object embed svg math canvas audio video button select textarea input dialog noembed noframes xmp title".split())
NOISE_TAGS = HIDDEN | frozenset("nav footer aside menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads ad-box advert adverts advertisement sponsored promo sidebar navbar menu breadcrumb breadcrumbs cookie-banner cookie-consent cookie-notice notice popup newsletter subscribe share-buttons social related-posts comment comments comment-list comment-section reader-comments disqus_thread respond pagination".split()
)
#: Elements that are taken by their class or id.
CONTAINERS = frozenset("article aside center dd details dialog dir div dl fieldset figure footer header li nav ol section table ul".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentarea discussion discussions disqus replies reply respond responses".split())
SIGNING_WORDS = frozenset("author avatar byline commenter date datetime nick nickname posted time timestamp user username vcard".split())
PROTECTED = frozenset("#root html body article main".split())
BARRIERS = frozenset("article main td th table".split())
CLOSES_P = BLOCK - frozenset("html head body caption option optgroup legend tbody td tfoot th thead tr title".split())
P_SCOPE = ("article", "section", "div", "td", "th", "li", "button", "body", "main", "blockquote")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "optgroup": ("select",), "tbody": ("table",), "tfoot": ("table",)}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_STOP = re.compile(r"""[>"']""")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_DIGITS = re.compile(r"\d{2,}")
_PARTS = re.compile(r"[-_:]+")
_SIGNED = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/. ]+\w{3,9}\.?[-/., ]+\d{4}|\w{3,9}\.? \d{1,2},? \d{4}|\d{1,2}:\d{2}|\bago\b|\b(?:says|said|wrote|writes|replied|schrieb|sagt|dit|dice)\b|^\s*(?:by|von|par|por)\s", re.I)
#: A signing text has so many characters at most.
SIGNATURE = 60


class Node:
    """An element: key is the hash of its path, names are whole classes and ids, and roles as role=..."""

    __slots__ = ("key", "kids", "names", "tag")

    def __init__(self, tag: str, key: int, names: frozenset[str] = frozenset()):
        self.tag, self.key, self.names, self.kids = tag, key, names, []


def digest(text: str, seed: int = 0) -> int:
    """A 64-bit hash of a text after what has been hashed before."""
    return int.from_bytes(hashlib.blake2b(seed.to_bytes(8, "little", signed=True) + text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Keys(dict):
    """(key of the parent, label) -> key of a path."""

    def __missing__(self, pair: tuple[int, str]) -> int:
        if len(self) > 100_000:
            self.clear()
        key = self[pair] = digest(pair[1], pair[0])
        return key


_keys = _Keys()


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, outside quoted values; -1 if there is none. An unclosed quote is an ordinary sign."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        before = at - 2
        while before > 0 and page[before].isspace():
            before -= 1
        if page[before] == "=":
            close = page.find(m[0], at)
            if close >= 0:
                at = close + 1
            else:
                return page.find(">", at)
    return -1


def parse(page: str) -> Node:
    """The page's element tree; kids are nodes and strings (still with character references)."""
    root = Node("#root", 0)
    stack, at = [root], 0
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    barriers: list[int] = []

    def cut(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop().tag
            where[tag].pop()
            if tag in BARRIERS:
                barriers.pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    while True:
        m = _OPEN.search(page, at)
        if m is None:
            if page[at:]:
                stack[-1].kids.append(page[at:])
            return root
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        if m[3]:  # comments, declarations, stray ends
            if page.startswith("<!--", m.start()):
                body = m.start() + 4
                short = 1 if page.startswith(">", body) else 2 if page.startswith("->", body) else 0
                end = None if short else _COMMENT_END.search(page, body)
                at = body + short if short else end.end() if end else len(page)
            else:
                at = page.find(">", m.end()) + 1 or len(page)
            continue
        close = _tag_end(page, m.end())
        if close < 0:
            return root
        tag, rest, at = m[2].lower(), page[m.end() : close], close + 1
        if m[1]:
            place = last((tag,))
            # a stray inline end tag closes nothing outside
            if place and not (tag not in BLOCK and barriers and barriers[-1] > place):
                cut(place)
            continue
        if tag in CLOSES_P and (place := last(("p",))) > last(P_SCOPE):
            cut(place)
        if tag in CLOSES and (place := last(CLOSES[tag])) > last(SCOPES[tag]):
            cut(place)
        names, roles = set(), set()
        if "=" in rest:
            for a in _ATTR.finditer(rest):
                value = (a[2] or a[3] or a[4] or "").lower()
                (roles if a[1].lower() == "role" else names).update(value.split())
        label = tag + "".join("." + x for x in sorted(_DIGITS.sub("0", n) for n in names)) if names else tag
        node = Node(tag, _keys[stack[-1].key, label], frozenset(names | {f"role={r}" for r in roles}) if names or roles else frozenset())
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            node.kids.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else stop
            at = at or len(page)
        elif tag not in VOID and (tag in BLOCK or not rest.rstrip().endswith("/")):
            where[tag].append(len(stack))
            if tag in BARRIERS:
                barriers.append(len(stack))
            stack.append(node)


def by_meaning(node: Node, inside: bool) -> bool:
    """No article text by its tag or role; inside: the node lies in an article."""
    if node.tag in NOISE_TAGS or node.tag == "header" and not inside:
        return True
    return bool(node.names) and node.tag not in PROTECTED and any(n[:5] == "role=" and n[5:] in NOISE_ROLES for n in node.names)


def by_name(node: Node) -> bool:
    """A container that is no article text by a whole class or id."""
    return bool(node.names) and node.tag in CONTAINERS and not NOISE_NAMES.isdisjoint(node.names)


def _has(node: Node, words: frozenset[str], last: bool = False) -> bool:
    """A class or id has one of the words as a part (last: as its last part)."""
    return any(not words.isdisjoint(_PARTS.split(n)[-1:] if last else _PARTS.split(n)) for n in node.names)


class Talk:
    """The reader comments of a page: `nodes` are the branches that hold them, `paths` the keys of their items.

    One pass notes for each element the characters before and in it, whether it is signed, and whether it holds what marks main text. Then siblings of one
    tag that share a class (or have none) are a run from the first on that has the main text before it: they are signed, or, beside a
    page's articles, each starts with a short text of its own; what comes before them is twice as long as one of them, and if that holds like siblings, those
    are three times as long. Where a run fills its parent, the parent goes; else the heading right before it goes along.
    """

    def __init__(self, tree: Node, known: frozenset[int] = frozenset()):
        self.nodes: set[int] = set()
        self.paths: set[int] = set()
        self.known = known
        # by node: characters before, characters in it, signed, holds main text, starts with a short text in an element of its own
        facts: dict[int, tuple[int, int, bool, bool, bool]] = {}
        self.facts = facts
        open_: list[list] = []
        todo: list[tuple[Node | str, bool]] = [(tree, False)]
        at, in_article, last_article, parents = 0, 0, -1, []
        while todo:
            item, closing = todo.pop()
            if isinstance(item, str):
                n = len(item) if not item.isspace() else 0
                top = open_[-1]
                if n and top[4] is None:
                    top[4] = False
                at += n
                if n and n <= SIGNATURE and _SIGNED.search(item):
                    top[2] = True
            elif closing:
                _, start, signed, main, lead = open_.pop()
                chars = at - start
                facts[id(item)] = start, chars, signed, main, bool(lead)
                if item.tag == "article":
                    in_article -= 1
                    last_article = at
                if open_:
                    up = open_[-1]
                    up[2] |= signed
                    up[3] |= main or item.tag in ("h1", "main") or item.tag == "article" and not _has(item, COMMENT_WORDS, True)
                    if up[4] is None and chars:
                        up[4] = chars <= SIGNATURE if item.tag not in ("h1", "h2", "h3") and not lead else lead
            elif by_meaning(item, in_article > 0) or by_name(item):
                continue
            else:
                in_article += item.tag == "article"
                signs = item.tag == "time" or bool(item.names) and _has(item, SIGNING_WORDS)
                open_.append([item, at, signs, False, None])
                todo.append((item, True))
                todo += [(k, False) for k in reversed(item.kids)]
                if any(not isinstance(k, str) and k.tag in CONTAINERS for k in item.kids):
                    parents.append((item, in_article > 0))
        for node, inside in parents:
            self._judge(node, inside, last_article)

    def _judge(self, parent: Node, inside: bool, last_article: int) -> None:
        facts, kids = self.facts, [k for k in parent.kids if not isinstance(k, str) and id(k) in self.facts]
        groups: dict[tuple[str, str], list[Node]] = defaultdict(list)
        gone: list[Node] = []
        for k in kids:
            if k.tag not in CONTAINERS:
                continue
            start, chars, signed, main, _ = facts[id(k)]
            if k.names and not main and start > 0 and _has(k, COMMENT_WORDS, k.tag == "article") or k.key in self.known and signed and start >= 2 * chars:
                gone.append(k)
            for n in {_DIGITS.sub("0", n) for n in k.names} or ("",):
                groups[k.tag, n].append(k)
        for group in groups.values():
            if len(group) < 2:
                continue
            beside = not inside and 0 <= last_article <= facts[id(group[-1])][0]
            first = len(group)
            while first and (facts[id(group[first - 1])][2] or beside and facts[id(group[first - 1])][4]):
                first -= 1
            while first <= len(group) - 2:
                run, earlier = group[first:], group[:first]
                mean = sum(facts[id(k)][1] for k in run) / len(run)
                before = facts[id(run[0])][0]
                longer = not earlier or sum(facts[id(k)][1] for k in earlier) / len(earlier) >= 3 * mean
                if mean and before >= 2 * mean and longer and not any(facts[id(k)][3] for k in run):
                    gone += run
                    self.paths.update(k.key for k in run)
                    break
                first += 1
        if not gone:
            return
        picked = {id(k) for k in gone}
        held = sum(facts[id(k)][1] for k in kids if id(k) in picked)
        _, chars, _, main, _ = facts[id(parent)]
        if parent.tag in CONTAINERS and parent.tag != "article" and not main and 5 * held >= 4 * (chars - sum(facts[id(k)][1] for k in kids if k.tag in HEADINGS)):
            self.nodes.add(id(parent))
            return
        for before, k in zip([None, *kids], kids, strict=False):
            if id(k) in picked:
                self.nodes.add(id(k))
                if before is not None and before.tag in HEADINGS and before.tag != "h1":
                    self.nodes.add(id(before))


def roots(tree: Node, talk: Talk) -> list[Node]:
    """Outermost articles, else main elements, else the body or the whole tree."""

    def of(tags: tuple[str, ...]) -> list[Node]:
        out, todo = [], [tree]
        while todo:
            node = todo.pop()
            if id(node) in talk.nodes or by_meaning(node, False) or by_name(node):
                continue
            if node.tag in tags or "main" in tags and "role=main" in node.names:
                out.append(node)
            else:
                todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
        return out

    return of(("article",)) or of(("main",)) or of(("body",)) or [tree]


class Judgement:
    """What the style tree says of a host: paths removed anywhere, those removed outside the main region, and those of reader comments."""

    def __init__(self, low: list[int], weak: list[int], region: int, talk: list[int] = ()):
        self.low, self.weak, self.region, self.talk = frozenset(low), frozenset(weak), region, frozenset(talk)

    def removes(self, node: Node, inside: bool) -> bool:
        return node.tag not in PROTECTED and (node.key in self.low or not inside and node.key in self.weak)


def walk(top: Node, talk: Talk, judged: Judgement | None = None) -> list[str]:
    """Blocks of text below top, without what is no article text by meaning, by the style tree or, inside articles and without it, by name."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    # inside: 0 outside the main region, 1 in it, 2 in an article
    todo: list[tuple[Node | str | None, int]] = [(top, 0)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(html.unescape(item) if "&" in item else item)
        elif item.tag == "br":
            line.append(" ")
        else:
            block = item.tag in BLOCK
            if block:
                flush()
            if item is not top:
                if id(item) in talk.nodes:
                    continue
                if by_meaning(item, inside == 2) or (inside == 2 or judged is None) and by_name(item) or inside == 2 and item.tag == "article":
                    continue
                if judged is not None and inside < 2 and judged.removes(item, bool(inside)):
                    continue
            now = 2 if item.tag == "article" else max(inside, int(judged is not None and item.key == judged.region))
            if block:
                todo.append((None, 0))
            todo += [(k, now) for k in reversed(item.kids)]
    flush()
    return blocks


def extract(page: str, judged: Judgement | None = None) -> str:
    tree = parse(page)
    talk = Talk(tree, judged.talk if judged is not None else frozenset())
    blocks = walk(tree, talk, judged) if judged is not None else []
    if not blocks:
        tops = roots(tree, talk)
        blocks = [b for top in tops for b in walk(top, talk)] or [b for top in tops for k in top.kids if not isinstance(k, str) for b in walk(k, talk)]
    return "\n\n".join(blocks)


def measures(tree: Node) -> tuple[int, dict[int, list]]:
    """The page's digest, and by path [depth, tag is a heading, block kids, shape, content, characters] of its block elements outside articles.

    Digests are made from the leaves up, once for every element; elements of one path count as one sequence.
    """
    found: dict[int, list] = {}
    # an entry for each open element: shape, content, characters and block kids so far
    open_: list[list] = []
    todo: list[tuple[Node | str | None, Node | None, int, bool]] = [(tree, None, 0, False)]
    whole = 0
    while todo:
        item, closing, depth, inside = todo.pop()
        if closing is not None:
            shape, content, chars, kids = open_.pop()
            shape = digest(closing.tag, hash((shape,)))
            block = closing.tag in BLOCK or closing is tree
            if open_:
                up = open_[-1]
                up[0], up[2], up[3] = hash((up[0], shape)), up[2] + chars, up[3] + block
                if chars:
                    up[1] = hash((up[1], content))
            else:
                whole = content
            if block and chars and not inside:
                had = found.setdefault(closing.key, [depth, closing.tag in HEADINGS, 0, 0, 0, 0])
                had[2:] = had[2] + kids, hash((had[3], shape)), hash((had[4], content)), had[5] + chars
        elif isinstance(item, str):
            text = "".join(item.split())
            if text:
                up = open_[-1]
                up[1], up[2] = digest(text, up[1]), up[2] + len(text)
        elif item.tag not in HIDDEN:
            open_.append([0, 0, 0, 0])
            todo.append((None, item, depth, inside))
            deeper = inside or item.tag == "article"
            todo += [(k, None, depth + 1, deeper) for k in reversed(item.kids)]
    return whole, found


#: Stands for the depth in rows of paths that are runs of comments.
COMMENTS = -1
_MEASURED = "host string, path long, depth int, heading boolean, kids long, shape long, content long, chars long, page long"


def _style(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> a row for every path of a page."""
    for batch in batches:
        out = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = parse(page or "")
            whole, found = measures(tree)
            out += [(host, path, *of, whole) for path, of in found.items()]
            out += [(host, path, COMMENTS, False, 0, 0, 0, 0, whole) for path in Talk(tree).paths]
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "depth", "heading", "kids", "shape", "content", "chars", "page"])


def measured(pages: DataFrame) -> DataFrame:
    """A row for each path, shape and content of every different page; pages are (host, html) and parsed once."""
    rows = pages.select("host", "html").mapInArrow(_style, _MEASURED)
    # equal pages count once
    return materialise(rows.groupBy("host", "path", "shape", "content", "page").agg(*(F.max(c).alias(c) for c in ("depth", "heading", "kids", "chars"))), "paths")


def comment_paths(rows: DataFrame) -> DataFrame:
    """(host, talk) of hosts with paths that are runs of comments on two pages or more."""
    paths = rows.where(F.col("depth") == COMMENTS).groupBy("host", "path").agg(F.count_distinct("page").alias("n")).where("n > 1")
    return paths.groupBy("host").agg(F.collect_list("path").alias("talk"))


def style_tree(rows: DataFrame) -> DataFrame:
    """(host, path, pages, depth, heading, kids, presentation, content, importance, told) of the elements of every host's merged tree, over its
    pages of different text, from measured()."""
    rows = rows.where(F.col("depth") != COMMENTS)

    def entropy(of: str, name: str, *more) -> DataFrame:
        counted = rows.groupBy("host", "path", of).agg(F.count("*").alias("c"), *(m[0] for m in more))
        total = counted.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), *(m[1] for m in more))
        kept = [F.col(c) for c in total.columns if c not in ("n", "s")]
        return total.select(*kept, "n", F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.log("n") - F.col("s") / F.col("n")) / F.log("n"))).otherwise(1.0).alias(name))

    sums = [(F.sum(c).alias(c), F.sum(c).alias(c)) for c in ("kids", "chars")] + [(F.max(c).alias(c), F.max(c).alias(c)) for c in ("depth", "heading")]
    both = entropy("shape", "presentation", *sums).join(entropy("content", "content").drop("n"), ["host", "path"])
    both = both.withColumn("kids", F.col("kids") / F.col("n"))
    share = F.pow(F.lit(DECAY), F.col("kids"))
    return both.select("host", "path", F.col("n").alias("pages"), "depth", "heading", "kids", "presentation", "content", ((1 - share) * F.col("presentation") + share * F.col("content")).alias("importance"), (F.col("content") * F.col("chars")).alias("told"))


def judge(tree: DataFrame) -> DataFrame:
    """(host, low, weak, region) of every host with MIN_PAGES pages of different text."""
    whole = tree.where("path = 0").select("host", F.col("told").alias("all"), F.col("pages").alias("of")).where(F.col("of") >= MIN_PAGES)
    rows = tree.join(whole, "host")
    region = rows.where("told >= 0.5 * all and (path = 0 or kids > 0)").groupBy("host").agg(F.max_by(F.struct("path", F.col("told").alias("main")), F.struct("depth", "told", "path")).alias("r")).select("host", "r.*").withColumnRenamed("path", "region")
    rows = rows.join(region, "host").where(F.col("pages") >= MIN_PAGES)
    scaled = F.when(F.col("heading"), F.col("importance")).otherwise(F.col("importance") * F.least(F.lit(1.0), F.col("told") / (SHARE * F.col("main"))))
    rows = rows.withColumn("low", F.col("importance") < LIMIT).withColumn("weak", scaled < LIMIT).where("path <> 0")
    paths = lambda c: F.collect_list(F.when(F.col(c), F.col("path"))).alias(c)
    return region.select("host", "region").join(rows.groupBy("host").agg(paths("low"), paths("weak")), "host", "left")


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, made = [], {}
        for page, host, region, low, weak, talk in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
            if region is not None and host not in made:
                made[host] = Judgement(low or [], weak or [], region, talk or [])
            texts.append(extract(page or "", None if region is None else made[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    limit_batches(pages.sparkSession)
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    paths = measured(rows.where("host is not null"))
    judged = materialise(judge(style_tree(paths)).join(comment_paths(paths), "host", "left"), "judged")
    release(paths)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = judged.agg(F.coalesce(F.sum(F.length("host") + 8 * (size("low") + size("weak") + size("talk")) + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(judged), "host", "left")
    else:
        salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kinds = dict(pages.dtypes)
    out = out.select("page_id", "url", "html", "host", "region", "low", "weak", "talk")
    return out.mapInArrow(_extractor, f"page_id {kinds['page_id']}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
