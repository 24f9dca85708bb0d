"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements
(tag with id and class). For each node the tree knows how varied its layout
(the tags of its children) and its content (its blocks of text) are over the
pages; template parts repeat, articles differ. Importance is measured by
entropy; blocks in nodes of low importance are removed from each page. Elements
whose tag or role says what they are (nav, footer and the like) are removed
everywhere, what a tag or role marks as the article is kept. Ids and classes
only weigh in: an element that a name calls noise (class "ad") goes unless it
holds nearly all that is important on the page, and a name that says article
lowers what its blocks must reach.

The tree is a table of counts, not an object per host: a page gives a row per
node and block, which are counted by (host, node, feature) and reduced to one
row per node. A host of a third of all pages is spread by its nodes and
features.
"""

import html
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import table
from mailspark.session import written

#: Branches below this importance go.
LEAST = 0.25

#: Blocks in elements whose name says article need so much only.
LEAST_NAMED = LEAST / 2

#: An element that a name calls noise stays if it holds so many times the
#: important text outside of such elements; that counts as often again in an
#: article.
OVERRULED = 4

#: Hosts whose different pages vary in less than this share of their text hold
#: copies of one page: nothing is judged there.
ALIKE = 0.02

#: Share of a node's importance that its layout makes up; content the rest.
LAYOUT = 0.1

#: Different pages of a host that a node must be seen on to be judged.
EVIDENCE = 4

#: Elements nested deeper are counted with their ancestor at this depth.
DEEPEST = 64

#: Elements that hold no article text.
NOISE_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea "
    "iframe object embed svg canvas audio video map menu dialog input label fieldset".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe title xmp".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion "
    "banner nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination header masthead "
    "topbar footer bottombar sidebar side aside widget widgets related recommended teaser share sharing "
    "social follow cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "dialog newsletter subscribe subscription signup login search form comment comments reply replies "
    "respond discussion disqus reactions skip toolbar copyright legal disclaimer tags tagcloud "
    "hidden".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "toolbar".split())
MAIN_WORDS = frozenset("article main maincontent entry post story content".split())
#: Names that begin so tell what an element goes with, not what it is.
MODIFIERS = frozenset("no not non without has have having with hide show".split())

#: An open element of one of these closes when a sibling or block starts.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"},
         "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'<>/]+)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _describe(tag, attributes):
    """(label of the node, says noise, says article) of a start tag: 2 by what
    it is, 1 by a name, else 0."""
    given = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes or ""):
        given.setdefault((name or bare).lower(), html.unescape(a or b or c))
    names = f"{given.get('id', '')} {given.get('class', '')}".split()
    words = {n.lower() for n in names}
    for name in names:
        parts = [w.lower() for w in WORD.findall(name)]
        if len(parts) < 2 or parts[0] not in MODIFIERS:
            words.update(parts)
    main = 2 if tag in ("article", "main") or given.get("role") in ("main", "article") \
        or given.get("itemprop") == "articleBody" else int(bool(words & MAIN_WORDS))
    noise = 2 if tag in NOISE_TAGS or given.get("role", "").lower() in NOISE_ROLES \
        or "hidden" in given or given.get("aria-hidden") == "true" \
        or "display:none" in given.get("style", "").replace(" ", "").lower() \
        else int(tag not in ("html", "body", "article", "main") and bool(words & NOISE_WORDS))
    label = (tag + "".join(f".{n}" for n in sorted(set(names)))).replace("/", "_")
    return label, noise, 0 if noise else main


def blocks(page):
    """(node path, text, says noise, in article) of each block of text of a
    page, in order, and the tags under each node: {path: child labels}.

    Noise is True by a tag or role, else the paths of the elements around the
    block, outermost first, that a name calls noise: none if it is empty. The
    article is 2 by a tag or role, 1 by a name, else 0.

    White space in a block becomes one space; br, block elements and their
    ends part blocks. Elements left open end where HTML ends them: p at the
    next block, li and table cells at the next of their kind.
    """
    out, layout, text = [], {}, []
    stack = []  # (tag, path, noise, main)
    outside = ("", "", (), 0)

    def flush():
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            _, path, noise, main = stack[-1] if stack else outside
            out.append((path, line, noise, main))

    def pop(depth):
        flush()
        del stack[depth:]

    def push(tag, label, noise, main):
        _, path, up_noise, up_main = stack[-1] if stack else outside
        layout.setdefault(path, []).append(label)
        if len(stack) < DEEPEST:
            path = f"{path}/{label}"
        layout.setdefault(path, [])
        if noise == 2 or up_noise is True:
            up_noise = True
        elif noise and path not in up_noise:
            up_noise += (path,)
        stack.append((tag, path, up_noise, max(main, up_main)))

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            text.append(page[at:])
            break
        text.append(page[at:found.start()])
        at = found.end()
        closing, opening, attributes = found.group(1), found.group(2), found.group(3)
        if closing:
            tag = closing.lower()
            if tag in ("br", "p") and not any(s[0] == tag for s in stack):
                flush()
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                pop(depth)
            elif tag not in INLINE_TAGS:
                flush()
        elif opening:
            tag = opening.lower()
            label, noise, main = _describe(tag, attributes)
            if tag in VOID_TAGS:
                if tag in ("br", "hr"):
                    flush()
                continue
            if tag in RAW_TAGS:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
                at = close.end() if close else end
                if tag not in INLINE_TAGS:
                    flush()
                continue
            # Inside an inline element that is noise, its kind is kept track of.
            if tag in INLINE_TAGS and not noise and all(s[0] != tag for s in stack):
                continue
            flush()
            if tag not in INLINE_TAGS:
                open_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if open_p is not None:
                    pop(open_p)
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in LISTS.get(tag, ()):
                        break
                    if stack[i][0] in CLOSES[tag]:
                        pop(i)
                        break
            push(tag, label, noise, main)
    pop(0)
    return out, layout


def _host(url):
    return re.sub(r"^[^/]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def _ancestors(path):
    parts = path.split("/")[1:]
    return ["/" + "/".join(parts[:i + 1]) for i in range(len(parts))]


PARSED = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("page", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.StringType())),
    T.StructField("layouts", T.ArrayType(T.LongType())), T.StructField("contents", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType()))])


def _hash(text):
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parse(batches):
    """Task code: a page to its blocks (packed), and the features that the
    tree counts: (node, hash of its layout), (node, hash of a block)."""
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
            found, layout = blocks(page if isinstance(page, str) else "")
            url = url if isinstance(url, str) else None
            kept = [(p, t, noise, main) for p, t, noise, main in found if noise is not True]
            paths = list(dict.fromkeys(p for p, _, _, _ in kept))
            number = {p: str(i) for i, p in enumerate(dict.fromkeys(
                [*paths, *(n for _, _, noise, _ in kept for n in noise)]))}
            body = "\n".join(f"{number[p]}\t{main}\t{','.join(number[n] for n in noise)}\t{t}"
                             for p, t, noise, main in kept)
            payload = zlib.compress("\x1e".join(["\n".join(number), body]).encode("utf-8", "replace"), 1)
            nodes, layouts, contents, lengths = [], [], [], []
            for p in dict.fromkeys(a for path in paths for a in _ancestors(path)):
                nodes.append(p)
                layouts.append(_hash("|".join(dict.fromkeys(layout.get(p, ())))))
                contents.append(None)
                lengths.append(None)
            # A block counts once a page.
            for p, t in dict.fromkeys((p, t) for p, t, _, _ in kept):
                nodes.append(p)
                layouts.append(None)
                contents.append(_hash(t))
                lengths.append(len(t))
            rows.append((None if page_id != page_id else page_id, url, _host(url), _hash(body), payload,
                         nodes, layouts, contents, lengths))
        yield pd.DataFrame(rows, columns=PARSED.names).astype({"page_id": "Int64"})


def node_importance(parsed):
    """(host, node, pages, importance) of the nodes of the merged tree of each
    host that enough pages have. Blocks elsewhere count for the nearest such
    node above them; where there is none, they aren't judged.

    Only different pages count, so copies of an article don't look like a
    template. Layout varies by the entropy of its forms over the pages of a
    node, to the base of the pages. A block seen on k of m pages is worth
    1 - log_m(k); content is the mean over the node's different blocks. A host
    whose pages hardly vary is left out.
    """
    # One page of each content per host: the one of least payload hash wins.
    distinct = parsed.groupBy("host", "page").agg(
        F.min_by(F.struct("nodes", "layouts", "contents", "lengths"), F.xxhash64("payload")).alias("p"))
    rows = distinct.select("host", F.explode(F.arrays_zip(
        F.col("p.nodes").alias("node"), F.col("p.layouts").alias("layout"),
        F.col("p.contents").alias("content"), F.col("p.lengths").alias("length"))).alias("r")).select("host", "r.*")
    counted = written(rows.groupBy("host", "node", "layout", "content").agg(
        F.count(F.lit(1)).alias("k"), F.max("length").alias("length")), "style-tree")
    m, k = F.col("pages"), F.col("k")
    seen = written(counted.filter("layout IS NOT NULL").groupBy("host", "node").agg(
        F.sum("k").alias("pages"), F.sum(k * F.log(k.cast("double"))).alias("klogk")), "seen-nodes")
    judged = seen.filter(m >= EVIDENCE)
    layout = judged.select("host", "node", "pages", (
        (F.log(m.cast("double")) - F.col("klogk") / m) / F.log(m.cast("double"))).alias("layout"))
    blocks = counted.filter("content IS NOT NULL")
    worths = [F.count(F.lit(1)).alias("blocks"), F.sum(F.log(k.cast("double"))).alias("logs")]
    # Nodes of too few pages, with the nearest judged node above them.
    parts = F.split("node", "/")
    above = seen.filter(m < EVIDENCE).select("host", "node", F.explode(F.filter(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
        lambda a: a != "")).alias("above"))
    homes = above.join(judged.select("host", F.col("node").alias("above")), ["host", "above"]).groupBy(
        "host", "node").agg(F.max_by("above", F.length("above")).alias("home"))
    strays = blocks.join(homes, ["host", "node"]).groupBy(
        "host", F.col("home").alias("node"), "content").agg(F.sum("k").alias("k"))
    content = (
        blocks.groupBy("host", "node").agg(*worths)
        .unionByName(strays.groupBy("host", "node").agg(*worths))
        .groupBy("host", "node").agg(F.sum("blocks").alias("blocks"), F.sum("logs").alias("logs"))
    )
    worth = F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("blocks") / F.log(m.cast("double")))
    alike = blocks.groupBy("host").agg(
        F.sum(F.col("length") * k).alias("all"), F.sum(F.when(k == 1, F.col("length")).otherwise(0)).alias("once")
    ).filter(F.col("once") < ALIKE * F.col("all")).select("host")
    return layout.join(content, ["host", "node"]).join(alike, "host", "left_anti").select(
        "host", "node", "pages",
        (LAYOUT * F.col("layout") + (1 - LAYOUT) * worth).alias("importance"))


@lru_cache(maxsize=64)
def _tree(listed):
    return {node: float(x) for node, x in (line.rsplit("\t", 1) for line in listed.split("\n"))} if listed else {}


def _joined(payload, listed):
    """Text of a page: the blocks whose node is important, without what names
    call noise; that is kept where it holds nearly all important text."""
    paths, _, body = zlib.decompress(payload).decode().partition("\x1e")
    tree, paths, known = _tree(listed), paths.split("\n"), {}

    def importance(i):
        if i not in known:
            path = paths[int(i)]
            while path and path not in tree:
                path = path[:path.rfind("/")]
            known[i] = tree.get(path, 1.0)
        return known[i]

    rows = []
    for line in body.split("\n") if body else []:
        i, main, named, text = line.split("\t", 3)
        found, named = importance(i), tuple(named.split(",")) if named else ()
        if found >= {"0": LEAST, "1": LEAST_NAMED, "2": 0}[main]:
            value = len(text) * max(found, LEAST) * (1 if named or main == "0" else OVERRULED)
            rows.append((text, named, value))
    stay = set()
    while True:
        plain, inside = 0, {}
        for _, named, value in rows:
            top = next((n for n in named if n not in stay), None)
            if top is None:
                plain += value
            else:
                inside[top] = inside.get(top, 0) + value
        top = max(inside, key=lambda n: (inside[n], n), default=None)
        if top is None or inside[top] <= OVERRULED * plain:
            break
        stay.add(top)
    return "\n".join(text for text, named, _ in rows if stay.issuperset(named))


def main_text(df, id_column="page_id"):
    """(page_id, url, text) of each row of ``df`` (page_id, url, html).

    Blocks of the article, one per line, character references decoded. Null
    and empty html gives an empty text; a null url counts as a host of its
    own; repeated rows come as often as they are given. Nothing is capped:
    blocks are dropped as noise only.
    """
    source = df.select(F.col(f"`{id_column}`").cast("long").alias("page_id"),
                       F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = written(source.mapInPandas(_parse, PARSED), "parsed-pages")
    tree = written(node_importance(parsed), "node-importance")
    # A host's list holds its judged nodes, not its pages; the pages are
    # streamed past it. Names hold no white space.
    lists = tree.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws("\t", "node", "importance"))), "\n").alias("tree"))

    @F.pandas_udf("string")
    def text(payload: pd.Series, tree: pd.Series) -> pd.Series:
        return pd.Series([_joined(p, x) for p, x in zip(payload, tree)], dtype=object)

    return (
        parsed.select("page_id", "url", "host", "payload").join(lists, "host", "left")
        .select("page_id", "url", text("payload", "tree").alias("text"))
    )


def op10_site_style_tree(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
