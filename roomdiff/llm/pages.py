"""HTML extraction with a site style tree.

The pages of one host are laid over each other: a node of the tree is a path of tags with their class names. For each node the tree has
how many pages show it, in which presentation styles (the sequence of its children) and, for nodes with text, in how many pages each text
stands. Entropies of both give a node's importance; its composite importance adds that of its children, weighted by style. Nodes whose
composite importance is low are the same from page to page; they are taken out of each page of the host, with all that is below them.
Pages of a host whose nodes and texts are all the same are one page of the tree, however many rows or addresses have it.

A tree only sees repetition, so menus or adverts that change from page to page would pass. Elements that say what they are (nav, footer,
form, class names such as "advert" or "comments", hidden ones) are therefore noise on every host, and if a page has an article or a main
element only what is in it is content. A class name says what an element is by its last word ("left-sidebar", "related-posts", but not
"related-work" or "page-with-sidebar"); one that holds such a word elsewhere counts only for an element that is mostly links and has less than half
of the page's text. If all of an article, or of a page without one, would be noise, it is judged again without class names and forms.
"""

from __future__ import annotations

import collections
import html
import itertools
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomdiff.functions.stage import written
from roomdiff.llm.text import as_bytes, hash64, slices

LEAST_PAGES = 3             # a host's node is judged from so many pages on
LOW = 0.2                   # composite importance under which a branch goes
GAMMA = 0.9                 # weight of a node's children, to the power of its number of styles
SALT = 16                   # parts a host's pages are dealt to when they meet their tree

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt option optgroup legend summary".split())
IMPLIED_END = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
               "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
               "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}

# Elements, roles and words in class names or ids that say they are not the article.
NOISE_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea input label fieldset iframe object svg canvas audio video map dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOISE_WORDS = frozenset(("nav navbar navigation menu menubar topbar sidebar sidenav footer masthead ad ads adv advert adverts advertisement advertising adsense banner "
                         "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
                         "signup login comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations breadcrumb "
                         "breadcrumbs pagination pager toolbar widget widgets skip paywall disclaimer copyright toc adsbygoogle adbox adslot adunit outbrain taboola").split())
# Words that may follow the one that says what an element is, and words of names that tell of what an element holds.
PARTS_OF = frozenset(("a area bar block body bottom box btn button buttons card cards center col column container content entry feed fixed form group head heading holder icon icons "
                      "img inline inner item items label left link links list main media meta message new outer overlay panel post posts article articles right row section slot "
                      "stories story sticky strip text this title to top unit us wide wrap wrapper zone").split())
HOLDS = frozenset("with has no without layout grid columns template".split())
READERS = frozenset("comment comments commentlist disqus respond replies discussion related recommended recommendations".split())     # may hold articles that are not the page's
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = r"<(/?)([A-Za-z][^\s/>]*+)"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|" + NAME + r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|""" + NAME + r"([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
PARTS = re.compile(r"[A-Za-z]+")


def attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), html.unescape(value))
    return found


def named_for(name: str) -> tuple[str | None, bool]:
    """(the noise word that a class name or id ends in, it has a noise word elsewhere)."""
    words = [w.lower() for w in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
    if not NOISE_WORDS.intersection(words):
        return None, False
    if words[0] in HOLDS or "with" in words:
        return None, True
    last = len(words) - 1
    while last and words[last] in PARTS_OF and words[last] not in NOISE_WORDS:
        last -= 1
    return (words[last], False) if words[last] in NOISE_WORDS else (None, True)


def says_noise(tag: str, attrs: dict[str, str], lenient: bool = False) -> tuple[bool, bool, bool]:
    """(the element names itself as something other than the article, also if it holds an article or main element, its class names only hint at it).
    ``lenient`` looks at neither class names nor forms."""
    if tag in NOISE_TAGS and not (lenient and tag in ("form", "fieldset")):
        return True, tag != "form", False
    if not attrs:
        return False, False, False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return True, True, False
    role = attrs.get("role", "").lower()
    if role in NOISE_ROLES and not (lenient and role == "form"):
        return True, True, False
    if lenient or tag in ("html", "body", "article", "main"):
        return False, False, False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    found = [named_for(name) for name in names]
    ends = {word for word, _ in found if word}
    words = {w.lower() for name in names for w in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))}
    own_header = "header" in words and tag != "header" and not words & ({"article", "entry", "post", "content", "story"} | HOLDS)
    return bool(ends) or own_header, bool(ends & READERS), any(hint for _, hint in found)


@dataclass
class Node:
    """An open element: its path on the host's tree, and what holds for everything inside."""

    tag: str
    path: int
    noise: bool = False         # something other than the article
    firm: bool = False          # an article inside does not change that
    main: bool = False          # inside an article or main element
    low: bool = False           # below a branch of low importance
    safe: bool = False          # never a branch that goes
    heading: bool = False       # a heading or inside one
    children: list = field(default_factory=list)
    around: list | None = None  # text before an inline element that is noise
    hint: tuple | None = None   # blocks and characters of links before an element whose class names hint at noise


def read(page: str, low: frozenset = frozenset(), lenient: bool = False):
    """(blocks, nodes) of a page.

    blocks: (text, path, noise, inside article or main, below a path in ``low``, inside a heading), in page order; white space is single and outer is cut.
    nodes: (path, parent's path, depth, children's sequence, safe) of every element.
    ``lenient``: class names and forms are no noise.
    """
    stack, blocks, nodes, parts, hints = [Node("", 0)], [], [], [], []
    linked = 0                  # characters in links so far
    opened = collections.Counter()

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            blocks.append((text, top.path, top.noise, top.main, top.low, top.heading))

    def close(n):
        while len(stack) > n:
            node = stack[-1]
            if node.tag in BLOCK or node.around is not None:
                flush()
            if node.hint is not None:
                first, before = node.hint
                hints.append((first, len(blocks), linked - before, node.main))
            opened[node.tag] -= 1
            stack.pop()
            parts.extend(node.around or ())
            nodes.append((node.path, stack[-1].path, len(stack), _sequence(node.children), node.safe))

    def nearest(tags, stops=frozenset()):
        if not any(opened[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                break
        return 0

    def outermost(tags, stops):
        first = 0
        if not any(opened[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                first = i
        return first

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        parts.append(html.unescape(page[at:m.start() if m else len(page)]))
        if opened["a"]:
            linked += len(" ".join(parts[-1].split()))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        rest = m[3] or m[6] or ""
        if not tag:
            continue
        if m[1] or m[4]:
            if k := nearest((tag,)):
                close(k)
            elif tag == "br":
                parts.append(" ")
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            stack[-1].children.append(tag)
            continue
        if tag in CLOSES_P and (k := nearest(("p",), ("button", "table", "td", "th", "object"))):
            close(k)
        if tag in IMPLIED_END and (k := outermost(*IMPLIED_END[tag])):
            close(k)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = len(page) if end is None else (page.find(">", end.end()) + 1 or len(page))
            continue
        attrs = attributes(rest) if rest.strip() else {}
        up = stack[-1]
        noise, firm, hint = says_noise(tag, attrs, lenient)
        main = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        if tag == "header" and not up.main:
            noise = firm = True
        name = f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]{3,}', '0', attrs['class']).lower().split()))}" if attrs.get("class") else tag
        up.children.append(name)
        if tag in BLOCK:
            flush()
        path = _signed(hash64(f"{up.path}/{name}".encode()))
        node = Node(tag, path, noise or (up.noise and not (main and not up.firm and not up.main)), up.firm or (noise and (firm or up.main)), up.main or main,
                    up.low or path in low, tag in HEADINGS or main or tag in ("html", "body"), up.heading or tag in HEADINGS)
        if noise and tag not in BLOCK:
            node.around = parts[:]
            parts.clear()
        if hint and not node.noise and tag in BLOCK:
            node.hint = len(blocks), linked
        opened[tag] += 1
        stack.append(node)
    flush()
    close(1)
    if hints:
        upto = [0, *itertools.accumulate(0 if b[2] else len(b[0]) for b in blocks)]
        for first, end, links, inside in hints:
            own = upto[end] - upto[first]
            if 2 * own < upto[-1] and 2 * links > own:
                blocks[first:end] = [(b[0], b[1], b[2] or inside or not b[3], *b[3:]) for b in blocks[first:end]]
    return blocks, nodes


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _sequence(children: list[str]) -> int:
    """A presentation style: the children in their order, runs of one kind counted once."""
    runs = [c for k, c in enumerate(children) if not k or children[k - 1] != c]
    return _signed(hash64("|".join(runs).encode())) if runs else 0


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


OBSERVED = {"host": pa.string(), "path": pa.int64(), "parent": pa.int64(), "depth": pa.int32(), "safe": pa.bool_(), "kind": pa.int32(), "what": pa.int64()}
PAGE = 3                    # kind of a row that stands for a page: its print is the path, its key the parent


def shown(raw: bytes | None) -> set:
    """(path, parent, depth, safe, kind, what) of a page: its nodes' styles (kind 0), texts (kind 1) and the nodes themselves (kind 2)."""
    blocks, nodes = read(raw.decode()) if raw else ([], [])
    place = {path: (parent, depth, safe) for path, parent, depth, _, safe in nodes}
    seen = {(path, *place[path], 0, style) for path, _, _, style, _ in nodes}
    seen |= {(path, *at, 2, 0) for path, at in place.items()}
    seen |= {(path, *place[path], 1, _signed(hash64(text.encode()))) for text, path, *_ in blocks if path in place}
    return seen


def _rows(counts: dict, schema: dict, last: str) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in keys], t) for k, t in enumerate(schema.values())] + [pa.array(list(counts.values()), pa.int64())], names=[*schema, last])


def observed(pages: DataFrame) -> DataFrame:
    """(host, path, parent, depth, safe, kind, what, pages): for each node of each host and each of its styles (kind 0) or texts (kind 1),
    and for the node itself (kind 2), on how many different pages. Counted within each slice of pages before anything is shuffled.

    A page that a slice shows again is left out there. Pages found in several slices are read once more, and what they were counted for too
    often is taken off; only their keys meet the pages, by a join.
    """
    keyed = pages.select("host", "html", F.xxhash64("html").alias("key"))

    def run(batches):
        for part in slices(batches, 2048):
            counts, known = {}, set()
            for host, raw, key in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist()):
                seen = shown(raw)
                print_ = _signed(hash64(repr(sorted(seen)).encode()))
                if (host, print_) in known:
                    continue
                known.add((host, print_))
                counts[host, print_, key, 0, False, PAGE, 0] = 1
                for x in seen:
                    counts[host, *x] = counts.get((host, *x), 0) + 1
            yield _rows(counts, OBSERVED, "pages")

    def again(batches):
        for part in slices(batches, 2048):
            counts, done = {}, set()
            for host, raw, key, extra in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if (host, key) not in done:
                    done.add((host, key))
                    counts.update({(host, *x, key): -extra for x in shown(raw)})
            yield _rows(counts, OBSERVED | {"key": pa.int64()}, "pages")

    fields = "host string, path bigint, parent bigint, depth int, safe boolean, kind int, what bigint"
    found = written(keyed.mapInArrow(run, f"{fields}, pages bigint").groupBy(*OBSERVED).agg(F.sum("pages").alias("pages")), "observed_slices")
    often = written(found.filter(F.col("kind") == PAGE).groupBy("host", "path").agg(F.sum("pages").alias("n"), F.min("parent").alias("key")).filter("n > 1")
                    .select(F.col("host").alias("__host"), F.col("key").alias("__key"), (F.col("n") - 1).alias("extra")), "observed_often")
    met = keyed.join(often, (F.col("host") == F.col("__host")) & (F.col("key") == F.col("__key"))).select("host", "html", "key", "extra")
    off = met.mapInArrow(again, f"{fields}, key bigint, pages bigint").distinct().drop("key")
    return found.filter(F.col("kind") != PAGE).unionByName(off).groupBy(*OBSERVED).agg(F.sum("pages").alias("pages"))


def importance(seen: DataFrame) -> DataFrame:
    """(host, path, parent, depth, safe, m, styles, inner, content): of each node the pages m that show it, its number of styles, the entropy
    of its styles and the importance of its texts, both 1 if only one page shows the node, and content null without texts.

    A style's share p adds -p log_m p. A text on k of m pages has the entropy log k / log m; the importance of texts is 1 less their mean.
    """
    keys = ["host", "path", "parent", "depth", "safe"]
    styles = seen.filter("kind = 0")
    sums = styles.groupBy(*keys).agg(F.sum("pages").alias("shown"), F.count("*").alias("styles"), F.sum(F.col("pages") * F.log("pages")).alias("plogp"))
    texts = seen.filter("kind = 1").groupBy("host", "path").agg(F.count("*").alias("texts"), F.sum(F.log("pages")).alias("logs"))
    shown = seen.filter("kind = 2").groupBy("host", "path").agg(F.sum("pages").alias("m"))
    both = sums.join(shown, ["host", "path"]).join(texts, ["host", "path"], "left")
    log_m = F.log("m")
    inner = F.when(F.col("m") == 1, 1.0).otherwise((F.log("shown") - F.col("plogp") / F.col("shown")) / log_m)
    content = F.when(F.col("texts").isNotNull(), F.when(F.col("m") == 1, 1.0).otherwise(1 - F.col("logs") / F.col("texts") / log_m))
    return both.select(*keys, "m", "styles", inner.alias("inner"), content.alias("content"))


def shared_nodes(tree: DataFrame) -> DataFrame:
    """(host, parent, node, depth, safe, m, styles, inner, content): the nodes on two different pages or more, and for each of them that has
    children on a single page one row without a node, their sum. What is below a node on a single page is left out: it has the importance 1
    and nothing reads it."""
    single = F.col("m") == 1
    shared = tree.filter(~single).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    below = tree.filter(single).join(shared, (F.col("host") == F.col("__host")) & (F.col("parent") == F.col("__path")), "left_semi")
    sums = (below.groupBy("host", "parent").agg(F.max("depth").alias("depth"), F.sum("m").alias("m"))
            .select("host", "parent", F.lit(None).cast("bigint").alias("node"), "depth", F.lit(False).alias("safe"), "m", F.lit(1).cast("bigint").alias("styles"),
                    F.lit(1.0).alias("inner"), F.lit(None).cast("double").alias("content")))
    return tree.filter(~single).select("host", "parent", F.col("path").alias("node"), "depth", "safe", "m", "styles", "inner", "content").unionByName(sums)


def low_branches(tree: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """(host, low): for each host the paths whose composite importance is under ``low`` on ``least_pages`` pages or more.

    A group is the tree of one host's ``shared_nodes``. It grows with the nodes that two different pages or more have, not with those of
    single pages.
    """
    def solve(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
        above: dict = {}            # path -> [weight, weighted importance] of its children
        found = []
        for r in rows:
            if r["node"] is None:
                value = 1.0
            else:
                weight, total = above.get(r["node"], (0.0, 0.0))
                own = r["inner"] if r["content"] is None else r["content"] if not weight else max(r["inner"], r["content"])
                share = GAMMA ** r["styles"]
                if not weight and r["content"] is None:
                    continue        # no text in or below it: inline elements and the like
                value = own if not weight else (1 - share) * own + share * total / weight
                if r["m"] >= least_pages and value < low and not r["safe"]:
                    found.append(r["node"])
            weight, total = above.get(r["parent"], (0.0, 0.0))
            above[r["parent"]] = (weight + r["m"], total + r["m"] * value)
        if not found:
            return pa.table({"host": pa.array([], pa.string()), "low": pa.array([], pa.list_(pa.int64()))})
        return pa.table({"host": pa.array([key[0].as_py()]), "low": pa.array([sorted(found)], pa.list_(pa.int64()))})

    return shared_nodes(tree).groupBy("host").applyInArrow(solve, "host string, low array<bigint>")


def main_text(page: str, low: frozenset = frozenset()) -> str:
    """The article's blocks. If the tree would leave nothing, or nothing but headings, what the elements say of themselves decides alone; if that
    leaves nothing of an article or main element, or of a page, class names and forms are passed over."""
    def clear(lenient):
        blocks, _ = read(page, low, lenient)
        plain = [b for b in blocks if not b[2]]
        return plain, [b for b in plain if b[3]], any(b[3] for b in blocks)

    plain, inside, has_main = clear(False)
    if not inside and (has_main or not plain):
        all_plain, inside, _ = clear(True)
        plain = plain or all_plain
    plain = inside or plain
    left = [b for b in plain if not b[4]]
    return "\n\n".join(b[0] for b in (left if any(not b[5] for b in left) else plain))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: its article, blocks in page order with an empty line between them.

    Null and empty pages have an empty text. Pages without a host share the empty one. Repeated rows get a result each and count once
    among the pages of their host. Character references are decoded; white space inside a block is one space.
    """
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    seen = written(observed(plain), "observed")         # read several times below; the pages are parsed for it once
    branches = written(low_branches(written(importance(seen), "tree"), least_pages, low), "branches")
    salted = branches.select(F.col("host").alias("__host"), "low", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    dealt = plain.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALT)).cast("int"))
    met = dealt.join(salted, (F.col("host") == F.col("__host")) & (F.col("salt") == F.col("__salt")), "left").select("id", "url", "html", "low")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            texts = [main_text(raw.decode(), frozenset(drop or ())) if raw else "" for raw, drop in zip(as_bytes(part.column(2)), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    return met.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
