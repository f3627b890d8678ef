"""Main text of web pages: boosted trees over the nodes of the DOM, decoded so that no node contradicts its ancestors.

A node is described by its subtree (text, tags, links, density), its tag, the tokens of its attributes, its depth, its place among its siblings
and the nearest telling ancestor. Training has no labels but the pages' own markup: elements that name their purpose (``article``, ``nav``, a class
like ``sidebar``) label what is below them. Every training node comes three times: as it is, with tags, tokens and ancestors blanked, and with the
shape of another node, so that the trees learn from shape and from names, each alone. Decoding gives each subtree the cheapest of: all kept, all dropped, or mixed with a price; where a subtree is settled
as a whole, nothing inside it can differ.

The trees are fitted on nodes of at most ``PAGES`` pages chosen by hash, ``NODES`` nodes at most; every page is parsed whole in one pass, page by
page, without a shuffle. What a task holds is one chunk of pages.

Defined cases: a null html is empty; a page without text gives an empty string; unclosed, misnested and unknown tags are taken as
browsers mostly do; where no node is kept, all text that no element disowns is; a table without labelled nodes gets no trees, and the named purposes decide; repeated rows each give a row. An empty
table gives an empty table; very long pages are parsed whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import chunks

PAGES, NODES = 3_000, 40_000
# Element classes of HTML, and words by which pages name the purpose of an element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
HIDDEN = frozenset("head script style title textarea noscript template iframe noframes xmp svg select option button object audio video canvas datalist".split())
BLOCK = frozenset("address article aside blockquote body br center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body br html td th tr tbody thead tfoot li dd dt summary figcaption".split())
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
KEEP_TAGS = frozenset("article main".split())
DROP_TAGS = frozenset("nav header footer aside form menu dialog".split())
KEEP_WORDS = frozenset("article articlebody content contents entry main post prose story text".split())
DROP_WORDS = frozenset("""ad ads advert adverts advertisement advertising alert aside author banner bio breadcrumb breadcrumbs byline caption comment commentlist comments complementary consent contentinfo cookie cookies copyright
    disclaimer discussion disqus footer footnote form gdpr header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended register related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar warning widget widgets""".split())
COMMENT_WORDS = frozenset("comment commentlist comments discussion disqus replies reply respond".split())
LAYOUT_TAGS = frozenset("div section form table tr td span center".split())
KINDS = ("div section article main p li ul nav header footer aside form a h1 h2 h3 table td span b blockquote pre figure".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WIDTH = 20 + len(KINDS) + 16


def markup(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, rest) of every tag, and of comments and declarations with an empty name; each character is looked at a bounded number of times.

    A tag ends at the first > outside quotes. Where a quote stays open, this and all later tags end at the first >. What begins like a tag and never ends is no text.
    """
    at, n, quotes = 0, len(html), True
    while (at := html.find("<", at)) >= 0:
        following = html[at + 1:at + 2]
        m = NAME.match(html, at)
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif m:
            whole = QUOTED.match(html, m.end()) if quotes else None
            quotes = whole is not None
            end = whole.end() if whole else html.find(">", m.end()) + 1 or n
        elif following in ("!", "?") or (following == "/" and html.find(">", at) < 0):
            end = html.find(">", at) + 1 or n
        else:
            at += 1  # a less-than sign
            continue
        skip = yield (at, end, m[1], m[2], html[m.end():end - 1]) if m and html[end - 1] == ">" else (at, end, "", "", "")
        at = skip or end


class Page:
    """Nodes of one page in order of their opening tags, and its texts."""

    def __init__(self, html: str):
        self.parent, self.tag, self.words, self.depth, self.hidden = [-1], ["#root"], [()], [0], [False]
        self.texts: list[tuple[int, str]] = []  # (node, text); node -1 ends a block
        stack, open_, at, n = [0], Counter(), 0, len(html)

        def close(upto: int):
            while len(stack) > upto:
                name = self.tag[stack.pop()]
                open_[name] -= 1
                if name in BLOCK:
                    self.texts.append((-1, ""))

        def last(names: tuple[str, ...] | list[str], stop: tuple[str, ...] | list[str] = ()) -> int:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in names:
                    return k
                if self.tag[stack[k]] in stop:
                    break
            return 0

        tags = markup(html)
        tag = next(tags, None)
        while at < n:
            end = tag[0] if tag else n
            if end > at:
                self.texts.append((stack[-1], html[at:end]))
            if not tag:
                break
            _, at, slash, name, rest = tag
            tag = None
            raw = self._element(slash, name.lower(), rest, stack, open_, close, last) if name else ""
            if raw:  # its content is no markup
                finish = re.compile(rf"</{raw}\b", re.I).search(html, at)
                close(len(stack) - 1)
                at = html.find(">", finish.end()) + 1 or n if finish else n
            try:
                tag = tags.send(at)
            except StopIteration:
                tag = None
        close(1)
        self.texts = [(k, t) for k, t in self.texts if k < 0 or not self.hidden[k]]

    def _element(self, slash: str, name: str, rest: str, stack: list[int], open_: Counter, close, last) -> str:
        """Takes a tag in; gives the name of an element whose content is raw."""
        if slash:
            if open_[name] > 0:
                close(last((name,)))
            elif name in BLOCK:
                self.texts.append((-1, ""))
            return ""
        if name in CLOSES_P and open_["p"] > 0 and (k := last(("p",), ("td", "th", "button", "table"))):
            close(k)
        if name in IMPLIED:
            own, stop = (x.split() for x in IMPLIED[name])
            if any(open_[x] > 0 for x in own) and (k := last(own, stop)):
                close(k)
        if name in BLOCK:
            self.texts.append((-1, ""))
        if name in VOID:
            return ""
        words = tuple(w.lower() for a in ATTRIBUTE.finditer(rest) for w in TOKEN.findall(a[2])) if "=" in rest else ()
        node, up = len(self.tag), stack[-1]
        self.parent.append(up)
        self.tag.append(name)
        self.words.append(words)
        self.depth.append(self.depth[up] + 1)
        self.hidden.append(self.hidden[up] or name in HIDDEN or bool(re.search(r"\bhidden\b(?!\s*-)|display\s*:\s*none", rest, re.I)) if rest else self.hidden[up] or name in HIDDEN)
        if rest.endswith("/") and name not in RAW and name in ("svg", "path", "use", "g"):
            return ""
        stack.append(node)
        open_[name] += 1
        return name if name in RAW else ""

    def purpose(self, letters: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """1, -1 or 0 where an element itself says keep, drop or nothing; ``letters`` of each subtree, and those in links.

        The page as a whole says nothing, nor does a word or a form tag around an article that holds half of the page: names there speak of the layout.
        A word that keeps says nothing of a list of links. A word that drops, unless it speaks of comments, says nothing of running text that holds
        half of the page while elements that keep hold next to nothing elsewhere: a name alone does not take a page's only text.
        """
        n = len(self.tag)
        out = np.zeros(n, np.int64)
        inside = np.zeros(n, bool)
        for k in range(n - 1, 0, -1):
            inside[self.parent[k]] |= inside[k] or self.tag[k] in KEEP_TAGS
        half = 2 * letters >= letters[0]
        around = inside & half
        doubtful = []
        for k, (name, words) in enumerate(zip(self.tag, self.words)):
            kept, dropped = any(w in KEEP_WORDS for w in words), any(w in DROP_WORDS for w in words)
            if name in ("html", "body"):
                continue
            if name in KEEP_TAGS:
                out[k] = -1 if dropped and not kept else 1
            elif (name in DROP_TAGS or dropped) and not (around[k] and name in LAYOUT_TAGS):
                out[k] = -1
            elif kept and 2 * linked[k] <= letters[k]:
                out[k] = 1
            if out[k] < 0 and half[k] and name not in DROP_TAGS and letters[k] >= 400 and 3 * linked[k] < letters[k] and not COMMENT_WORDS.intersection(words):
                doubtful.append(k)
        if doubtful:
            top, under = np.zeros(n), out > 0
            for k in range(1, n):
                if out[k] > 0 and not under[self.parent[k]]:
                    top[k] = letters[k]
                under[k] |= under[self.parent[k]]
            for k in range(n - 1, 0, -1):
                top[self.parent[k]] += top[k]
            for k in doubtful:
                if 5 * (top[0] - top[k]) < letters[k]:
                    out[k] = 0
        return out

    def nearest(self, own: np.ndarray) -> np.ndarray:
        """The purpose of the nearest element, upwards from the node itself; a dropped part cannot be taken back below."""
        out = own.copy()
        for k in range(1, len(out)):
            up = out[self.parent[k]]
            if up < 0 or out[k] == 0:
                out[k] = up
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features [nodes, WIDTH], the nearest purpose, and each node's own letters."""
        n = len(self.tag)
        own = np.zeros((n, 6))  # letters, words, stops, letters in links, tags, paragraphs
        link = np.zeros(n, bool)
        for k in range(1, n):
            link[k] = link[self.parent[k]] or self.tag[k] == "a"
        for k, t in self.texts:
            if k >= 0 and (w := t.split()):
                size = sum(map(len, w))
                own[k] += (size, len(w), sum(x[-1] in ".!?,;:" for x in w), size * link[k], 0, 0)
        own[1:, 4] = 1
        own[:, 5] = [t == "p" for t in self.tag]
        letters = own[:, 0].copy()
        whole = own.copy()
        parent = np.array(self.parent)
        children = np.bincount(parent[1:], minlength=n)
        for k in range(n - 1, 0, -1):
            whole[parent[k]] += whole[k]
        rank = np.zeros(n)
        seen = np.zeros(n, np.int64)
        for k in range(1, n):
            rank[k] = seen[parent[k]]
            seen[parent[k]] += 1
        up = np.maximum(parent, 0)
        named = self.purpose(whole[:, 0], whole[:, 3])
        near = self.nearest(named)
        total = max(whole[0, 0], 1)
        x = np.zeros((n, WIDTH))
        x[:, 0] = np.log1p(whole[:, 0])
        x[:, 1] = whole[:, 0] / (whole[:, 4] + 1)
        x[:, 2] = whole[:, 3] / np.maximum(whole[:, 0], 1)
        x[:, 3] = whole[:, 2] / np.maximum(whole[:, 1], 1)
        x[:, 4] = whole[:, 0] / np.maximum(whole[:, 1], 1)
        x[:, 5] = whole[:, 0] / total
        x[:, 6] = whole[:, 0] / np.maximum(whole[up, 0], 1)
        x[:, 7] = np.log1p(whole[:, 4])
        x[:, 8] = np.log1p(whole[:, 5])
        x[:, 9] = np.minimum(self.depth, 50)
        x[:, 10] = np.log1p(children)
        x[:, 11] = np.log1p(children[up])
        x[:, 12] = rank / np.maximum(children[up] - 1, 1)
        x[:, 13] = np.log1p(letters)
        x[:, 14] = np.arange(n) / n
        x[:, 15] = link
        x[:, 16] = whole[:, 1] / np.maximum(whole[:, 5], 1)
        x[:, 17] = named
        x[:, 18] = near
        x[:, 19] = near[up]
        kinds = {name: 20 + k for k, name in enumerate(KINDS)}
        for k, (name, words) in enumerate(zip(self.tag, self.words)):
            if name in kinds:
                x[k, kinds[name]] = 1
            for w in words:
                x[k, 20 + len(KINDS) + sum(w.encode()) % 16] = 1
        return x, near, letters

    def decode(self, keep: np.ndarray, letters: np.ndarray, price: float = 2.0) -> np.ndarray:
        """Nodes whose own text stays, from each node's probability: every subtree is kept, dropped or, for a price, mixed."""
        n = len(self.tag)
        keep = np.clip(keep, 1e-4, 1 - 1e-4)
        weight = np.where(np.isin(self.tag, ("#root", "html", "body")), 0.0, 1.0 + np.log1p(letters))
        all_in, all_out = -weight * np.log(keep), -weight * np.log(1 - keep)
        own_in, own_out = all_in.copy(), all_out.copy()
        mixed = np.where(letters > 0, np.minimum(own_in, own_out), 0) + price
        best = np.zeros(n)
        for k in range(n - 1, -1, -1):
            best[k] = min(all_in[k], all_out[k], mixed[k])
            if k:
                up = self.parent[k]
                all_in[up] += all_in[k]
                all_out[up] += all_out[k]
                mixed[up] += best[k]
        state, out = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(n):
            above = state[self.parent[k]] if k else 0
            state[k] = above or (1 if all_in[k] <= min(all_out[k], mixed[k]) else -1 if all_out[k] <= mixed[k] else 0)
            out[k] = state[k] > 0 or (state[k] == 0 and own_in[k] <= own_out[k])
        return out

    def text(self, keep: np.ndarray) -> str:
        """Text of the kept nodes, or where they hold none, of the paragraphs that no element disowns; references are decoded inside each piece of text, not across tags."""
        if not any(k >= 0 and keep[k] and t.strip() for k, t in self.texts):
            paragraph = np.array(self.tag) == "p"
            link = np.array(self.tag) == "a"
            for k in range(1, len(self.tag)):
                paragraph[k] |= paragraph[self.parent[k]]
                link[k] |= link[self.parent[k]]
            size, linked = np.zeros(len(self.tag)), np.zeros(len(self.tag))
            for k, t in self.texts:
                if k >= 0:
                    size[k] += len("".join(t.split()))
                    linked[k] = size[k] * link[k]
            for k in range(len(self.tag) - 1, 0, -1):
                size[self.parent[k]] += size[k]
                linked[self.parent[k]] += linked[k]
            keep = paragraph & (self.nearest(self.purpose(size, linked)) >= 0)
        return " ".join("".join(" " if k < 0 else unescape(t) for k, t in self.texts if k < 0 or keep[k]).split())


class Trees:
    """Boosted regression trees on binned features for the logistic loss; each tree is complete with ``depth`` levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.depth, width = depth, x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        code = self._bin(x)
        rate_ = np.clip(y.mean(), 0.01, 0.99)
        self.start, self.trees = float(np.log(rate_ / (1 - rate_))), []
        z = np.full(len(y), self.start)
        offset = np.arange(width) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            split = []
            for level in range(depth):
                size = width * bins
                slot = (leaf[:, None] * size + offset + code).ravel()
                gs, hs = (np.bincount(slot, weights=np.repeat(v, width), minlength=(1 << level) * size).reshape(1 << level, width, bins).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs)**2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                top = gain.reshape(1 << level, -1).argmax(axis=1)
                f, b = top // bins, top % bins
                split.append((f, b))
                leaf = 2 * leaf + (code[np.arange(len(y)), f[leaf]] > b[leaf])
            gl, hl = (np.bincount(leaf, weights=v, minlength=1 << depth) for v in (g, h))
            value = -rate * gl / (hl + ridge)
            self.trees.append((split, value))
            z += value[leaf]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        code, row = self._bin(x), np.arange(len(x))
        z = np.full(len(x), self.start)
        for split, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, b in split:
                leaf = 2 * leaf + (code[row, f[leaf]] > b[leaf])
            z += value[leaf]
        return 1 / (1 + np.exp(-z))


def train(pages: DataFrame, html_col: str = "html", limit: int = PAGES, nodes: int = NODES) -> Trees | None:
    """Trees from the labelled nodes of a bounded sample, or None without nodes of both kinds."""
    order = F.xxhash64(F.lit(11), html_col)
    total = pages.count()
    share = int(min(1.0, 1.5 * limit / max(total, 1)) * (1 << 30))
    sample = pages.select(html_col).filter(F.col(html_col).isNotNull() & (F.pmod(order, F.lit(1 << 30)) < share)).orderBy(order).limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0).to_pylist():
                x, near, _ = Page(html).features()
                some = near != 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some].tolist(), pa.list_(pa.float64())), pa.array((near[some] > 0).astype(np.int8))], names=["x", "y"])

    got = sample.mapInArrow(run, T.StructType().add("x", T.ArrayType(T.DoubleType())).add("y", T.ByteType()))
    got = got.orderBy(F.xxhash64(F.lit(12), "x")).limit(nodes).toPandas()
    y = got["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(got["x"].tolist())
    blank, strange = x.copy(), x.copy()
    blank[:, 17:] = 0
    strange[:, :17] = x[np.random.default_rng(0).permutation(len(x)), :17]
    return Trees(np.vstack([x, blank, strange]), np.r_[y, y, y])


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", limit: int = PAGES) -> DataFrame:
    """The id columns with text and n_chars of every page."""
    trees = train(pages, html_col, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [h or "" for h in batch.column(0).to_pylist()]
            for a, b in chunks(htmls):
                dom = [Page(h) for h in htmls[a:b]]
                x, near, letters = zip(*(d.features() for d in dom))
                keep = trees.predict(np.vstack(x)) if trees else (1 + np.concatenate(near)) / 2
                edge = np.cumsum([0, *map(len, near)])
                texts = [d.text(d.decode(keep[i:j], n)) for d, i, j, n in zip(dom, edge, edge[1:], letters)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    used = pages.select(F.col(html_col).alias("__html"), *id_cols)
    return used.mapInArrow(run, used.drop("__html").schema.add("text", "string").add("n_chars", "long"))
