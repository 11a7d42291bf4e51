"""Main text of web pages: boosted trees over DOM nodes, decoded on the whole tree.

Every node, element or text run, gets the log-odds of holding main text from its tag,
attribute tokens, depth, and the density and link share of its subtree and siblings.
Decoding picks the most likely labels in which a node that holds main text has only
ancestors that do, by one pass up and one down the tree. The trees are trained here
on generated pages of many layouts, whose labels are known.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.dom import Tree, parse
from twinsieve.llm.shared import single_threaded

TAGS = ("#text", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "button", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "body", "html", "#root")
# Attribute words that tell what an element is for.
AGAINST = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip", "head": "header masthead banner logo site brand",
    "foot": "footer copyright legal colophon bottom", "side": "sidebar aside widget rail related recommended trending popular more tags",
    "note": "cookie consent notice alert gdpr modal popup overlay dialog warning", "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "form": "form search login signup subscribe newsletter register input button", "talk": "comment comments reply replies discussion disqus respond thread", "share": "share sharing social follow facebook twitter email print",
}
FOR = "article content main post entry body text story story page prose articlebody maincontent document"
GROUP = {w: k for k, words in enumerate(AGAINST.values()) for w in words.split()} | {w: len(AGAINST) for w in FOR.split()}
GROUPS = len(AGAINST) + 1
TAG_ID = {t: i for i, t in enumerate(TAGS)}
PUNCTUATION = (". ", ", ", "; ", ": ", "! ", "? ")


def features(trees: list[Tree]) -> np.ndarray:
    """One row per node of all trees, in order."""
    sizes = [len(t.tag) for t in trees]
    base = np.cumsum([0, *sizes])[:-1]
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.concatenate([np.array(t.parent) + b for t, b in zip(trees, base, strict=True)])
    roots = base
    parent[roots] = roots
    tag = np.array([TAG_ID.get(x, len(TAGS)) for t in trees for x in t.tag])
    depth = np.array([d for t in trees for d in t.depth])
    chars = np.array([len(x) if x else 0 for t in trees for x in t.text], float)
    linked = np.array([x for t in trees for x in t.linked], float)
    ends = np.array([sum(x.count(p) for p in PUNCTUATION[:2]) + (x[-1] in ".!?") if x else 0 for t in trees for x in t.text], float)
    words = np.zeros((len(tag), GROUPS), np.float32)
    row = 0
    for t in trees:
        for a in t.attrs:
            for w in a:
                k = GROUP.get(w)
                if k is not None:
                    words[row, k] = 1
            row += 1
    leaf = tag == 0
    count = np.ones(len(tag))
    total = np.stack([chars, linked, ends, leaf.astype(float), (chars > 80).astype(float), count, chars.copy()], axis=1)
    best = chars.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] != level]
        if len(level):
            np.add.at(total, parent[level], total[level])
            np.maximum.at(best, parent[level], best[level])
    above = words.copy()
    tag_above = np.zeros((len(tag), 6), np.float32)
    marks = [TAG_ID[x] for x in ("nav", "header", "footer", "aside", "form", "article")]
    for j, k in enumerate(marks):
        tag_above[:, j] = tag == k
    down = order[::-1]
    for level in np.split(down, np.flatnonzero(np.diff(depth[down])) + 1):
        level = level[parent[level] != level]
        above[level] = np.maximum(above[level], above[parent[level]])
        tag_above[level] = np.maximum(tag_above[level], tag_above[parent[level]])
    siblings = np.bincount(parent, minlength=len(tag)).astype(float)
    same = np.bincount(parent * (len(TAGS) + 1) + tag, minlength=len(tag) * (len(TAGS) + 1))
    all_chars = total[roots, 0][page] + 1
    start = np.cumsum(chars) - chars
    start -= start[roots][page]
    up = total[parent]
    log = np.log1p
    columns = [
        depth, log(total[:, 0]), total[:, 0] / all_chars, total[:, 1] / (total[:, 0] + 1), log(total[:, 0] / total[:, 5]), total[:, 2] / (total[:, 0] / 100 + 1), log(best),
        total[:, 3], total[:, 4] / (total[:, 3] + 1), log(total[:, 5]), start / all_chars, siblings[parent], same[parent * (len(TAGS) + 1) + tag] / siblings[parent],
        log(up[:, 0] / np.maximum(1, siblings[parent])), up[:, 1] / (up[:, 0] + 1), log(up[:, 0] / up[:, 5]), up[:, 4] / (up[:, 3] + 1), log(best[parent]), total[:, 0] / (up[:, 0] + 1), siblings,
    ]
    kinds = np.zeros((len(tag), 2 * len(TAGS)), np.float32)
    known = tag < len(TAGS)
    kinds[np.flatnonzero(known), tag[known]] = 1
    over = tag[parent]
    kinds[np.flatnonzero(over < len(TAGS)), len(TAGS) + over[over < len(TAGS)]] = 1
    return np.column_stack([*columns, words, above, tag_above, kinds]).astype(np.float32)


class Boosted:
    """Gradient-boosted regression trees on binned features, logistic loss; trees are complete and of one depth."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        self.feature, self.cut, self.value = [], [], []
        b, used = self.bins, [j for j, e in enumerate(edges) if len(e)]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), int), [], []
            for level in range(self.depth):
                n = 1 << level
                gain = np.full((n, x.shape[1], b), -np.inf)
                for j in used:
                    cell = node * b + code[:, j]
                    gs, hs = (np.bincount(cell, v, n * b).reshape(n, b) for v in (g, h))
                    gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    ok = (hl > 1) & (ht - hl > 1)
                    gain[:, j] = np.where(ok, gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge), 0)
                at = gain.reshape(n, -1).argmax(axis=1)
                f, c = at // b, at % b
                empty = gain.reshape(n, -1)[np.arange(n), at] <= 0
                # A node that is not split sends all its rows left.
                threshold = np.array([np.inf if empty[k] or c[k] >= len(edges[f[k]]) else edges[f[k]][c[k]] for k in range(n)])
                feature.append(f)
                cut.append(threshold)
                node = 2 * node + (x[np.arange(len(y)), f[node]] > threshold[node])
            gs, hs = (np.bincount(node, v, 1 << self.depth) for v in (g, h))
            value = self.rate * gs / (hs + self.ridge)
            score += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (x[rows, f[node]] > c[node])
            out += value[node]
        return out


def decode(parent: list[int], score: list[float]) -> list[bool]:
    """The labels of greatest total score in which each kept node's parent is kept."""
    gain = [0.0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        # Kept: its score and the best of its children; dropped: all below is dropped.
        gain[i] = max(0.0, score[i] + gain[i])
        if i:
            gain[parent[i]] += gain[i]
    keep = [False] * len(parent)
    for i in range(len(parent)):
        keep[i] = gain[i] > 0 and (i == 0 or keep[parent[i]])
    return keep


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p or "") for p in pages]
    score = model.log_odds(features(trees)).tolist() if trees else []
    out, at = [], 0
    for t in trees:
        n = len(t.tag)
        keep = decode(t.parent, score[at : at + n])
        at += n
        out.append("\n\n".join(x for x, k in zip(t.text, keep, strict=True) if k and x))
    return out


class _Pages:
    """Generates pages; text of the article begins with a mark that the labels are read from."""

    MARK = "\u2063"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioutnrsldmé") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(4, 22).capitalize() + self.r.choice((".", ".", ".", "?", "!")) for _ in range(self.r.randint(a, b)))

    def name(self, words: str, neutral: float = 0.2) -> str:
        r = self.r
        if r.random() < neutral:
            return r.choice(("", f' class="c{r.randint(1, 99)}"', f' id="x{r.randint(1, 99)}"', ' class="row col-8"', ' class="box"'))
        w = r.choice(words.split())
        style = r.choice((w, w, f"{w}-{r.choice(('box', 'wrap', 'inner', 'list', 'area', 'block'))}", f"site-{w}", f"{w}s"))
        return f' {r.choice(("class", "class", "id"))}="{style}"'

    def links(self, a: int, b: int) -> str:
        r = self.r
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(r.randint(a, b))]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<p>" + " ".join(items) + "</p>"))()

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            t = r.choice(("nav", "nav", "div", "ul"))
            inner = self.links(3, 12)
            return f"<{t}{self.name(AGAINST['menu'], 0.6 if t == 'nav' else 0.15)}>{inner}</{t}>"
        if kind == "head":
            t = r.choice(("header", "header", "div"))
            return f"<{t}{self.name(AGAINST['head'], 0.5 if t == 'header' else 0.15)}>{r.choice((f'<h1>{self.words(1, 4)}</h1>', f'<a href=/>{self.words(1, 3)}</a>', f'<p>{self.words(2, 9)}</p>'))}{r.choice(('', self.part('menu'), self.part('form')))}</{t}>"
        if kind == "foot":
            t = r.choice(("footer", "footer", "footer", "div"))
            body = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>&copy; 20{r.randint(10, 29)} {self.words(2, 8)}</p>", self.links(2, 8) + f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 4)))
            return f"<{t}{self.name(AGAINST['foot'], 0.7 if t == 'footer' else 0.1)}>{body}</{t}>"
        if kind == "side":
            t = r.choice(("aside", "aside", "div", "section"))
            body = r.choice((self.links(3, 9), f"<p>{self.sentences(1, 4)}</p>", f"<h3>{self.words(1, 4)}</h3>{self.links(3, 8)}", f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 3)}</p>"))
            return f"<{t}{self.name(AGAINST['side'], 0.5 if t == 'aside' else 0.05)}>{body}</{t}>"
        if kind == "talk":
            one = lambda: f"<{u}{self.name('comment reply', 0.3)}>{r.choice(('', f'<b>{self.words(1, 2)}</b> '))}<p>{self.sentences(1, 4)}</p></{u}>"
            t, u = r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "article")))
            return f"<{t}{self.name('comments comment discussion replies respond disqus', 0.02)}>{r.choice(('', f'<h3>{self.words(1, 3)}</h3>'))}{''.join(one() for _ in range(r.randint(1, 6)))}</{t}>"
        if kind == "form":
            return f"<form{self.name(AGAINST['form'], 0.5)}><label>{self.words(1, 3)}</label><input name=q>{r.choice(('', f'<p>{self.sentences(1, 2)}</p>', f'<select><option>{self.words(1, 2)}</option></select>'))}<button>{self.words(1, 2)}</button></form>"
        t = r.choice(("div", "div", "section", "aside", "p"))
        body = r.choice((self.sentences(1, 3), self.words(1, 6), f"<p>{self.sentences(1, 2)}</p>" if t != "p" else self.sentences(1, 2), f'<a href="#">{self.words(2, 7)}</a>'))
        return f"<{t}{self.name(AGAINST[kind], 0.03)}>{body}</{t}>"

    def block(self) -> str:
        r, m = self.r, self.MARK
        k = r.random()
        if k < 0.62:
            s = self.sentences(1, 9) if r.random() < 0.85 else self.words(1, 4) + "."
            if r.random() < 0.2:
                s = s.replace(" ", f' <a href="/x">{self.words(1, 3)}</a> ', 1)
            if r.random() < 0.12:
                return f"<p><b>{m}{s}<br>"
            return f"<p>{m}{s}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.74:
            t = r.choice(("h2", "h2", "h3", "h4"))
            return f"<{t}>{m}{self.words(1, 9)}</{t}>"
        if k < 0.84:
            t = r.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li>{m}{self.words(2, 25)}{r.choice(('', '.'))}</li>" for _ in range(r.randint(2, 7))) + f"</{t}>"
        if k < 0.9:
            return f"<blockquote><p>{m}{self.sentences(1, 4)}</p></blockquote>"
        if k < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k < 0.97:
            return f"<pre>{m}{self.words(5, 30)}</pre>"
        return f'<figure><img src="a.png"><figcaption>{m}{self.words(3, 14)}</figcaption></figure>'

    def page(self) -> str:
        r, m = self.r, self.MARK
        blocks = [f"<h1>{m}{self.words(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((r.randint(1, 3), r.randint(2, 12), r.randint(5, 30)))):
            blocks.append(self.block())
            if r.random() < 0.06:
                blocks.append(self.part(r.choice(("ad", "share", "form", "side", "note"))))
        if r.random() < 0.1:
            blocks.append(self.part("share"))
        t = r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        body = f"<{t}{self.name(FOR, 0.75 if t in ('article', 'main') else 0.25)}>" + "".join(blocks) + f"</{t}>"
        for _ in range(r.randint(0, 2)):
            body = f"<{r.choice(('div', 'main', 'section'))}{self.name('content main wrapper container page', 0.5)}>{body}</div>" if r.random() < 0.5 else body
        pick = lambda kinds, p: "".join(self.part(k) for k in kinds if r.random() < p)
        before = [self.part(k) for k, p in (("head", 0.6), ("menu", 0.85), ("note", 0.3), ("ad", 0.5), ("side", 0.2), ("form", 0.2)) if r.random() < p]
        r.shuffle(before)
        after = pick(("share", "ad"), 0.25) + pick(("talk",), 0.35) + pick(("side", "form"), 0.3) + pick(("note",), 0.15) + pick(("foot",), 0.9)
        if t == "td":
            body = f"<table><tr><td>{self.links(3, 9)}</td>{body}</tr></table>"
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- x -->{body}{after}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled(count: int, seed: int) -> tuple[list[Tree], np.ndarray]:
    """Parsed pages, and for each node whether it holds text of the article."""
    made = _Pages(seed)
    trees, labels = [], []
    for _ in range(count):
        t = parse(made.page())
        y = [bool(x) and made.MARK in x for x in t.text]
        t.text = [x.replace(made.MARK, "") if x else x for x in t.text]
        for i in range(len(y) - 1, 0, -1):
            y[t.parent[i]] |= y[i]
        trees.append(t)
        labels += y
    return trees, np.array(labels, float)


@lru_cache(2)
def train(pages: int = 300, seed: int = 11) -> Boosted:
    single_threaded()
    trees, y = labelled(pages, seed)
    return Boosted().fit(features(trees), y)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars; one row per row.

    The whole html is read. Character references are decoded, white space within a
    block is one space, and blocks are joined by an empty line. Null or empty html, and
    pages without main text, give an empty text. Null ids and repeated rows are rows
    like others; other columns are ignored.
    """
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(train())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        single_threaded()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


