"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block and text run of a page is scored from its tag, attribute tokens, depth, the text, links and controls of its
subtree, and how it stands among its siblings. The trees' log-odds are decoded together: a node may be kept only if its
parent is, and the choice of highest total log-likelihood under that rule is found by one pass up and one pass down, so
no paragraph is kept inside a dropped menu and no container is kept for nothing.

The pages carry no labels, so the trees are trained on pages that ``training_pages`` invents: layouts of many kinds with
known main text. Training is bounded by ``PAGES`` and is the same for every corpus.

Defined cases: null or empty html has empty text; broken markup is read as far as it goes; text outside any element
counts as text of the page. Repeated rows give the same text. Only id, url and html columns are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm import boosting, html_dom

#: Invented pages to train on.
PAGES = 600
#: Characters of pages that are looked at together, and 256 pages at most.
AT_ONCE = 1 << 21
#: Stands before main text in invented pages.
MARK = "\x01"

TAGS = (
    "#text p div article section main nav header footer aside form ul ol li table td h1 h2 h3 h4 blockquote pre figure figcaption body dl dialog"
).split()
TAG_NO = {t: i for i, t in enumerate(TAGS)}
ABOVE = "nav header footer aside form ul table article main".split()
#: Attribute tokens by what pages use them for.
MAIN_WORDS = "article content post entry story main text body page single prose".split()
OTHER_WORDS = {
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split(),
    "side": "sidebar side widget related recommended popular trending rail".split(),
    "foot": "footer foot copyright legal colophon".split(),
    "head": "header head masthead topbar logo".split(),
    "note": "cookie cookies consent gdpr notice alert popup modal overlay".split(),
    "talk": "comment comments reply replies respond discussion disqus".split(),
    "form": "form login search newsletter subscribe signup register".split(),
    "share": "share social sharing follow".split(),
}
WORDS = [*MAIN_WORDS, *(w for words in OTHER_WORDS.values() for w in words)]
WORD_NO = {w: i for i, w in enumerate(WORDS)}


def subtree_sums(values: np.ndarray, parents: np.ndarray, by_depth: list[np.ndarray]) -> np.ndarray:
    """``values`` (rows: nodes) summed over each node's subtree, deepest level first."""
    total = values.astype(np.float64).copy()
    for nodes in reversed(by_depth[1:]):
        np.add.at(total, parents[nodes], total[nodes])
    return total


class Forest:
    """The nodes of many pages in arrays."""

    def __init__(self, pages: list[html_dom.Page]):
        sizes = np.array([len(p.tags) for p in pages], np.int64)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        offset = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = np.concatenate([np.array(p.parents, np.int64) for p in pages])
        self.parents = np.where(own < 0, -1, own + offset)
        self.first = np.cumsum(sizes) - sizes
        depth = np.zeros(len(own), np.int64)
        level, self.by_depth = np.flatnonzero(self.parents < 0), []
        children_of = np.argsort(self.parents, kind="stable")
        sorted_parents = self.parents[children_of]
        at = 0
        while len(level):
            depth[level] = at
            self.by_depth.append(level)
            lo, hi = np.searchsorted(sorted_parents, level), np.searchsorted(sorted_parents, level, side="right")
            spans = hi - lo
            steps = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            level = np.sort(children_of[np.repeat(lo, spans) + steps])
            at += 1
        self.depth = depth
        self.tag = np.array([TAG_NO.get(t, len(TAGS)) for p in pages for t in p.tags], np.int64)
        self.texts = [t for p in pages for t in p.texts]
        self.length = np.array([len(t) for t in self.texts], np.float64)
        self.words = np.array([t.count(" ") + 1 if t else 0 for t in self.texts], np.float64)
        self.stops = np.array([t.count(".") + t.count(",") if t else 0 for t in self.texts], np.float64)
        self.links = np.minimum(np.array([x for p in pages for x in p.links], np.float64), self.length)
        self.controls = np.array([x for p in pages for x in p.controls], np.float64)
        rows, cols, at = [], [], 0
        for p in pages:
            for tokens in p.tokens:
                for t in tokens:
                    if t in WORD_NO:
                        rows.append(at)
                        cols.append(WORD_NO[t])
                at += 1
        self.marks = np.zeros((len(own), len(WORDS)), np.float32)
        self.marks[rows, cols] = 1

    def features(self) -> np.ndarray:
        n, parent = len(self.parents), np.maximum(self.parents, 0)
        is_text = (self.tag == 0).astype(np.float64)
        sums = subtree_sums(np.stack([self.length, self.words, self.stops, self.links, self.controls, is_text, np.ones(n)], 1), self.parents, self.by_depth)
        length, words, stops, links, controls, runs, nodes = sums.T
        whole = length[self.first[self.page]]
        inside = np.zeros((n, len(ABOVE)))
        inherited = np.zeros((n, len(WORDS)), np.float32)
        for i, name in enumerate(ABOVE):
            inside[:, i] = self.tag == TAG_NO[name]
        inherited[:] = self.marks
        for level in self.by_depth[1:]:
            inside[level] = np.maximum(inside[level], inside[parent[level]])
            inherited[level] = np.maximum(inherited[level], inherited[parent[level]])
        child = self.parents >= 0
        siblings = np.bincount(self.parents[child], minlength=n)[parent].astype(np.float64)
        place = np.zeros(n)
        order = np.argsort(self.parents, kind="stable")
        starts = np.searchsorted(self.parents[order], self.parents[order])
        place[order] = np.arange(n) - starts
        same = np.bincount((parent * (len(TAGS) + 1) + self.tag)[child], minlength=n * (len(TAGS) + 1))[parent * (len(TAGS) + 1) + self.tag]
        kinds = np.array([self.marks[:, [WORD_NO[w] for w in words_]].max(1) for words_ in (MAIN_WORDS, *OTHER_WORDS.values())]).T
        above = np.array([inherited[parent][:, [WORD_NO[w] for w in words_]].max(1) for words_ in (MAIN_WORDS, *OTHER_WORDS.values())]).T
        columns = [
            self.tag, self.tag[parent], self.depth, np.log1p(length), np.log1p(words), links / np.maximum(length, 1), stops / np.maximum(words, 1),
            np.log1p(length / np.maximum(nodes, 1)), np.log1p(runs), length / np.maximum(whole, 1), length / np.maximum(length[parent], 1),
            np.log1p(controls), np.log1p(siblings), place / np.maximum(siblings, 1), same / np.maximum(siblings, 1),
            length * siblings / np.maximum(length[parent], 1), links[parent] / np.maximum(length[parent], 1), np.log1p(length[parent]),
        ]
        return np.column_stack([*columns, *(self.tag == i for i in range(len(TAGS))), inside, kinds, above, self.marks]).astype(np.float32)

    def decode(self, logit: np.ndarray) -> np.ndarray:
        """Which nodes to keep: the likeliest choice where a kept node's parent is kept."""
        yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
        drop = subtree_sums(no[:, None], self.parents, self.by_depth)[:, 0]
        keep = yes.copy()
        for nodes in reversed(self.by_depth[1:]):
            np.add.at(keep, self.parents[nodes], np.maximum(keep[nodes], drop[nodes]))
        kept = np.zeros(len(logit), bool)
        kept[self.by_depth[0]] = True  # the page itself
        for nodes in self.by_depth[1:]:
            kept[nodes] = kept[self.parents[nodes]] & (keep[nodes] > drop[nodes])
        return kept


def _invent(rng: random.Random) -> str:
    """One page. Main text is marked; everything else on it is not."""
    syllables = [rng.choice("bcdfglmnprstv") + rng.choice("aeiouéü") + rng.choice(["", "n", "r", "s"]) for _ in range(40)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def prose(words: int, mark: str = "") -> str:
        out = []
        for k in range(words):
            w = word() + (rng.choice([".", ",", ".", "!", "&amp;", "|", " %%%"]) if rng.random() < 0.12 else "")
            out.append(w.capitalize() if k == 0 else f"<{t}>{w}</{t}>" if rng.random() < 0.02 and (t := rng.choice(["b", "i", "em", "a href='#'", "span"]).split()[0]) else w)
        return mark + " ".join(out) + rng.choice([".", ".", ""])

    def attrs(kind: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        names = MAIN_WORDS if kind == "main" else OTHER_WORDS[kind]
        value = rng.choice(names) + rng.choice(["", "", "-" + rng.choice(["box", "area", "wrap", "inner", "x1"])])
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{word()}{" " + word() if rng.random() < 0.3 else ""}</a>' for _ in range(n)]
        if rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" ", " | ", ""]).join(items)

    semantic = rng.random() < 0.7
    tag = lambda name: name if semantic else "div"

    def wrap(name: str, kind: str, inner: str) -> str:
        t = tag(name)
        return f"<{t}{attrs(kind, 0.35 if t != 'div' else 0.97)}>{inner}</{t}>"

    def other(kind: str) -> str:
        if kind == "nav":
            return wrap("nav", "nav", links(rng.randint(2, 12)))
        if kind == "head":
            inner = rng.choice([f"<h1>{prose(2)}</h1>", f"<div>{prose(3)}</div>", f"<a href='/'>{word()}</a>"])
            return wrap("header", "head", inner + (other("nav") if rng.random() < 0.5 else ""))
        if kind == "foot":
            inner = rng.choice(["&copy; ", "", "(c) 2020 "]) + prose(rng.randint(3, 25)) + rng.choice(["", " &middot; " + prose(5)])
            return wrap("footer", "foot", rng.choice([inner, f"<p>{inner}</p>", links(4) + f"<p>{inner}</p>"]))
        if kind == "side":
            parts = [f"<h3>{prose(2)}</h3>" + rng.choice([links(rng.randint(3, 8)), f"<p>{prose(rng.randint(5, 40))}</p>"]) for _ in range(rng.randint(1, 3))]
            return wrap("aside", "side", "".join(parts))
        if kind == "note":
            return f"<{(t := rng.choice(['div', 'section', 'dialog']))}{attrs('note', 1)}>{rng.choice(['{}', '<p>{}</p>']).format(prose(rng.randint(5, 30)))} <button>{word()}</button></{t}>"
        if kind == "talk":
            said = "".join(f"<div{attrs('talk', 0.9)}><b>{word()}</b><p>{prose(rng.randint(4, 80))}</p></div>" for _ in range(rng.randint(1, 6)))
            box = f"<form><textarea></textarea><button>{word()}</button></form>" if rng.random() < 0.4 else ""
            return f"<{(t := rng.choice(['section', 'div', 'div', 'ol']))}{attrs('talk', 1)}><h3>{prose(2)}</h3>{said}{box}</{t}>"
        if kind == "form":
            return f"<form{attrs('form', 0.7)}>{rng.choice(['', '<p>' + prose(rng.randint(3, 15)) + '</p>', prose(4)])}<input><label>{word()}</label><button>{word()}</button></form>"
        if kind == "share":
            return f"<div{attrs('share', 1)}>{links(rng.randint(2, 5))}</div>"
        inner = rng.choice(["{}", "<p>{}</p>", "<a href='/'>{}</a>"]).format(prose(rng.randint(3, 30)))
        return f"<div{attrs('ad', 1)}>{inner}</div>"

    def main_block() -> str:
        roll, size = rng.random(), rng.choice([1, 2, 5, 12, 30, 60, 100, 160])
        if roll < 0.7:
            return f"<p>{prose(size, MARK)}" + rng.choice(["</p>", "</p>", "<br>" + prose(4, MARK) + "</p>", ""])
        if roll < 0.78:
            return f"<h{(n := rng.randint(2, 4))}>{prose(rng.randint(1, 6), MARK)}</h{n}>"
        if roll < 0.86:
            return "<ul>" + "".join(f"<li>{prose(rng.randint(1, 20), MARK)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if roll < 0.9:
            return f"<blockquote>{prose(size, MARK)}</blockquote>"
        if roll < 0.93:
            return f"<pre>{prose(size, MARK)}</pre>"
        if roll < 0.96:
            return "<table>" + "".join(f"<tr><td>{prose(2, MARK)}</td><td>{prose(3, MARK)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img><figcaption>{prose(6, MARK)}</figcaption></figure>"

    blocks = [main_block() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15, 30]))]
    if rng.random() < 0.85 or not blocks:
        blocks.insert(0, f"<h1>{prose(rng.randint(1, 12), MARK)}</h1>")
    for kind in ("ad", "share", "side", "form"):
        if rng.random() < 0.12:
            blocks.insert(rng.randint(0, len(blocks)), other(kind))
    if rng.random() < 0.15:
        blocks.append(other("talk"))
    body = "".join(blocks)
    shape = rng.random()
    if shape < 0.55:
        body = wrap("article", "main", body)
    elif shape < 0.75:
        body = wrap("main", "main", body)
    else:
        body = f"<div{attrs('main', 0.95)}>{body}</div>"
    if rng.random() < 0.25:
        body = rng.choice(["<main>{}</main>", "<div class='wrap'>{}</div>", "<section>{}</section>"]).format(body)
    before = [other(k) for k, p in (("note", 0.2), ("head", 0.45), ("nav", 0.6), ("form", 0.1), ("ad", 0.35)) if rng.random() < p]
    after = [other(k) for k, p in (("share", 0.15), ("side", 0.35), ("talk", 0.3), ("ad", 0.15), ("form", 0.15), ("foot", 0.75), ("note", 0.1)) if rng.random() < p]
    if rng.random() < 0.2:
        rng.shuffle(before)
    if after and rng.random() < 0.25:
        before.append(after.pop(0))
    page = "".join(before) + body + "".join(after)
    if rng.random() < 0.3:
        page = f"<div id='page'>{page}</div>"
    return f"<html><head><title>{prose(4)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def training_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [_invent(rng) for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> boosting.BoostedTrees:
    """Trees that tell nodes with main text in them from the rest."""
    pages = [html_dom.read(h) for h in training_pages()]
    main = np.array([float(MARK in t) for p in pages for t in p.texts])
    for p in pages:
        p.texts = [t.replace(MARK, "") for t in p.texts]
    forest = Forest(pages)
    label = subtree_sums(main[:, None], forest.parents, forest.by_depth)[:, 0] > 0
    return boosting.fit(forest.features().astype(np.float64), label.astype(np.float64))


def extract_texts(sources: list[str | None], model: boosting.BoostedTrees) -> list[str]:
    if not sources:
        return []
    pages = [html_dom.read(s or "") for s in sources]
    forest = Forest(pages)
    kept = forest.decode(model.logits(forest.features())) & (forest.tag == 0)
    parts: list[list[str]] = [[] for _ in sources]
    for node in np.flatnonzero(kept):
        parts[forest.page[node]].append(forest.texts[node])
    return [" ".join(p) for p in parts]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            sizes = np.cumsum(np.array([0 if h is None else len(h) for h in whole.column(2).to_pylist()], np.int64) + AT_ONCE // 256)
            cuts = np.flatnonzero(np.diff(sizes // AT_ONCE, prepend=-1))
            for at, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), whole.num_rows]):
                batch = whole.slice(at, stop - at)
                texts = extract_texts(batch.column(2).to_pylist(), model)
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(extracted, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
