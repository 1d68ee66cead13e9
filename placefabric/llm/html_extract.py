"""Main-text extraction: boosted trees over DOM-node features, decoded down the tree.

Every structural element gets features of its subtree (text density, links, controls, sentences), its attribute tokens,
its depth and its siblings. The trees give each node the odds of holding main text; decoding picks the labels of highest
joint likelihood in which a dropped node drops its whole subtree and a kept node has kept ancestors. The model is trained
here, on pages that a generator writes with known main text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placefabric.llm.arrays import memo
from placefabric.llm.boosting import Trees, fit
from placefabric.llm.dom import RAW, Node, clean, parse

TRAIN_PAGES = 500
TRAIN_SEED = 7
PART_CHARS = 4 << 20  # of pages that are judged together
_BAD = frozenset("nav navigation navbar menu menubar breadcrumb breadcrumbs footer foot header masthead banner sidebar side aside rail widget ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share social sharing related recommended recommendations comment comments respond reply replies discussion disqus form search pagination pager tags toolbar skip hidden contentinfo complementary copyright legal".split())
_GOOD = frozenset("article content contents main body post entry text story page articlebody hentry prose".split())
_GROUPS = (
    frozenset(("article", "main")), frozenset(("nav", "menu")), frozenset(("footer",)), frozenset(("header",)), frozenset(("aside",)), frozenset(("form", "fieldset", "input", "button", "label", "dialog")),
    frozenset(("p", "pre", "blockquote")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("ul", "ol", "dl")), frozenset(("li", "dt", "dd")), frozenset(("table", "tbody", "thead", "tr", "td", "th")), frozenset(("div", "section", "center")), frozenset(("html", "body", "#root")),
)


class Page:
    """Nodes in page order with what is counted for their subtrees. Texts keep the number of their block: a flat node's stand in its parent's."""

    def __init__(self, html: str):
        self.nodes: list[Node] = []
        self.up: list[int] = []
        self.blocks: list[tuple[int, str]] = []  # (node, text) in page order
        self.numbers: list[int] = []  # of the block of each
        stats: list[list[float]] = []
        stack: list[tuple] = [(parse(html, _BAD), -1)]
        block = 0
        while stack:  # depth first with explicit places, so that texts between children stay in order
            node, up = stack.pop()
            if node is None:
                block += 1
                continue
            if isinstance(node, tuple):
                text, linked = node
                self.blocks.append((up, text))
                self.numbers.append(block)
                n, own = len(text.strip()), stats[up]
                own[0] += n
                own[1] += n * linked
                own[4] += sum(text.count(c) for c in ".!?;:,")
                own[6] += n > 60
                continue
            k = len(self.nodes)
            self.nodes.append(node)
            self.up.append(up)
            stats.append([0.0, 0.0, 1.0, float(node.links), 0.0, float(node.tag == "input"), 0.0])  # chars, linked chars, tags, links, sentence ends, controls, paragraphs
            if node.tag in RAW:
                continue
            if not node.flat:
                block += 1
                stack.append((None, up))
            stack += [(c, k) for c in reversed(node.children)]
        self.stats = np.array(stats)
        self.total = self.stats.copy()
        for k in range(len(self.nodes) - 1, 0, -1):
            self.total[self.up[k]] += self.total[k]

    def features(self) -> np.ndarray:
        n = len(self.nodes)
        depth, bad, good = np.zeros(n), np.zeros(n), np.zeros(n)
        own_bad, own_good, in_head = np.zeros(n), np.zeros(n), np.zeros(n)
        kids: dict[int, list[int]] = {}
        groups = np.zeros((n, len(_GROUPS)))
        boiler = np.zeros(n)
        for k, node in enumerate(self.nodes):
            u = self.up[k]
            own_bad[k], own_good[k] = sum(t in _BAD for t in node.tokens), sum(t in _GOOD for t in node.tokens)
            for g, tags in enumerate(_GROUPS):
                if node.tag in tags:
                    groups[k, g] = 1
            in_head[k] = node.tag in ("head", *RAW)
            if u >= 0:
                depth[k] = depth[u] + 1
                bad[k], good[k], boiler[k] = bad[u] + own_bad[u], good[u] + own_good[u] + groups[u, 0], boiler[u]
                in_head[k] = max(in_head[k], in_head[u])
                kids.setdefault(u, []).append(k)
            boiler[k] += groups[k, 1] + groups[k, 2] + groups[k, 4] + groups[k, 5]
        chars, linked, tags, links, marks, controls, paragraphs = self.total.T
        whole = max(1.0, chars[0])
        same, place, beside, share = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for u, c in kids.items():
            c_ = np.array(c)
            place[c_] = (np.arange(len(c)) + 1) / (len(c) + 1)
            mean = chars[c_].mean()
            beside[c_] = np.log1p(mean)
            share[c_] = chars[c_] / max(1.0, chars[u])
            _, tag, count = np.unique([self.nodes[k].tag for k in c], return_inverse=True, return_counts=True)
            same[c_] = count[tag] / len(c)
        return np.column_stack([
            np.log1p(chars), np.log1p(chars / tags), linked / np.maximum(1, chars), np.log1p(links), np.log1p(marks), marks / np.maximum(1, chars), controls, np.log1p(paragraphs), chars / whole,
            depth, own_bad, own_good, bad, good, boiler, in_head, same, place, beside, share, np.log1p(self.stats[:, 0]), groups,
        ])


def decode(up: list[int], logit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Labels of highest joint likelihood such that below a dropped node all is dropped. The root is kept."""
    keep, drop = -np.logaddexp(0, -logit) * weight, -np.logaddexp(0, logit) * weight
    kept, dropped = keep.copy(), drop.copy()
    for k in range(len(up) - 1, 0, -1):
        kept[up[k]] += max(kept[k], dropped[k])
        dropped[up[k]] += dropped[k]
    out = np.zeros(len(up), bool)
    out[0] = True
    for k in range(1, len(up)):
        out[k] = out[up[k]] and kept[k] > dropped[k]
    return out


def _words(r: random.Random, n: int) -> str:
    syllables = ("an", "be", "co", "de", "er", "fu", "ga", "hi", "in", "jo", "ka", "lo", "mi", "no", "or", "pe", "qui", "ra", "st", "th", "un", "vo", "we", "ya")
    out = []
    for _ in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append(w + r.choice(("", "", "", "", "", ",", ".", ".")))
    return " ".join(out).capitalize()


def training_page(r: random.Random) -> str:
    """A page whose main text is written in elements with the token `mainmark`, which the features never see."""
    text = lambda a, b: _words(r, r.randint(a, b))
    junk = []
    links = lambda n: "".join(f'<li><a href="/{i}">{text(1, 3)}</a></li>' for i in range(n))
    attr = lambda *names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"'))

    def box(names: tuple[str, ...], inside: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = r.choice(tags)
        return f"<{tag}{attr(*names) if tag in ('div', 'section', 'ul') or r.random() < 0.5 else ''}>{inside}</{tag}>"

    nav = r.choice((f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", box(("menu", "nav", "navbar", "topmenu nav"), f"<ul>{links(r.randint(2, 9))}</ul>"), ""))
    header = r.choice(("", f"<header>{text(1, 6)}</header>", box(("header", "masthead", "banner"), f"<p>{text(2, 9)}</p>"), f"<header><h1>{text(2, 5)}</h1>{nav}</header>"))
    ad = lambda: r.choice(("", box(("ad", "ads", "advert", "sponsored", "promo"), r.choice((text(3, 30), f"<p>{text(3, 30)}</p>", f'<a href="/x">{text(2, 9)}</a>')))))
    notice = r.choice(("", "", box(("cookie-notice", "notice", "alert", "consent popup"), f"<p>{text(5, 25)}</p><button>{text(1, 2)}</button>")))
    form = r.choice(("", "", f"<form><p>{text(2, 8)}</p><input name=q><button>{text(1, 1)}</button></form>", box(("newsletter", "subscribe", "signup"), f"<form>{text(3, 12)}<input type=email></form>")))
    side = r.choice(("", "", f"<aside><h3>{text(1, 3)}</h3><p>{text(6, 30)}</p></aside>", box(("sidebar", "widget", "related"), f"<h3>{text(1, 3)}</h3><ul>{links(r.randint(2, 7))}</ul>"), box(("sidebar", "rail side"), f"<p>{text(8, 40)}</p>")))
    comments = r.choice(("", "", box(("comments", "comment-list", "discussion replies"), "".join(f'<div class="comment"><b>{text(1, 2)}</b><p>{text(4, 40)}</p></div>' for _ in range(r.randint(1, 6))), ("div", "section"))))
    footer = r.choice((f"<footer>&copy; {text(2, 14)}</footer>", box(("footer", "site-footer", "contentinfo legal"), f"<p>&copy; {text(2, 20)}</p>"), ""))
    # controls and adverts that stand inside a block of the main text
    inside = lambda: r.choice((f"<button>{text(1, 3)}</button>", f'<button class="btn share">{text(1, 2)}</button>', f"<label>{text(1, 3)} <input></label>", f"<span{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'share', 'social')}>{text(1, 8)}</span>", f"<a{attr('advert', 'sponsored', 'promo')} href=/x>{text(1, 8)}</a>"))
    parts = [f'<h1 class="mainmark">{text(2, 9)}</h1>'] if r.random() < 0.85 else []
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25))):
        parts.append(
            r.choices(
                (f'<p class="mainmark">{text(2, 110)}</p>', f'<p class="mainmark"><b>{text(1, 20)}<br>', f'<h2 class="mainmark">{text(1, 6)}</h2><p class="mainmark">{text(9, 80)}</p>', '<ul class="mainmark">' + "".join(f'<li class="mainmark">{text(2, 14)}</li>' for _ in range(r.randint(2, 5))) + "</ul>", f'<blockquote class="mainmark"><p class="mainmark">{text(4, 40)}</p></blockquote>', f'<pre class="mainmark">{text(4, 30)}</pre>', '<table class="mainmark"><tr class="mainmark">' + "".join(f'<td class="mainmark">{text(1, 5)}</td>' for _ in range(4)) + "</tr></table>"),
                (14, 4, 2, 1, 1, 0.5, 0.5),
            )[0]
        )
        if r.random() < 0.06:
            parts.append(ad())
        if r.random() < 0.04:
            parts.append(f'<p class="mainmark">{text(4, 60)} {inside()} {text(0, 40)}</p>' if r.random() < 0.8 else inside())
    if r.random() < 0.15:
        parts.append(box(("share", "social", "tags"), f"<ul>{links(3)}</ul>"))
    body = "".join(parts)
    main = r.choice((f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", box(("content", "post-body", "entry text", "story"), body), f"<main><article>{body}</article>{r.choice((side, comments, ''))}</main>", f'<div class="x">{body}</div>', body))
    if r.random() < 0.4:
        main = box(("wrap", "container", "page", "row"), r.choice((main + side, side + main, main)))
        side = ""
    junk = [header, nav if "nav" not in header else "", notice, ad(), main, ad(), side, form, comments, footer]
    return f"<!DOCTYPE html><html><head><title>{text(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(junk)}</body></html>"


@memo
def model() -> Trees:
    """Trained on TRAIN_PAGES generated pages; the same for every run and every input."""
    r = random.Random(TRAIN_SEED)
    xs, ys, ws = [], [], []
    for _ in range(TRAIN_PAGES):
        page = Page(training_page(r))
        truth = np.array(["mainmark" in n.tokens for n in page.nodes])
        for k in range(len(truth) - 1, 0, -1):
            truth[page.up[k]] |= truth[k]
        xs.append(page.features())
        ys.append(truth)
        ws.append(np.ones(len(truth)))
    return fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_blocks(pages: list[Page], trees: Trees) -> Iterator[list[str]]:
    """The main text blocks of each page, in page order."""
    if not pages:
        return
    logits = trees.logit(np.concatenate([p.features() for p in pages]))
    at = 0
    for p in pages:
        n = len(p.nodes)
        own = logits[at : at + n]
        at += n
        label = decode(p.up, own, np.sqrt(1 + p.total[:, 0]))
        kept: dict[int, list[str]] = {}
        for number, (k, text) in zip(p.numbers, p.blocks, strict=True):
            if label[k]:
                kept.setdefault(number, []).append(text)
        yield [text for parts in kept.values() if (text := clean("".join(parts)))]


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars, a row for each row.

    Blocks of main text in page order, joined by line feeds; a null or empty html, or one without main text, gives an
    empty string. Markup that isn't closed or isn't HTML is read as far as it goes. Buttons, labels and marked inline
    elements are judged as nodes; where they go, the block around them stays one. Repeated rows give equal rows; other
    columns are ignored.
    """
    trees = model()
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            part: list[Page] = []
            size = 0
            for html in batch.column(2):
                part.append(Page(html.as_py() or ""))
                size += len(html.as_py() or "")
                if len(part) == 200 or size > PART_CHARS:
                    texts += ["\n".join(b) for b in main_blocks(part, trees)]
                    part, size = [], 0
            texts += ["\n".join(b) for b in main_blocks(part, trees)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", pages["html"].cast("string").alias("html")).mapInArrow(scan, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")
