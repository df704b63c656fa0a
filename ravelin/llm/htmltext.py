"""Main-text extraction with a linear-chain conditional random field over the leaf blocks of a page.

A page is a sequence of leaf blocks (text between block-level tags), each described by its ancestor tags, words in their
class and id attributes, and its text. A two-label chain is trained on labelled pages by gradient ascent on the likelihood and
decoded by Viterbi. Labelled pages are the small set below and a bounded sample of the table, labelled by the rule that an
article or main element marks its text; in half of the sample those two tags are hidden, so that the chain also learns what
text looks like.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that are trained on (about, by a hash of the id), steps and step size of training, weight decay.
SAMPLE, STEPS, RATE, DECAY = 300, 120, 0.5, 1e-3
#: Tags that bound blocks, tags without an end, tags whose content is never text up to their end tag or the end of the page.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style".split())
#: What the features look at.
TAGS = "article main section div p h1 h2 h3 h4 li ul ol table td nav header footer aside form button select textarea figure figcaption blockquote pre dl details".split()
HINTS = {
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad",
    "comment": "comment comments reply replies disqus respond discussion",
    "side": "sidebar side widget related recommended share sharing social tags trending popular more",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination toc topbar",
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert newsletter subscribe signup login banner",
    "edge": "footer header masthead copyright legal colophon",
    "content": "content article post entry story body text main-content page-content",
    "meta": "meta byline author date timestamp byline-author",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_AUTO_CLOSE = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
#: A quote begins a value only behind "="; elsewhere, and where it is never closed, it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[^>=]++|=)*+)>?", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE_END = re.compile(r"<(/?title|/?head|/?body)\b[^>]*>?", re.I)
_WHITE = re.compile(r"\s+")

FEATURES = ["bias", *(f"in {t}" for t in TAGS), *(f"own {t}" for t in ("p", "h", "li", "td", "div", "other")), *(f"hint {h}" for h in HINTS), "words 1-3", "words 4-9", "words 10-24", "words 25-", "stop", "links none", "links some", "links most", "copyright", "first", "last", "commas", "label"]
_AT = {name: k for k, name in enumerate(FEATURES)}


def blocks(page: str) -> list[tuple[str, list[int], dict[str, str]]]:
    """(text, features, marks) of each leaf block in page order; marks are the data-y attributes of its ancestors (for labelled pages)."""
    out: list[tuple[str, list[int], dict]] = []
    stack: list[tuple[str, frozenset, str | None]] = []
    within, marks = Counter(), []  # what the stack's tags and hints are, and the marks in it
    parts: list[str] = []
    linked, in_link, foreign, at, n = 0, False, 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, _features(text, stack[-1][0] if stack else "other", within, linked), {"y": marks[-1] if marks else ""}))
        parts, linked = [], 0

    def pop():
        tag, hints, y = stack.pop()
        within.subtract([tag, *hints])
        if y:
            marks.pop()

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                linked += len(text)
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ("svg", "math"):
            foreign = max(0, foreign - 1) if closing else foreign + (not m[3].endswith("/"))
            continue
        if foreign and m[3].endswith("/"):
            continue
        if tag in HIDDEN and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "title" and not closing:
            # only a title that is closed before the next one, or before the body, is skipped
            end = _TITLE_END.search(page, at)
            if end and end[1].lower() == "/title":
                flush()
                at = end.end()
                continue
        if tag not in BLOCK:
            continue
        flush()
        in_link = False
        if closing:
            open_ = within[tag]
            while open_ and within[tag] == open_:
                pop()
            continue
        while stack and (stack[-1][0] in _AUTO_CLOSE.get(tag, {"p"}) or stack[-1][0] == "head" and tag != "title"):
            pop()
        if tag not in EMPTY:
            names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m[3])) if m[3] else ""
            hints = frozenset(f"hint {_HINT[w]}" for w in re.split(r"[\s_]+", names.lower().replace("-", " ") + " " + names.lower()) if w in _HINT) if names else frozenset()
            y = re.search(r'data-y="(\d)"', m[3]) if m[3] else None
            stack.append((tag, hints, y[1] if y else None))
            within.update([tag, *hints])
            if y:
                marks.append(y[1])
    flush()
    for k, (_, f, _) in enumerate(out):
        if k == 0:
            f.append(_AT["first"])
        if k == len(out) - 1:
            f.append(_AT["last"])
    return out


def _features(text: str, own: str, within: Counter, linked: int) -> list[int]:
    f = [_AT["bias"]]
    f += [_AT[f"in {t}"] for t in TAGS if within[t] > 0]
    own = "h" if re.fullmatch("h[1-6]", own) else own
    f.append(_AT[f"own {own}"] if f"own {own}" in _AT else _AT["own other"])
    f += [_AT[f"hint {h}"] for h in HINTS if within[f"hint {h}"] > 0]
    n = text.count(" ") + 1
    f.append(_AT["words 1-3" if n <= 3 else "words 4-9" if n <= 9 else "words 10-24" if n <= 24 else "words 25-"])
    if text[-1] in ".!?:;\"'”’)":
        f.append(_AT["stop"])
    share = linked / len(text)
    f.append(_AT["links none" if not linked else "links some" if share < 0.5 else "links most"])
    if "©" in text or "copyright" in text[:60].lower():
        f.append(_AT["copyright"])
    if text.count(",") >= 2:
        f.append(_AT["commas"])
    if text.endswith(":") or n <= 2:
        f.append(_AT["label"])
    return f


_NOT_TEXT = {_AT[k] for k in ("in nav", "in header", "in footer", "in aside", "in form", "in button", "in select", "in textarea", "hint ad", "hint comment", "hint side", "hint menu", "hint notice")}
_MARKS = {_AT["in article"], _AT["in main"]}


def examples(page: str, hide: bool) -> tuple[list[list[int]], list[int]] | None:
    """(features, labels) of a page of the table by the rule, or None if it has no article or main element."""
    found = [set(f) for _, f, _ in blocks(page)]
    if not any(f & _MARKS for f in found):
        return None
    labels = [int(bool(f & _MARKS) and not f & _NOT_TEXT) for f in found]
    return [sorted(f - _MARKS if hide else f) for f in found], labels


class Chain:
    """Weights of a two-label chain: w[feature, label], t[from, to], s[first label]."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in rows])

    def train(self, data: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Chain:
        """Gradient ascent (Adagrad) on the mean log-likelihood; pages of one length are worked on together."""
        by_size: dict[int, list] = {}
        for rows, labels in data:
            if rows:
                by_size.setdefault(len(rows), []).append((rows, labels))
        groups = []
        for own in by_size.values():
            x = np.zeros((len(own), len(own[0][0]), len(FEATURES)))
            for i, (rows, _) in enumerate(own):
                for j, f in enumerate(rows):
                    x[i, j, f] = 1
            groups.append((x, np.eye(2)[np.array([y for _, y in own])]))
        total = sum(x.shape[0] * x.shape[1] for x, _ in groups) or 1
        memory = [np.full(p.shape, 1e-6) for p in (self.w, self.t, self.s)]
        for _ in range(steps):
            grads = [-decay * p for p in (self.w, self.t, self.s)]
            for x, y in groups:
                node, pair = self._marginals(x @ self.w)
                d = y - node
                grads[0] += np.einsum("ijf,ijk->fk", x, d) / total
                grads[1] += (np.einsum("ijk,ijl->kl", y[:, :-1], y[:, 1:]) - pair) / total
                grads[2] += d[:, 0].sum(axis=0) / total
            for p, g, m in zip((self.w, self.t, self.s), grads, memory, strict=True):
                m += g * g
                p += rate * g / np.sqrt(m)
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals [page, block, label] and summed pair marginals, by forward-backward in logs."""
        n = e.shape[1]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = self.s + e[:, 0]
        for j in range(1, n):
            a[:, j] = np.logaddexp(a[:, j - 1, :1] + self.t[0], a[:, j - 1, 1:] + self.t[1]) + e[:, j]
        for j in range(n - 2, -1, -1):
            v = b[:, j + 1] + e[:, j + 1]
            b[:, j] = np.logaddexp(v[:, :1] + self.t[:, 0], v[:, 1:] + self.t[:, 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        node = np.exp(a + b - z[:, None, None])
        pair = np.zeros((2, 2))
        for j in range(1, n):
            pair += np.exp(a[:, j - 1, :, None] + self.t + (e[:, j] + b[:, j])[:, None, :] - z[:, None, None]).sum(axis=0)
        return node, pair

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to text."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        e = self.scores(rows).tolist()
        a, b = self.s[0] + e[0][0], self.s[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            back.append((0 if a + t00 > b + t10 else 1, 0 if a + t01 > b + t11 else 1))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        out = [0 if a > b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


#: Labelled pages; data-y marks an element's text as main text (1) or not (0).
LABELLED = [
    '<body data-y="0"><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article data-y="1"><h1>Rain over the valley</h1><p>It rained for three days, and the river rose by a metre.</p><p>Nobody was hurt, but two roads are closed until further notice.</p></article><aside class="related" data-y="0"><p>Read next: ten walks in the hills around the town, with maps.</p></aside><footer>&copy; The Paper</footer></body>',
    '<body data-y="0"><header><div class="logo">The Paper</div><p>Independent since 1901, and proud of every single issue.</p></header><div class="cookie-notice"><p>We use cookies to give you the best experience, to measure visits and to show adverts.</p><button>Accept</button></div><div class="content" data-y="1"><h1>A short guide to bees</h1><p>Bees live in colonies, and each of them has a task.</p><ul><li>Workers gather nectar and pollen from spring to autumn.</li><li>Drones leave the hive in summer.</li></ul><blockquote>The hive is a city, not a house.</blockquote></div><div id="comments" data-y="0"><h3>Comments</h3><p>Great article, I learned a lot about bees and shared it with my class!</p><p>I don\'t agree with the second part, since drones may stay longer.</p></div><footer><p>Imprint, terms and privacy. All rights reserved.</p></footer></body>',
    '<body data-y="0"><div class="menu"><a href="/a">Shop</a> <a href="/b">Basket</a></div><main data-y="1"><h1>How to sharpen a knife</h1><p>Wet the stone, hold the blade at twenty degrees and draw it towards you.</p><div class="ad" data-y="0"><p>Buy the best knives of the season now, with free delivery to your door.</p></div><p>Repeat on the other side, then strop it on leather.</p><h2>Common mistakes</h2><p>Do not press hard, since pressure rounds the edge.</p><section class="comments" data-y="0"><p>Thanks, this helped me a lot, my knives are sharp again.</p></section></main><form><p>Subscribe to our newsletter and get a tip every week, free of charge.</p><label>Your mail</label></form><footer>&copy; Blades</footer></body>',
    '<body data-y="0"><div class="topbar">Sign in</div><div><div class="post" data-y="1"><h2>Notes on a bridge</h2><p>The old bridge was built of oak, and it stood for two centuries.</p><p>Its piles are still there, under the water, and can be seen when the river is low.</p><table><tr><td>Length in metres</td><td>120</td></tr></table></div><div class="sidebar" data-y="0"><h3>Popular</h3><ul><li><a href="/1">The mill and its owners</a></li><li><a href="/2">Floods of the last century</a></li></ul></div></div><div class="footer"><p>Contact us, or write to the editor.</p></div></body>',
    '<body data-y="0"><p>Share this page with your friends</p><div data-y="1"><h1>Plain page</h1><p>This page has no classes at all, only a long paragraph, which goes on, and on, and says what it has to say.</p><p>Another paragraph follows it, with some more words, so that there is a text.</p></div><div data-y="0"><a href="/x">Back to top</a></div><div>Copyright 2020 by nobody</div></body>',
    '<article data-y="1"><p>A page that holds a single paragraph, and nothing around it.</p></article>',
    '<main data-y="1"><h1>Bare page</h1><p>There is no menu above this text.</p><p>Nor does anything follow it, since the page ends here.</p></main>',
    '<body data-y="0"><article data-y="1"><h1>Cut off</h1><p>The transfer of this page broke off in its last paragraph, so that no footer</p></article></body>',
]


def labelled() -> list[tuple[list[list[int]], list[int]]]:
    found = [blocks(page) for page in LABELLED]
    return [([f for _, f, _ in page], [int(m["y"] == "1") for _, _, m in page]) for page in found]


def _sampled(batches):
    for batch in batches:
        rows, labels = [], []
        for page, hide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = examples(page or "", hide)
            if got:
                rows.append(got[0])
                labels.append(got[1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], ["rows", "labels"])


def fit(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", sample: int = SAMPLE, most_blocks: int = 400) -> Chain:
    """A chain trained on LABELLED and on about ``sample`` pages of the table (those of at most ``most_blocks`` blocks), picked by a hash of the id."""
    n = pages.count()
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))
    rows = pages.where(F.col(text_col).isNotNull() & (bucket < int((1 << 20) * min(1.0, sample / max(n, 1))) + 1)).select(F.col(text_col).cast("string"), (bucket % 2 == 0).alias("hide"))
    found = rows.mapInArrow(_sampled, "rows array<array<int>>, labels array<int>").where(F.size("rows") <= most_blocks).orderBy(F.xxhash64("rows", "labels")).limit(2 * sample).collect()
    own = labelled()
    # the hand-labelled pages weigh as much as the sample
    times = max(1, len(found) // (2 * len(own)))
    return Chain().train(own * times + [(r["rows"], r["labels"]) for r in found])


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    labels = chain.decode([f for _, f, _ in found])
    return "\n\n".join(text for (text, _, _), y in zip(found, labels, strict=True) if y)


def _extracted(held):
    def rows(batches):
        chain = held.value
        for batch in batches:
            texts = [main_text(x.as_py() or "", chain) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text, its blocks joined by two line breaks; empty if there is none.

    Null and empty pages have no text, repeated rows stay rows, an empty table gives no rows, other columns are never read.
    """
    held = pages.sparkSession.sparkContext.broadcast(chain)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted(held), "page_id long, url string, text string, n_chars long")
