"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokeniser cuts a page into leaf blocks: runs of text between block-level tags, inline tags
being markup. Each block has features of its ancestors (tags, the nearest sectioning tag, hints in class,
id and role) and of its text (length, links, stops, typical words). A linear-chain CRF with two labels is
trained by maximum likelihood on labelled pages, and Viterbi decoding labels the blocks of a page; those
labelled main are the text.

Labelled pages: LABELLED (built from parts whose label is known) and a hash sample of the pages
given whose markup tells (an ``article`` or ``main`` element, apart from parts with boilerplate hints). The sample
is of about SAMPLE_PAGES pages; of their chains of CHAIN blocks those of the smallest hashes are learnt from,
SAMPLE_CHAINS at most, so what the driver receives is bounded whatever the length of pages.

Cases: a null or empty page has no blocks and the text ""; unclosed tags, a page that breaks off inside a
tag or an entity, stray end tags and nesting of any depth are read as browsers do, roughly; script, style
and other elements that are not text never become blocks, but elements whose names only begin like theirs
(svg-icon) are markup; a self-closing svg is empty; the text of math is text; a quote that doesn't begin a value is a
character of its tag like others; hidden elements, noscript and buttons are blocks to be told from the text; repeated rows are extracted one by one; an
empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import html
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SAMPLE_PAGES, SAMPLE_CHAINS = 300, 600
CHAIN = 48  # longer pages are cut into chains of so many blocks, for training only
L2, STEPS = 0.02, 150

#: What follows a tag's name. Quotes hold a value only after an equals sign, elsewhere they are characters like others.
_REST = r"(?>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=|[^=>]+)*)"
_TOKEN = re.compile(
    rf"<svg(?=[\s/>]){_REST}(?<=/)>"
    rf"|<(?P<raw>script|style|template|title|textarea|select|iframe|svg|canvas|object)(?=[\s/>]){_REST}(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_REST})(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements that begin and end a block, and those without content.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article main nav aside header footer form section dialog head noscript button".split())

#: Words in class, id and role that hint at what a part of a page is for.
HINTS = {
    "advert": "ad ads adv advert advertisement advertising banner adsbygoogle promo promoted sponsor sponsored dfp adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs toolbar",
    "comment": "comment comments reply replies disqus respond discussion commentlist reviews",
    "sidebar": "sidebar side aside widget related recommended recommendations trending popular rail complementary secondary archives blogroll",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay paywall subscribe newsletter signup disclaimer",
    "footer": "footer foot copyright contentinfo legal colophon credits",
    "header": "header masthead logo banner topbar brand",
    "form": "form search login register contact",
    "share": "share sharing social follow tags",
    "hidden": "hidden invisible",
    "content": "article content post entry hentry main story body text prose",
}
#: Hints that set an inline element apart from the text around it.
APART = frozenset({"advert", "hidden", "notice", "comment", "sidebar", "form"})
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
_TELLS = re.compile(r"©|\bcookies?\b|\bcopyright\b|\ball rights reserved\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\badvertisement\b|\breply\b|\bpowered by\b", re.I)


@dataclass
class Block:
    path: tuple  # (tag, hints) of the open elements, outermost first
    text: str
    linked: int  # code points of raw text inside links


def _hints(rest: str) -> frozenset:
    if not rest or rest.isspace():
        return frozenset()
    found = set()
    for m in _NAMED.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style":
            if name == "hidden" or _UNSEEN.search(value):
                found.add("hidden")
            continue
        found.update(HINT_OF[w] for w in _WORD.findall(value.lower()) if w in HINT_OF)
    return frozenset(found)


def leaf_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    path: list[tuple] = []
    held: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked, in_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(tuple(path), text, linked))
            held.clear()
        linked = in_link = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            held.append(text)
            linked += len(text) if in_link else 0
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
            if m["close"]:
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] == tag:
                        del path[k:]
                        break
            else:
                ends = {"p", tag} if tag in ("li", "dd", "dt", "td", "th", "tr") else {"p"} if tag != "button" else ()
                if path and path[-1][0] in ends:
                    path.pop()
                    if path and path[-1][0] == tag and tag in ends:
                        path.pop()
                if tag not in VOID:
                    path.append((tag, _hints(m["rest"])))
        elif tag == "br":
            held.append("\n")
        elif m["close"]:
            k = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == tag), -1)
            if k >= 0:  # an inline part of another kind than the text around it
                flush()
                del path[k:]
            elif tag == "a":
                in_link = 0
        else:
            hints = _hints(m["rest"]) | ({HINT_OF[w] for w in _WORD.findall(tag) if w in HINT_OF} if "-" in tag else set())
            if tag not in VOID and m["rest"][-1:] != "/" and (hints & APART or any(t == tag for t, _ in path)):
                flush()
                path.append((tag, frozenset(hints)))
            elif tag == "a":
                in_link = 1
            # other inline tags are markup and no more
    flush()
    return blocks


def _path_features(path: tuple) -> tuple:
    path = tuple(x for x in path if x[0] not in ("html", "body") or x[1])
    tags = {t for t, _ in path}
    near = next((t for t, _ in reversed(path) if t in SECTIONS), "none")
    hints = set().union(*(h for _, h in path)) if path else set()
    bad = hints - {"content"}
    found = {f"in:{t}" for t in tags} | {f"hint:{h}" for h in hints} | {f"near:{near}", f"tag:{path[-1][0] if path else 'none'}"}
    found |= {"hinted"} if bad else {f"clean:{near}"}
    if "article" in tags or "main" in tags:
        found.add(f"inner:{near}:{'hinted' if bad else 'clean'}")
    else:
        found.add(f"outer:{near}")
    if "content" in hints and not bad:
        found.add("clean content")
    return tuple(sorted(found))


def _text_features(b: Block) -> tuple:
    n = len(b.text)
    share = b.linked / max(n, 1)
    return (
        f"size:{min(n.bit_length(), 10)}",
        "links:most" if share > 0.6 else "links:some" if share > 0.1 else "links:few",
        "ends" if b.text[-1] in ".!?\"'”»" else "open",
        "tells" if n < 2000 and _TELLS.search(b.text) else "plain",
    )


def _says(b: Block) -> bool:
    """Is a block running text by itself?"""
    return len(b.text) >= 60 and b.linked <= 0.3 * len(b.text)


def place_features(blocks: list[Block]) -> list[list[str]]:
    """Where a block stands: before the page's first running text, after its last, or between; with its links and their like around it.

    Nothing for what stands in an article or main, where markup tells; where no text runs, these count for it.
    """
    told = [any(t in ("article", "main") for t, _ in b.path) for b in blocks]
    said = [k for k, b in enumerate(blocks) if _says(b)] or [k for k, t in enumerate(told) if t]
    if not said:
        return [[] for _ in blocks]
    low, high = said[0], said[-1]
    links = [b.linked > 0.6 * len(b.text) for b in blocks]
    found = []
    for k, b in enumerate(blocks):
        if told[k]:
            found.append([])
            continue
        around = links[max(k - 1, 0)] + (links[k + 1] if k + 1 < len(blocks) else links[k])
        kind = "linked" if links[k] else "tells" if len(b.text) < 200 and _TELLS.search(b.text) else "plain"
        where = "lead" if k < low else "tail" if k > high else "inside"
        found.append([f"{where}:{kind}", f"{where}:near{around}:{kind}"] + (["edge:" + kind] if k in (0, len(blocks) - 1) else []))
    return found


def features(blocks: list[Block]) -> list[list[str]]:
    return [[*_path_features(b.path), *_text_features(b), *place] for b, place in zip(blocks, place_features(blocks))]


def markup_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page whose markup tells, else None: inside article or main, outside of boilerplate parts."""
    if not any(t in ("article", "main") for b in blocks for t, _ in b.path):
        return None
    labels = []
    for b in blocks:
        tags = [t for t, _ in b.path]
        inner = b.path[max(k for k, t in enumerate(tags) if t in ("article", "main")) :] if {"article", "main"} & {*tags} else ()
        bad = any(t in ("nav", "aside", "footer", "form", "dialog", "noscript", "button") or h - {"content", "header"} for t, h in inner)
        labels.append(int(bool(inner) and not bad))
    return labels


_SAID = (
    "The council met on Tuesday to discuss the new bridge over the river, and most members spoke in favour of the plan.",
    "Nobody knew. It rained.",
    "Work is to begin in the spring; the cost is put at four million, of which the county pays a third.",
    "A bridge at last",
    "Why now?",
    "Those who live by the water have waited for this for twenty years, says the mayor, and she means to keep her word this time.",
)
#: Further content, in the elements that it may come in; the texts are content too.
_MORE = (
    "<ul><li>Stone from the old quarry</li><li>Two lanes and a footpath.</li></ul>",
    "<div>The first plans were drawn in 1911.</div><p><a href='/plan'>The plan in full</a></p>",
    "<table><tr><th>Year</th><td>Cost in millions</td></tr></table><pre>North bank: 12 m</pre>",
    "<p>Sign up at the town hall; no newsletter and no cookies, she says.</p><ol><li><a href='/law'>The law</a></li></ol>",
    "<section><h3>The other side</h3><p>All rights reserved, say the farmers of the north bank.</p></section><div><div>Reply to them!</div></div>",
    "<figure><figcaption>The ford in winter</figcaption></figure><dl><dt>Ford</dt><dd>A crossing on foot</dd></dl>A line without an element.",
)
_PARTS = {
    "nav": ("<nav><ul>{}</ul></nav>", ("<li><a href='/a'>Home</a></li>", "<li><a href='/b'>News</a></li>", "<li><a href='/c'>Sport and games</a></li>")),
    "header": ("<header class='masthead'>{}</header>", ("<h1>Daily Post</h1>", "<div class='logo'>The Post</div>", "<p>All the news of the valley, every day.</p>")),
    "top": ("<header>{}</header>", ("<h1>Valley News</h1>", "<h2>Since 1890</h2>", "<p>Read by ten thousand people each day.</p>")),
    "name": ("<header>{}</header>", ("<h1>The Valley</h1>",)),
    "ad": ("<div class='ad'>{}</div>", ("<p>Buy two shoes and pay for one, this week only.</p>", "<span>Cheap flights.</span>")),
    "promo": ("<section class='sponsored promo'>{}</section>", ("<h3>From our partners</h3>", "<p>How one trick made this woman rich in a week.</p>")),
    "aside": ("<aside class='sidebar'>{}</aside>", ("<h3>Most read</h3>", "<ul><li><a href='/x'>Storm on the way</a></li></ul>", "<p>The valley has seen many storms, and this one is no worse than others.</p>")),
    "notice": ("<div class='cookie-notice' role='alert'>{}</div>", ("<p>We use cookies to make this site work. By going on you agree.</p>", "<button>Accept</button>")),
    "form": ("<form action='/s'>{}</form>", ("<label>Your address</label>", "<p>Send me the letter every week.</p>")),
    "comments": ("<section id='comments' class='comments'>{}</section>", ("<h3>3 comments</h3>", "<div class='comment'><p>I have lived here all my life and I do not want this bridge.</p></div>", "<div class='comment'><p>Well said.</p></div>")),
    "share": ("<div class='share social'>{}</div>", ("<a href='/t'>Share this</a>",)),
    "menu": ("<div id='menu'>{}</div>", ("<a href='/a'>Home</a> <a href='/d'>Valley</a>", "<ul><li><a href='/e'>Letters to the editor</a></li></ul>")),
    "noscript": ("<noscript>{}</noscript>", ("<p>Turn on scripts in your browser to see this page in full.</p>", "This page needs a newer browser.")),
    "hidden": ("<div style='display: none'>{}</div>", ("<p>The list is being loaded, please wait for it.</p>", "<div hidden>Nothing was found in this place.</div>")),
    "unseen": ("<p hidden>{}</p>", ("This line is not for the reader.",)),
    "dialog": ("<dialog open>{}</dialog>", ("<p>Before you go: read all of it for a month at half the price.</p>", "<div>No, thanks</div>")),
    "button": ("<button type='button'>{}</button>", ("Show more of it",)),
    "side": ("<div class='sidebar'>{}</div>", ("<a href='/x'>Storm on the way</a><br><a href='/y'>Frost</a>", "<p>The weather of the week, every morning.</p>")),
    "foot": ("<div class='site-footer'>{}</div>", ("<p>All rights reserved.</p>", "<div>Printed in the valley on paper from the valley.</div>")),
    "footer": ("<footer>{}</footer>", ("<p>&copy; Daily Post &middot; all rights reserved.</p>", "<p>The editor answers letters on Mondays.</p>")),
}
#: Parts that stand alone before and after the content of short pages.
_BEFORE = ("nav", "header", "notice", "name", "ad", "top", "menu", "name", "promo", "side", "top", "noscript", "hidden", "aside", "name", "nav")
_AFTER = ("foot", "comments", "footer", "aside", "form", "share", "side", "dialog", "hidden", "button", "ad", "foot", "promo")
_AROUND = ("<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", "<div class='content'>{}</div>", "<div id='story' class='entry-content'>{}</div>", "<section class='article'>{}</section>", "<div>{}</div>")


def labelled_pages() -> list[tuple[str, list[int]]]:
    """LABELLED: pages put together from parts whose label is known, and their blocks' labels."""
    said = {*_SAID, *(b.text for more in _MORE for b in leaf_blocks(more))}
    parts = {k: around.format("".join(rows)) for k, (around, rows) in _PARTS.items()}
    pages = []
    inside = ("", "ad", "aside", "comments", "form", "share", "footer", "notice", "promo", "nav", "noscript", "hidden", "unseen", "dialog", "button")
    for n, (around, inner, head) in enumerate(itertools.product(_AROUND, inside, (0, 1, 2))):
        title = f"<h1>{_SAID[3]}</h1>"
        body = (f"<header>{title}</header>" if head and around != "<div>{}</div>" else title) + f"<p>{_SAID[0]}<p>{_SAID[1]}</p>" + parts.get(inner, "")
        body += f"<h2>{_SAID[4]}</h2><p>{_SAID[2]}</p><blockquote>{_SAID[5]}</blockquote>" + _MORE[n % len(_MORE)] + _MORE[n // 7 % len(_MORE)]
        page = parts["noscript"] + parts["nav"] + parts["header"] + parts["notice"] + parts["ad"] + around.format(body) + parts["comments"] + parts["aside"] + parts["form"] + parts["footer"] + parts["hidden"]
        if head == 2:  # next to nothing: a line, a part of another kind, a line
            body = _SAID[n % len(_SAID)] + parts.get(inner, "") + ("<p>" + _SAID[n // 2 % len(_SAID)] + "</p>") * (n % 3)
        if head == 1:
            page = parts["top"] + parts["menu"] + parts["promo"] + parts["aside"] + around.format(body) + parts["button"] + parts["share"] + parts["comments"] + parts["foot"] + parts["dialog"]
        if head == 2:
            lead, tail = _BEFORE[n // 3 % len(_BEFORE)], _AFTER[n // 3 % len(_AFTER)]
            page = parts[lead] + around.format(body) + parts[tail]
        pages.append((page, [int(b.text in said) for b in leaf_blocks(page)]))
    return pages + plain_pages(said)


#: Pages whose markup tells nothing: what comes before and after the text, and what holds it.
_LINKS = ("<a href='/'>Home</a> <a href='/about'>About</a>", "<a href='/'>Home</a>", "<a href='/a'>First</a><br><a href='/b'>Second page</a><br><a href='/c'>Third</a>", "<ul><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul>")
_ENDS = ("Copyright 2020 Somebody", "&copy; 1999 The Valley. All rights reserved.", "<a href='/p'>Privacy</a> <a href='/i'>Imprint</a>", "Powered by <a href='/w'>Press</a>", "<h3>Archives</h3><ul><li><a href='/5'>May 2020</a></li><li><a href='/4'>April 2020</a></li></ul>")
_PLAIN = (
    "<div>{}</div><div>{}</div><div>{}</div>",
    "<table><tr><td>{}</td><td>{}</td></tr><tr><td colspan=2>{}</td></tr></table>",
    "<div id='page'><div id='top'>{}</div><div class='hentry'>{}</div><div id='secondary'>{}</div></div>",
    "<div>{}</div><div class='wrap'><div class='col'>{}</div></div><div id='colophon'>{}</div>",
    "<center>{}</center>{}<hr><center>{}</center>",
)


def plain_pages(said: set[str]) -> list[tuple[str, list[int]]]:
    pages, said = [], said | {"It rained.", "Oak", "Stone and lime"}
    for n, (around, links, end) in enumerate(itertools.product(_PLAIN, _LINKS, _ENDS)):
        body = (f"<h1>{_SAID[3]}</h1>" if n % 3 else "") + f"<p>{_SAID[0]}</p><p>{_SAID[n % 2 * 4 or 1]}</p><p>{_SAID[2]}</p>" + (_MORE[n % len(_MORE)] if n % 2 else "") + f"<p>{_SAID[5]}</p>"
        body += "<p>It rained.</p><ul><li>Oak</li><li>Stone and lime</li></ul>" if n % 3 == 0 else ""  # the text's end needn't run
        page = around.format(links, body, end)
        pages.append((page, [int(b.text in said) for b in leaf_blocks(page)]))
    return pages


class ChainField:
    """Two-label linear chain: a weight per feature (for label 1 against 0) and one per pair of labels."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.weights = dict(zip(names, weights.tolist()))
        self.moves = moves.tolist()

    def scores(self, blocks: list[Block], cache: dict) -> list[float]:
        """Weight for label 1 of each block; ``cache`` keeps the part that a path of elements gives."""
        get, found = self.weights.get, []
        for b, place in zip(blocks, place_features(blocks)):
            if (own := cache.get(b.path)) is None:
                if len(cache) > 10_000:
                    cache.clear()
                own = cache[b.path] = sum(get(f, 0.0) for f in _path_features(b.path))
            found.append(own + sum([get(f, 0.0) for f in _text_features(b)]) + sum([get(f, 0.0) for f in place]))
        return found

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        (m00, m01), (m10, m11) = self.moves
        a = b = 0.0
        back = []
        for k, score in enumerate(scores):
            if not k:
                a, b = 0.0, score
                continue
            to0, to1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01) + score
        if not scores:
            return []
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], l2: float = L2, steps: int = STEPS) -> ChainField:
    """Maximum likelihood with an L2 term, by forward-backward over all pages at once and Adam steps."""
    pages = [(rows[k : k + CHAIN], y[k : k + CHAIN]) for rows, y in pages for k in range(0, len(y), CHAIN)]
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    column = {f: k for k, f in enumerate(names)}
    count, longest = len(pages), max(len(y) for _, y in pages)
    place = np.array([k * longest + t for k, (_, y) in enumerate(pages) for t in range(len(y))])
    x = np.zeros((len(place), len(names)))
    for i, row in enumerate(r for rows, _ in pages for r in rows):
        x[i, [column[f] for f in row]] = 1.0
    y = np.array([v for _, own in pages for v in own])
    there = np.zeros(count * longest, bool)
    there[place] = True
    there = there.reshape(count, longest)
    follows = np.flatnonzero(np.diff(place) == 1)
    follows = follows[(place[follows] + 1) % longest != 0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follows], y[follows + 1]), 1.0)
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    theta, first, second = np.zeros(len(names) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        score = np.zeros(count * longest)
        score[place] = x @ w
        emit = np.stack([np.zeros_like(score), score], axis=1).reshape(count, longest, 2)
        forward, backward = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        p1 = np.exp(forward[..., 1] + backward[..., 1] - total[:, None]).ravel()[place]
        pair = forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(pair)[there[:, 1:]].sum(axis=0) if longest > 1 else np.zeros((2, 2))
        gradient = np.concatenate([x.T @ (p1 - y), (expected - seen).ravel()]) + l2 * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return ChainField(names, theta[:-4], theta[-4:].reshape(2, 2))


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chains: int = SAMPLE_CHAINS) -> ChainField:
    """Trains on LABELLED and a hash sample of about ``sample_pages`` pages whose markup tells, of ``sample_chains`` chains at most."""
    total = max(pages.count(), 1)
    part = pages.filter(F.pmod(F.xxhash64(F.col("page_id").cast("string"), "html", F.lit(3)), F.lit(1 << 20)) < sample_pages / total * (1 << 20))

    def label(batches):
        for batch in slices(batches, "html"):
            rows = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "")
                labels = markup_labels(blocks)
                told = features(blocks) if labels is not None else []
                for k in range(0, len(told), CHAIN):
                    rows.append({"rows": told[k : k + CHAIN], "labels": labels[k : k + CHAIN]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rows", pa.list_(pa.list_(pa.string()))), ("labels", pa.list_(pa.int32()))]))

    chains = part.select("html").mapInArrow(label, "rows array<array<string>>, labels array<int>")
    known = chains.orderBy(F.xxhash64("rows", "labels"), "rows", "labels").limit(sample_chains).collect()
    own = [(features(leaf_blocks(page)), labels) for page, labels in labelled_pages()]
    return train(own + sorted((r["rows"], r["labels"]) for r in known))


def extract(pages: DataFrame, model: ChainField) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars, n_blocks (of all kinds)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for batch in slices(batches, "html"):
            found, counts = [], []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "")
                labels = shared.value.decode(shared.value.scores(blocks, cache))
                found.append("\n\n".join(b.text for b, y in zip(blocks, labels) if y))
                counts.append(len(blocks))
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(found, pa.string()),
                    "n_chars": pa.array([len(t) for t in found], pa.int64()),
                    "n_blocks": pa.array(counts, pa.int64()),
                }
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long"
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
