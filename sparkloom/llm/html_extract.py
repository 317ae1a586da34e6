"""Main-text extraction by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of elements. Each element's features are its tag, the words in its class, id and role, its
depth, place among and number of siblings, and its subtree's share of the page's text, text per tag, link share,
punctuation and parts. Boosted trees, trained here on generated pages of many layouts, estimate whether an element
holds main text. Decoding picks the likeliest consistent labelling: below a dropped element nothing is kept, and what
is kept has kept ancestors. Kept text is given block by block.

Defined cases: a null or empty page has no text; a page without any markup is its own text; unclosed, crossed and
stray tags, broken comments and attributes are read as browsers do, roughly, and never raise; pages are judged one by
one, so repeated rows get equal texts; a page is handled whole, whatever its length; columns of any other name and
type are ignored, or carried as they are if `keep` names them.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import bounded_batches, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
#: Elements that never hold text to read.
SILENT = frozenset("head script style textarea title noscript iframe template svg math xmp noembed noframes form button select option input canvas object audio video dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split())
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
#: A start tag on the left ends open elements on the right, up to the container after them.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HINT = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words in class, id and role, by what they speak of.
HINTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs topbar pagination pager skip",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner outbrain taboola dfp commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter paywall subscribe subscription signup",
    "side": "sidebar side aside widget related recommended rail trending popular more",
    "edge": "footer header masthead colophon copyright legal bottom top complementary contentinfo logo brand",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews",
    "share": "share sharing social follow tweet facebook meta byline tags tag author",
    "form": "form search login input",
    "main": "article content post entry story main body text prose paragraph page blog news maintext articlebody",
}
HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
TAG_KINDS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "a", "h1", "h2", "h3", "table", "td", "figure", "blockquote", "pre", "span", "b", "body", "html")


@dataclass
class Page:
    """Elements in order of their start tags, and runs of text as (element, block, text)."""

    tags: list[str] = field(default_factory=lambda: ["#"])
    parents: list[int] = field(default_factory=lambda: [-1])
    hints: list[frozenset] = field(default_factory=lambda: [frozenset()])
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def hints_of(attributes: str) -> frozenset:
    out = set()
    for found in HINT.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        for word in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
            if word in HINT_OF:
                out.add(HINT_OF[word])
    return frozenset(out)


class OpenElements:
    """The elements open at a place of the page, with their places by tag and those of blocks, so that no end tag has
    to look through all of them."""

    def __init__(self) -> None:
        self.stack, self.tags = [0], ["#"]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.tags.append(tag)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the elements from this place on."""
        while len(self.stack) > place:
            self.stack.pop()
            self.at[self.tags.pop()].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I | re.A)


def parse(source: str) -> Page:
    """The page's tree; what a browser would repair is repaired alike where it bears on text. Time is in proportion to
    the page, however its tags are nested."""
    page, open_elements, block, at, n = Page(), OpenElements(), 0, 0, len(source)

    def text(until: int) -> None:
        if until > at:
            page.runs.append((open_elements.stack[-1], block, source[at:until]))

    while at < n:
        open_ = source.find("<", at)
        if open_ < 0:
            text(n)
            break
        after = source[open_ + 1 : open_ + 2]
        if after == "!" or after == "?":
            text(open_)
            if source.startswith("<!--", open_):
                end = source.find("-->", open_ + 4)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", open_)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        name = NAME.match(source, open_ + 1 + closing)
        if not name:
            if closing:  # a bogus comment
                text(open_)
                end = source.find(">", open_)
                at = n if end < 0 else end + 1
            else:
                text(open_ + 1)
                at = open_ + 1
            continue
        text(open_)
        tag = name[0].lower()
        end = TAG_END.match(source, name.end())
        stop = end.end() if end else source.find(">", name.end()) + 1
        if not stop:
            break
        attributes, at = source[name.end() : stop - 1], stop
        if tag in BLOCK:
            block += 1
        innermost = open_elements.blocks[-1] if open_elements.blocks else 0
        if closing:
            place = open_elements.last(tag)
            # an inline element's end doesn't reach out of its block
            if place and tag not in ("body", "html") and (tag in BLOCK or tag == "a" or place > innermost):
                open_elements.cut(place)
            continue
        if tag in ("html", "body", "head") and open_elements.last(tag):
            continue
        if tag in CLOSES_P and innermost and open_elements.tags[innermost] == "p":
            open_elements.cut(innermost)
        head = open_elements.last("head")
        if head and (tag == "body" or tag in BLOCK and tag != "title" and head < 3):
            open_elements.cut(head)
        if tag in ENDS:
            ended, fence = ENDS[tag]
            place = open_elements.last(*ended)
            if place > open_elements.last(*fence):
                open_elements.cut(place)
        page.tags.append(tag)
        page.parents.append(open_elements.stack[-1])
        page.hints.append(hints_of(attributes) if "=" in attributes else frozenset())
        if tag in RAW and not attributes.endswith("/"):
            found = _raw_end(tag).search(source, at)
            close = source.find(">", found.start()) if found else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID:
            open_elements.push(len(page.tags) - 1, tag)
    return page


#: Ancestors whose tag alone says much.
ABOVE = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "li", "p")
FEATURES = len(TAG_KINDS) + 2 * len(HINTS) + len(ABOVE) + 18


def is_centre(page: Page, i: int) -> bool:
    """True for an element whose tag or attributes call it main text."""
    return page.tags[i] in ("article", "main") or len(HINTS) - 1 in page.hints[i]


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tags)
    parent = page.parents
    own = np.zeros((n, 4))  # characters, characters in links, sentence ends, words
    in_link = [False] * n
    depth, size, kids, place = [0] * n, [1] * n, [0] * n, [0] * n
    paragraphs, links = [0] * n, [0] * n
    for i in range(1, n):
        p, tag = parent[i], page.tags[i]
        depth[i], in_link[i] = depth[p] + 1, in_link[p] or tag == "a"
        place[i] = kids[p]
        kids[p] += 1
        paragraphs[i], links[i] = int(tag == "p"), int(tag == "a")
    for i, _, text in page.runs:
        words = text.split()
        length = sum(map(len, words))
        own[i] += (length, length * in_link[i], text.count(".") + text.count("!") + text.count("?"), len(words))
    before, centre, longest = np.zeros(n), [0] * n, [0.0] * n  # children that are or are called articles; most characters in a child
    total = own.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i]
        links[p] += links[i]
        centre[p] += is_centre(page, i)
        longest[p] = max(longest[p], total[i][0])
    run = 0.0
    for i in range(n):
        before[i] = run
        run += own[i][0]
    page_text = max(1.0, total[0][0])
    out = np.zeros((n, FEATURES), np.float32)
    above, over = [frozenset()] * n, [frozenset()] * n
    kind_at = {t: k for k, t in enumerate(TAG_KINDS)}
    for i in range(n):
        row, p = out[i], parent[i]
        if i:
            above[i] = above[p] | page.hints[p] if page.hints[p] else above[p]
            over[i] = over[p] | {page.tags[p]} if page.tags[p] in ABOVE else over[p]
        if page.tags[i] in kind_at:
            row[kind_at[page.tags[i]]] = 1
        for h in page.hints[i]:
            row[len(TAG_KINDS) + h] = 1
        for h in above[i]:
            row[len(TAG_KINDS) + len(HINTS) + h] = 1
        for k, tag in enumerate(ABOVE):
            if tag in over[i]:
                row[len(TAG_KINDS) + 2 * len(HINTS) + k] = 1
        chars, linked, ends, words = total[i]
        pc = total[p][0] if i else chars
        row[-18:] = (
            depth[i], place[i], kids[p] if i else 1, size[i], np.log1p(chars), chars / size[i], linked / max(1.0, chars), ends / max(1.0, words),
            chars / page_text, chars / max(1.0, pc), before[i] / page_text, paragraphs[i], links[i], own[i][0] / max(1.0, chars), paragraphs[p] if i else 0, links[i] / size[i],
            (centre[p] - is_centre(page, i) if i else 0), chars / max(1.0, longest[p]) if i else 1,
        )
    return out


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a kept element's ancestors are kept.

    The trees estimate an element's chance given that its parent is kept, so a labelling's likelihood is the product
    over the kept elements' children. From the leaves up, each element's best value if kept is compared with the
    value of dropping it with all below it.
    """
    n = len(page.tags)
    kept, dropped = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    keep = [False] * n
    for i in range(n - 1, 0, -1):
        tag = page.tags[i]
        if tag in SILENT:
            kept[i] = -np.inf
        elif tag in ("html", "body"):
            dropped[i] = -np.inf
        kept[page.parents[i]] += max(kept[i], dropped[i])
    for i in range(n):
        keep[i] = i == 0 or keep[page.parents[i]] and kept[i] > dropped[i]
    return keep


def blocks(page: Page, keep: list[bool]) -> str:
    """Kept text: white space in a block becomes one space, blocks are joined by two line feeds, empty ones go."""
    out: list[str] = []
    at, held = None, []
    for i, block, text in [*page.runs, (0, -1, "")]:
        if block != at:
            line = " ".join("".join(held).split())
            if line:
                out.append(line)
            at, held = block, []
        if keep[i]:
            held.append(html.unescape(text) if "&" in text else text)
        elif page.tags[i] == "br":
            held.append(" ")
    return "\n\n".join(out)


# ---------------------------------------------------------------- training pages

#: Marks main text in generated pages; it is gone before features are taken.
MARK = "\ue000"


def generated_page(rng: random.Random) -> str:
    """A page of random layout with marked main text."""
    syllables = "ba ke lo mi nu ra se ti vo wa de fi go hu ja ko le ma no pe".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 16).capitalize() + rng.choice(".....!?")
    pick = lambda *x: rng.choice(x)
    mute = rng.random() < 0.2
    hint = lambda kind: word() if mute else rng.choice(HINTS[kind].split())

    def attr(kind: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return f' class="{pick("box", "wrap", "c" + str(rng.randint(1, 99)), "row")}"' if rng.random() < 0.5 else ""
        value = hint(kind) + pick("", "-" + word(), "_" + hint(kind), "-wrap", " " + word())
        return f' {pick("class", "class", "id", "role")}={pick(chr(34), chr(39))}{value}'.replace(chr(39), chr(34)) + '"'

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 4)}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        inner = pick(f"<ul>{items}</ul>", " | ".join(link() for _ in range(rng.randint(3, 8))), f"<ol>{items}</ol>")
        tag = pick("nav", "nav", "div", "ul")
        return f"<{tag}{attr('menu', 0.3 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def prose(n: int) -> str:
        return " ".join(sentence() for _ in range(n))

    def drop() -> str:
        kind = pick("menu", "advert", "advert", "notice", "side", "edge", "comment", "share", "form", "form")
        if kind == "menu":
            return menu()
        if kind == "edge":
            tag = pick("footer", "header", "div")
            return f"<{tag}{attr('edge', 0.4 if tag != 'div' else 1)}>{pick('&copy; ', '', '')}{pick(words(1, 5), prose(rng.randint(1, 5)) + ' ' + link(), menu())} {pick('', words(2, 9) + '.')}</{tag}>"
        if kind == "side":
            tag = pick("aside", "aside", "div", "section")
            return f"<{tag}{attr('side', 0.4 if tag == 'aside' else 1)}><h3>{words(1, 3)}</h3>{pick('<ul>' + ''.join(f'<li>{link()}</li>' for _ in range(5)) + '</ul>', '<p>' + prose(rng.randint(1, 4)) + '</p>')}</{tag}>"
        if kind == "comment":
            each = "".join(f"<{t}{attr('comment', 0.8)}>{pick('<b>' + word() + '</b>', '')}<p>{prose(rng.randint(1, 4))}</p></{t}>" for t in [pick("div", "li", "article")] * rng.randint(1, 5))
            tag = pick("section", "div", "ol", "ul")
            return f"<{tag}{attr('comment', 1)}>{pick('<h2>' + words(1, 2) + '</h2>', '')}{each}</{tag}>"
        if kind == "form":
            return f"<form{attr('form', 0.5)}><label>{words(1, 4)}</label><input name=q><p>{pick(prose(1), words(1, 3))}</p><button>{word()}</button></form>"
        tag = pick("div", "div", "section", "p", "aside", "span")
        return f"<{tag}{attr(kind, 0.4 if tag == 'aside' else 1)}>{pick(prose(rng.randint(1, 3)), '<p>' + prose(rng.randint(1, 3)) + '</p>', link() + ' ' + words(2, 8), words(1, 6))}</{tag}>"

    def main_text() -> str:
        tag = pick("p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "table", "div")
        body = prose(rng.randint(1, pick(1, 2, 8, 20))) if tag not in ("h2", "h3") else words(2, 7)
        if rng.random() < 0.3:
            inner = pick("b", "i", "em", "strong", "a", "span", "code")
            body = f"{body} <{inner}>{MARK + sentence()}</{inner}> {MARK + sentence()}"
        body = MARK + body
        if tag == "li":
            many = "".join(f"<li>{MARK + sentence()}</li>" for _ in range(rng.randint(1, 5)))
            return f"<{pick('ul', 'ol')}><li>{body}</li>{many}</ul>"
        if tag == "table":
            return f"<table><tr><td>{body}</td><td>{MARK + words(1, 4)}</td></tr></table>"
        return f"<{tag}>{pick('', '', '<b>')}{body}{pick('', '', '<br>')}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")

    parts = [main_text() for _ in range(pick(1, 1, 1, 2, 4, 8, 15))]
    if rng.random() < 0.08:  # a page with next to nothing to say
        parts = [f"<p>{MARK + words(1, 3)}.</p>"]
    if rng.random() < 0.8:
        parts.insert(0, f"<h1>{MARK + words(2, 8)}</h1>")
    for _ in range(pick(0, 0, 0, 1, 2)):
        parts.insert(rng.randint(0, len(parts)), drop())
    tag = pick("article", "article", "main", "div", "div", "section", "td")
    core = "".join(parts)
    bare = rng.random() < 0.08
    if not bare:
        core = f"<{tag}{attr('main', 0.5 if tag in ('article', 'main') else 0.9)}>{core}</{tag}>"
    if tag == "td" and not bare:
        core = f"<table><tr>{core}</tr></table>"
    for _ in range(pick(0, 0, 1, 2)):
        side = pick("", drop())
        core = f"<{pick('div', 'div', 'main', 'section')}{attr('main', 0.4)}>{pick(side + core, core + side)}</div>"
    before, after = "".join(drop() for _ in range(rng.randint(0, 3))), "".join(drop() for _ in range(rng.randint(0, 3)))
    stray = pick("", "", words(1, 4))
    return f"<html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{stray if rng.random() < 0.1 else ''}{before}{core}{after}</body></html>"


@lru_cache(maxsize=4)
def train(pages: int = 1200, seed: int = 4) -> boosting.Boosted:
    """Trees fitted to generated pages: whether main text lies in an element, for those whose parent has some.

    The same model every time, so a process trains it once."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = parse(generated_page(rng))
        label = np.zeros(len(page.tags))
        for i, _, text in page.runs:
            if MARK in text:
                while i >= 0 and not label[i]:
                    label[i] = 1
                    i = page.parents[i]
        page.runs = [(i, b, t.replace(MARK, "")) for i, b, t in page.runs]
        asked = [p >= 0 and label[p] == 1 and page.tags[i] not in SILENT for i, p in enumerate(page.parents)]
        xs.append(features(page)[asked])
        ys.append(label[asked])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys))


def extract(sources: list[str | None], model: boosting.Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(s or "") for s in sources]
    if not parsed:
        return []
    logit = model.logits(np.concatenate([features(p) for p in parsed]))
    at = np.cumsum([0, *(len(p.tags) for p in parsed)])
    return [blocks(p, decode(p, logit[a:b])) for p, a, b in zip(parsed, at[:-1], at[1:], strict=True)]


def main_text(pages: DataFrame, model: boosting.Boosted, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, text and n_chars."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    given = pages.select(F.col(html_col).cast("string").alias("__html"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = extract(part.column("__html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[1:], "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    return given.mapInArrow(tidied(run), f"{kinds}, text string, n_chars long")


def op10_html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return main_text(pages, train())
