"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

A page is read into its leaf blocks: runs of text between the tags that begin or end a
block. A block's features are the tags around it, its length, its share of linked text and
its marks, and what its ancestors are called: elements such as nav or article, and words of
classes and ids. Names count by nearness: those of the nearest ancestor that has one, of
the next such, and of all further ones are different features, so an article stays one
whatever is said of the frames around it. Words on an article or main element are features
apart, since they tell its state; words on html and body, and names that training has not
seen, have no weight. The field is trained on labelled pages (``labelled_pages``, whose
blocks are known to be content or not), and Viterbi decoding picks the content blocks of a
page. An element's features are made from its parent's, so time grows with the page,
however deep its elements are.

Scripts, styles, templates and comments hold no text; tags may be left open, as browsers
allow: a block closes an open paragraph, an end tag all that was opened since. So an open
template, noscript, object, select or svg ends with its parent, and an svg also at a tag that
only HTML has; an open script, style, textarea, title or iframe goes on to the page's end.

Defined cases: a null or empty page and one without content have an empty text; white
space is what str.split takes as such; repeated rows have equal texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm import crf
from shelfmark.llm.common import chunks

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PAGE = frozenset(["html", "body"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: those whose inside is not markup, and the others.
RAW = frozenset("script style textarea title iframe".split())
SILENT = frozenset("template noscript svg object select".split())
#: Elements that a slash in the tag does not make empty.
SLASHED = INLINE | SILENT | {"div", "p"}
#: HTML within an svg, and the tags that end an svg where they are not in one of those.
WITHIN_SVG = frozenset("foreignobject desc title".split())
NOT_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
    "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: An opening tag of the second kind closes an open one of the first, up to the barrier.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "select": (frozenset(["select"]), frozenset()),
    "input": (frozenset(["select"]), frozenset()),
    "textarea": (frozenset(["select"]), frozenset()),
}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
WORDS = re.compile("[a-z]+")
END_OF_NOSCRIPT = re.compile(r"</noscript(?=[\s/>])", re.IGNORECASE)


class Place(NamedTuple):
    """What a block's ancestors tell: the innermost block tag, all known tags, and names."""

    inner: str = ""
    tags: frozenset[str] = frozenset()
    near: frozenset[str] = frozenset()
    next: frozenset[str] = frozenset()
    outer: frozenset[str] = frozenset()

    def within(self, tag: str, words: list[str]) -> Place:
        """The place within an element here."""
        own = frozenset(f"{tag} {w}" if tag in ARTICLES else w for w in words if w in TELLING)
        if tag in TELLING_TAGS:
            own |= {f"<{tag}>"}
        place = self
        if tag not in INLINE:
            place = place._replace(inner=tag if tag in LAYOUT | TELLING_TAGS else "other")
        if tag in LAYOUT and tag not in self.tags:
            place = place._replace(tags=self.tags | {tag})
        if own:
            outer = self.outer if self.next <= self.outer else self.outer | self.next
            place = place._replace(near=own, next=self.near, outer=outer)
        return place


#: Text, place, linked characters.
Block = tuple[str, Place, int]


def blocks(page: str) -> list[Block]:
    """Leaf blocks: text, place among the ancestors, linked characters."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    places: dict[Place, Place] = {}  # one object for equal places
    silent: list[int] = []  # where the stack has elements without text, or HTML within an svg
    pieces: list[str] = []
    linked, at, end = 0, 0, len(page)
    wall = -1  # the next end of a noscript, beyond which nothing begun within it goes

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append((text, stack[-1][1] if stack else Place(), linked))
        pieces.clear()
        linked = 0

    def close(index: int) -> None:
        opened.subtract(t for t, _ in stack[index:])
        del stack[index:]
        while silent and silent[-1] >= index:
            silent.pop()

    while at < end:
        stop = end
        if silent and any(stack[i][0] == "noscript" for i in silent):
            if wall < at:
                ending = END_OF_NOSCRIPT.search(page, at)
                wall = ending.start() if ending else end
            stop = wall if wall > at else end
        found = TAG.search(page, at, stop)
        text = page[at : found.start() if found else stop]
        if text and not silent:
            text = unescape(text)
            pieces.append(text)
            if opened["a"]:
                linked += len(text.strip())
        if not found:
            at = stop
            continue
        at = found.end()
        ends, tag = found.group(1), (found.group(2) or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if ends:
            if not opened[tag]:
                continue
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    close(index)
                    break
            continue
        empty = found.group(3).endswith("/")
        in_svg = bool(silent) and stack[silent[-1]][0] == "svg"
        if in_svg and tag in NOT_SVG:
            while silent and stack[silent[-1]][0] == "svg":
                close(silent[-1])
            in_svg = False
        lowest = silent[-1] if silent else 0
        if opened["p"] and tag not in INLINE and tag not in RAW and tag not in SILENT:
            for index in range(len(stack) - 1, lowest - 1, -1):
                if stack[index][0] == "p":
                    close(index)
                    break
                if stack[index][0] not in INLINE:
                    break
        kinds, barrier = CLOSES.get(tag, (frozenset(), frozenset()))
        if not any(opened[kind] for kind in kinds):
            kinds = frozenset()
        for index in range(len(stack) - 1, lowest - 1, -1):
            if stack[index][0] in kinds:
                close(index)
                break
            if stack[index][0] in barrier or not kinds:
                break
        if tag in RAW and not in_svg:
            closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at, stop)
            at = closing.end() if closing else stop
            continue
        if tag in VOID or empty and (in_svg or tag == "svg" or tag not in SLASHED):
            continue
        words: list[str] = []
        if tag not in PAGE:
            for given in NAMES.findall(found.group(3)):
                words += WORDS.findall(unescape("".join(given)).lower())
        if tag in SILENT or in_svg and tag in WITHIN_SVG:
            silent.append(len(stack))
        place = (stack[-1][1] if stack else Place()).within(tag, words)
        stack.append((tag, places.setdefault(place, place)))
        opened[tag] += 1
    flush()
    return out


#: What the words of a block tell, beside its place.
Marks = tuple[int, int, bool, bool]


def marks(text: str, linked: int) -> Marks:
    """Share of linked text, length in words, a sentence's end, a copyright sign."""
    words = text.count(" ") + 1
    share = min(3, 4 * linked // max(1, len(text)))
    return share, min(words.bit_length(), 7), text[-1] in ".!?:;…”", "©" in text


def named(place: Place, told: Marks) -> list[str]:
    """The features of a block by name."""
    links, words, ends, copyright_ = told
    return [
        f"in {place.inner}", f"links {links}", f"words {words}", f"ends {ends}",
        f"copyright {copyright_}", "any", *(f"<{t}>" for t in place.tags),
        *(f"near {n}" for n in place.near or ("nothing",)),
        *(f"next {n}" for n in place.next), *(f"outer {n}" for n in place.outer),
        f"near aside name {not place.near.isdisjoint(ASIDE_NAMES)}",
        f"next aside name {not place.next.isdisjoint(ASIDE_NAMES)}",
    ]


def features(found: list[Block], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the different kinds of blocks, and the kind of each block.

    Blocks of one place and one set of marks have the same features, so a page of a
    million blocks has few kinds. A kind has as many places as the fullest one needs; a
    feature that is not in ``numbers`` takes none, and unused places are 0.
    """
    kinds: dict[tuple[int, Marks], int] = {}
    own: list[list[int]] = []
    kind = np.zeros(len(found), np.int64)
    for i, (text, place, linked) in enumerate(found):
        key = (id(place), marks(text, linked))
        at = kinds.get(key)
        if at is None:
            at = kinds[key] = len(own)
            own.append(sorted(numbers[n] for n in named(place, key[1]) if n in numbers))
        kind[i] = at
    lengths = np.array([len(x) for x in own], np.int64)
    out = np.zeros((len(own), max(lengths, default=0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = [x for xs in own for x in xs]
    return out, kind


#: Where pages keep what is not their article: elements, and words of classes and ids.
ASIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu")
ASIDE_NAMES = tuple(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer disqus footer header login masthead menu meta modal nav navbar navigation "
    "newsletter notice pagination popup promo promoted promotion reader recommended related "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar "
    "topbar widget".split()
)
MAIN_NAMES = tuple("article body content entry main post story text".split())
#: Elements that are the article, and words that tell a reader's comment even on those.
ARTICLES = ("article", "main")
REPLIES = ("comment", "comments", "reader", "replies", "respond")
TELLING = frozenset(ASIDE_NAMES + MAIN_NAMES)
TELLING_TAGS = frozenset(ASIDE_TAGS + ARTICLES)
LAYOUT = frozenset(
    "blockquote body dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre section table td "
    "th tr ul".split()
)
LONG = "The words of an article run on for a while, and a full stop ends them."
SHORT = "A short heading"


def labelled_pages() -> list[tuple[str, list[int]]]:
    """Pages with their blocks' labels, 1 for content: every kind of aside around and within
    every kind of main part, with long and short blocks in both, and main parts within
    frames whose names are those of asides."""
    tags = [(f"<{t}>", f"</{t}>") for t in ASIDE_TAGS]
    boxes = [(f'<div class="{n}">', "</div>") for n in ASIDE_NAMES]
    asides = tags * 5 + boxes  # tags are far more common than each name
    asides += [(f'<section id="{n}">', "</section>") for n in ASIDE_NAMES[::3]]
    # a frame named as a main part within an aside, or an aside named as both
    asides += [(f'<div class="{n}"><div class="{m}">', "</div></div>")
               for n, m in zip(ASIDE_NAMES, MAIN_NAMES * 6, strict=False)]
    asides += [(f'<div class="{m}-{n}">', "</div>")
               for n, m in zip(ASIDE_NAMES, MAIN_NAMES[3:] * 10, strict=False)]
    asides += [(f'<{t}><div class="{m}">', f"</div></{t}>") for t in ASIDE_TAGS for m in MAIN_NAMES]
    asides += [(f"<{t}><article>", f"</article></{t}>") for t in ("nav", "aside", "footer", "menu")]
    asides += [(f'<article class="{n}">', "</article>") for n in REPLIES] * 4
    asides += [(f'<section><article class="{n}">', "</article></section>") for n in REPLIES] * 4
    asides += [(f"<{t}><section><div>", f"</div></section></{t}>") for t in ASIDE_TAGS]
    named_ = [(f'<div class="{n}">', "</div>") for n in MAIN_NAMES]
    plain = [("<article>", "</article>"), ("<main>", "</main>"), ("<section>", "</section>"),
             ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")]
    states = [(f'<{t} class="{n}">', f"</{t}>") for t in ARTICLES for n in (*ASIDE_NAMES, *MAIN_NAMES)
              if n not in REPLIES]
    mains = [*plain, *named_, ("<main><article>", "</article></main>"),
             ("<article><div class='text'>", "</div></article>")]
    bodies = [
        (f"<h1>{SHORT}</h1><p>{LONG}</p><p>{LONG} {LONG}</p>", 3),
        (f"<p><b>{LONG}<br><p>{SHORT}</p><p>{LONG * 4}</p>", 3),
        (f"<h2>{SHORT}</h2><ul><li>{SHORT}</li><li>{LONG}</li></ul><blockquote>{LONG}</blockquote>"
         f"<h3>{SHORT}</h3><p>{LONG}</p>", 6),
        (f"<p>{SHORT} | {SHORT}</p><p>{LONG}</p><p>See <a href='/x'>{SHORT}</a>.</p>", 3),
        (f"<h1>{SHORT}</h1><p>{SHORT}</p><h2>More</h2><table><tr><td>{SHORT}<td>One</table>"
         f"<figure><figcaption>{SHORT}</figcaption></figure><p>Two words</p>", 7),
    ]
    fillers = [
        (f"<ul><li><a href='/a'>{SHORT}</a></li><li><a href='/b'>More</a></li></ul>", 2),
        (f"<p>{LONG}</p>", 1), (f"{LONG * 3}", 1), (f"&copy; site &middot; {LONG}", 1),
        (f"<h3>{SHORT}</h3><p>{LONG}</p>", 2), (f"{SHORT}.", 1), ("Look here. Some more words.", 1),
    ]
    pages: list[tuple[str, list[int]]] = []

    def add(before: tuple, main: tuple, after: tuple, number: int, frame: tuple = ("", "")) -> None:
        body, content = bodies[number % len(bodies)]
        head, n_head = fillers[number % len(fillers)] if before else ("", 0)
        tail, n_tail = fillers[(number // 3) % len(fillers)] if after else ("", 0)
        head = f"{before[0]}{head}{before[1]}" if before else ""
        tail = f"{after[0]}{tail}{after[1]}" if after else ""
        within = number % 3 == 0  # the last aside within the main part
        inner = f"{main[0]}{body}{tail}{main[1]}" if within else f"{main[0]}{body}{main[1]}{tail}"
        page = f"<html><body>{frame[0]}{head}{inner}{frame[1]}</body></html>"
        pages.append((page, [0] * n_head + [1] * content + [0] * n_tail))

    for number, (aside, main) in enumerate(product(asides, mains)):
        if number % 2 == 0 or aside in tags:
            add(aside, main, asides[(number * 7 + 3) % len(asides)], number)
        if number % 11 == 0:  # nothing but an article, and nothing but an aside
            add((), main, (), number)
            filler, many = fillers[number % len(fillers)]
            pages.append((f"<body>{aside[0]}{filler}{aside[1]}</body>", [0] * many))
    for number, main in enumerate(states * 2):
        add(asides[number % len(asides)], main, (), number)
    frames = [*boxes, ("<form>", "</form>"), *(
        (f"{a[0]}{b[0]}", f"{b[1]}{a[1]}") for a, b in zip(boxes, [*boxes[7:], *boxes[:7]], strict=True)
    )]
    for number, (frame, main) in enumerate(product(frames, (plain[0], plain[1], mains[-2]))):
        add(tags[number % len(tags)], main, boxes[(number * 5) % len(boxes)], number, frame)
        add((), main, (), number + 1, frame)
    # asides beside an article within a frame named as a main part
    whole = [("<main>", "</main>"), *named_]
    for number, (aside, frame) in enumerate(product([*tags, *boxes], whole)):
        if number % 2 == 0 or frame == whole[0]:
            add(aside, (plain[0], named_[number % 8])[number % 2], boxes[number * 5 % len(boxes)], number + 1, frame)
    # a menu without any name before an article without one
    links = f"<div><ul><li><a href='/a'>{SHORT}</a></li><li><a href='/b'>More</a></li></ul></div>"
    for number in range(20):
        body, content = bodies[number % len(bodies)]
        pages.append((f"<body>{links}<div>{body}</div></body>", [0, 0] + [1] * content))
    return pages


@cache
def feature_numbers() -> dict[str, int]:
    """The features of the labelled pages and their numbers, from 1 on."""
    seen = {
        name
        for page, _ in labelled_pages()
        for text, place, linked in blocks(page)
        for name in named(place, marks(text, linked))
    }
    return {n: i for i, n in enumerate(sorted(seen), 1)}


def train() -> crf.Field:
    """The field, from all labelled pages."""
    pages = labelled_pages()
    numbers = feature_numbers()
    found, kind = features([b for page, _ in pages for b in blocks(page)], numbers)
    labels = np.array([x for _, label in pages for x in label])
    lengths = np.array([len(label) for _, label in pages])
    return crf.train(
        found, labels, lengths, 1 + len(numbers), rounds=200, decay=1e-5, unused=0, kind=kind
    )


def extract(pages: DataFrame, field: crf.Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    field = train() if field is None else field
    numbers = feature_numbers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            found = [blocks(x or "") for x in part.column("html").to_pylist()]
            lengths = np.array([len(x) for x in found], np.int64)
            slots, kind = features([b for x in found for b in x], numbers)
            label = crf.viterbi(field, slots, lengths, kind)
            at = np.r_[0, np.cumsum(lengths)]
            texts = [
                "\n".join(b[0] for b, keep in zip(x, label[a:], strict=False) if keep)
                for x, a in zip(found, at[:-1].tolist(), strict=True)
            ]
            yield pa.record_batch({
                "page_id": part.column("page_id"), "url": part.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(x) for x in texts], pa.int64()),
            })

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
