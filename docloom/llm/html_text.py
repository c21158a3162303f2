"""Operator 3: main text of web pages by two passes of block rules.

Pass one labels every block by where it stands (menus, footers, adverts, forms and the like are out), by its link density,
its length and its share of stop words. Pass two gives the blocks that are too short or too mixed to tell the label of their
nearest decided neighbours. Per row, one pass over the input, no exchange.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

LONG, SHORT = 200, 70
STOP_HIGH, STOP_LOW, LINKS_HIGH = 0.30, 0.15, 0.33

# Tag names of HTML, words of class and id attributes, and common function words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select head".split())
OUT_TAGS = frozenset("nav footer aside form button dialog menu search fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that their class or id never puts out.
NAMED_IN = HEADINGS | frozenset("body html article main p".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget footer masthead topbar toolbar pagination pager "
    "comment comments respond disqus reply replies share sharing social related recommended newsletter subscribe signup login search tags".split()
)
STOP_WORDS = frozenset(
    "the of and to in is for on with that this by are be as at it was from or an a not have has but which their they its "
    "der die das und in zu den mit von für ist im auf des dem ein eine nicht als auch an "
    "le la les de des du et en un une est que qui dans pour par sur au aux avec pas plus "
    "el los las de del y en un una que es por con para su se al lo como más no".split()
)

#: Words that say nothing beside a name of ``OUT_NAMES`` in one compound, as in ad-box or comment-list.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons container content group inner items item left links link list main menu module outer panel "
    "posts post right section site slot top unit wrap wrapper".split()
)

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _named_out(value: str) -> bool:
    """Whether a class or id names a part that is out: each of its tokens as a whole, the words of a compound together."""
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if any(p in OUT_NAMES for p in parts) and all(p in OUT_NAMES or p in NEUTRAL for p in parts):
            return True
    return False


def _is_out(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in OUT_TAGS or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in NAMED_IN and _named_out(value):
                return True
        elif name == "role":
            if value.lower() in OUT_ROLES:
                return True
        elif name == "style":
            if "display:none" in value.lower().replace(" ", ""):
                return True
        elif name == "hidden" or value.lower() == "true":
            return True
    return False


def tags_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """The page as ``(text before, tag, closing, attributes)``, the rest of the text with an empty tag.

    One scan from left to right: what a search has found missing up to the end of the page is not searched for again. Quoted
    attribute values may hold ``>``; where quotes never close, the next ``>`` ends the tag, and where none is left, ``<`` is
    text. The content of raw elements is passed over.
    """
    at, n, text_from = 0, len(page), 0
    quotes = True
    last_end = page.rfind(">")
    unclosed: set[str] = set()
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[text_from:at], "!", False, ""
            at = text_from = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            yield page[text_from:at], "!", False, ""
            at = text_from = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at) if at < last_end else -1
            yield page[text_from:at], "!", False, ""
            at = text_from = n if end < 0 else end + 1
            continue
        m = _OPEN.match(page, at)
        if m is None or m.end() > last_end:
            at += 1
            continue
        closed = _QUOTED.match(page, m.end()) if quotes else None
        if closed is None:
            quotes = False
        end = closed.end() - 1 if closed else page.find(">", m.end())
        tag, closing, attrs = m[2].lower(), bool(m[1]), page[m.end() : end]
        yield page[text_from:at], tag, closing, attrs
        at = text_from = end + 1
        if tag in RAW_TAGS and not closing and not attrs.endswith("/"):
            stop = None if tag in unclosed else _raw_end(tag).search(page, at)
            if stop is None:
                unclosed.add(tag)
                at = text_from = at if tag in ("head", "select", "noscript") else n
            else:
                at = text_from = stop.start() if stop[0][1:5].lower() == "body" else stop.end()
    yield page[text_from:], "", False, ""


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>" + (r"|<body\b" if tag == "head" else ""), re.I)


def blocks_of(page: str) -> list[dict]:
    """Text blocks in page order: raw text pieces, tag, place and length of linked text."""
    blocks: list[dict] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, opens a part that is out, opens a main part
    opened: Counter = Counter()  # elements of the stack by tag, and those that are out
    opened_out: Counter = Counter()
    out_depth = main_depth = link_depth = 0
    pieces: list[str] = []
    linked: list[str] = []
    tag_now = "body"

    def close() -> None:
        nonlocal pieces, linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            links = " ".join(html.unescape("".join(linked)).split())
            blocks.append({"text": text, "tag": tag_now, "out": out_depth > 0, "main": main_depth > 0, "linked": len(links)})
        pieces, linked = [], []

    def pop() -> str:
        nonlocal out_depth, main_depth
        tag, was_out, was_main = stack.pop()
        opened[tag] -= 1
        opened_out[tag] -= was_out
        out_depth -= was_out
        main_depth -= was_main
        return tag

    for raw, tag, closing, attrs in tags_of(page):
        if raw:
            pieces.append(raw)
            if link_depth:
                linked.append(raw)
        if tag in ("", "!"):
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag in RAW_TAGS:
            if not closing and not attrs.endswith("/") and tag not in ("svg", "math", "canvas"):
                close()
        elif tag in VOID_TAGS:
            if tag == "hr":
                close()
        elif tag == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        elif (
            tag in BLOCK_TAGS
            or tag == "button"
            or (closing and opened_out[tag])  # the end of an inline part that is out
            or (not closing and attrs and _is_out(tag, attrs, main_depth > 0))
        ):
            close()
            if closing:
                if opened[tag]:
                    while pop() != tag:
                        pass
                if tag in ("li", "p", "div", "nav", "ul"):
                    link_depth = 0
                tag_now = stack[-1][0] if stack else "body"
                continue
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                pop()
            is_out, is_main = _is_out(tag, attrs, main_depth > 0), tag in MAIN_TAGS
            stack.append((tag, is_out, is_main))
            opened[tag] += 1
            opened_out[tag] += is_out
            out_depth += is_out
            main_depth += is_main
            tag_now = tag
    close()
    return blocks


def classify(blocks: list[dict]) -> list[bool]:
    """Keep or leave each block."""
    has_main = any(b["main"] and not b["out"] for b in blocks)
    labels: list[str] = []
    for b in blocks:
        size = len(b["text"])
        words = _LETTERS.findall(b["text"].lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        links = b["linked"] / size
        if b["out"] or (has_main and not b["main"]):
            label = "bad"
        elif links > LINKS_HIGH:
            label = "bad" if size >= SHORT or links > 0.9 or not b["main"] else "short"
        elif size < SHORT:
            label = "short"
        elif stops >= STOP_HIGH:
            label = "good" if size >= LONG else "near"
        elif stops >= STOP_LOW:
            label = "near"
        else:
            label = "near" if b["main"] else "bad"
        labels.append(label)
    if not has_main and "good" not in labels and not any(x == "near" for x in labels):
        return [x == "short" for x in labels]  # nothing decided: what isn't out is all there is
    keep = []
    nearest = {1: [None] * len(blocks), -1: [None] * len(blocks)}
    for way, order in ((1, range(len(blocks))), (-1, range(len(blocks) - 1, -1, -1))):
        last: dict[tuple[bool, bool], str] = {}
        for i in order:
            place = blocks[i]["main"], blocks[i]["out"]
            nearest[way][i] = last.get(place)
            if labels[i] in ("good", "bad"):
                last[place] = labels[i]
    for i, b in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            keep.append(labels[i] == "good")
            continue
        before, after = nearest[1][i], nearest[-1][i]
        if before == after and before is not None:
            keep.append(before == "good" or b["main"])
        elif before is None and after is None:
            keep.append(b["main"] or labels[i] == "near")
        elif b["tag"] in HEADINGS:
            keep.append((after or before) == "good" or b["main"])
        else:
            keep.append(b["main"] or labels[i] == "near" or "good" in (before, after))
    return keep


def main_text(page: str | None) -> str:
    """Main text of one page: kept blocks in page order, a line each."""
    blocks = blocks_of(page or "")
    return "\n".join(b["text"] for b, k in zip(blocks, classify(blocks), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Edge cases: null and empty html give the empty text; broken markup (open tags, open comments, stray ends) is read as far
    as it goes; repeated rows, null ids and urls are kept; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            out = batch[["page_id", "url"]].copy()
            out["page_id"] = out["page_id"].astype("Int64")
            yield out.assign(text=text, n_chars=[len(t) for t in text])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return picked.mapInPandas(tidied(run), "page_id long, url string, text string, n_chars long")
