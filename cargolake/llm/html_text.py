"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each stretch between block-level tags.
Elements that by tag, role, class or id are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, hidden parts) leave a gap of blank lines, unless they hold the page's
chief article: the longest by text outside links of those that are not a
comment or a teaser by class and not inside an element of such.  A name that
holds a listed word in its middle ("layout-sidebar-right") does not make an
element unwanted that holds most of the page's text.  Then the text lengths of
sliding windows of lines are summed: a region surges where its windows pass a
threshold and ends at a dive to nothing; text between is kept.  Link text adds
no length, so unlabelled link lists dive by themselves (but for a linked h1).  The
threshold falls with the page's largest window, so short articles are kept.  A
mark (<article>, <main>) adjusts that choice where the marked text is a fair share
of the page: marked lines that dived come back, regions outside it go.  An advert
within the text is passed over; other unwanted elements part regions.

The page is read once from left to right, in time that grows with its length.

Edge cases: null or empty html, or html without text, gives an empty text;
unclosed or crossed tags are read as far as they go; a head without an end ends at
the first tag that cannot be in it; a quoted > is honoured in the first thousand
characters of a tag; an unclosed unwanted element is not followed, except a
footer, script, style, title or textarea, which end with the page; repeated rows and null ids are read each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import per_text, prepare

WINDOW = 3
SURGE = 86  # characters in a window
SURGE_SHARE = 0.3  # of the page's largest window, where that is less
MAIN_SHARE = 0.25  # of the text, above which only marked articles are read

# Elements whose content is no text, those of them that run on if unclosed, and what a head may hold.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video select title".split())
RUNS_ON = frozenset("script style textarea title".split())
IN_HEAD = frozenset("meta link base head".split())
# Elements, roles and names that mark what is no article text.
UNWANTED_TAGS = frozenset("nav footer header aside form button dialog menu fieldset label input option datalist marquee".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
UNWANTED_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment
    comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav
    navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended
    related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar
    widget widgets""".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adbox promo promotion sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_PARTS = frozenset("post article entry content story news".split())  # before "header": that of the article
STATES = frozenset("with without has no is show hide".split())  # parts of names that tell a state by what follows
# Those of the above whose articles are remarks or teasers.
REMARK_TAGS = frozenset(("aside", "nav"))
REMARK_NAMES = frozenset("comment comments commentlist disqus recommended related replies reply respond sidebar".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike
    strong sub sup time tt u var wbr""".split())
MAIN = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body", "article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

LONGEST_TAG = 1000
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _tokens(page: str) -> list[tuple]:
    """(start, end, slash, name, attributes, raw) of each tag; comments have no name, nor have raw elements, which are one token."""
    out, at, ended = [], 0, set()  # raw names that have no end tag from here on
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            out.append((start, at, "", "", "", False))
            continue
        named = _NAME.match(page, start)
        if not named and page[start + 1:start + 2] not in ("!", "?"):
            at = start + 1
            continue
        rest = _REST.match(page, named.end(), named.end() + LONGEST_TAG) if named else None
        end = rest.end() if rest else page.find(">", start) + 1
        if not end:  # no tag ends from here on
            break
        at = end
        if not named:
            out.append((start, end, "", "", "", False))
            continue
        slash, name, attributes = named[1], named[2].lower(), page[named.end():end - 1]
        if slash or name not in RAW or attributes.endswith("/"):
            out.append((start, end, slash, "" if name in RAW else name, attributes, False))
            continue
        close = None if name in ended else re.compile(f"</{name}(?=[\\s>/])[^>]*>?", re.I).search(page, end)
        if close:
            at = close.end()
        else:
            ended.add(name)
            at = len(page) if name in RUNS_ON else end
        out.append((start, at, "", "", "", True))
    return out


WANTED, INNER, ADVERT, UNWANTED, REMARK = range(5)


def _kind(name: str, attributes: str) -> int:
    """INNER: only by a listed word in the middle of a name; REMARK: articles in it are none of the page's own."""
    if name in REMARK_TAGS:
        return REMARK
    kind = UNWANTED if name in UNWANTED_TAGS else WANTED
    if not attributes or name in HEADINGS or name in ROOTS and name != "article":
        return kind
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if name == "article":  # whole names only: an article "comments-open" has comments
                if not REMARK_NAMES.isdisjoint(value.split()):
                    return REMARK
                continue
            if name == "p":  # a paragraph is judged by whole class names alone
                if key == "class" and not UNWANTED_NAMES.isdisjoint(value.split()):
                    kind = max(kind, UNWANTED if ADVERTS.isdisjoint(value.split()) else ADVERT)
                continue
            for one in value.split():
                parts = re.split(r"[^a-z0-9]+", one)
                state = next((k for k, part in enumerate(parts) if part in STATES), len(parts))
                parts = parts[:state]  # "content-with-sidebar" names a page that has one
                listed = [k for k, part in enumerate(parts) if part in UNWANTED_NAMES]
                if not listed:
                    continue
                if not REMARK_NAMES.isdisjoint(parts) and (0 in listed or listed[-1] == len(parts) - 1):
                    return REMARK
                if parts[-1] == "header" and len(listed) == 1 and parts[0] in ARTICLE_PARTS:
                    continue
                whole = 0 in listed or listed[-1] == len(parts) - 1
                advert = not ADVERTS.isdisjoint(parts[k] for k in listed)
                kind = max(kind, (ADVERT if advert else UNWANTED) if whole else INNER)
        elif name != "article" and (key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in UNWANTED_ROLES
                                    or key == "style" and "display:none" in value.replace(" ", "")):
            kind = UNWANTED
    return kind


def _chiefs(page: str, tokens: list[tuple], matched: dict[int, int], kinds: dict[int, int], mains: list[int]) -> tuple[list[int], list[int]]:
    """(tokens that open a chief article, text outside links before each token and in all)."""
    before, link, at = [0], 0, 0
    for start, end, slash, name, _, raw in tokens:
        before.append(before[-1] + (0 if link else len("".join(page[at:start].split()))))
        at = end
        if name and not raw and (name == "a" or name not in INLINE):
            link = int(name == "a" and not slash)
    before.append(before[-1] + len("".join(page[at:].split())))
    turns = [0] * (len(tokens) + 1)  # where remarks begin and end
    for i, kind in kinds.items():
        if kind == REMARK and i in matched:
            turns[i] += 1
            turns[matched[i]] -= 1
    inside, inner = 0, set()
    for i in range(len(tokens)):
        inside += turns[i]
        if inside:
            inner.add(i)
    size = {i: before[matched.get(i, len(tokens)) + 1] - before[i + 1] for i in mains if kinds.get(i) != REMARK}
    found = []
    for name in MAIN:
        own = [i for i in size if tokens[i][3] == name and i not in inner]
        if own:
            found.append(max(own, key=size.__getitem__))
    return found + [i for i in size if i in inner and 2 * size[i] > before[-1]], before


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, inside a marked article) of each line; a gap is a blank line."""
    tokens = _tokens(page)
    closes: dict[str, list[int]] = {}  # per name, indices of its tags
    mains = []
    for i, (_, _, slash, name, _, _) in enumerate(tokens):
        if name:
            closes.setdefault(name, []).append(i)
            if name in MAIN and not slash:
                mains.append(i)
    matched: dict[int, int] = {}
    for name, places in closes.items():
        if name in VOID:
            continue
        stack: list[int] = []
        for i in places:
            if not tokens[i][2]:
                stack.append(i)
            elif stack:
                matched[stack.pop()] = i
    kinds = {i: kind for i, (_, _, slash, name, attributes, raw) in enumerate(tokens) if name and not slash and not raw
             and (kind := _kind(name, attributes))}
    chiefs, before = _chiefs(page, tokens, matched, kinds, mains) if kinds else ([], [0])
    lines: list[tuple[str, int, bool]] = []
    piece: list[str] = []
    weight, depth, link, at, i = 0, 0, 0, 0, 0
    in_head = in_title = False

    def close_line() -> None:
        nonlocal weight
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            lines.append((text, weight, depth > 0))
        piece.clear()
        weight = 0

    def add(text: str) -> None:
        nonlocal weight
        if text:
            piece.append(text)
            weight += 0 if link and not in_title else len("".join(text.split()))

    while i < len(tokens):
        start, end, slash, name, attributes, raw = tokens[i]
        if not in_head:
            add(page[at:start])
        at = end
        if raw or not name:
            i += 1
            continue
        in_head = name in IN_HEAD if in_head else name == "head"
        if name == "head":
            in_head = not slash
            i += 1
            continue
        if name == "h1":
            in_title = not slash
        if kinds.get(i):
            stop = matched.get(i, len(tokens) if name == "footer" else None)
            most = stop is not None and kinds[i] == INNER and 2 * (before[stop + 1] - before[i + 1]) > before[-1]
            if stop is not None and not most and not any(i < m < stop for m in chiefs):
                if name not in INLINE:
                    close_line()
                    if kinds[i] != ADVERT:
                        lines.extend([("", 0, False)] * WINDOW)
                at = tokens[stop][1] if stop < len(tokens) else len(page)
                i = stop + 1
                continue
        if name in MAIN:
            close_line()
            depth = max(0, depth + (-1 if slash else 1))
            lines.extend([("", 0, False)] * WINDOW)
        elif name == "a":
            link = 0 if slash else 1
        elif name not in INLINE:
            close_line()
            link = 0
        i += 1
    if not in_head:
        add(page[at:])
    close_line()
    return lines


def regions(size: list[int]) -> list[bool]:
    """For each line, whether it lies between a surge and the dive after it, from the lengths that count."""
    block = [sum(size[i:i + WINDOW]) for i in range(len(size))]
    least = min(SURGE, SURGE_SHARE * max(block, default=0))
    kept, i = [False] * len(size), 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        end = i  # a region runs until its windows dive to nothing
        while end < len(size) and block[end]:
            end += 1
        if max(block[i:end]) >= least:
            kept[i:end] = [True] * (end - i)
        i = end
    return kept


def main_text(page: str) -> str:
    lines = lines_of(page)
    size = [n for _, n, _ in lines]
    kept = regions(size)
    marked = sum(n for _, n, inside in lines if inside)
    if marked and marked >= MAIN_SHARE * sum(size):
        kept = [inside for _, _, inside in lines]
    return " ".join(text for (text, _, _), keep in zip(lines, kept) if keep and text)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    prepare(pages.sparkSession)

    def row(raw: bytes) -> tuple:
        text = main_text(raw.decode("utf-8", "replace"))
        return text, len(text)

    found = per_text([("text", pa.string()), ("n_chars", pa.int64())], "text string, n_chars long", row)(F.col("html"))
    return pages.select("page_id", "url", found.alias("x")).select("page_id", "url", "x.text", "x.n_chars")
