"""Main text of web pages as the maximum-scoring subsequence of their tokens.

Method.  A page is a sequence of text runs and tags.  The words of a run score by its context (the
role of the element around it and its innermost block tag), tags score negative by role and
name.  Both weights are log odds learned from labelled pages, those that mark their article by exactly one
``article`` element: how much more often a context or tag stands inside than outside.  One linear
scan finds the contiguous region with the largest sum.  Runs inside the region whose element is a menu, header,
footer, sidebar, notice, advert, form or comment section are left out; inside a marked
article or main element such runs score nothing, so they cannot split it.

Character references are decoded, white space is one space, inline tags join and all others part
words, and blocks follow in page order, joined by one space.

Roles come from element names and from words of class, id and role attributes.  Hints of html and body mean nothing, and the role of an element around
most of a page's words lapses where hardly any words would be left.

Edge cases: null and empty pages and pages where nothing scores positive give an empty text; unclosed
comments, scripts and elements reach to the end; a head ends at the first tag that cannot stand in it; a tag that never ends
takes the rest of the page; stray closing tags are ignored; every page is read in time proportional to its length; without labelled
pages the prior weights decide; repeated rows give one row each; null ids and urls are passed on;
other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][\w:-]*+")
QUOTE_OR_END = re.compile(r"""["'>]""")
#: References to numbers beyond Unicode, and leading zeros, which the library reads digit by digit.
LARGE = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
HINT = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = ("script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "title")
#: Of these, the ones that reach to the end of the page where they are not closed.
OPEN_ENDED = frozenset("script style textarea iframe title".split())
#: What may stand in a head; another start tag ends it.
HEAD = frozenset("base link meta html head".split()) | frozenset(RAW)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
BLOCKS = frozenset(
    "p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 div section td th tr table pre blockquote figure figcaption body address "
    "details summary center".split())
ROLES = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
         "button": "form", "dialog": "notice"}
#: Words of class, id and role attributes that name an element's role.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sitemap tabs topbar",
    "header": "header masthead banner logo",
    "footer": "footer copyright colophon",
    "sidebar": "sidebar aside widget related recommended trending rail complementary more-stories",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adsbox",
    "form": "form search login share sharing social",
    "comments": "comment comments respond disqus replies reply feedback reviews",
}
HINT_ROLE = {word: role for role, words in HINTS.items() for word in words.split()}
#: Words of the same attributes that name the article itself.
CONTENT = frozenset("article articlebody post entry story content".split())
LIMIT = 8.0
#: An element around this many words, most of the page's, is a wrapper whatever its hints say.
WRAPPED = 30


def references(text: str) -> str:
    """Character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LARGE.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return entities.unescape(text)


def next_tag(page: str, at: int, quotes: bool) -> tuple[int, int, str, str, bool] | None:
    """``(start, end, name, attributes, quotes)`` of the next comment or declaration (empty name) or tag.

    A tag ends at its first ``>`` outside quotes.  Where the page has none left, quotes mean nothing from there on (the last value
    turns false) and a tag ends at the first ``>`` or with the page, so a page is read once.
    """
    size = len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, size if end < 0 else end + 3, "", "", quotes
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            return start, size if end < 0 else end + 1, "", "", quotes
        name = NAME.match(page, start + 1)
        if not name:
            at = start + 1
            continue
        end = name.end()
        while quotes and (mark := QUOTE_OR_END.search(page, end)):
            if mark[0] == ">":
                end = mark.start()
                break
            close = page.find(mark[0], mark.end())
            end = mark.end() if close < 0 else close + 1
        else:
            quotes, end = False, page.find(">", name.end())
        return start, size if end < 0 else end + 1, name[0], page[name.end() : size if end < 0 else end], quotes
    return None


def role_of(name: str, attributes: str) -> str | None:
    """Role an element's tag or attributes name, ``content`` for the article, None when nothing does."""
    if name in ("article", "main"):
        return "content"
    words: list[str] = []
    for found in HINT.findall(attributes):
        for part in (found[0] or found[1] or found[2]).lower().split():
            words += [part, *re.split(r"[-_]", part)]
    for word in words:
        if word in HINT_ROLE:
            return HINT_ROLE[word]
    if name in ROLES:
        return ROLES[name]
    return "content" if name in ("div", "section") and any(w in CONTENT for w in words) else None


def tokens(page: str, lapsed: frozenset[int] = frozenset(), found: dict[int, list[int]] | None = None):
    """Yield ``(text, context, role, marked)`` for text runs and ``(None, tag, breaks, None)`` for tags.

    ``marked`` is true inside a content element; a content element ends the role around it.  Hints of html and body
    mean nothing.  Elements are known by the number of their tag: those in ``lapsed`` name no role, and ``found`` receives, for
    each other one whose hints or form name a role, the number of words that have it from there.
    """
    stack: list[tuple[str, str | None, bool, str, int]] = []  # name, role, marked, block, element of the role
    opened: Counter = Counter()
    at, in_head, quotes, number = 0, False, True, 0

    def run(text):
        role, marked, block, source = stack[-1][1:] if stack else (None, False, "none", -1)
        if in_head or not text:
            return None
        if text.isspace():
            return None, "", True, None
        if found is not None and source >= 0:
            found[source][0] += len(text.split())
        return references(text), f"{role or 'plain'}:{block}", role, marked

    def close(name):
        while stack:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    while tag := next_tag(page, at, quotes):
        start, end, name, attributes, quotes = tag
        if token := run(page[at:start]):
            yield token
        at, number = end, number + 1
        if not name:
            continue
        closing, name = name[0] == "/", name.lstrip("/").lower()
        breaks = name not in INLINE
        if in_head:
            if closing and name == "head" or not closing and name not in HEAD:
                in_head = False
                if closing:
                    continue
            elif not closing and name in RAW:
                at = _raw_end(page, at, name)
                continue
            else:
                continue
        if closing:
            yield None, f"{(stack[-1][1] if stack else None) or 'plain'}:/{name}", breaks, None
            if opened[name]:
                close(name)
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            close("p")  # a paragraph ends where the next begins
        own = None if number in lapsed else role_of(name, "" if name in ("html", "body") else attributes)
        role, marked, block, source = stack[-1][1:] if stack else (None, False, "none", -1)
        if own == "content":
            role, marked, source = None, True, -1
        elif own and not (own == "header" and marked):  # an article's own heading is part of it
            role, source = own, -1
            if found is not None and (name == "form" or ROLES.get(name) != own):
                found[number] = [0]
                source = number
        yield None, f"{role or 'plain'}:{name}", breaks, None
        if name in RAW:
            at = _raw_end(page, at, name)
        elif name == "head":
            in_head = True
        elif name not in VOID and not attributes.endswith("/"):
            stack.append((name, role, marked, name if name in BLOCKS else block, source))
            opened[name] += 1
    if token := run(page[at:]):
        yield token


def _raw_end(page: str, at: int, name: str) -> int:
    """Where the content of a raw element ends; one that is not closed reaches to the end or holds nothing."""
    end = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
    return end.end() if end else len(page) if name in OPEN_ENDED else at


def parsed(page: str) -> list[tuple]:
    """Tokens of a page, with the roles of wrappers lapsed.

    Where roles leave less than a tenth of the words, the element that gives its role to most of the page's words is
    taken for a wrapper, if hints or a form name that role; one after the other, a few times at most."""
    lapsed: frozenset[int] = frozenset()
    for _ in range(8):
        found: dict[int, list[int]] = {}
        out = list(tokens(page, lapsed, found))
        words = plain = 0
        for text, _, role, _ in out:
            if text is not None:
                n = len(text.split())
                words, plain = words + n, plain + (0 if role else n)
        most = max(found, key=lambda e: found[e][0], default=None)
        if 10 * plain >= words or most is None or found[most][0] < max(WRAPPED, words / 2):
            break
        lapsed |= {most}
    return out


def count_labelled(page: str, into: Counter) -> None:
    """Add the contexts and tags of a page with exactly one article element, inside and outside."""
    if len(re.findall(r"<article[\s>]", page)) != 1:
        return
    inside = False
    for text, context, _, _ in parsed(page):
        if text is None:
            name = context.partition(":")[2]
            inside = inside or name == "article"
            if context:
                into["t", context, inside] += 1
            inside = inside and name != "/article"
        else:
            into["w", context, inside] += len(text.split())


def weights(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Log odds of standing inside; words of plain runs lean to positive, all else to negative."""
    total = {(kind, side): sum(n for (k, _, s), n in counts.items() if (k, s) == (kind, side))
             for kind in "wt" for side in (True, False)}
    out = {}
    for kind, name in {(k, n) for k, n, _ in counts}:
        plain = kind == "w" and name.startswith("plain:")
        odds = [(counts.get((kind, name, side), 0) + (2.0 if plain == side else 1.0)) / (total[kind, side] + 10.0)
                for side in (True, False)]
        value = math.log(odds[0] / odds[1])
        out[kind, name] = max(-LIMIT, min(LIMIT, value)) if kind == "w" else max(-LIMIT, min(-0.1, value))
    return out


def extract(page: str, learned: dict[tuple[str, str], float]) -> str:
    """Text of the best region."""
    parts = parsed(page)
    best = total = 0.0
    first = start = last = 0
    for i, (text, context, role, marked) in enumerate(parts):
        if text is None:
            total += learned.get(("t", context), -0.1 if context.startswith("plain:") else -0.5) if context else 0.0
        elif not (role and marked):
            total += len(text.split()) * learned.get(("w", context), -1.0 if role else 1.0)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total >= best:
            best, first, last = total, start, i + 1
    kept = []
    for text, _, role, _ in parts[first:last]:
        if text is None:
            kept.append(" " if role else "")  # for tags: whether they part words
        elif not role:
            kept.append(text)
    return " ".join("".join(kept).split())


def learn(pages: DataFrame, html_col: str = "html") -> dict[tuple[str, str], float]:
    """Weights from all labelled pages; one sum for each context and tag reaches the driver."""
    known = set(BLOCKS) | set(INLINE) | set(VOID) | set(RAW) | set(ROLES) | {"html", "article", "main"}

    def count(batches):
        import pyarrow as pa

        into: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_labelled(page or "", into)
        rows = [(k, n, s, c) for (k, n, s), c in into.items() if k == "w" or n.partition(":")[2].lstrip("/") in known]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["kind", "name", "inside", "n"])

    sums = pages.select(html_col).mapInArrow(count, "kind string, name string, inside boolean, n long")
    sums = sums.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return weights({(r.kind, r.name, r.inside): r.n for r in sums.collect()})


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``."""
    learned = learn(pages, html_col)

    @F.arrow_udf("string")
    def best(column):
        import pyarrow as pa

        return pa.array([extract(page or "", learned) for page in column.to_pylist()], pa.string())

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), best(F.col(html_col)).alias("text"))
