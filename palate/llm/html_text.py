"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block from its stop-word density, its length and its link
density. What stands around a block shifts these thresholds: inside an article or main element they are low; containers that by tag
or name hold no article (forms, asides, adverts, notices, comments, ...) raise them beyond what a block can reach, unless the
container holds the bulk of the page; navigation and footers hold no article at all. The second pass settles the blocks that were too
short or too plain to tell: they take the label of their nearest decided neighbours, and headings that of the text they stand over.

Odd cases: null, empty or text-free html gives the empty string; unclosed tags, links, quotes and comments end with their block or
with the page; pages of any length are read whole, in time linear in them; other columns stay as they are (one named as the output is
replaced).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, slices

# Common function words of the languages that pages come in.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its more no not of on one or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis bist da das dass dem den der des die dir du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur",
    "fr": "a au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes ne nos nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vos votre vous y à été être",
    "es": "a al algo como con cuando de del desde donde dos el ella en entre era es ese esta este ha hay la las le les lo los me mi mucho muy más ni no nos o otra para pero por porque que se ser si sin sobre son su sus también te tiene todo tu un una uno y ya",
    "it": "a ad al alla anche che chi ci come con cui da dal dalla dei del della delle di e gli ha ho i il in io la le lo ma mi nel nella non o per più questo se si sono su sul tra un una è",
    "pt": "a ao aos as até com como da das de do dos e ela em entre era essa este eu foi isso já mais mas me muito na nas no nos não o os ou para pela pelo por que se sem ser seu sua são também um uma à é",
    "nl": "aan als bij dat de den der deze die dit een en er haar had heeft het hij hoe ik in is je kan maar me met mijn naar niet nog of om onder ook op over te toch tot uit van veel voor want was wat we wel wordt ze zich zij zijn zo",
}
# Elements that end a block, that hold no text, and that never hold an article's text.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object embed noframes xmp".split())
APART = frozenset("nav footer button select label option menu dialog canvas audio video head map".split())
#: Elements that hold no article unless they hold the bulk of the page, like containers named so.
ASIDE = frozenset("aside form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id or role that mark a container as no part of the article.
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adslot|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|cookiebar|consent|gdpr|notices?|alerts?|popups?|modal|overlay|toast"
    r"|nav|navbar|navigation|menus?|submenu|breadcrumbs?|pagination|pager|toc|sidebars?|side-?bar|rail|widgets?|masthead|topbar|site-?header|page-?header|site-?footer|page-?footer|footer|foot|copyright|legal|disclaimer"
    r"|comments?|commentlist|respond|replies|reply|disqus|discussion|reviews|share|sharing|social|follow|related|recommended|recommendations|trending|popular|newsletter|subscribe|subscription|signup|sign-?up|login|log-?in"
    r"|search|searchbox|tags|tagcloud|skip-?link|complementary|contentinfo|alertdialog|hidden|sr-only|visually-hidden)(?:$|[\s_-])",
    re.I,
)
HOME = re.compile(r"itemprop\s*=\s*[\"']?articleBody|role\s*=\s*[\"']?(?:main|article)\b|(?:class|id)\s*=\s*[\"']?[^\"'>]*\b(?:article-?body|entry-?content|post-?content|article-?content|story-?body)\b", re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"'>]*+>))*+")
OPENED = re.compile(r"</?[a-zA-Z][^\s/>]*")
#: A tag among quotes that nothing closes ends at the next angle bracket.
CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|(?=<)|\Z)")
TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"'>]*+>))*+)(?:>|\Z))", re.S)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f\u061f\u0964\u2026:;,\u3001\u060c]")

#: Thresholds of the first pass: characters of a short and of a long block, link and stop-word densities.
SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH = 70, 200, 0.33, 0.12, 0.2
#: Share of the page's text over which a container's name does not count, stop-word density of a page under which no list fits, and
#: share of the text that could be an article under which an article element does not rule out what stands beside it.
BULK, FITS, HOME_LEAST = 0.75, 0.05, 0.2
#: Where no list fits: words from which a block is dense if it has marks of sentences, too.
SENTENCE_WORDS = 8

_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "brief"


class Block:
    """away: by its tags or hidden; named, around: the innermost container that by name holds no article, within the article and around
    it (0: none); home: the article around."""

    __slots__ = ("around", "away", "heading", "home", "linked", "named", "text")

    def __init__(self, text: str, linked: int, away: bool, named: int, around: int, home: int, heading: bool):
        self.text, self.linked, self.away, self.named, self.around, self.home, self.heading = text, linked, away, named, around, home, heading


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in order, each with the characters of it that are links and the kind of container around it; and of each
    container that by name holds no article (from 1) the next one around it, 0 if there is none."""
    out: list[Block] = []
    parts: list[str] = []
    inside = [0]
    # name, holds no article by its tags, container that by name holds none within and around the article, number of the article around
    open_tags: list[tuple[str, bool, int, int, int]] = []
    depth: Counter[str] = Counter()
    linked = in_link = n_home = breaks = 0
    outside = (False, 0, 0, 0)
    (away, named, around, home), heading = outside, False

    def flush() -> None:
        nonlocal linked, breaks, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, away, named, around, home, heading))
            parts.clear()
        linked = breaks = in_link = 0

    def say(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if breaks and not text.isspace():
                breaks = 0
            if in_link:
                linked += len(" ".join(text.split()))

    def close() -> str:
        nonlocal away, named, around, home
        name = open_tags.pop()[0]
        depth[name] -= 1
        away, named, around, home = open_tags[-1][1:] if open_tags else outside
        return name

    pos, n, unquoted = 0, len(html), 0
    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            say(html[pos:])
            break
        say(html[pos:lt])
        m = TAG.match(html, lt) if lt >= unquoted else CUT_TAG.match(html, lt)
        if not m and lt >= unquoted and (opened := OPENED.match(html, lt)):
            # no tag before this quote needs another look for its end; either kind of quote is left open once at most
            unquoted = ATTRIBUTES.match(html, opened.end()).end()
            m = CUT_TAG.match(html, lt)
        if not m:
            say("<")
            pos = lt + 1
            continue
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name, attrs = name.lower(), m[3]
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in HEADINGS or name in BLOCK or name in APART:
                flush()
            if depth[name]:
                while close() != name:
                    pass
            if name in HEADINGS:
                heading = False
            continue
        if name == "br":
            breaks += 1
            if breaks >= 2:
                flush()
            else:
                parts.append(" ")
            continue
        if name in RAW:
            if name in BLOCK:
                flush()
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = end.end() if end else n
            continue
        if name == "a":
            in_link = int(bool(HREF.search(attrs)))
            continue
        if name in BLOCK or name in APART:
            flush()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == name:
                close()
            heading = name in HEADINGS
        if name in VOID:
            continue
        if name in BLOCK or name in APART or name in ("span", "ins"):
            names = " ".join(a or b or c for a, b, c in NAMED.findall(attrs)) if attrs else ""
            if name in ("article", "main") or (attrs and HOME.search(attrs)):
                if not home:
                    n_home += 1
                    home, named, around = n_home, 0, named
            apart = (name == "header" and not home) or name in ASIDE
            away = away or name in APART or bool(attrs and UNSEEN.search(attrs))
            if apart or (names and name not in ("body", "html", "main") and AWAY.search(names)):
                inside.append(named)
                named = len(inside) - 1
            open_tags.append((name, away, named, around, home))
            depth[name] += 1
    flush()
    return out, inside


def _language(found: list[Block], declared: str) -> frozenset[str]:
    if declared in _STOPS:
        return _STOPS[declared]
    seen = [w for b in found for w in WORD.findall(b.text.lower())]
    return max(_STOPS.values(), key=lambda stops: sum(w in stops for w in seen))


def _apart(found: list[Block], inside: list[int]) -> list[bool]:
    """Whether each block is out by its containers. A name does not put out what is over ``BULK`` of the page's text, nor, if no other
    article is left, an article inside."""
    held, total = [0] * len(inside), 0
    for b in found:
        if not b.away:
            total += len(b.text)
            held[b.named] += len(b.text)
            if b.around != b.named:
                held[b.around] += len(b.text)
    counts = [False] * len(inside)
    for c in range(len(inside) - 1, 0, -1):  # a container comes after the one around it
        held[inside[c]] += held[c]
    for c in range(1, len(inside)):
        counts[c] = held[c] <= BULK * total or counts[inside[c]]
    named, around = [counts[b.named] for b in found], [counts[b.around] for b in found]
    homes = any(b.home and not (b.away or x or y) for b, x, y in zip(found, named, around, strict=True))
    return [b.away or x or (y and (homes or not b.home)) for b, x, y in zip(found, named, around, strict=True)]


def labels(found: list[Block], inside: list[int], declared: str = "") -> list[bool]:
    """Whether each block belongs to the article. If none seems to, names of containers count no more; then, neither does density."""
    out = _labels(found, declared, _apart(found, inside))
    if not any(out):
        away = [b.away for b in found]
        out = _labels(found, declared, away)
        if not any(out):
            plain = [not x and b.linked <= LINKS * len(b.text) and bool(WORD.search(b.text)) for b, x in zip(found, away, strict=True)]
            long = [x and len(b.text) >= SHORT for b, x in zip(found, plain, strict=True)]
            out = long if any(long) else plain
    return out


def _densities(found: list[Block], stops: frozenset[str], away: list[bool]) -> list[float]:
    """Stop words of all words of each block. On a page in a language without a list, blocks of sentences count as dense, others as thin."""
    words = [WORD.findall(b.text.lower()) for b in found]
    said = [w for b, x, ws in zip(found, away, words, strict=True) if not x and b.linked <= LINKS * len(b.text) for w in ws]
    if sum(w in stops for w in said) >= FITS * len(said):
        return [sum(w in stops for w in ws) / len(ws) if ws else 0.0 for ws in words]
    sentences = [bool(ws) and bool(SENTENCE.search(b.text)) and (len(ws) >= SENTENCE_WORDS or len(b.text) > LONG) for b, ws in zip(found, words, strict=True)]
    return [1.0 if x else 0.5 * STOPS_LOW if ws and not b.home else 1.0 * bool(ws) for b, ws, x in zip(found, words, sentences, strict=True)]


def _labels(found: list[Block], declared: str, away: list[bool]) -> list[bool]:
    density = _densities(found, _language(found, declared), away)
    stands = [not x and b.linked <= LINKS * len(b.text) and d >= STOPS_LOW for b, x, d in zip(found, away, density, strict=True)]
    beside = sum(len(b.text) for b, x in zip(found, stands, strict=True) if x and not b.home and len(b.text) >= SHORT)
    own = sum(len(b.text) for b, x in zip(found, away, strict=True) if b.home and not x)
    has_home = own > 0 and own >= HOME_LEAST * (own + beside)
    first: list[str] = []
    for b, apart, d in zip(found, away, density, strict=True):
        size, links = len(b.text), b.linked / len(b.text)
        if apart or (has_home and not b.home) or links > LINKS:
            first.append(BAD)
        elif size < SHORT:
            first.append(BAD if links > 0 and not b.home else BRIEF)
        elif d >= STOPS_HIGH:
            first.append(GOOD if size > LONG or b.home else NEAR)
        elif d >= STOPS_LOW:
            first.append(NEAR)
        else:
            first.append(BRIEF if b.home else BAD)
    n = len(found)
    before, after = [(BAD, n)] * n, [(BAD, n)] * n  # the nearest decided neighbour on either side and how far it is
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[str, int]] = {}  # by article; what is no part of an article by name is no neighbour in it
        for i in order:
            own = found[i].home if has_home else 0
            into[i] = (last[own][0], abs(i - last[own][1])) if own in last else (BAD, n)
            if first[i] in (GOOD, BAD) and not (own and away[i]):
                last[own] = (first[i], i)
    # a container that by its tag holds the article vouches for its undecided blocks if nothing in it was decided
    settled = {b.home for b, x in zip(found, first, strict=True) if b.home and x == GOOD}
    out = []
    for i, (b, x) in enumerate(zip(found, first, strict=True)):
        if x in (GOOD, BAD):
            out.append(x == GOOD)
        elif b.home:
            near = [y for y in (before[i], after[i]) if y[0] == GOOD]
            out.append(bool(near) or b.home not in settled)
        elif x == NEAR:
            out.append(GOOD in (before[i][0], after[i][0]))
        elif b.heading:
            out.append(after[i][0] == GOOD or (before[i][0] == GOOD and after[i][1] >= n))
        else:
            (one, d1), (two, d2) = before[i], after[i]
            out.append(one == GOOD if one == two or d1 < d2 else two == GOOD if d2 < d1 else False)
    own = [bool(b.home) == has_home for b in found]  # where the article is looked for
    if not any(x and y for x, y in zip(out, own, strict=True)):  # nothing stood out there: plain pages of middling blocks
        out = [x or (y and z == NEAR) for x, y, z in zip(out, own, first, strict=True)]
    return out


_DECLARED = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by blank lines."""
    if not html:
        return ""
    found, inside = blocks(html)
    declared = _DECLARED.search(html)
    keep = labels(found, inside, declared[1].lower() if declared else "")
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """Add the main text of each page."""
    ship_package(pages.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([main_text(h) for h in part.to_pylist()], pa.string())

    return pages.withColumn(text_col, text(F.col(html_col)))
