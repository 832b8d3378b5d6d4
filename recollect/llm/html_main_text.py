"""Main text of web pages by two-pass block rules (operator 4).

A page is cut into blocks at block-level tags. The first pass decides what it can:
blocks in menus, forms, adverts and other marked zones go, and the others are
judged by length and by the share of stop words and of characters in links. Short
or middling blocks stay undecided. A marked article lifts what isn't made of links
by one step: few stop words leave a block undecided, and a long undecided one stays.
The second pass gives each undecided block the label of its nearest decided
neighbour; in an article only neighbours in the same article count, and where none
of them stays, what isn't made of links or a heading over it does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.session import ship

# Common function words of the languages that the rules know.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous
    als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wir zu zum zur
    al como con del el ella en entre era es esta este ha las lo los más mi muy no o para pero por que se si sin sobre su sus también un una y ya""".split()
)
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_RAW, _HELD = "script|style", "noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_ZONE_TAGS = frozenset("nav aside footer form button menu dialog head fieldset".split())
_ZONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
_ZONE_NAMES = re.compile(
    r"""(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|
    nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|toc|header|masthead|topbar|footer|bottombar|side-?bar\w*|widget\w*|rail|
    comments?|commentlist|replies|reply|respond|disqus|reviews?|discussion|share|sharing|social|related|recommend\w*|teasers?|trending|tags|byline|copyright|legal|login|search)(?=$|[\s_-])""",
    re.I | re.X,
)
# Names that mark a zone of a page, but also headlines and parts of an article.
_MILD_NAMES = re.compile(r"(?:^|(?<=[\s_-]))(?:banner|notices?|alert|header|masthead|topbar|reviews?|discussion|tags|legal)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <({_RAW})(?![\w:-])[^>]*>.*?(?:</\1\s*>|\Z) | <(?P<held>{_HELD})(?![\w:-])[^>]*>
    | <(/?)([a-z][a-z0-9:-]*)((?:"[^"<]*"|'[^'<]*'|[^'"><]|["'])*)>""",
    re.I | re.S | re.X,
)
_HELD_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z) | <({_RAW})(?![\w:-])[^>]*>.*?(?:</\1\s*>|\Z) | <(/?)({_HELD})(?![\w:-])[^>]*>", re.I | re.S | re.X)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.I)
_WORD = re.compile(r"\w+")
# A block outside any marked zone.
LONG, SHORT = 200, 70
MANY_STOP_WORDS, SOME_STOP_WORDS, MANY_LINKS = 0.3, 0.2, 0.33
_BAD, _OPEN, _GOOD = range(3)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    zone: bool = False
    article: int = 0  # number of the innermost article, 0 outside
    heading: bool = False
    text: str = ""
    label: int = _OPEN


def _attributes(source: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(source)}


def _is_zone(tag: str, source: str, in_article: bool) -> bool:
    if tag in _ZONE_TAGS or tag == "header" and not in_article:
        return True
    if "=" not in source and "hidden" not in source.lower() or tag in ("body", "html", "article", "main") and "comment" not in source.lower():
        return False
    a = _attributes(source)
    style = a.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or a.get("role", "").lower() in _ZONE_ROLES
        or any(_ZONE_NAMES.search(_MILD_NAMES.sub("", a[k]) if in_article or tag in _HEADING else a[k]) for k in ("class", "id") if k in a)
    )


def _held(page: str) -> dict[int, int]:
    """Where elements without text of the page end, by where they begin; those closed in their own tag or never are left out."""
    ends, begun = {}, {}
    for m in _HELD_TOKEN.finditer(page):
        if m[3]:
            own = begun.setdefault(m[3].lower(), [])
            if not m[2]:
                if m[0][-2] != "/" or m[0].count('"') % 2:
                    own.append(m.start())
            elif own:
                ends[own.pop()] = m.end()
    return ends


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; blocks without text are left out."""
    stack: list[tuple[str, bool, bool]] = []  # tag, begins a zone, begins an article
    zones = links = 0
    articles, n_articles = [], 0
    found, now, at = [], Block(), 0

    def close() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            now.zone, now.article = zones > 0, articles[-1] if articles else 0
            now.heading = any(t in _HEADING for t, _, _ in stack[-3:])
            found.append(now)
        now = Block()

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            now.parts.append(text)
            if links:
                now.linked += len("".join(text.split()))

    def pop(to: int) -> None:
        nonlocal zones, links
        for tag, zone, article in stack[to:]:
            zones, links = zones - zone, links - (tag == "a")
            if article:
                articles.pop()
        del stack[to:]

    ends = _held(page)
    while m := _TOKEN.search(page, at):
        say(page[at: m.start()])
        at = ends.get(m.start(), m.end()) if m["held"] else m.end()
        tag = (m[4] or "").lower()
        if not tag:
            if m[1] or m["held"]:
                now.parts.append(" ")
            continue
        if tag == "br":
            now.parts.append(" ")
        if m[3]:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in _BLOCK:
                close()
            # An inline end tag closes nothing outside its own block.
            if where is not None and (tag in _BLOCK or tag in _ZONE_TAGS or not any(t in _BLOCK for t, _, _ in stack[where + 1:])):
                pop(where)
            continue
        if tag in _VOID and tag != "hr":
            continue
        source = m[5]
        is_article = tag in ("article", "main") or 'role="main"' in source
        zone = _is_zone(tag, source, bool(articles))
        if tag in _BLOCK or zone:
            close()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
                limit = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, ("dt", "dd", "option", "p"))
                i = len(stack)
                while i and (stack[i - 1][0] in limit or stack[i - 1][0] not in _BLOCK and stack[i - 1][0] not in _ZONE_TAGS):
                    i -= 1
                if any(t in limit for t, _, _ in stack[i:]):
                    pop(i)
            if tag == "body" or is_article and not zone and zones and not any(z and t in _ZONE_TAGS for t, z, _ in stack):
                # A body ends an open head; an article is never part of an advert that was not closed.
                pop(next(i for i, (_, z, _) in enumerate(stack) if z) if zones else len(stack))
        if tag == "hr" or source.endswith("/") and tag not in _BLOCK:
            continue
        stack.append((tag, zone, is_article and not zone))
        zones, links = zones + zone, links + (tag == "a")
        if is_article and not zone:
            n_articles += 1
            articles.append(n_articles)
    say(page[at:])
    close()
    return found


def _first_pass(found: list[Block]) -> None:
    begun = {0}
    for b in found:
        if b.zone:
            b.label = _BAD
            continue
        # The headline of an article is often a link to the article.
        headline = b.heading and b.article not in begun
        begun.add(b.article)
        solid = len("".join(b.text.split()))
        words = [w.lower() for w in _WORD.findall(b.text)]
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.linked > MANY_LINKS * solid and not headline:
            b.label = _BAD
        elif b.heading or len(b.text) < SHORT:
            b.label = _OPEN
        elif stops >= MANY_STOP_WORDS or stops >= SOME_STOP_WORDS and len(b.text) > LONG:
            b.label = _GOOD
        elif stops >= SOME_STOP_WORDS or len(b.text) > LONG:
            b.label = _GOOD if b.article else _OPEN
        else:
            b.label = _OPEN if b.article else _BAD


def _inherit(found: list[Block], decided: list[tuple[int, int]], places: list[int], other: int) -> None:
    """Labels for the undecided blocks at ``places`` from those at ``decided``; ``other`` beyond both ends."""
    k = 0
    for i in places:
        b = found[i]
        while k < len(decided) and decided[k][0] < i:
            k += 1
        if b.label == _OPEN:
            before = decided[k - 1] if k else (-1, other)
            after = decided[k] if k < len(decided) else (len(found), other)
            if b.heading:  # a heading goes with what it stands over
                b.label = after[1]
            elif i - before[0] == after[0] - i:
                b.label = min(before[1], after[1])
            else:
                b.label = (before if i - before[0] < after[0] - i else after)[1]


def _second_pass(found: list[Block]) -> None:
    of: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        of.setdefault(b.article, []).append(i)
    all_decided = [(i, b.label) for i, b in enumerate(found) if b.label != _OPEN]
    for article, places in of.items():
        if article:  # a zone inside says nothing about the text around it
            own = [(i, found[i].label) for i in places if found[i].label != _OPEN and not found[i].zone]
            if any(label == _GOOD for _, label in own):  # before the first and after the last these go on
                _inherit(found, [(-1, own[0][1]), *own, (len(found), own[-1][1])], places, _GOOD)
            else:
                for i in places:
                    if found[i].label == _OPEN and not found[i].heading:
                        found[i].label = _GOOD
                own = [(i, found[i].label) for i in places if found[i].label != _OPEN and not found[i].zone]
                _inherit(found, own, places, _GOOD)
        else:
            _inherit(found, all_decided, places, _BAD)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    _first_pass(found)
    _second_pass(found)
    return "\n".join(b.text for b in found if b.label == _GOOD)


def with_main_text(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the column ``name``: the main text, blocks joined by one newline.

    Character references are decoded, white space inside a block is one space. A
    NULL or empty page, and one without main text, gives ''. Broken markup is read
    as far as it goes and never fails. Rows and other columns pass through, a
    column called ``name`` is replaced; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    columns = [c for c in pages.columns if c != name or c == source]
    target = name

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(source)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns if c != target], pa.array(texts, pa.string())], [*[c for c in columns if c != target], target])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != target)
    return pages.mapInArrow(extract, (schema + ", " if schema else "") + f"`{target}` string")
