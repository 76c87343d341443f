"""Main text of HTML pages by two passes of rules over text blocks.

A page is cut into blocks at block-level tags. The first pass decides a block by its place (menus,
forms, adverts, reader comments), its share of linked characters, its length and its density of
stop words. Blocks that this leaves open, mostly short ones, inherit in the second pass the label
of the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import pieces, schema_of, utf8, without

RESULT = ("text", "n_chars", "n_blocks", "n_kept")
CONTENT, OPEN, CLUTTER = 1, 0, -1

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from has have he in is it its not of on or that the they this to
was we were which will with you
aber auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich ihr im ist mit
nicht noch oder sich sie sind und von war werden wie wird zu zum
au aux avec ce ces dans de du elle en est et il ils je la le les mais ne nous ou par pas plus pour
que qui se son sur un une vous
al como con del el ella las lo los más no o para pero por se su sus una y
""".split())

# Elements by what they mean for the text.
HIDDEN = "script style noscript template textarea select button svg math iframe object canvas title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span
strike strong sub sup time tt u var wbr img
""".split())
REPEATING = frozenset("li dt dd td th tr option".split())
MAIN = frozenset(["article", "main"])
CLUTTER_TAGS = frozenset("nav footer aside form dialog menu".split())

# Words in class, id and role that mark clutter; the second list only outside an
# article, as pages also name their wrappers and an article's own head so.
CLUTTER_NAMES = frozenset("""
ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer gdpr login menu nav navbar navigation newsletter pagination
popup promo promoted promotion related reply respond search share sharing sidebar signup social
sponsor sponsored subscribe
""".split())
LAYOUT_NAMES = frozenset("""
alert complementary contentinfo copyright disclaimer header legal masthead modal notice notices
toolbar topbar widget widgets
""".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<hidden>%s)(?=[\s/>])[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-z][^\s/>]*)
      (?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)(?:>|\Z)
    |<[a-z!?/][^>]*(?:>|\Z)"""
    % HIDDEN.replace(" ", "|"),
    re.S | re.I | re.X,
)
MARKS = re.compile(
    r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
    re.I,
)
COMMENTS = re.compile(r"(?<![a-z])comments?(?![a-z])", re.I)
HEADING = re.compile("h[1-6]")
NAME_PART = re.compile(r"[a-z]+")
WORD_OF_LETTERS = re.compile(r"[^\W\d_]+")


def _marks_clutter(name: str, attrs: str, in_main: bool) -> bool:
    """Whether an element's attributes mark it as hidden or as clutter."""
    for key, value in MARKS.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value == "true":
                return True
        else:
            parts = set(NAME_PART.findall(value))
            if parts & CLUTTER_NAMES or (not in_main and parts & LAYOUT_NAMES):
                return True
    return False


class Block:
    __slots__ = ("text", "linked", "clutter", "scope", "heading", "label", "near")

    def __init__(self, text: str, linked: int, clutter: bool, scope: int, heading: bool):
        self.text, self.linked, self.clutter = text, linked, clutter
        self.scope, self.heading = scope, heading
        self.label, self.near = OPEN, False


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order, with what the rules need to know of their place."""
    found: list[Block] = []
    parts: list[str] = []
    # name, clutter, scope, heading, and whether an article inside stays clutter
    stack: list[tuple[str, bool, int, bool, bool]] = []
    opened: Counter[str] = Counter()
    state = {"linked": 0, "in_link": 0, "scopes": 0, "breaks": 0}

    def here() -> tuple[str, bool, int, bool, bool]:
        return stack[-1] if stack else ("", False, 0, False, False)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            _, clutter, scope, heading, _ = here()
            found.append(Block(text, state["linked"], clutter, scope, heading))
        parts.clear()
        state["linked"] = state["breaks"] = 0

    def say(raw: str) -> None:
        if raw:
            text = unescape(raw)
            parts.append(text)
            if not text.isspace():
                state["breaks"] = 0
            if state["in_link"]:
                state["linked"] += len(" ".join(text.split()))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for token in TOKEN.finditer(html):
        say(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            state["in_link"] = 0 if token["close"] else 1
            if token["close"] and opened["a"]:
                while here()[0] != "a":
                    pop()
                pop()
                continue
        if name == "br":
            state["breaks"] += 1
            parts.append(" ")
            if state["breaks"] > 1:
                flush()
            continue
        inline = name in INLINE
        if token["close"]:
            if not inline:
                flush()
                state["in_link"] = 0
            if opened[name]:
                if inline and here()[0] != name:
                    continue
                while here()[0] != name:
                    pop()
                pop()
            continue
        marked = _marks_clutter(name, token["attrs"], here()[2] > 0 or name in MAIN)
        if name in VOID or (inline and not marked):
            if not inline:
                flush()
            continue
        flush()
        state["in_link"] = int(name == "a")
        # a paragraph, list item or cell that was left open ends where the next block starts
        while stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in REPEATING)):
            pop()
        _, clutter, scope, _, firm = here()
        if name in MAIN:
            state["scopes"] += 1
            scope = scope or state["scopes"]
            clutter = marked or firm
        elif name not in ("html", "body"):
            place = name in CLUTTER_TAGS or (name == "header" and not scope)
            clutter = clutter or marked or place
            firm = firm or place or (marked and bool(COMMENTS.search(token["attrs"])))
        stack.append((name, clutter, scope, bool(HEADING.fullmatch(name)), firm))
        opened[name] += 1
    say(html[at:])
    flush()
    return found


def first_pass(
    blocks: list[Block],
    stop_words: frozenset[str],
    short: int,
    long: int,
    low: float,
    high: float,
    most_links: float,
) -> None:
    """Decide what place, links, length and stop words can decide."""
    density, seen = [], False
    for block in blocks:
        found = WORD_OF_LETTERS.findall(block.text.lower())
        hits = sum(word in stop_words for word in found)
        seen |= hits > 0
        density.append(hits / max(len(found), 1))
    for block, share in zip(blocks, density):
        size = len(block.text)
        if block.clutter or block.linked > most_links * size:
            block.label = CLUTTER
        elif size < short:
            continue
        elif block.scope:
            block.label = CONTENT if share >= low else OPEN
        elif not seen:  # a language without stop words here: length alone speaks
            block.near = size >= long
        elif share >= high and size >= long:
            block.label = CONTENT
        elif share >= low:
            block.near = True
        elif size >= long:
            block.label = CLUTTER


def second_pass(blocks: list[Block]) -> None:
    """Give open blocks the label of the nearest decided neighbours.

    In an article only its own blocks that the text itself decided are asked, content wins a tie,
    and without any the block is content. Elsewhere both ends of the page count as clutter; where
    the two sides differ, a heading follows the block after it, a block that nearly was content
    stays, and else the nearer side decides, clutter at a tie.
    """
    n = len(blocks)
    asked = [b.label != OPEN and not (b.scope and b.clutter) for b in blocks]
    before: list[int] = [-1] * n
    after: list[int] = [n] * n
    last: dict[int, int] = {}
    for k in range(n):
        before[k] = last.get(blocks[k].scope, -1)
        if asked[k]:
            last[blocks[k].scope] = k
    last = {}
    for k in range(n - 1, -1, -1):
        after[k] = last.get(blocks[k].scope, n)
        if asked[k]:
            last[blocks[k].scope] = k
    decided = any(b.label == CONTENT or (b.scope and not b.clutter) for b in blocks)
    labels = [b.label for b in blocks]
    for k, block in enumerate(blocks):
        if block.label != OPEN:
            continue
        left, right = before[k], after[k]
        left_label = labels[left] if left >= 0 else CLUTTER
        right_label = labels[right] if right < n else CLUTTER
        if block.scope:
            if left < 0 and right == n:
                labels[k] = CONTENT
            elif left < 0 or right == n:
                labels[k] = labels[right] if left < 0 else labels[left]
            elif k - left == right - k:
                labels[k] = max(left_label, right_label)
            else:
                labels[k] = left_label if k - left < right - k else right_label
        elif not decided:
            labels[k] = CONTENT
        elif left_label == right_label:
            labels[k] = left_label
        elif block.near:
            labels[k] = CONTENT
        elif block.heading:
            labels[k] = right_label
        elif k - left == right - k:
            labels[k] = CLUTTER
        else:
            labels[k] = left_label if k - left < right - k else right_label
    for block, label in zip(blocks, labels):
        block.label = label


def extract_main_text(
    pages: DataFrame,
    html_col: str = "html",
    stop_words: frozenset[str] = STOP_WORDS,
    short: int = 70,
    long: int = 200,
    low: float = 0.1,
    high: float = 0.2,
    most_links: float = 0.5,
) -> DataFrame:
    """The main text of every page.

    Adds ``text`` (kept blocks in page order, joined by a line break), ``n_chars`` (its code
    points), ``n_blocks`` and ``n_kept`` in place of ``html_col``; the other columns stay. A page
    is worked on whole and alone, so there is no shuffle, and a lost task repeats only its pages.

    ``short`` and ``long`` are lengths in characters, ``low`` and ``high`` shares of stop words,
    ``most_links`` the share of linked characters above which a block is a menu. Inside an
    ``article`` or ``main`` element a block needs a reason to go; outside it needs one to stay.
    Character references are decoded once; any white space of Unicode becomes one space; a line
    break element is a space, two in a row end a block. Markup cut off at the end is dropped.

    Null or empty HTML, and pages without main text: empty text. Bytes that are not UTF-8 become
    U+FFFD. Repeated rows and null ids: a row each. Empty table: none. Input columns called like a
    result column are replaced. Pages on which nothing else is decided keep their open blocks.
    """
    rest = without(pages, *RESULT, html_col)
    keep = rest.columns
    held = "__html" + "_" * max(map(len, ["", *keep]))  # a name that no column has
    given = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias(held))
    schema = schema_of(rest, keep, "text string, n_chars long, n_blocks long, n_kept long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            rows = []
            for raw in utf8(batch.column(held)):
                blocks = blocks_of(raw.decode("utf-8", "replace")) if raw else []
                first_pass(blocks, stop_words, short, long, low, high, most_links)
                second_pass(blocks)
                kept = [b.text for b in blocks if b.label == CONTENT]
                text = "\n".join(kept)
                rows.append((text, len(text), len(blocks), len(kept)))
            columns = list(zip(*rows)) if rows else [()] * 4
            made = [pa.array(columns[0], pa.string())]
            made += [pa.array(c, pa.int64()) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + made, names=keep + list(RESULT)
            )

    return given.mapInArrow(run, schema)
