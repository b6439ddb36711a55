"""Main text of web pages by the maximum-scoring run of words and tags.

Pages that mark their article say which tags and words are content: each token weighs the
logarithm of how much more often it lies inside than outside.  In any page the run of
tokens with the largest sum is the content; menus, adverts, forms, scripts and the like
inside it are left out by their elements.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried, slices

#: Element names of the HTML standard by their role.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "nav aside footer form script style noscript template iframe button select textarea dialog "
    "menu head title object svg canvas audio video option datalist fieldset".split()
)
CONTENT = frozenset(("article", "main"))
#: Elements that separate the text of an article inside a container.
STRUCTURE = frozenset(
    "p li ul ol dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre "
    "figure figcaption hr details summary address section".split()
)
#: A run of which this part of the words lies in an article is that article's, or belongs to it.
LIES_IN, BELONGS_TO = 0.9, 0.5
#: Only these can be marked: ids of headings and classes of paragraphs speak of their own text.
CONTAINERS = frozenset("div section ul ol dl table center".split())
#: Words in class, id or role that mark a container as no part of an article; what comes behind
#: "no-", "has-" or "with-" describes the element's surroundings.
_MARKED = r"(?:^|[^a-z])(?<!no-)(?<!has-)(?<!with-)(?<!without-)(?:{})(?![a-z])"
MARKS = re.compile(
    _MARKED.format(
        r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|"
        r"footer|comments?|comment-\w+|replies|disqus|cookies?|consent|gdpr|notices?|popup|modal|"
        r"overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
        r"widget|pagination|pager|skip|search|toolbar|complementary|contentinfo|dialog|alert"
    ),
    re.I,
)
#: Comments can be longer than what they comment on.
COMMENTS = re.compile(_MARKED.format(r"comments?|comment-\w+|replies|disqus"), re.I)
#: A marked container with more than this part of the words is what a page is about.
MOST, MOST_COMMENTS = 0.5, 0.9
#: The head of a page, which inside an article is the article's own.
HEADS = re.compile(_MARKED.format("header|masthead"), re.I)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE = re.compile(r"\s*([\"']?)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Weights:
    """Score of a word, of tags by name, of others within an article's text, and of all others.

    The labelled pages need not show lists or tables; what they don't show must not cost more than
    the words in it.
    """

    word: float = 1.0
    tags: tuple[tuple[str, float], ...] = ()
    other: float = -2.0
    structure: float = -0.25


@dataclass
class Token:
    kind: str  # "text" or the tag, with "/" before the name of an end tag
    text: str = ""
    marked: bool = False
    comments: bool = False
    head: bool = False
    score: float = 0.0


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at ``at``: behind its ``>``, or at the end of the page.

    Quotes hold a ``>`` back only around a value; one that nothing closes is a character like others.
    ``last`` has the last place of each quote, so that no search for one runs in vain.
    """
    stop = -1
    while True:
        if stop < at:
            stop = page.find(">", at)
        if stop < 0:
            return len(page)
        equals = page.find("=", at, stop)
        if equals < 0:
            return stop + 1
        value = _VALUE.match(page, equals + 1)
        quote, at = value[1], value.end()
        if quote and last[quote] >= at:
            at = page.find(quote, at) + 1


def tokens(page: str) -> list[Token]:
    """Texts and tags of a page in order; comments and declarations are left out.

    One scan forward, in time proportional to the page.
    """
    out: list[Token] = []
    last = {q: page.rfind(q) for q in "\"'"}
    begin = at = 0  # of the text, and from where to look for the next tag

    def text(end: int) -> None:
        if end > begin:
            out.append(Token("text", page[begin:end]))

    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            text(start)
            opens, closes = next(
                ((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, start)),
                ("<", ">"),
            )
            found = page.find(closes, start + len(opens))
            begin = at = len(page) if found < 0 else found + len(closes)
            continue
        end = after == "/"
        named = _NAME.match(page, start + 1 + end)
        if not named:
            at = start + 1
            continue
        text(start)
        begin = at = _tag_end(page, named.end(), last)
        name = named[0].lower()
        attributes = _ATTRIBUTE.findall(page[named.end() : at].removesuffix(">")) if not end else ()
        says = " ".join(value for x in attributes for value in x[1:])
        box = name in CONTAINERS
        out.append(
            Token(
                ("/" if end else "") + name,
                "",
                box and bool(MARKS.search(says)),
                box and bool(COMMENTS.search(says)),
                name == "header" or box and bool(HEADS.search(says)),
            )
        )
        if not end and name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            begin = at = close.start() if close else len(page)
    text(len(page))
    return out


def unhide(page: list[Token]) -> None:
    """Take the marks from containers with most of the words, which wrap what the page is about.

    Words are those inside ``article`` or ``main`` if the page has one, else all; those in
    boilerplate elements don't count.  Elements end as in `useful`.
    """
    open_: list[tuple[str, Token, int, int]] = []  # name, start, words before it: in content, all
    count: Counter[str] = Counter()  # of the names in ``open_``
    found: list[tuple[Token, int, int]] = []  # marked or head, its words in content, all
    boiler = content = within = every = 0
    labelled = False

    def close() -> str:
        nonlocal boiler, content
        name, token, a, b = open_.pop()
        count[name] -= 1
        boiler -= name in BOILERPLATE
        content -= name in CONTENT
        if token.marked or token.head:
            found.append((token, within - a, every - b))
        return name

    for token in page:
        name = token.kind
        if name == "text":
            if not boiler:
                n = len(token.text.split())
                every += n
                within += n if content else 0
        elif name.startswith("/"):
            if count[name[1:]]:
                while close() != name[1:]:
                    pass
        elif name not in VOID:
            if name == "p" and open_ and open_[-1][0] == "p":
                close()
            open_.append((name, token, within, every))
            count[name] += 1
            boiler += name in BOILERPLATE
            content += name in CONTENT
            labelled = labelled or name in CONTENT
    while open_:
        close()
    for token, a, b in found:
        own, all_ = (a, within) if labelled else (b, every)
        if own > (MOST_COMMENTS if token.comments else MOST) * all_:
            token.marked = token.head = False


def useful(page: list[Token]) -> list[Token]:
    """Tokens without what boilerplate elements hold; their own tags stay outside articles.

    An element ends with its end tag, or where an element around it ends.  Inside
    ``article`` a ``header`` is its heading; elsewhere it is the page's.
    """
    if any(t.marked or t.head for t in page):
        unhide(page)
    out: list[Token] = []
    open_: list[str] = []
    count: Counter[str] = Counter()  # of the names in ``open_``
    hidden = 0  # depth at which a boilerplate element began, 0 outside
    shown = True  # are the tags of that element kept
    for token in page:
        name = token.kind
        if name == "text":
            if not hidden:
                out.append(token)
        elif name.startswith("/"):
            if count[name[1:]]:
                closed = ""
                while closed != name[1:]:
                    closed = open_.pop()
                    count[closed] -= 1
                if hidden and len(open_) < hidden:
                    hidden = 0
                    if shown:
                        out.append(token)
                    continue
            if not hidden:
                out.append(token)
        else:
            if name in VOID:
                if not hidden:
                    out.append(token)
                continue
            if name == "p" and open_ and open_[-1] == "p":
                open_.pop()  # a paragraph ends where the next begins
                count["p"] -= 1
            within = any(count[c] for c in CONTENT)
            open_.append(name)
            count[name] += 1
            if not hidden:
                boiler = name in BOILERPLATE or (
                    token.marked and name not in ("body", "html", *CONTENT)
                )
                if boiler or (token.head and not within and name not in ("body", "html", *CONTENT)):
                    # what interrupts an article must not end it
                    hidden, shown = len(open_), not within
                if not hidden or shown:
                    out.append(token)
    return out


def score(page: list[Token], weights: Weights) -> None:
    tags = dict(weights.tags)
    for token in page:
        if token.kind == "text":
            token.score = weights.word * len(token.text.split())
        elif token.kind in tags:
            token.score = tags[token.kind]
        else:
            name = token.kind.removeprefix("/")
            inner = name in STRUCTURE or name in INLINE
            # a link of one word is worth nothing
            token.score = -weights.word / 2 if name == "a" else weights.structure if inner else weights.other


def best_run(page: list[Token]) -> tuple[int, int]:
    """First and end of the run with the largest sum; of equal ones the first, the longer."""
    best, run = 0.0, 0.0
    span, start = (0, 0), 0
    for i, token in enumerate(page):
        if run < 0:
            run, start = 0.0, i
        run += token.score
        if run > best or (run == best and start == span[0] and run > 0):
            best, span = run, (start, i + 1)
    return span


def whole_article(page: list[Token], first: int, end: int) -> tuple[int, int]:
    """The run, or the ends of the innermost article or main that it lies in.

    A run that lies in one only for the larger part reaches from the first to the last of both.
    """
    words = [0]
    for token in page:
        words.append(words[-1] + (len(token.text.split()) if token.kind == "text" else 0))
    spans, open_, count = [], [], Counter()
    for i, token in enumerate([*page, Token("")]):
        name = token.kind
        if name.startswith("/") and count[name[1:]] or not name:
            while open_:
                opened, at = open_.pop()
                count[opened] -= 1
                if opened in CONTENT:
                    spans.append((at, i))
                if opened == name[1:]:
                    break
        elif name != "text" and not name.startswith("/") and name not in VOID:
            open_.append((name, i))
            count[name] += 1
    own = words[end] - words[first]
    if not own:
        return first, end

    def innermost(part: float) -> tuple[int, int, int] | None:
        return min(
            (
                (b - a, a, b)
                for a, b in spans
                if max(a, first) < min(b, end) and words[min(b, end)] - words[max(a, first)] >= part * own
            ),
            default=None,
        )

    if found := innermost(LIES_IN):
        return found[1:]
    if found := innermost(BELONGS_TO):
        return min(found[1], first), max(found[2], end)
    return first, end


def blocks(run: list[Token]) -> list[str]:
    """Texts of blocks: references decoded, white space made one space, ends trimmed."""
    out, parts = [], []
    for token in [*run, Token("p")]:
        name = token.kind.removeprefix("/")
        if token.kind == "text":
            parts.append(token.text)
        elif name == "br":
            parts.append(" ")
        elif name not in INLINE:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts = []
            if text:
                out.append(text)
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best run, or of the article it lies in, joined by an empty line."""
    kept = useful(tokens(page or ""))
    score(kept, weights)
    first, end = whole_article(kept, *best_run(kept))
    return "\n\n".join(blocks(kept[first:end]))


def _tally(batches):
    """Of pages with exactly one article or main: tokens inside and outside, by tag."""
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for whole in batches:
        for batch in slices(whole, "html"):
            for page in batch.column("html").to_pylist():
                kept = useful(tokens(page or ""))
                marks = [i for i, t in enumerate(kept) if t.kind in CONTENT]
                ends = [i for i, t in enumerate(kept) if t.kind.removeprefix("/") in CONTENT]
                if len(marks) != 1 or len(ends) != 2:
                    continue
                for i, token in enumerate(kept):
                    # the article's own tags are what labels the page and get no weight from it
                    if i in ends:
                        continue
                    count = len(token.text.split()) if token.kind == "text" else 1
                    to = inside if ends[0] < i < ends[1] else outside
                    if count:
                        to[token.kind] = to.get(token.kind, 0) + count
    kinds = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(kinds, pa.string()),
            pa.array([inside.get(k, 0) for k in kinds], pa.int64()),
            pa.array([outside.get(k, 0) for k in kinds], pa.int64()),
        ],
        ["kind", "inside", "outside"],
    )


def fit(pages: DataFrame, fit_rows: int = 20_000, most_kinds: int = 1000) -> Weights:
    """Weights from labelled pages: those with one ``article`` or ``main``.

    About ``fit_rows`` pages, chosen by a hash of their html, are read for it.  Words weigh
    0.1 to 1 and tags -5 to -0.1, so a run ends where tags outweigh the words to come.  The
    ``most_kinds`` commonest tags get weights of their own.
    """
    rows = pages.count()
    part = F.shiftrightunsigned(F.xxhash64("html"), 11) / float(1 << 53)
    chosen = pages.where(part < fit_rows / max(1, rows)).select("html")
    found = (
        chosen.mapInArrow(_tally, "kind string, inside long, outside long")
        .groupBy("kind")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.col("inside") + F.col("outside"), "kind", ascending=[False, True])
        .limit(most_kinds)
        .collect()
    )
    counts = {r["kind"]: (r["inside"], r["outside"]) for r in found}
    all_in = sum(a for a, _ in counts.values()) or 1
    all_out = sum(b for _, b in counts.values()) or 1
    ratio = {
        k: math.log((a + 0.5) / (all_in + 1)) - math.log((b + 0.5) / (all_out + 1))
        for k, (a, b) in counts.items()
    }
    # a word counts 1 at most and a tag at least -5, so that ten words outweigh two tags
    word = min(1.0, max(0.1, ratio.pop("text", 1.0)))
    tags = {k: max(-5.0, min(-0.1, v)) for k, v in ratio.items()}
    seen = [v for k, v in tags.items() if k.removeprefix("/") in STRUCTURE]
    structure = max(-word / 4, sum(seen) / len(seen) if seen else -word / 4)
    return Weights(word, tuple(sorted(tags.items())), structure=structure)


def _extract(batches, weights: Weights, carry: list[str]):
    for whole in batches:
        for batch in slices(whole, "_html"):
            texts = [main_text(x, weights) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry]
                + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                carry + ["text", "n_chars"],
            )


def extract(pages: DataFrame, weights: Weights, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``pages``, the main ``text`` of each whole page and ``n_chars``.

    A null or empty page, or one without words outside boilerplate, gives an empty text.  Rows
    stand alone; no rows give no rows; columns not carried are ignored, one named
    like a result is left out.
    """
    carry, ddl = carried(pages, carry, {"text", "n_chars", "_html"})
    taken = pages.select(
        *[F.col(f"`{c}`") for c in carry], F.col("html").cast("string").alias("_html")
    )
    return taken.mapInArrow(
        partial(_extract, weights=weights, carry=carry), ddl + "text string, n_chars long"
    )
