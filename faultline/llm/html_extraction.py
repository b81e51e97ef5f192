"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Script, style and other content that is never
text is left out. Blocks inside menus, footers, side bars, forms, notices, adverts and comments
(by tag, role, class or id) are decided: bad. The first pass decides others by their own text:
a share of link text over ``LINKS`` is bad; of blocks outside an article, long ones with enough
stop words are good and long ones without are bad. Inside ``article`` or ``main``, stop words
decide only for good. What is short or undecided is ambiguous. In the second pass, an ambiguous
block takes the label of its nearest decided neighbours in the same part of the page. Outside an
article it is good if all of them are, and bad without any; inside, it is bad only between two
bad ones.

Character references are decoded, white space inside a block becomes one space, ``br`` is white
space, blocks are joined in order by an empty line.

Defined results: null, empty and tag-only pages give an empty text; pages of any length are read
whole, in time proportional to their length; broken markup (open tags, open quotes, stray ends) is read as far as tags
can be told; ``head`` ends at the first tag that it cannot hold, a link without end at the next block; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import fresh, table

LINKS = 0.5
LONG = 70
STOP_SHARE = 0.2
#: With fewer stop words than this share, a page is in none of the languages below; length and links decide alone.
FOREIGN = 0.05

#: Frequent function words of the languages that are told apart.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you
were all her she there would their we him been has when who will no more if out so up what about into than its
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
le la les de des du et à en un une est que qui dans pour pas sur au ce il sont par plus avec ne se son aux ou mais
comme cette elle être nous vous leur sans fait ces été tout
el los las de y en que un una es por con no para se del al lo su más como pero sus le ya o este sí porque esta entre
cuando muy sin sobre también me hasta hay donde quien desde todo nos durante
""".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas title select textarea video audio".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr
ul caption""".split())
HELD = frozenset("""article aside body center details dialog div dl fieldset figure footer form header html li main menu nav ol
section table tbody td tfoot th thead tr ul span label button blockquote p h1 h2 h3 h4 h5 h6""".split())
BAD_TAGS = frozenset("nav footer aside menu dialog button fieldset".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
SWALLOWING = frozenset("script style".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert".split())
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies
consent gdpr notice notification sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment
comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription popup modal overlay
pagination pager widget login signup search hidden""".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"""[^<>"']*""")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_WORDS = re.compile(r"\w+")


def _bad(tag: str, attributes: str, in_article: bool) -> str:
    """``hard`` by tag or if hidden, ``soft`` by name, role or as a form, else empty."""
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return "hard"
    if tag in ("html", "body", "article", "main"):
        return ""
    if _HIDDEN.search(attributes):
        return "hard"
    for value in _NAMES.findall(attributes):
        parts = [p.lower() for p in _PARTS.findall(value)]
        if any(p in BAD_NAMES or p in BAD_ROLES for p in parts):
            return "soft"
    return "soft" if tag == "form" else ""


class _Page:
    """Tags and texts of a page, in one pass: what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, {}
        anchors = [(m.start(), bool(m[1])) for m in _ANCHOR.finditer(page)]
        # links that have their own end: the next anchor tag after them is an end tag
        self.closed = {at for (at, end), (_, next_end) in zip(anchors, anchors[1:]) if not end and next_end}

    def find(self, what: str, at: int) -> int:
        """The place of ``what`` at or behind ``at``, or -1."""
        if self.missing.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def close_of(self, tag: str, at: int) -> int:
        """Behind the end tag of ``tag``, or -1."""
        key = f"</{tag}"
        if self.missing.get(key, len(self.page) + 1) <= at:
            return -1
        m = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(self.page, at)
        if not m:
            self.missing[key] = at
        return m.end() if m else -1

    def _end_of_tag(self, at: int) -> tuple[int, int]:
        """End of the attributes and of the tag; quotes may hold any character, a quote that stays open holds none."""
        begin = at
        while True:
            at = _PLAIN.match(self.page, at).end()
            c = self.page[at : at + 1]
            if c == ">":
                return at, at + 1
            close = self.find(c, at + 1) if c in ("'", '"') else -1
            if close < 0:
                end = self.find(">", begin)
                return (end, end + 1) if end >= 0 else (-1, -1)
            at = close + 1

    def tokens(self):
        """``text, "", False, "", place`` or ``None, tag, is_end, attributes, place`` in order; the place behind the token may be set by ``send``."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            if page[at] != "<":
                end = self.find("<", at)
                end = size if end < 0 else end
                at = (yield page[at:end], "", False, "", end) or end
                continue
            m = _OPEN.match(page, at)
            if m:
                stop, end = self._end_of_tag(m.end())
                if end < 0:  # no tag ends from here on: all that is left is text
                    yield page[at:], "", False, "", size
                    return
                at = (yield None, m[2].lower(), bool(m[1]), page[m.end() : stop], end if m[2].lower() != "a" or m[1] else -at - 1) or end
            elif page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?") and self.find(">", at) >= 0:
                at = self.find(">", at) + 1
            else:
                at = (yield "<", "", False, "", at + 1) or at + 1


def blocks(page: str) -> list[tuple[str, float, str, int]]:
    """Text, share of link text, kind of place (bad, article, other) and number of the part, of each block.

    A place that is bad only by its name, its role or as a form is not, if it holds the page's first article or more
    than half of the page's text outside links and other bad places.
    """
    out: list[tuple[str, float, bool, int, int]] = []
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # tag, hard, innermost soft place or 0, article or 0
    text: list[str] = []
    linked = in_link = 0
    articles = 0
    around, excused = [0], [True]  # of each soft place, the one around it and whether it counts as none; place 0 is the page
    read = _Page(page)
    tokens, go_on = read.tokens(), None

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                _, hard, soft, article = stack[-1]
                out.append((joined, linked / max(1, sum(len(t.strip()) for t in text)), hard, soft, article))
            text.clear()
        linked = 0

    while True:
        try:
            said, tag, ends, attributes, place = tokens.send(go_on)
        except StopIteration:
            break
        go_on = None
        if said is not None:
            text.append(said)
            if in_link:
                linked += len(said.strip())
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            flush()
            stack.pop()
        if tag in SKIPPED:
            if not ends and not attributes.endswith("/"):
                close = read.close_of(tag, place)
                go_on = close if close >= 0 else len(page) if tag in SWALLOWING else None
            continue
        if tag == "a":  # 1: has its own end, 2: ends with the next block
            in_link = 0 if ends else 1 if -place - 1 in read.closed else 2
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS or tag == "head":
            flush()
            in_link = 0 if in_link == 2 or tag in ("article", "nav", "footer", "main", "body") else in_link
        if (tag not in HELD and tag != "head") or attributes.endswith("/"):
            continue
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and stack[i][1:3] != stack[i - 1][1:3]:
                        flush()
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if tag in BLOCKS:
            while stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
        _, hard, soft, article = stack[-1]
        if tag in ("article", "main") and not article and not hard:
            outer = soft
            while not articles and not excused[outer]:
                excused[outer] = True
                outer = around[outer]
            if excused[soft]:
                articles += 1
                article = articles
        elif tag == "body":
            hard, soft, article = False, 0, 0
        how = "hard" if tag == "head" else _bad(tag, attributes, bool(article))
        if how and tag not in BLOCKS:
            flush()
        if how == "soft":
            around.append(soft)
            excused.append(False)
            soft = len(around) - 1
        stack.append((tag, hard or how == "hard", soft, article))
    flush()
    held, total = [0.0] * len(around), 0.0
    for joined, share, hard, soft, _ in out:
        if not hard:
            held[soft] += len(joined) * (1 - share)
            total += len(joined) * (1 - share)
    for place in range(len(around) - 1, 0, -1):
        held[around[place]] += held[place]
    for place in range(1, len(around)):
        excused[place] = excused[around[place]] and (excused[place] or (not articles and 2 * held[place] > total))
    kind = lambda hard, soft, article: "bad" if hard or not excused[soft] else "article" if article else "other"
    return [(joined, share, kind(hard, soft, article), article) for joined, share, hard, soft, article in out]


def _counted(text: str) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = [w.lower() for w in _WORDS.findall(text)]
    return sum(w in STOP_WORDS for w in words), len(words)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    counts = [_counted(text) for text, *_ in found]
    readable = [c for c, (_, links, place, _) in zip(counts, found, strict=True) if place != "bad" and links <= LINKS]
    foreign = sum(s for s, _ in readable) < FOREIGN * sum(n for _, n in readable)
    labels: list[bool | None] = []
    for (text, links, place, _), (stop, words) in zip(found, counts, strict=True):
        stops = stop / max(1, words)
        if place == "bad" or links > LINKS or (place == "other" and "©" in text and len(text) < LONG):
            labels.append(False)
        elif len(text) < LONG:
            labels.append(None)
        elif stops >= STOP_SHARE or (foreign and place == "other"):
            labels.append(True)
        else:
            labels.append(None if place == "article" else False)
    kept = []
    before: dict[tuple[str, int], bool] = {}
    left: list[bool | None] = []
    for (_, _, place, part), label in zip(found, labels, strict=True):
        left.append(before.get((place, part)))
        if label is not None:
            before[place, part] = label
    after: dict[tuple[str, int], bool] = {}
    for i in range(len(found) - 1, -1, -1):
        text, _, place, part = found[i]
        label = labels[i]
        if label is None:
            sides = [s for s in (left[i], after.get((place, part))) if s is not None]
            label = len(sides) < 2 or any(sides) if place == "article" else bool(sides) and all(sides)
        else:
            after[place, part] = label
        if label:
            kept.append(text)
    return "\n\n".join(reversed(kept))


def extracted(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``page`` in a new column ``out`` instead of ``page``."""
    (out,) = fresh([c for c in pages.columns if c != page], out)
    others = [c for c in pages.columns if c != page]

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*others).dtypes)
    return pages.select(*others, page).mapInArrow(run, f"{schema}, `{out}` string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
