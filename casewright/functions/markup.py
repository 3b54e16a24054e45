"""Opinion markup: clean-up and anchors as expressions; summaries and link rewriting as Arrow-batched functions."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is cut from an opinion's markup, and how page labels are rewritten.
CUTS = [r"\s+data-blocks='[^']*'", r"(?s)<p class=\"attorneys\"[^>]*>.*?</p>", r"<img[^>]*>"]
PAGE_LABEL = r"(?s)<a [^>]*class=\"page-label\"[^>]*>\s*(.*?)\s*</a>"


def strip(html: Column) -> Column:
    """Markup without block attributes, attorneys and images; page labels become spans."""
    for pattern in CUTS:
        html = F.regexp_replace(html, pattern, "")
    return F.regexp_replace(html, PAGE_LABEL, '<span class="page-label">$1</span>')


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, href) of every anchor."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("href"))


# Elements without an end, those that make a paragraph, and what a summary takes.
ENDLESS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(["p", "blockquote"])
SUMMARY_LENGTH, BODY_LENGTH, SYLLABUS_TAKES, BODY_TAKES = 140, 60, 4, 3
OPENERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ“\"‘'")


class _Events(HTMLParser):
    """A page as a list of events (kind, tag, what): "open" with the classes, "close", and "text"."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.list: list[tuple[str, str, object]] = []
        self.depth = 0
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag not in ENDLESS:
            self.depth += 1
            self.list.append(("open", tag, (dict(attrs).get("class") or "").split()))
        elif tag == "br":
            self.list.append(("text", "", " "))

    def handle_endtag(self, tag):
        if tag not in ENDLESS and self.depth:  # an end with nothing open is no event
            self.depth -= 1
            self.list.append(("close", tag, None))

    def handle_data(self, data):
        self.list.append(("text", "", data))


def _within(events: list, marks) -> list[bool]:
    """For each event, whether an element whose classes ``marks`` accepts is open around it."""
    around: list[bool] = []
    out = []
    for kind, _, what in events:
        if kind == "close":
            around.pop()
        out.append(any(around))
        if kind == "open":
            around.append(marks(what))
    return out


def paragraphs(html: str | None) -> list[tuple[bool, list[str], str]]:
    """(in head matter, classes, text) of each paragraph that ends and has text; page labels are left out."""
    events = _Events(html or "").list
    head = _within(events, lambda classes: any("head-matter" in c for c in classes))
    label = _within(events, lambda classes: "page-label" in classes)
    edges = [i for i, (kind, tag, _) in enumerate(events) if tag in BLOCKS]
    ends = [i for i in edges if events[i][0] == "close"]
    out, after = [], 0
    for i in edges:
        end = bisect.bisect(ends, i)
        if events[i][0] == "close" or i < after or end == len(ends):
            continue  # not the start of a paragraph, or nested in one, or never closed
        after = ends[end]
        text = squeeze("".join(events[j][2] for j in range(i, after) if events[j][0] == "text" and not label[j]))
        if text:
            out.append((head[i], events[i][2], text))
    return out


def _rank(head: bool, classes: list[str], text: str) -> int | None:
    """0: syllabus, or a long summary in the head matter; 1: a body paragraph that reads like an opening; else null."""
    if "syllabus" in classes or (head and "summary" in classes and len(text) >= SUMMARY_LENGTH):
        return 0
    return 1 if not head and len(text) > BODY_LENGTH and text[0] in OPENERS else None


def summarise(html: str | None) -> str:
    """The first paragraphs of the best rank that a page has; empty without any."""
    ranked: dict[int | None, list[str]] = {0: [], 1: [], None: []}
    for found in paragraphs(html):
        ranked[_rank(*found)].append(found[2])
    return " ".join(ranked[0][:SYLLABUS_TAKES] or ranked[1][:BODY_TAKES])


@F.pandas_udf(StringType())
def summary(html: pd.Series) -> pd.Series:
    return html.map(summarise)


# Words of a party's name besides capitalised ones, forms with one party, and words that only introduce.
SHORT_FORMS = frozenset("Corp Assn Dept Bros Natl Comm Commn Admin Indus Hosp Univ Educ Assoc Distrib Transp Mfrs".split())
SMALL_WORDS = frozenset("&amp; of the and de du des for a an".split())
WORD_PAIRS = frozenset([("ex", "rel."), ("et", "al."), ("et", "ux.")])
SINGLE_PARTY = [("Ex", "parte"), ("In", "re"), ("Matter", "of"), ("In", "the", "Matter", "of")]
SIGNAL_PAIRS = frozenset([("See", "also"), ("But", "see"), ("But", "cf.")])
SIGNALS = frozenset(
    "See Cf Compare Accord In And Also But Contra Quoting Citing Under Unlike Like Both Thus Hence Here Or Nor For The That This With "
    "As Of On Since Where When While Although Because If Our Its His Her First Second Third Fourth Finally Then Again Indeed Moreover "
    "However Therefore Accordingly of the and a an for de du des".split()
)
CAPITALISED = re.compile(r"[A-Z][A-Za-z0-9'’&\-]*(?:\.[A-Z][A-Za-z0-9'’&\-]*)*")
REACH, SIGNALS_CUT, EMPHASIS_REACH = 300, 4, 12

_CITATION = re.compile(r'<a ([^>]*class="citation"[^>]*)>(.*?)</a>', re.S)
_PIECE = re.compile(r"(?P<gap>(?:\s|</?em>)+)|(?P<word>[^\s<]+)|<")
_TAG = re.compile(r"<[^>]+>")


@dataclass
class _Word:
    text: str  # without a comma at its end
    start: int
    comma: bool
    space: bool  # only white space, not emphasis, stands after it


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _plain(text: str) -> str:
    return squeeze(entities.unescape(text))


def _one(ids: Sequence[int], nodes: Mapping[int, int], self_id: int | None) -> int | None:
    """The only node, other than this one, that the ids mean."""
    met = {nodes[i] for i in ids if i in nodes} - {self_id}
    return met.pop() if len(met) == 1 else None


def _anchor_ids(attributes: str) -> list[int]:
    found = re.search(r'data-case-ids="([^"]*)"', attributes)
    return [int(x) for x in re.split(r"[,\s]+", found[1]) if x.isdigit()] if found else []


def is_name_word(word: str) -> bool:
    """Whether a party's name may hold the word; a full stop ends only short words and known short forms."""
    if word in SMALL_WORDS or CAPITALISED.fullmatch(word):
        return True
    stem = word.removesuffix(".")
    ends_long = len(stem) >= 6 and stem[-6:].isascii() and stem[-6:].isalpha()
    return stem != word and (stem in SHORT_FORMS or (CAPITALISED.fullmatch(stem) is not None and not ends_long))


def _words_before(html: str, low: int, high: int) -> list[_Word]:
    """Words that end right before ``high``, nearest first, as far as only white space and emphasis part them."""
    pieces = list(_PIECE.finditer(html, low, high))
    out: list[_Word] = []
    space = True
    for piece in reversed(pieces):
        if piece["gap"]:
            space = piece["gap"].isspace()
        elif piece["word"]:
            word = piece["word"].removesuffix(",")
            out.append(_Word(word, piece.start(), word != piece["word"], space))
        else:
            break
    return out


def _side(words: list[_Word], at: int) -> tuple[list[_Word], int]:
    """The name words from ``words[at]`` on leftwards, leftmost first, and the place of the first other word.

    A word that is no name word may end in one, as "(Swift" does: that part is taken, and nothing left of it.
    """
    taken: list[_Word] = []
    while at < len(words):
        word = words[at]
        if word.comma and taken and not (word.space and taken[0].text[:1].isupper()):
            break
        if at + 1 < len(words) and (words[at + 1].text, word.text) in WORD_PAIRS and not words[at + 1].comma:
            taken[:0] = [words[at + 1], word]
            at += 2
        elif is_name_word(word.text):
            taken.insert(0, word)
            at += 1
        else:
            cut = next((k for k in range(1, len(word.text)) if is_name_word(word.text[k:])), None)
            if cut is not None and word.text != "v.":
                taken.insert(0, _Word(word.text[cut:], word.start + cut, word.comma, word.space))
                return taken, len(words)
            break
    return taken, at


def _case_name(words: list[_Word]) -> list[_Word]:
    """The words of a case name at the end of ``words`` (nearest first): two sides around "v.", or a one-party form."""
    right, at = _side(words, 0)
    if right and at < len(words) and words[at].text == "v." and not words[at].comma:
        left, _ = _side(words, at + 1)
        if left and not left[-1].comma:
            return [*left, words[at], *right]
        return []
    known = [*reversed(words[at : at + 1]), *right] if at < len(words) else right  # "re" and "parte" end a side
    if at + 1 < len(words):
        known = [words[at + 1], *known]
    texts = tuple(w.text for w in known)
    for i in range(len(texts)):
        if any(texts[i : i + len(form)] == form and len(texts) > i + len(form) for form in SINGLE_PARTY):
            return known[i:]
    return []


def _without_signals(name: list[_Word]) -> list[_Word]:
    for _ in range(SIGNALS_CUT):
        if len(name) > 1 and (name[0].text, name[1].text) in SIGNAL_PAIRS:
            name = name[2:]
        elif name and name[0].text.removesuffix(".") in SIGNALS and not name[0].comma:
            name = name[1:]
    texts = tuple(w.text for w in name)
    return name if "v." in texts or any(texts[: len(form)] == form for form in SINGLE_PARTY) else []


def name_start(html: str, low: int, start: int) -> int:
    """Where the case name right before a link begins; ``start`` itself if there is none to draw in.

    Emphasis that ends in the name must begin in it or right before it; a name that begins inside an emphasis which
    also holds its signal stays outside.
    """
    low = max(low, start - REACH)
    whole = _case_name(_words_before(html, low, start))
    name = _without_signals(whole)
    if not name:
        return start
    begin = name[0].start
    if name[0] is whole[0] and html[low:begin].endswith("<em>"):
        begin -= len("<em>")
    surplus = html.count("</em>", begin, start) - html.count("<em>", begin, start)
    if surplus == 1 and (mark := re.search(r"<em>\s*$", html[max(low, begin - EMPHASIS_REACH) : begin])):
        return begin - len(mark[0])
    return begin if surplus == 0 else start


def _unwrapped(html: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The page without citation anchors, and where each one's content now stands, with its attributes."""
    out, found, size, at = [], [], 0, 0
    for m in _CITATION.finditer(html):
        out += [html[at : m.start()], m[2]]
        size += m.start() - at
        found.append((size, size + len(m[2]), m[1]))
        size += len(m[2])
        at = m.end()
    return "".join([*out, html[at:]]), found


def _free_text(html: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, str]]:
    """(place, text) of what lies outside tags, anchors and the taken spans."""
    depth = at = 0
    blocks = sorted([(m.start(), m.end(), m[0].lower()) for m in _TAG.finditer(html)] + [(a, b, "") for a, b, _ in taken])
    for a, b, tag in [*blocks, (len(html), len(html), "")]:
        if a > at and not depth:
            yield at, html[at:a]
        depth = max(0, depth + (tag.startswith(("<a ", "<a>"))) - tag.startswith("</a"))
        at = max(at, b)


def link_cites(html: str, cites: Sequence[tuple[str, Sequence[int]]], nodes: Mapping[int, int], self_id: int | None = None) -> tuple[str, dict]:
    """Opinion markup (already stripped) with links to the nodes it cites, and counts.

    Spans to link are found over the page without its citation anchors, and written out at the end:
    anchors whose ids mean exactly one other node; then, outside anchors and spans, whole words that are a cite (text,
    ids) which no anchor had, the longest first; each span reaches back over the case name right before it.
    """
    html, anchors_found = _unwrapped(html)
    spans = [(a, b, node) for a, b, attributes in anchors_found if (node := _one(_anchor_ids(attributes), nodes, self_id)) is not None]
    wrapped = {_plain(html[a:b]) for a, b, _ in anchors_found}
    meant = [(_plain(text or ""), _one(ids, nodes, self_id)) for text, ids in cites]
    wanted: dict[str, int] = {}
    for text, node in meant:
        if node is not None and text and text not in wrapped:
            wanted.setdefault(entities.escape(text, quote=False), node)
    of_anchors = len(spans)
    if wanted:
        longest = sorted(wanted, key=len, reverse=True)
        either = "|".join(rf"({'\\s+'.join(map(re.escape, t.split()))})" for t in longest)
        pattern = re.compile(rf"(?<!\w)(?:{either})(?!\w)")
        spans += [(at + m.start(), at + m.end(), wanted[longest[m.lastindex - 1]]) for at, text in _free_text(html, spans) for m in pattern.finditer(text)]
    stats = {
        "cites_to": len(cites), "cites_to_cases": sum(bool(ids) for _, ids in cites), "cites_to_resolved": sum(n is not None for _, n in meant),
        "cap_anchors": len(anchors_found), "links": len(spans), "links_text_pass": len(spans) - of_anchors, "linked_ids": sorted({n for _, _, n in spans}),
    }
    out, at = [], 0
    for start, end, node in sorted(spans):
        begin = name_start(html, at, start)
        out += [html[at:begin], f'<a class="cite" data-id="{node}">', html[begin:end], "</a>"]
        at = end
    return "".join([*out, html[at:]]), stats


_STATS = "cites_to int, cites_to_cases int, cites_to_resolved int, cap_anchors int, links int, links_text_pass int, linked_ids array<long>"


def link_opinions(opinions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cap_id, html, stats): opinions with their cites linked.

    opinions: cap_id, html, cites_to (array of struct<cite, case_ids>); nodes: cap_id, node.  The ids an opinion
    mentions are joined with ``nodes`` first, so each row carries only the part of the map that it needs.
    """

    @F.pandas_udf(f"html string, stats struct<{_STATS.replace(' ', ':').replace(',:', ',')}>")
    def rewrite(html: pd.Series, cites: pd.Series, ids: pd.Series, to: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for h, c, i, t, s in zip(html, cites, ids, to, own, strict=True):
            pairs = [(x["cite"], list(x["case_ids"] if x["case_ids"] is not None else [])) for x in (c if c is not None else [])]
            known = dict(zip(i, t, strict=True)) if i is not None else {}
            rows.append(link_cites(h or "", pairs, known, None if pd.isna(s) else int(s)))
        return pd.DataFrame(rows, columns=["html", "stats"])

    rows = opinions.select("cap_id", strip(F.col("html")).alias("html"), "cites_to")
    wrapped = F.flatten(F.transform(F.regexp_extract_all("html", F.lit('data-case-ids="([^"]*)"'), 1), lambda x: F.split(x, r"[,\s]+")))
    listed = F.flatten(F.transform("cites_to", lambda x: F.coalesce(x.case_ids, F.array().cast("array<long>"))))
    mentioned = F.array_union(F.transform(wrapped, lambda x: x.try_cast("long")), F.coalesce(listed, F.array().cast("array<long>")))
    ids = rows.select("cap_id", F.explode(mentioned).alias("x")).where("x is not null")
    to = nodes.select(F.col("cap_id").alias("x"), "node")
    known = ids.join(to, "x").groupBy("cap_id").agg(F.collect_list(F.struct("x", "node")).alias("k"))
    own = nodes.select("cap_id", F.col("node").alias("own"))
    full = rows.join(known, "cap_id", "left").join(own, "cap_id", "left")
    out = full.select("cap_id", rewrite("html", "cites_to", F.col("k.x"), F.col("k.node"), F.col("own")).alias("r"))
    return out.select("cap_id", "r.html", "r.stats")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references resolved, white space squeezed."""
    return text.map(lambda s: None if s is None else _plain(s))
