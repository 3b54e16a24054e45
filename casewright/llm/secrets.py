r"""Secret scans through a trigram inverted index, in DataFrame operations alone.

Each rule's regex is turned into a Boolean query over trigrams that every match must hold (an OR of ANDs, derived
from its literals and alternations, lower-cased).  The index has a posting (trigram, text) for every text and every
trigram that some query names.  Postings of a query's branch are intersected by counting, and the candidate (text,
rule) pairs are verified with the regex itself.  A rule without mandatory trigrams scans every text in full.

The index and the candidates carry 64-bit keys, never text.  Candidates are broadcast while they are fewer than
``BROADCAST_ROWS``, else both sides are shuffled by the text's key.

Spans are places of the whole match in code points, end exclusive: leftmost, non-overlapping for each rule; a match
whose measured part is too short is consumed and dropped.  Places follow from the lengths of the matches and of the
gaps between them.

Defined results: a null text counts as empty and has no spans; repeated rows give equal rows; extra columns are
ignored (kept by :func:`redact`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.columns import let, places, scan
from casewright.llm.decontaminate import text_key
from casewright.session import cut

BROADCAST_ROWS = 500_000
FEW = 32


@dataclass(frozen=True)
class Rule:
    """``group``: the part whose length must be ``least`` or more; base rules are always reported as they are."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: In the order of their kinds in reports.  The first three are the base rules.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
RULES = [
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=-]+@"),
]


# --- trigram queries -------------------------------------------------------------------------------------------


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """An OR of ANDs over lower-cased trigrams that every match satisfies; [] if no trigram is mandatory."""
    runs: list[set[str]] = []  # in every match, one string of each set stands
    _runs(_parser.parse(pattern), runs, most)
    branches: list[frozenset[str]] = [frozenset()]
    for run in runs:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in options:  # one of the strings is too short to ask for anything
            continue
        joined = list({a | b for a, b in product(branches, options)})
        branches = joined if len(joined) <= most else branches
    return sorted(branches, key=sorted) if branches != [frozenset()] else []


def _runs(tree, runs: list[set[str]], most: int) -> None:
    """Cuts a sequence into sets of strings; whatever isn't a few literals ends a run."""
    run = {""}

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = {""}

    for kind, arg in tree:
        options = _exact([(kind, arg)], most)
        if options is not None:
            joined = {a + b for a, b in product(run, options)}
            if len(joined) > most:
                end()
                joined = options
            run = joined
            continue
        end()
        if kind is op.SUBPATTERN:
            _runs(arg[3], runs, most)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            _runs(arg[2], runs, most)
    end()


def _exact(tree, most: int) -> set[str] | None:
    """All strings that a tree matches, lower-cased, if they are few."""
    out = {""}
    for kind, arg in tree:
        if kind is op.LITERAL:
            options = {chr(arg).lower()}
        elif kind is op.SUBPATTERN:
            options = _exact(arg[3], most)
        elif kind is op.BRANCH:
            parts = [_exact(x, most) for x in arg[1]]
            options = None if None in parts else set().union(*parts)
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            options = {chr(c).lower() for _, c in arg}
        elif kind is op.MAX_REPEAT and arg[1] is not op.MAXREPEAT and arg[1] <= 3:
            once = _exact(arg[2], most)
            options = None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
        else:
            options = None
        if options is None:
            return None
        out = {a + b for a, b in product(out, options)}
        if len(out) > most:
            return None
    return out


def queries_of(rules: list[Rule]) -> dict[str, list[frozenset[str]]]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


# --- index, intersection, verification --------------------------------------------------------------------------


def trigram_index(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the named trigrams over the lower-cased whole texts."""
    vocabulary = F.array(*[F.lit(t) for t in sorted(trigrams)])
    held = let(F.lower(F.col("text")), lambda low: F.filter(vocabulary, lambda t: F.contains(low, t)))
    rows = documents.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), held.alias("held"))
    return rows.select("key", F.explode_outer("held").alias("trigram")).where("trigram is not null").select("trigram", "key")


def candidates(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): the rules whose trigram query a text satisfies."""
    queries = queries_of(rules)
    branches = [(kind, n, t, len(b)) for kind, query in queries.items() for n, b in enumerate(query) for t in sorted(b)]
    spark = documents.sparkSession
    wanted = spark.createDataFrame(branches, "kind string, branch int, trigram string, needed int")
    postings = trigram_index(documents, sorted({b[2] for b in branches})).distinct()
    # The queries' side is bounded by the rules, a parameter.
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "branch", "needed").count()
    return met.where("count = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's places in ``text``."""
    found = places(text, rule.pattern, rule.group if rule.least else 0)
    if rule.least:
        found = F.filter(found, lambda x: x.part >= rule.least)
    return F.transform(found, lambda x: F.struct(x["at"].alias("start"), F.lit(rank).alias("rank"), (x["at"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))


def with_spans(documents: DataFrame, rules: list[Rule] = RULES, into: str = "__spans") -> DataFrame:
    """``documents`` and a column of all verified spans, sorted by start, then kind as listed."""
    queries = queries_of(rules)
    gated = [r for r in rules if queries[r.kind]]
    found = cut(candidates(documents, gated)).select(F.col("key").alias("__key"), F.col("kinds").alias("__kinds"))
    n = found.count()
    keyed = documents.withColumn("__key", text_key(F.col("text")))
    joined = keyed.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, "__key", "left")
    none = F.array().cast(_SPANS)

    def all_spans(text: Column) -> Column:
        parts = []
        for rank, rule in enumerate(rules):
            own = _spans(text, rule, rank)
            parts.append(F.when(F.array_contains("__kinds", rule.kind), own).otherwise(none) if queries[rule.kind] else own)
        return F.array_sort(F.concat(*parts))

    spans = let(F.coalesce(F.col("text"), F.lit("")), all_spans)
    return joined.withColumn(into, spans).drop("__key", "__kinds")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _is(kind: str):
    return lambda s: s.kind == kind


def scan_secrets(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    rows = with_spans(documents.select("doc_id", "text"), rules, "spans").select("doc_id", "spans")
    base = [r.kind for r in BASE]
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(_listed(F.filter("spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, _listed(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, rules: list[Rule] = RULES, mask: str = "<SECRET>") -> DataFrame:
    """``documents`` with each span (overlapping ones together) of a text put for ``mask``; n_chars follows."""

    text = F.col("text")
    # What stands before each span, from the furthest end so far; a span that overlaps an earlier one adds nothing.

    def step(at: Column, s: Column) -> Column:
        out = F.when(s.start >= at, F.struct(at.alias("a"), s.start.alias("b")))
        return F.struct(F.greatest(at, s.end).alias("state"), out.alias("out"))

    kept = scan(F.col("__spans"), F.lit(0), step, "struct<a:int,b:int>")
    furthest = F.array_max(F.transform("__spans", lambda s: s.end))

    def pieces(parts: Column) -> Column:
        # substring() walks to its place from the start each time, so with many spans the text is cut up once.
        few = F.transform(parts, lambda x: F.substring(text, x.a + 1, x.b - x.a))
        many = let(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: F.transform(parts, lambda x: F.array_join(F.slice(c, x.a + 1, x.b - x.a), "")))
        return F.when(F.size(parts) <= FEW, few).otherwise(many)

    masked = F.concat(F.array_join(let(kept, pieces), mask), F.lit(mask), F.substring(text, furthest + 1, F.length(text) - furthest))
    found = with_spans(documents, rules)
    changed = F.size("__spans") > 0
    both = let(masked, lambda m: F.struct(m.alias("text"), F.length(m).cast("long").alias("n")))
    found = found.withColumn("__new", F.when(changed, both))
    out = {"text": F.when(changed, F.col("__new.text")).otherwise(text)}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.when(changed, F.col("__new.n")).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*documents.columns)


# --- a plain reference, for tests ----------------------------------------------------------------------------------


def spans_of(text: str | None, rules: list[Rule] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by Python's regexes (brute force)."""
    out = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]
