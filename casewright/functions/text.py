"""Text functions as Column expressions: name tokens, overlaps, cites, names, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the two name tokenisers (they differ on purpose), generic words of party names,
# reporter synonyms and abbreviations.
MERGE_STOP = (
    "v vs the of and co inc corp et al a an in re ex parte state states united company city county no on for by to at ltd llc"
).split()
NAME_STOP = (
    "v vs the of co inc et al and corp company a an in re ex parte rel ltd llc no on by for to at mr mrs his her their its"
).split()
GENERIC = (
    "united states state city county people commonwealth board bank railroad railway company commissioner director "
    "secretary attorney general"
).split()
REPORTERS = {
    "dal": "dall", "dallas": "dall", "cr": "cranch", "wh": "wheat", "pet": "pet", "peters": "pet", "howard": "how", "wallace": "wall", "bl": "black",
}
ABBREVIATIONS = {
    "comm'n": "commission", "ass'n": "association", "assn": "association", "dept": "department", "dep't": "department",
    "bd": "board", "nat'l": "national", "natl": "national", "ins": "insurance", "r.r.": "railroad", "ry": "railway",
    "sch": "school", "dist": "district", "cty": "county", "univ": "university", "mfg": "manufacturing",
}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def merge_tokens(name: Column) -> Column:
    """Distinct words of two letters or more without the merge stop words (for duplicate clusters)."""
    return F.filter(F.array_except(_words(name), _strings(MERGE_STOP)), lambda w: F.length(w) > 1)


def name_tokens(name: Column) -> Column:
    """Distinct words without the name stop words (for matching across sources)."""
    return F.array_except(_words(name), _strings(NAME_STOP))


def distinctive_tokens(name: Column) -> Column:
    return F.array_except(name_tokens(name), _strings(GENERIC))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements as a part of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements as a part of all; 0 if either set is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def same_case(year_a: Column, cite_a: Column, name_a: Column, year_b: Column, cite_b: Column, name_b: Column) -> Column:
    """Same known year, and the same non-empty cite or a name Jaccard of 0.6 or more."""
    cite = F.coalesce((cite_a == cite_b) & (cite_a != ""), F.lit(False))
    return F.coalesce((year_a == year_b) & (year_a != 0), F.lit(False)) & (cite | (jaccard(name_tokens(name_a), name_tokens(name_b)) >= 0.6))


def related_case(year_a: Column, name_a: Column, year_b: Column, name_b: Column) -> Column:
    """Same known year, and distinctive words that overlap by half or more."""
    return F.coalesce((year_a == year_b) & (year_a != 0), F.lit(False)) & (overlap(distinctive_tokens(name_a), distinctive_tokens(name_b)) >= 0.5)


def squeeze(text: Column) -> Column:
    """White space runs (Unicode) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


_CITE = r"(?U)^\s*(\d+)\s+(.+?)\s+(\d+[A-Za-z\-]*)\s*$"


def reporter_key(reporter: Column) -> Column:
    """Letters and digits in lower case, without a final ``rep``, synonyms folded."""
    key = F.regexp_replace(F.lower(reporter), "[^a-z0-9]", "")
    short = F.regexp_replace(key, "rep$", "")
    key = F.when(short == "", key).otherwise(short)
    table = F.create_map(*[F.lit(x) for kv in REPORTERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def parse_cite(cite: Column) -> Column:
    """Struct (volume, reporter, page) of ``264 U. S. 182``; null if it is no cite."""
    text = F.replace(F.coalesce(cite, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    part = lambda i: F.regexp_extract(text, _CITE, i)
    parsed = F.struct(
        part(1).try_cast("long").alias("volume"),
        reporter_key(part(2)).alias("reporter"),
        F.regexp_extract(part(3), r"^(\d+)", 1).try_cast("long").alias("page"),
    )
    return F.when(text.rlike(_CITE), parsed)


def cite_key(cite: Column) -> Column:
    """One string for equal cites: ``#volume|reporter|page``, or ``~`` and the squeezed lower-case text."""
    p = parse_cite(cite)
    return F.when(
        p.isNotNull(), F.concat(F.lit("#"), p.volume.cast("string"), F.lit("|"), p.reporter, F.lit("|"), p.page.cast("string"))
    ).otherwise(F.concat(F.lit("~"), F.lower(squeeze(F.coalesce(cite, F.lit(""))))))


def clean_cite(cite: Column) -> Column:
    return F.replace(F.regexp_replace(cite, r"\s+", " "), F.lit("S.Ct."), F.lit("S. Ct."))


def squashed_name(name: Column) -> Column:
    """Lower case without anything but (Unicode) word characters."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\W+", "")


def normal_name(name: Column, expand: bool = True) -> Column:
    """A popular name for matching: & as and, abbreviations expanded, corporate words, marks and v dropped."""
    out = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    if expand:
        for short, long in ABBREVIATIONS.items():
            out = F.regexp_replace(out, rf"\b\Q{short}\E\.?(?=\s|$|,)", long)
    out = F.regexp_replace(out, r"\b(inc|co|corp|ltd|llc|the|of|et al|ex rel|on behalf of)\b\.?", " ")
    out = F.regexp_replace(out, "[^a-z0-9 ]", " ")
    return F.array_join(F.filter(F.split(out, " +"), lambda w: ~w.isin("", "v", "vs")), " ")


def clip(text: Column, n: int) -> Column:
    """At most n characters, cut back to the last space, with an ellipsis."""
    head = F.substring(text, 1, n)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit(" ...")))


def long_words(text: Column) -> Column:
    """Distinct words of five letters a to z or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{5,})"), 1))


def relatedness(a: Column, b: Column) -> Column:
    """0 to 4: the Jaccard similarity of the long words, the stand-in judge."""
    return F.round(jaccard(long_words(a), long_words(b)) * 4, 4)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def par(shortest: Column) -> Column:
    return F.when(shortest == 1, 1).otherwise(shortest + 2)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of BMP text, as a long."""

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        # times 16777619 = 2^24 + 403, modulo 2^32, without leaving 64 bits
        return (x * 403 + F.shiftleft(x.bitwiseAND(F.lit(255)), 24)).bitwiseAND(F.lit(4294967295))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def url_title(url: Column) -> Column:
    """The last part of a url's path, percent-decoded; a plus sign stays one."""
    return F.url_decode(F.replace(F.substring_index(url, "/", -1), F.lit("+"), F.lit("%2B")))


def volume_of(path: Column) -> Column:
    """Struct (reporter, volume) of a raw volume's path; an error for any other path."""
    pattern = r"(us|s-ct)/(\d+)\.zip$"
    found = F.struct(F.regexp_extract(path, pattern, 1).alias("reporter"), F.regexp_extract(path, pattern, 2).try_cast("int").alias("volume"))
    return F.when(path.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("not a volume: "), path)).cast("struct<reporter:string,volume:int>"))


def around(text: Column, anchor: Column, width: int = 150) -> Column:
    """The text within ``width`` characters of an anchor's first place; null if it isn't there."""
    at = F.call_function("locate", anchor, text)
    low = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, low, at - low + F.length(anchor) + width))
