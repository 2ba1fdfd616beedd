"""Text functions as Column expressions. Blank text counts as missing throughout."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions import fixed

#: White space as Unicode has it; Java's own class stops at ASCII.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Entities that registers use most.
ENTITIES = [("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&pound;", "£"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_value(*cols: Column | str) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*map(blank_to_null, cols))


def _entity_names() -> str:
    """The names of HTML 5, with and without semicolon, by their first letter, as JSON."""
    names = defaultdict(dict)
    for name, value in html5.items():
        names[name[0]][name] = value
    return json.dumps(names)


_NAMES = _entity_names()
#: Names that count without a semicolon whatever follows, the longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Numbers that stand for characters of Windows-1252.
_WINDOWS = json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})


def _character(number: Column) -> Column:
    """The character of a numeric reference; null numbers are too large ones."""
    n = F.coalesce(number, F.lit(-1))
    mapped = F.try_element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), n.cast("string"))
    none = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    bad = (n <= 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    shown = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(n == 0xD, "\r").when(mapped.isNotNull(), mapped).when(none, "").otherwise(shown)


def _resolved(part: Column, names: Column) -> Column:
    """What stood behind an ampersand, with the ampersand resolved: the longest of names that fits, or a number."""
    called = lambda name: F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)
    after = lambda name: F.substring(part, F.length(name) + 1, F.length(part))
    rest = lambda p: F.regexp_replace(part, p, "")
    kept = F.concat(F.lit("&"), part)
    bare = lambda b: F.when(b == "", kept).otherwise(F.concat(called(b), after(b)))
    name = lambda w, known: F.when(known.isNotNull(), F.concat(known, after(w))).otherwise(let(F.regexp_extract(w, f"^({_BARE})", 1), bare))
    named = let(F.regexp_extract(part, "^([^\\t\\n\\f <&#;]{1,32};?)", 1), lambda w: let(called(w), lambda known: name(w, known)))
    decimal = lambda d: F.concat(let(F.ltrim(d, F.lit("0")).try_cast("bigint"), _character), rest("^#[0-9]+;?"))
    value = lambda h: F.when(F.length(F.ltrim(h, F.lit("0"))) <= 8, F.conv(h, 16, 10)).try_cast("bigint")
    hexed = lambda h: F.when(h == "", kept).otherwise(F.concat(let(value(h), _character), rest("^#[xX][0-9a-fA-F]+;?")))
    number = let(F.regexp_extract(part, "^#([0-9]+);?", 1), lambda d: F.when(d != "", decimal(d)).otherwise(let(F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1), hexed)))
    return F.when(F.startswith(part, F.lit("#")), number).otherwise(named)


def unescape(c: Column | str) -> Column:
    """All HTML entities, as browsers read them: names with and without semicolon, the longest that fits, and numbers.

    c stands in the expression once, so that calls within calls don't multiply it.
    """
    whole = lambda names: F.array_join(F.transform(F.split(col(c), "&"), lambda part, i: F.when(i == 0, part).otherwise(_resolved(part, names))), "")
    return let(F.from_json(F.lit(_NAMES), "map<string,map<string,string>>"), whole)


def clean_text(c: Column | str) -> Column:
    """Entities resolved, white space collapsed and trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(unescape(c), SPACE + "+", " ")), F.lit(""))


def normalize_label(c: Column | str) -> Column:
    low = F.replace(F.lower(F.coalesce(clean_text(c), F.lit(""))), F.lit("&"), F.lit("and"))
    return F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "_"), F.lit("_"))


def extract_postcode(*cols: Column | str) -> Column:
    """The first postcode in the first column that has one: upper case, one space before the last three."""
    def one(c: Column | str) -> Column:
        bare = F.upper(F.regexp_replace(F.regexp_extract(col(c), fixed.POSTCODE, 1), SPACE + "+", ""))
        return F.when(bare != "", F.concat(F.substring(bare, F.lit(1), F.length(bare) - 3), F.lit(" "), F.right(bare, F.lit(3))))

    return F.coalesce(*map(one, cols))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reference(c: Column | str, dialect: str = "generic") -> Column:
    return F.nullif(F.regexp_extract(col(c), fixed.REFERENCES[dialect], 0), F.lit(""))


def idox_reference(anchor: Column, row: Column) -> Column:
    """The reference after a label of the row's text, else in the link, else in the row, else the link's text."""
    labelled = F.regexp_extract(row, "(?i)" + fixed.REFERENCE_LABEL + "(" + fixed.REFERENCES["idox"].removeprefix("(?i)") + ")", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), reference(anchor, "idox"), reference(row, "idox"), blank_to_null(anchor))


def northgate_reference(anchor: Column, row: Column, uid: Column) -> Column:
    """A prefixed reference of the link, else a plain one of link or row, else the link's text, else the uid."""
    return F.coalesce(reference(anchor, "northgate"), reference(anchor, "generic"), reference(row, "generic"), uid)


def without_reference(text: Column | str, ref: Column | str, labels: bool = False) -> Column:
    """Text less a reference; labels: also less the words that label a row's cells."""
    bare = F.replace(col(text), F.coalesce(col(ref), F.lit("\0")), F.lit(" "))
    return clean_text(F.regexp_replace(bare, fixed.ROW_LABELS, " ") if labels else bare)


def without_title(text: Column, title: Column) -> Column:
    """A row's text less its link's: what describes a document."""
    return F.when(blank_to_null(title).isNull() | text.isNull(), text).otherwise(clean_text(F.replace(text, title, F.lit(" "))))


def without_label(value: Column, label: str) -> Column:
    """A cell's text less the label it begins with."""
    return F.trim(F.regexp_replace(clean_text(value), rf"(?i)^{label}\s*", ""))


def application_number(value: Column) -> Column:
    return blank_to_null(F.regexp_replace(clean_text(value), fixed.NUMBER_PREFIX, ""))


def trim_text(c: Column | str, n: int) -> Column:
    return F.left(clean_text(c), F.lit(n))


def sanitize_path_part(c: Column | str) -> Column:
    safe = F.regexp_replace(F.regexp_replace(col(c), r'[<>:"/\\|?*]+', " "), SPACE + "+", " ")
    return F.coalesce(F.nullif(F.left(F.btrim(safe, F.lit(" .")), F.lit(120)), F.lit("")), F.lit("untitled"))


def comparable_title(c: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\.[a-z0-9]{2,5}$", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def titles_match(a: Column | str, b: Column | str) -> Column:
    """Equal, or either holds the other; an empty title matches all."""
    x, y = comparable_title(a), comparable_title(b)
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def parse_keywords(text: Column | str) -> Column:
    """Lines without quotes and blanks, the first of those equal but for case."""
    lines = F.transform(F.split(col(text), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"'“”]+|[\"'“”]+$", "")))
    lines = F.filter(lines, lambda x: x != "")
    return F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def keyword_set_name(keywords: Column | str) -> Column:
    own = F.transform(col(keywords), lambda x: F.lower(F.trim(x)))
    return F.when(own == F.array(*map(F.lit, fixed.STANDARD_KEYWORDS)), "Standard").otherwise("Custom")


def contains_any(c: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(v)) for v in values])


def keyword_hits(haystack: Column, keywords: list[str]) -> Column:
    """The keywords that a lower-case text holds, in their order."""
    return F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(haystack, k))


def reference_excluded(c: Column | str) -> Column:
    return F.startswith(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), F.lit("old"))


def proposal_excluded(c: Column | str) -> Column:
    """Proposals that are no new works: prefixes, condition numbers, whole retrospective applications, phrases."""
    def excluded(p: Column) -> Column:
        prefixed = reduce(lambda a, b: a | b, [F.startswith(p, F.lit(x)) for x in fixed.EXCLUDED_PREFIXES])
        whole = F.contains(p, F.lit("retrospective")) & ~p.rlike(r"\bpart\b")
        return prefixed | p.rlike(r"\bcondition\s+\d+\b") | whole | contains_any(p, fixed.EXCLUDED_PHRASES)

    return let(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), SPACE + "+", " ")), excluded)


def first_marker(text: Column, rules: list[tuple[str, list[str]]], default: Column | None = None) -> Column:
    """The name of the first rule with a marker in text."""
    names = [F.when(contains_any(text, markers), F.lit(name)) for name, markers in rules]
    return F.coalesce(*names, *([default] if default is not None else []))


def portal_family(html: Column | str, url: Column | str) -> Column:
    text = F.lower(F.concat_ws("\n", F.coalesce(col(url), F.lit("")), F.coalesce(col(html), F.lit(""))))
    return first_marker(text, fixed.SIGNATURES)


def platform(authority: Column | str, scraper: Column | str, family: Column | str) -> Column:
    named = col(authority).isin(*fixed.AGGREGATOR_ALIASES, *fixed.AGGREGATOR_FIRST)
    portal = F.lower(F.concat_ws(" ", F.coalesce(col(scraper), F.lit("")), F.coalesce(col(family), F.lit(""))))
    by_marker = first_marker(portal, [(p, [m]) for m, p in fixed.PLATFORM_MARKERS], F.lit("custom"))
    return F.when(named, "planit").when(F.lower(col(authority)).isin(*fixed.SALESFORCE_AUTHORITIES), "salesforce").otherwise(by_marker)


def failure_signal(error: Column | str) -> Column:
    e = F.lower(col(error))
    return first_marker(e, [("rate_limited", fixed.RATE_LIMITED), ("blocked", fixed.BLOCKED), ("service_unavailable", fixed.UNAVAILABLE)], F.lit("failed"))


def failure_degraded(error: Column | str) -> Column:
    """Whether the service did respond: a responsive token, or no token of a confirmed outage."""
    e = F.lower(col(error))
    return contains_any(e, fixed.RESPONSIVE) | ~contains_any(e, fixed.OUTAGE)


def failure_platform(error: Column | str, platform: Column | str) -> Column:
    """Which platform a failure counts against: the aggregator if the text names it."""
    return F.when(F.contains(F.lower(col(error)), F.lit(fixed.AGGREGATOR_HOST)), "planit").otherwise(col(platform))


def retry_with_fresh_session(error: Column | str) -> Column:
    return contains_any(F.lower(col(error)), fixed.FRESH_SESSION)


def adapter(authority: Column | str, scraper: Column | str, family: Column | str, listing_url: Column | str) -> Column:
    """The adapter of a target: authorities first, then families and URLs, in this order."""
    a = F.lower(col(authority))
    text = lambda c: F.lower(F.coalesce(col(c), F.lit("")))
    portal, listing = F.concat_ws(" ", text(scraper), text(family)), text(listing_url)
    has = lambda *m: contains_any(portal, list(m))
    rules = [
        ("wiltshire", a == "wiltshire"),
        *((f"authority:{k}", a.isin(*v)) for k, v in fixed.AUTHORITY_ADAPTERS.items()),
        ("arcus", has("arcus")),
        ("achieveforms", has("achieveforms", "achieve forms")),
        ("atrium", has("atrium")),
        ("tascomi", has("tascomi") & contains_any(listing, ["tascomi", "/planning/index.html"])),
        ("enterprisestore", has("enterprisestore", "enterprise store")),
        ("appsearchserv", has("appsearchserv", "applicationsearchservlet")),
        ("fastweb", has("fastweb")),
        ("cced", has("cced")),
        ("astun", has("astun", "developmentcontrol.aspx") | F.contains(listing, F.lit("advancedsearchtab.tmplt"))),
        ("socrata", has("socrata") | F.contains(listing, F.lit("opendata.camden.gov.uk"))),
        ("statmap", has("statmap") | F.contains(listing, F.lit("horizonext"))),
        ("enterprisestore", a == "peak district"),
        ("northlincs", a == "north lincs"),
        ("htmllist", a.isin(*fixed.LIST_AUTHORITIES)),
        ("queryform", a.isin(*fixed.QUERY_AUTHORITIES)),
        ("idox", has("idox")),
        ("ocella", has("ocella")),
        ("agile", has("agile")),
        ("civica", has("civica")),
        ("northgate", has("northgate", "planningexplorer")),
    ]
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit("generic"))


def resolved_adapter(authority: Column | str, scraper: Column | str, family: Column | str, listing_url: Column | str) -> Column:
    """The adapter of a target by name: an authority's own, else what adapter() gives."""
    own = F.create_map(*[F.lit(x) for key, name, _ in fixed.AUTHORITIES for x in (key, name)])
    named = F.when(F.lower(col(authority)) != "wiltshire", F.try_element_at(own, F.lower(col(authority))))
    return F.coalesce(named, adapter(authority, scraper, family, listing_url))
