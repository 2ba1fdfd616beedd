"""URL functions as Column expressions."""

from __future__ import annotations

from urllib.parse import uses_netloc, uses_params, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.text import SPACE, blank_to_null, col, contains_any, let, platform


def host(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")))


def path(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def query_param(url: Column | str, name: str) -> Column:
    raw = F.regexp_extract(col(url), rf"(?i)[?&]{name}=([^&#]*)", 1)
    return blank_to_null(F.coalesce(F.try_url_decode(raw), raw))


def uid_from_url(url: Column | str, params: list[str], path_pattern: str | None = None, dialect: str = "generic") -> Column:
    """Ordered query parameters, then a pattern over the path, then a reference anywhere."""
    tail = [blank_to_null(F.regexp_extract(path(url), path_pattern, 1))] if path_pattern else []
    return F.coalesce(*[query_param(url, p) for p in params], *tail, blank_to_null(F.regexp_extract(col(url), fixed.REFERENCES[dialect], 0)))


def last_segment(url: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(path(url), r"/+$", ""), r"([^/]*)$", 1)


def path_suffix(url: Column | str) -> Column:
    """Lower-case extension of the path, with its dot; none: empty."""
    return F.lower(F.regexp_extract(F.coalesce(F.try_url_decode(last_segment(url)), last_segment(url)), r".(\.[^./\\]*)$", 1))


def title_from_url(url: Column | str, params: tuple[str, ...] = ("filename", "fileName", "title", "name", "document", "doc")) -> Column:
    last = last_segment(url)
    return F.coalesce(*[query_param(url, p) for p in params], blank_to_null(F.coalesce(F.try_url_decode(last), last)), F.lit("Document"))


def base_url(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def set_param(url: Column | str, name: str, value: str) -> Column:
    u, has = col(url), col(url).rlike(rf"[?&]{name}=")
    joined = F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}={value}"))
    return F.when(has, F.regexp_replace(u, rf"([?&]{name}=)[^&#]*", f"$1{value}")).otherwise(joined)


def canonical_url(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(url), "[\\x00-\\x1f]", ""), r"\s*([?&=])\s*", "$1"))


def join_root(base: Column | str, href: Column | str) -> Column:
    """Absolute and root-relative references; others go to resolve()."""
    h = F.trim(col(href))
    return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("/")), F.concat(base_url(base), h)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(col(base), r"[?#].*$", ""), r"[^/]*$", ""), h))


def _parts(url: Column, default: Column) -> Column:
    """An address as scheme (or default), netloc, path, params (of the last segment), query and fragment; what is missing is empty."""
    scheme = r"^([A-Za-z][A-Za-z0-9+.-]*):"
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(own: Column, rest: Column, tail: Column) -> Column:
        whole = F.regexp_extract(tail, r"^[^?#]*", 0)
        has = own.isin(*uses_params) & F.contains(tail, F.lit(";"))
        named = {
            "scheme": own, "netloc": F.regexp_extract(rest, r"^//([^/?#]*)", 1), "path": F.when(has, F.regexp_replace(whole, r";[^/]*$", "")).otherwise(whole), "params": F.when(has, F.regexp_extract(whole, r";([^/]*)$", 1)).otherwise(""),
            "query": F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1), "fragment": F.regexp_extract(tail, r"(?s)#(.*)$", 1),
        }
        return F.struct(*[v.alias(k) for k, v in named.items()])

    own = lambda b: F.coalesce(F.nullif(F.lower(F.regexp_extract(b, scheme, 1)), F.lit("")), default)
    return let(bare, lambda b: let(own(b), lambda o: let(F.regexp_replace(b, scheme, ""), lambda r: let(F.regexp_replace(r, r"^//[^/?#]*", ""), lambda t: parts(o, r, t)))))


def _address(scheme: Column, netloc: Column, path_: Column, params: Column, query: Column, fragment: Column) -> Column:
    """The inverse of _parts(); empty parts leave no mark."""
    mark = lambda sign, c: F.when(c != "", F.concat(F.lit(sign), c)).otherwise("")

    def place(p: Column) -> Column:
        rooted = F.startswith(p, F.lit("/"))
        at = F.when(netloc != "", F.concat(F.lit("//"), netloc, F.when((p != "") & ~rooted, "/").otherwise(""), p))
        return at.when(F.startswith(p, F.lit("//")) | ((scheme != "") & scheme.isin(*uses_netloc) & ((p == "") | rooted)), F.concat(F.lit("//"), p)).otherwise(p)

    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), let(F.concat(path_, mark(";", params)), place), mark("?", query), mark("#", fragment))


def _without_dots(base_path: Column, path_: Column) -> Column:
    """path_ seen from base_path, its dot segments removed: a fold whose state is the stack of segments kept."""
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    inner = lambda s: F.filter(s, lambda x, i: (i == 0) | (i == F.size(s) - 1) | (x != ""))
    segments = F.when(F.startswith(path_, F.lit("/")), F.split(path_, "/")).otherwise(let(F.split(F.concat(folder, path_), "/"), inner))
    step = lambda stack, x: F.when(x == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(x == ".", stack).otherwise(F.concat(stack, F.array(x)))

    def over(s: Column) -> Column:
        stack = F.aggregate(s, F.array().cast("array<string>"), step)
        return F.array_join(F.when(F.element_at(s, -1).isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack), "/")

    return F.coalesce(F.nullif(let(segments, over), F.lit("")), F.lit("/"))


def quote(url: Column) -> Column:
    """Percent quoting of all characters that addresses may not hold, as UTF-8."""
    allowed = r"[A-Za-z0-9_.~%/:=&?#+!$,;'@()*\[\]-]"
    one = lambda c: F.when(c.rlike(f"^{allowed}$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return let(url, lambda u: F.when(u.rlike(f"^{allowed}*$"), u).otherwise(F.array_join(F.transform(F.regexp_extract_all(u, F.lit("(?s)."), F.lit(0)), one), "")))


def resolve(base: Column | str, href: Column | str) -> Column:
    """A reference seen from a base address (RFC 3986), percent quoted; a null base is empty."""
    b = F.coalesce(col(base), F.lit(""))
    h = F.regexp_replace(col(href), f"^{SPACE}+|{SPACE}+$", "")

    def join(o: Column, u: Column) -> Column:
        scheme = u["scheme"]
        alone = _address(scheme, u["netloc"], u["path"], u["params"], u["query"], u["fragment"])
        netloc = F.when(scheme.isin(*uses_netloc), o["netloc"]).otherwise(u["netloc"])
        same = _address(scheme, netloc, o["path"], o["params"], F.coalesce(F.nullif(u["query"], F.lit("")), o["query"]), u["fragment"])
        moved = _address(scheme, netloc, _without_dots(o["path"], u["path"]), u["params"], u["query"], u["fragment"])
        there = scheme.isin(*uses_netloc) & (u["netloc"] != "")
        return F.when((scheme != o["scheme"]) | ~scheme.isin(*uses_relative), h).when(there, alone).when((u["path"] == "") & (u["params"] == ""), same).otherwise(moved)

    joined = let(_parts(b, F.lit("")), lambda o: let(_parts(h, o["scheme"]), lambda u: join(o, u)))
    return quote(F.when(h.isNull(), h).when(b == "", h).when(h == "", b).otherwise(joined))


#: Viewers and the downloads they stand for.
VIEWERS = [("documentviewer.do", "documentdownload.do"), ("documentviewer", "documentdownload"), ("viewdocument", "downloadDocument")]


def document_candidates(url: Column | str) -> Column:
    """Addresses to try for a document, each once: itself, downloads in place of viewers, with a module named, by id beside the path."""
    u = col(url)
    p, bare = F.lower(path(u)), F.regexp_extract(u, r"^([^?]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    swapped = [F.when(F.contains(F.lower(u), F.lit(a)), F.regexp_replace(u, "(?i)" + a.replace(".", r"\."), b)) for a, b in VIEWERS]
    keyed = F.lower(u).rlike("[?&]keyval=")
    viewer, download = F.contains(p, F.lit("documentviewer.do")), F.contains(p, F.lit("documentdownload.do"))
    target = F.regexp_replace(bare, r"(?i)documentviewer\.do", "documentdownload.do")
    named = F.when(keyed & (viewer | download) & ~F.lower(u).rlike("[?&]module="), F.concat(target, F.lit("?module=planning&"), query))
    ident = F.coalesce(*[query_param(u, n) for n in ("id", "documentId", "docid")])
    up = F.regexp_replace(F.regexp_replace(bare, r"[^/]*$", ""), r"[^/]+/$", "")
    by_id = F.when(~F.contains(p, F.lit("download")) & ident.isNotNull() & contains_any(p, ["view", "document"]), F.concat(up, F.lit("DownloadDocument?id="), F.url_encode(ident)))
    return F.array_distinct(F.array_compact(F.array(u, *swapped, named, by_id)))


def host_key(authority: Column, scraper: Column, family: Column, listing: Column, base: Column, aggregator: str) -> Column:
    p = platform(authority, scraper, family)
    return F.when(p == "planit", F.lit(aggregator)).otherwise(F.coalesce(F.nullif(host(F.coalesce(listing, base)), F.lit("")), F.lower(authority)))


def is_tab_href(href: Column | str) -> Column:
    h = F.lower(F.trim(col(href)))
    fragment = F.regexp_extract(h, "#(.*)$", 1)
    return (F.contains(h, F.lit("applicationdetails.do")) & F.contains(h, F.lit("activetab=documents"))) | fragment.isin("tabdocuments", "documents")


def is_site_document(href: Column | str, title: Column | str | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", col(href), *([col(title)] if title is not None else [])))
    return ~contains_any(text, fixed.SITE_DOCUMENT_ALLOWED) & contains_any(text, fixed.SITE_DOCUMENT_TOKENS)


def is_document_href(href: Column | str) -> Column:
    h = F.lower(F.trim(col(href)))
    scheme = F.lit(False)
    for s in fixed.HREF_SCHEMES:
        scheme = scheme | F.startswith(h, F.lit(s))
    denied = scheme | is_site_document(href) | contains_any(h, fixed.HREF_DENIED) | is_tab_href(href) | F.contains(h, F.lit("search.do"))
    return F.coalesce(~denied & contains_any(h, fixed.HREF_MARKERS), F.lit(False))


def is_dialect_document(href: Column | str, dialect: str) -> Column:
    """Document addresses in the dialects with short marker lists."""
    h = F.lower(col(href))
    denied = F.contains(h, F.lit("applicationdetails.do")) if dialect == "idox" else F.lit(False)
    return F.coalesce(contains_any(h, fixed.DIALECT_MARKERS[dialect]) & ~denied, F.lit(False))


def is_application_link(href: Column, title: Column, reference: Column, uid: Column, family: str) -> Column:
    """Whether a link of a listing leads to an application, as its family tells."""
    h = F.lower(F.coalesce(href, F.lit("")))
    both = F.concat_ws(" ", h, F.lower(F.coalesce(title, F.lit(""))))
    if family == "northgate":
        return ~F.startswith(h, F.lit("#")) & uid.isNotNull() & contains_any(h, fixed.LINK_MARKERS[family])
    if family == "htmllist":
        return reference.isNotNull() & contains_any(h, fixed.LINK_MARKERS[family])
    marked = contains_any(both, fixed.LINK_MARKERS[family])
    return marked & uid.isNotNull() if family == "ocella" else marked & reference.isNotNull() & ~F.startswith(h, F.lit("#"))


def with_query(url: Column, *pairs: tuple[str, Column]) -> Column:
    """url without query or fragment, and an encoded query."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat(bare, F.lit("?"), F.concat_ws("&", *[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v)) for k, v in pairs]))


def sibling(url: Column, name: str) -> Column:
    """Another page of the same folder."""
    return F.concat(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", ""), F.lit(name))


def summary_url(page: Column, uid: Column, tab: str = "summary") -> Column:
    return with_query(sibling(page, "applicationDetails.do"), ("activeTab", F.lit(tab)), ("keyVal", uid))


def weekly_list_url(base: Column, root: Column, start: Column, end: Column) -> Column:
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    return with_query(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.btrim(root, F.lit("/")), F.lit("/search.do")), ("action", F.lit("weeklyList")), ("dateStart", day(start)), ("dateEnd", day(end)))


def viewer_url(page: Column, viewer: Column, key: Column, kind: Column, text: Column) -> Column:
    """The key-object viewer's address; without a key text it says Subject."""
    return with_query(join_root(page, F.coalesce(viewer, F.lit(fixed.VIEWER_PATH))), ("KeyNo", F.coalesce(key, F.lit(""))), ("RefType", kind), ("KeyText", F.coalesce(text, F.lit("Subject"))))


def aura_endpoint(listing: Column, *pairs: tuple[str, str]) -> Column:
    """The action address of a content site under its path prefix."""
    return with_query(F.concat(base_url(listing), path_prefix(listing), F.lit("/s/sfsites/aura")), *[(k, F.lit(v)) for k, v in pairs])


def path_prefix(url: Column) -> Column:
    return F.regexp_extract(path(url), fixed.PREFIX_PATH, 1)


def record_id(url: Column) -> Column:
    raw = F.regexp_extract(path(url), fixed.RECORD_PATH, 1)
    return blank_to_null(F.coalesce(F.try_url_decode(raw), raw))


def display_uid(url: Column) -> Column:
    """The application number in a display address."""
    raw = F.regexp_extract(path(url), fixed.DISPLAY_PATH, 1)
    return blank_to_null(F.btrim(F.coalesce(F.try_url_decode(raw), raw), F.lit("/")))


def client_slug(url: Column) -> Column:
    """The client of a hosted register: first path part there, else the host's first label unless it is a common one."""
    hosted = F.endswith(host(url), F.lit(fixed.HOSTED_REGISTERS))
    first, label = blank_to_null(F.regexp_extract(path(url), "^/+([^/]+)", 1)), F.split_part(host(url), F.lit("."), F.lit(1))
    return F.when(hosted & first.isNotNull(), first).when(~label.isin(*fixed.COMMON_LABELS), label)


def application_root(listing: Column) -> Column:
    """The folder of a register's search page; others have the usual one."""
    root = F.regexp_extract(path(listing), r"^(.*?)search\.do", 1)
    return F.when(F.startswith(root, F.lit("/")) & F.endswith(root, F.lit("/")), root).otherwise(fixed.IDOX_ROOT)


def replaced_action(url: Column, action: str) -> Column:
    return set_param(url, "fa", action)


def dated_search(url: Column, start: Column, end: Column) -> Column:
    """The search address of list pages that take a window in their query."""
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
    name = lambda side: F.url_encode(F.lit(f"{fixed.DATED_FIELD}[{side}][date]"))
    query = F.concat(name("min"), F.lit("="), day(start), F.lit("&"), name("max"), F.lit("="), day(end))
    takes = F.contains(url, F.lit(fixed.DATED_SEARCH)) & (start.isNotNull() | end.isNotNull())
    return F.when(takes, F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), query)).otherwise(url)


def valid_search(url: Column, start: Column, end: Column) -> Column:
    """The search address under a site's root that takes a window of valid dates."""
    parts = [F.lit(fixed.VALID_SEARCH), F.concat(F.lit("startDate="), F.date_format(start, "yyyy-MM-dd")), F.concat(F.lit("endDate="), F.date_format(end, "yyyy-MM-dd"))]
    return F.concat(base_url(url), F.lit("/search?"), F.concat_ws("&", *parts))


def is_document_link_text(title: Column | str, href: Column | str) -> Column:
    return F.lower(F.trim(col(title))).isin(*fixed.DOCUMENT_TITLES) & contains_any(F.lower(F.coalesce(col(href), F.lit(""))), fixed.DOCUMENT_TITLE_HREFS)


def document_text(title: Column, url: Column, description: Column, kind: Column, source: Column) -> Column:
    parts = [F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" "))) for c in (title, url, description, kind, source, title_from_url(url))]
    return F.lower(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def excluded_document(text: Column, url: Column) -> Column:
    return F.contains(text, F.lit(".exe")) | (path_suffix(url) == ".exe") | (F.contains(text, F.lit("existing")) & ~F.contains(text, F.lit("proposed")))


def downloadable_document(title: Column, url: Column, description: Column, kind: Column, source: Column) -> Column:
    text = document_text(title, url, description, kind, source)
    known = is_document_href(url) | F.contains(F.lower(url), F.lit("runthirdpartysearch")) | contains_any(text, fixed.EXTENSIONS) | F.lower(F.coalesce(kind, F.lit(""))).isin(*fixed.DOCUMENT_TYPES)
    return blank_to_null(url).isNotNull() & known & ~excluded_document(text, url)
