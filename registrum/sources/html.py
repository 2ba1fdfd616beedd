"""Stored HTML as trees and as a node table, and the extraction operators over them.

One Arrow-batched pass of the standard library's parser gives a row a page (trees): its nodes in document order, each with the numbers
of its ancestors and the range of its text pieces, and the pieces, so text is stored once however deep it stands. The node table
(key, node, parent, tag, attrs, text, last, up) is that row spread out: text with all descendants' text, last the number of the last
descendant, up the ancestors from the root. Ancestors are found by equality of numbers, not by intervals, so a page with
very many nodes is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.text import SPACE, clean_text, contains_any, normalize_label
from registrum.functions.urls import is_document_href, is_document_link_text, is_tab_href, join_root
from registrum.sources.scratch import kept

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end an open one of the same group.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "p": {"p"}}
#: Tags that are one kind among siblings.
_KINDS = {"th": "cell", "td": "cell", "dt": "term", "dd": "term"}
_SCOPE = {"table", "ul", "ol", "dl", "select", "body", "html", "div"}
#: Bytes of pages that are parsed at once; a longer page is one portion.
PORTION = 1 << 22
#: begin and end: the node's pieces; a script's or style's own are code's, numbered -1, -2 and so on. peer: the next sibling of the same kind, nth: its place among them.
NODE = "node int, parent int, tag string, attrs map<string,string>, begin int, end int, last int, up array<int>, peer int, nth int"
TREE = f"nodes array<struct<{NODE.replace(' ', ': ').replace(',: ', ', ')}>>, pieces array<string>, code array<string>, turns array<int>"


class _Tree(HTMLParser):
    """rows: node, parent, tag, attrs, begin, end, last, up, peer, nth. turns: pieces in order, those of code as negative numbers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.code: list[str] = []
        self.turns: list[int] = []
        self.latest: dict[tuple[int, str], int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES:
            ended = None  # the outermost: a row ends the open cell and its row, or rows without end tags would nest
            for k in range(len(self.open) - 1, -1, -1):
                name = self.rows[self.open[k]][2]
                if name in _CLOSES[tag]:
                    ended = k
                elif name in _SCOPE:
                    break
            if ended is not None:
                self.end(ended)
        n, parent, at = len(self.rows), self.open[-1] if self.open else -1, len(self.pieces)
        kind = (parent, _KINDS.get(tag, tag))
        before = self.latest.get(kind)
        if before is not None:
            self.rows[before][8] = n
        self.latest[kind] = n
        if tag in ("script", "style"):
            at = -len(self.code) - 1
        self.rows.append([n, parent, tag, [(k, v or "") for k, v in dict(attrs).items()], at, at, n, list(self.open), -1, 1 if before is None else self.rows[before][9] + 1])
        if tag not in _VOID:
            self.open.append(n)

    def end(self, k: int) -> None:
        for i in self.open[k:]:
            row = self.rows[i]
            row[6] = len(self.rows) - 1
            row[5] = len(self.pieces) if row[4] >= 0 else -len(self.code) - 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][2] == tag:
                return self.end(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.rows[self.open[-1]][4] < 0:
            self.code.append(data)
            self.turns.append(-len(self.code))
        else:
            self.turns.append(len(self.pieces))
            self.pieces.append(data)


def parse(html: str) -> _Tree:
    t = _Tree()
    t.feed(html or "")
    t.close()
    t.end(0)
    return t


def _dealt(pages: DataFrame) -> DataFrame:
    """pages of a scan with fewer splits than there are cores, dealt out to all of them: parsing takes far longer than moving a page."""
    if "Exchange" in pages._jdf.queryExecution().executedPlan().toString():
        return pages  # shuffled already; asking for its partitions would run it
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def _portions(b: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    """b in runs of pages of about PORTION bytes, so that large pages are not parsed all at once."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(html)), 0).to_pylist()):
        if i > begin and size + n > PORTION:
            yield b.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if b.num_rows > begin or not b.num_rows:
        yield b.slice(begin)


def trees(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and TREE of every page; a null page has no nodes."""
    kind = pages.schema[key].dataType.simpleString()
    ints = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.int32(), ints, pa.int32(), pa.int32()]
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(it: Iterator) -> Iterator:
        texts = lambda rows: pa.array(rows, pa.list_(pa.string()))
        for whole in it:
            for b in _portions(whole, html):
                found = [parse(h) for h in b.column(html).to_pylist()]
                ends = pa.array([0, *accumulate(len(t.rows) for t in found)], pa.int32())
                cols = list(zip(*[r for t in found for r in t.rows])) or [()] * len(kinds)
                nodes_ = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names))
                yield pa.record_batch([b.column(key), nodes_, texts([t.pieces for t in found]), texts([t.code for t in found]), pa.array([t.turns for t in found], ints)], names=[key, "nodes", "pieces", "code", "turns"])

    return _dealt(pages.select(key, html)).mapInArrow(run, f"{key} {kind}, {TREE}")


def stored_trees(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """trees() written once to the shared folder: extraction that reads them several times would parse the pages each time."""
    return kept(trees(pages, key, html), "trees")


def _text(n: Column) -> Column:
    """The text of node n of a tree."""
    part = lambda c, begin, size: F.array_join(F.slice(c, begin, size), " ")
    return F.when(n["begin"] == n["end"], F.lit("")).when(n["begin"] < 0, part("code", -n["begin"], n["begin"] - n["end"])).otherwise(part("pieces", n["begin"] + 1, n["end"] - n["begin"]))


def spread(trees_: DataFrame, key: str = "page_id") -> DataFrame:
    """The node table of trees."""
    node = lambda n: F.struct(n["node"].alias("node"), n["parent"].alias("parent"), n["tag"].alias("tag"), n["attrs"].alias("attrs"), _text(n).alias("text"), n["last"].alias("last"), n["up"].alias("up"))
    return trees_.select(key, F.explode(F.transform("nodes", node)).alias("n")).select(key, "n.*")


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The node table of pages; a null page has no nodes."""
    return spread(trees(pages, key, html), key)


def stored_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """nodes() of stored_trees()."""
    return spread(stored_trees(pages, key, html), key)


def text_pieces(trees_: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place, text of the pieces of text between a page's tags, in order; blank ones are left out."""
    piece = lambda x: F.when(x >= 0, F.get("pieces", x)).otherwise(F.get("code", -x - 1))
    return trees_.select(key, F.posexplode(F.transform("turns", piece)).alias("place", "text")).withColumn("text", clean_text("text")).filter("text is not null")


def text_sequence(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """text_pieces() of pages."""
    return text_pieces(trees(pages, key, html), key)


def has_class(name: str) -> Column:
    """Whether a node has a class of this name."""
    return F.coalesce(F.array_contains(F.split(F.trim(F.col("attrs")["class"]), r"\s+"), name), F.lit(False))


def nearest(items: DataFrame, nodes_: DataFrame, tests: list[Column], key: str = "page_id") -> DataFrame:
    """items (key, node, and up unless it is to be looked up) with outer, outer_last: the nearest ancestor that passes the first of tests that any passes.

    Only numbers meet: an ancestor's text is as long as all it holds, and would go along with every item below it.
    """
    rank = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
    c = nodes_.withColumn("_r", rank).filter("_r is not null").select(key, F.col("node").alias("_n"), F.col("last").alias("_l"), "_r")
    here = items if "up" in items.columns else nodes_.select(key, "node", "up").join(items.select(key, "node").distinct(), [key, "node"], "left_semi")
    above = here.select(key, "node", F.explode("up").alias("_n")).join(c, [key, "_n"])
    best = above.groupBy(key, "node").agg(F.min_by(F.struct("_n", "_l"), F.struct("_r", -F.col("_n"))).alias("e"))
    return items.join(best.select(key, "node", F.col("e._n").alias("outer"), F.col("e._l").alias("outer_last")), [key, "node"], "left")


def enclosing(items: DataFrame, nodes_: DataFrame, tests: list[Column], key: str = "page_id") -> DataFrame:
    """nearest() with outer_text, the text of outer."""
    held = nodes_.filter(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]))
    return nearest(items, nodes_, tests, key).join(held.select(key, F.col("node").alias("outer"), F.col("text").alias("outer_text")), [key, "outer"], "left")


def first_within(items: DataFrame, nodes_: DataFrame, test: Column, name: str, key: str = "page_id") -> DataFrame:
    """items with outer and outer_last, and name: the text of the first node within outer that passes test."""
    c = nodes_.filter(test).select(key, F.col("node").alias("_n"), F.col("text").alias("_t"), F.explode("up").alias("outer"))
    here = items.filter("outer is not null").select(key, "outer").distinct()
    j = c.join(here, [key, "outer"], "left_semi")
    return items.join(j.groupBy(key, "outer").agg(clean_text(F.min_by("_t", "_n")).alias(name)), [key, "outer"], "left")


def row_cells(nodes_: DataFrame, tags: tuple[str, ...] = ("td",), key: str = "page_id") -> DataFrame:
    """key, outer (a row) and cells: the cleaned texts of its cells in order, blank ones empty."""
    c = nodes_.filter(F.col("tag").isin(*tags)).select(key, F.col("parent").alias("outer"), "node", F.coalesce(clean_text("text"), F.lit("")).alias("t"))
    return c.groupBy(key, "outer").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "t"))), lambda x: x["t"]).alias("cells"))


def anchors(nodes_: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node, href, title, up of links with an href."""
    return nodes_.filter("tag = 'a' and attrs['href'] is not null").select(key, "node", F.trim(F.col("attrs")["href"]).alias("href"), F.coalesce(clean_text("text"), F.lit("")).alias("title"), "up")


def containers(nodes_: DataFrame, tags: tuple[str, ...] = ("tr", "li", "article", "div"), key: str = "page_id") -> DataFrame:
    """Each link with the text of its nearest enclosing container: key, node, href, title, context."""
    a = enclosing(anchors(nodes_, key), nodes_, [F.col("tag").isin(*tags)], key)
    return a.select(key, "node", "href", "title", clean_text("outer_text").alias("context"))


def _siblings(nodes_: DataFrame, key: str, every: bool) -> DataFrame:
    """key, node, tag, attrs, text, and of the next sibling of the same kind next (its tag) and value (text); n: the node's place among them; after: the text of the next sibling.

    Over trees nothing is moved: a parser has noted the siblings. Over a node table they are found by windows.
    """
    cells = ("th", "td", "dt", "dd", "input")
    if "nodes" in nodes_.columns:
        peer = lambda n: F.when(n["peer"] >= 0, F.get("nodes", n["peer"]))
        then = lambda n: F.get("nodes", n["last"] + 1)
        after = (lambda n: F.when(then(n)["parent"] == n["parent"], _text(then(n)))) if every else (lambda n: F.lit(None).cast("string"))
        held = F.col("nodes") if every else F.filter("nodes", lambda n: n["tag"].isin(*cells))
        one = lambda n: F.struct(n["node"].alias("node"), n["tag"].alias("tag"), n["attrs"].alias("attrs"), _text(n).alias("text"), peer(n)["tag"].alias("next"), F.when(n["peer"] >= 0, _text(peer(n))).alias("value"), n["nth"].alias("n"), after(n).alias("after"))
        return nodes_.select(key, F.explode(F.transform(held, one)).alias("n")).select(key, "n.*")
    w = Window.partitionBy(key, "parent").orderBy("node")
    n = nodes_ if every else nodes_.filter(F.col("tag").isin(*cells))
    kind = F.when(F.col("tag").isin("th", "td"), "cell").when(F.col("tag").isin("dt", "dd"), "term").otherwise(F.col("tag"))
    n = n.select(key, "parent", "node", "tag", "attrs", "text", kind.alias("kind"))
    same = Window.partitionBy(key, "parent", "kind").orderBy("node")
    n = n.withColumns({"next": F.lead("tag").over(same), "value": F.lead("text").over(same), "n": F.row_number().over(same)})
    return n.withColumn("after", F.lead("text").over(w) if every else F.lit(None).cast("string"))


def labelled_pairs(nodes_: DataFrame, key: str = "page_id", class_labels: bool = False, inputs: bool = True) -> DataFrame:
    """key, source, ordinal, label, value from tables (th or td, then td), definition lists and (inputs) hidden inputs; sources in order of trust.

    nodes_: trees or a node table. One pass over siblings. class_labels: also elements of a class named like a label, with the
    element after them. Hidden inputs that change with every page (tokens, names that begin with an underscore) are left out.
    """
    n = _siblings(nodes_, key, class_labels)
    marked = F.contains(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))), F.lit("label"))
    hidden = F.lit(inputs) & (F.col("tag") == "input") & (F.lower(F.col("attrs")["type"]) == "hidden") & F.col("attrs")["name"].isNotNull() & ~is_transient(F.col("attrs")["name"])
    pair = lambda test, source, label, value: F.when(test, F.struct(F.lit(source).alias("source"), label.alias("label"), value.alias("value")))
    tag, text, value, after = (F.col(c) for c in ("tag", "text", "value", "after"))
    found = F.array_compact(
        F.array(
            pair((tag == "th") & (F.col("next") == "td"), 0, text, value),
            pair((tag == "td") & (F.col("next") == "td") & (F.col("n") == 1) & (F.length("text") < 80), 1, text, value),
            pair((tag == "dt") & (F.col("next") == "dd"), 2, text, value),
            pair(hidden, 3, F.col("attrs")["name"], F.col("attrs")["value"]),
            pair(marked & after.isNotNull() & (F.length("text") < 80), 4, text, after),
        )
    )
    out = n.select(key, F.col("node").alias("ordinal"), F.explode(found).alias("f")).select(key, "f.source", "ordinal", normalize_label("f.label").alias("label"), clean_text("f.value").alias("value"))
    return out.filter("label != '' and value is not null")


def is_transient(name: Column) -> Column:
    label = normalize_label(name)
    return F.startswith(F.trim(name), F.lit("_")) | (label == "csrf") | contains_any(label, fixed.TRANSIENT)


def sequential_pairs(texts: DataFrame, dialect: str = "generic", key: str = "page_id") -> DataFrame:
    """The same columns from running text: a known label, and of the five pieces after it the first that is no label itself."""
    known = [x for c, labels in fixed.LABELS[dialect].items() for x in labels]
    officer = fixed.LABELS[dialect].get("case_officer", [])
    t = texts.withColumn("label", normalize_label("text"))
    w = Window.partitionBy(key).orderBy("place")
    later = F.array(*[F.struct(F.lead("text", i).over(w).alias("text"), F.lead("label", i).over(w).alias("label")) for i in range(1, 6)])
    t = t.withColumn("later", later).filter(F.col("label").isin(*[x for x in known if x not in officer]) & (F.length("text") < 80))
    usable = lambda x: x["text"].isNotNull() & ~x["label"].isin(*known, *fixed.NOT_VALUES) & ~F.startswith(x["label"], F.lit("view_"))
    value = F.get(F.filter("later", usable), F.lit(0))["text"]
    return t.select(key, F.lit(5).alias("source"), F.col("place").alias("ordinal"), "label", value.alias("value")).filter("value is not null")


def label_columns(pairs: DataFrame, dialect: str, key: str = "page_id", more: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a page: the columns of a dialect's label map; the first or the last value wins, as the dialect has it.

    more: further columns and their labels, of which the first value wins.
    """
    order = F.struct("source", "ordinal")

    def column(pick, name: str, labels: list[str]) -> Column:
        held = F.col("label").isin(*labels)
        return pick(F.when(held, F.col("value")), F.when(held, order)).alias(name)

    own = F.min_by if fixed.LABEL_ORDER[dialect] == "first" else F.max_by
    return pairs.groupBy(key).agg(*[column(own, c, n) for c, n in fixed.LABELS[dialect].items()], *[column(F.min_by, c, n) for c, n in (more or {}).items()])


def header_tables(nodes_: DataFrame, dialect: str = "forms", key: str = "page_id") -> DataFrame:
    """Data rows of tables whose header row has two known labels or more: key, row, column, value, href (the row's first link)."""
    known = {label: c for c, labels in fixed.LABELS[dialect].items() for label in labels}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("label"))
    rows = nodes_.filter("tag = 'tr'").select(key, F.col("node").alias("row"), F.explode("up").alias("table"))
    tables = nodes_.filter("tag = 'table'").select(key, F.col("node").alias("table"))
    cells = nodes_.filter(F.col("tag").isin("th", "td")).select(key, F.col("parent").alias("row"), "node", "tag", "text")
    cells = cells.withColumn("place", F.row_number().over(Window.partitionBy(key, "row").orderBy("node")))
    r = rows.join(tables, [key, "table"]).groupBy(key, "row").agg(F.max("table").alias("table"))
    cells = cells.join(r, [key, "row"])
    head = cells.withColumn("label", normalize_label("text")).withColumn("column", name)
    heads = head.groupBy(key, "table", "row").agg(F.count("column").alias("n")).filter("n >= 2").groupBy(key, "table").agg(F.min("row").alias("head"))
    labels = head.join(heads, [key, "table"]).filter("row = head and column is not null").select(key, "table", "head", "place", "column")
    data = cells.join(labels, [key, "table", "place"]).filter("row > head")
    links = nodes_.filter("tag = 'a' and attrs['href'] is not null").select(key, F.col("node").alias("_a"), F.trim(F.col("attrs")["href"]).alias("href"), F.explode("up").alias("row"))
    first = links.join(r.select(key, "row"), [key, "row"], "left_semi").groupBy(key, "row").agg(F.min_by("href", "_a").alias("href"))
    return data.join(first, [key, "row"], "left").select(key, "row", "column", clean_text("text").alias("value"), "href")


def document_links(nodes_: DataFrame, base: Column, key: str = "page_id") -> DataFrame:
    """Links to documents from anchors, data attributes, scripted clicks, forms and frames: key, node, kind, url, title; one row a URL."""
    pick = lambda cond, kind, href, title="text": nodes_.filter(cond).select(key, "node", F.lit(kind).alias("kind"), F.expr(href).alias("href"), F.col(title).alias("title"))
    click = r"regexp_extract(attrs['onclick'], '[''\"]([^''\"]*(?:document|download|\\\\.pdf)[^''\"]*)[''\"]', 1)"
    parts = [
        pick("tag = 'a' and attrs['href'] is not null", "anchor", "attrs['href']"),
        pick("attrs['data-href'] is not null or attrs['data-url'] is not null", "data", "coalesce(attrs['data-href'], attrs['data-url'])"),
        pick("attrs['onclick'] is not null", "click", click),
        pick("tag = 'form' and lower(coalesce(attrs['method'], 'get')) = 'get' and attrs['action'] is not null", "form", "attrs['action']"),
        pick("tag in ('iframe', 'embed', 'object')", "frame", "coalesce(attrs['src'], attrs['data'])"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.filter("href is not null and href != ''").withColumn("title", F.coalesce(clean_text("title"), F.lit("")))
    u = u.filter(is_document_href("href") | is_document_link_text("title", "href") | is_tab_href("href"))
    u = u.withColumn("url", join_root(base, F.col("href")))
    return u.groupBy(key, "url").agg(F.min(F.struct("node", "kind", "title")).alias("m")).select(key, "m.node", "m.kind", "url", "m.title")


def single_summary(nodes_: DataFrame, phrase: str = "application summary", key: str = "page_id") -> DataFrame:
    hit = nodes_.filter(F.col("tag").isin("title", "h1") & F.contains(F.lower(F.regexp_replace("text", SPACE + "+", " ")), F.lit(phrase)))
    return hit.select(key).distinct()


def reported_total(text: Column) -> Column:
    """Total and shown counts of a result page's text."""
    total = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)there are (\d+) in total", r"(?i)of (\d+) (?:results|records|cases)", r"(?i)(\d+) (?:results|records|cases) found")])
    return F.struct(total.cast("int").alias("total"), F.regexp_extract(text, r"(?i)first (\d+)", 1).try_cast("int").alias("shown"))


def next_pages(nodes_: DataFrame, param: str = "page", key: str = "page_id") -> DataFrame:
    """Paging links, each once, with page: their number, and turn: their place in the order of reading."""
    n = F.regexp_extract("href", rf"(?i)[?&](?:searchCriteria\.)?{param}=(\d+)", 1).try_cast("int")
    a = anchors(nodes_, key).withColumn("page", F.coalesce(n, F.lit(0))).filter("page > 0")
    a = a.groupBy(key, "href").agg(F.min_by(F.struct("node", "title", "page"), "node").alias("m")).select(key, "href", "m.*")
    return a.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("page", "node")))


def refresh_target(nodes_: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url of a page's meta refresh, and disclaimer: the action of a form that only asks for agreement."""
    content = F.regexp_extract(F.col("attrs")["content"], r"(?i)url\s*=\s*['\"]?([^'\";]+)", 1)
    meta = nodes_.filter("tag = 'meta' and lower(attrs['http-equiv']) = 'refresh'").groupBy(key).agg(F.min_by(F.nullif(F.trim(content), F.lit("")), "node").alias("url"))
    asks = nodes_.filter((F.col("tag") == "form") & F.contains(F.lower("text"), F.lit("disclaimer"))).groupBy(key).agg(F.min_by(F.col("attrs")["action"], "node").alias("disclaimer"))
    return meta.join(asks, key, "full")


def script_strings(html: Column) -> Column:
    """Settings that pages keep in scripts (fixed.SCRIPT_SETTINGS): the register's API, its record type and viewer, form and document lists."""
    got = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])
    return F.struct(*[F.replace(got(p), F.lit("\\/"), F.lit("/")).alias(name) for name, p in fixed.SCRIPT_SETTINGS.items()])


def js_string(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf'var\s+{name}\s*=\s*"([^"]+)"', 1), F.lit(""))


def boot_context(html: Column) -> Column:
    """mode, fwuid, app of the first usable boot script address of a content site."""
    raw = F.regexp_extract_all(html, F.lit(fixed.BOOT_SCRIPT), F.lit(1))
    boots = F.filter(F.transform(raw, lambda x: F.try_url_decode(x)), lambda x: F.get_json_object(x, "$.fwuid").isNotNull() & F.startswith(F.get_json_object(x, "$.loaded"), F.lit("{")))
    first = F.get(boots, F.lit(0))
    at = lambda p: F.get_json_object(first, f"$.{p}")
    return F.when(first.isNotNull(), F.struct(F.coalesce(at("mode"), F.lit("PROD")).alias("mode"), at("fwuid").alias("fwuid"), F.coalesce(at("app"), F.lit("siteforce:communityApp")).alias("app")))
