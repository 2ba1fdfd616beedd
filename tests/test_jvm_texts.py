"""Entities, addresses and quoted CSV as expressions, held against the standard library."""

import base64
import csv
import html
import io
import random
from html.entities import html5
from urllib.parse import quote, urljoin

from registrum.functions import text, urls
from registrum.sources import payloads


def values(spark, rows, schema, *cols):
    d = spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    df = d.select("i", *cols)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))
    return [r[1] for r in sorted(df.collect())]


def test_entities_equal_the_library(spark):
    rng = random.Random(3)
    names = sorted(html5)
    odd = ["", "&", "&&", "&;", "a & b", "R&D", "&notit;", "&notin;", "&amp;lt;", "&ampamp;", "&copy2026", "&#65;&#x41;&#X41", "&#0;", "&#13;", "&#128;", "&#x80;&#x81;&#x9f", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#11;&#1;x", "&#xFDD0;&#xFFFF;&#x1FFFE;", "&#;", "&#x;", "&# 5;", "&#128512;", "&hellip;&nbsp;x", "&nosuchname;", "&ltx", "&gt", "naïve &eacute;", "&" + "a" * 40 + ";", "&\tamp;", "&#0065;", "&#x00041;", None]
    mixed = ["".join(rng.choice(["&", rng.choice(names), rng.choice(names)[:4], ";", "#", "x4f", "12", " ", "z"]) for _ in range(12)) for _ in range(150)]
    rows = [*odd, *[f"a&{n}b" for n in rng.sample(names, 150)], *[f"&{n}" for n in names if not n.endswith(";")], *mixed]
    expect = [None if r is None else html.unescape(r) for r in rows]
    assert values(spark, rows, "t string", text.unescape("t")) == expect
    assert values(spark, ["&hellip; A&eacute;&nbsp; &amp;lt; "], "t string", text.clean_text("t")) == ["… Aé &lt;"]


def test_addresses_equal_the_library(spark):
    bases = ["http://h.example/a/b/c?q=1#f", "https://H.example", "https://h.example/", "http://h.example/a/b/../c/./d;p?x", "", "a/b", "/a/b/", "mailto:a@b.c", "ftp://h/x/y", "http://u:p@h:80/x//y/z", "HTTP://h/x", "file:///a/b", "x-app:/a/b", "//h/a/b", "http://h?x=/y", "?a", "/", "a"]
    hrefs = ["", "x", "./x", "../x", "../../x", "../../../../x", ".", "..", "./", "../", "/x", "/x/../y/./z", "//other/x", "https://o/x?y#z", "http:x", "http:/x", "http:", "?q=2", "#frag", "?", "#", ";p", "x;p/y;q", "x;", "..;p", "/", "//", "///x", "a//b//../c", "x?a=/../b", "x#a/../b", "javascript:void(0)", "MAILTO:x@y", " x y ", "café/\U0001f600?日=本", "a\tb\nc", "%7Ex%20y", 'x"<>\\^`{|}', "x=1&y=2", "g;x=1/../y", "a:b", "1a:b", "+a:b", "x/./", "x/..", " x　", "[x]", "x'(y)*!$,@"]
    rows = [(b, h) for b in bases for h in hrefs] + [(None, "x/../y"), ("http://h/a", None)]
    expect = [None if h is None else quote(urljoin(b or "", h.strip()), safe="%/:=&?~#+!$,;'@()*[]") for b, h in rows]
    got = values(spark, rows, "b string, h string", urls.resolve("b", "h"))
    assert [(r, g, e) for r, g, e in zip(rows, got, expect) if g != e] == []


def test_csv_equals_the_library(spark):
    rng = random.Random(5)
    odd = ["", "a", "a,b\r\nc,d", "a,b\n", "a,", ",", "\n\na\n\n", '"a,b",c', '"a\r\nb","c"\r\n', '"x ""y"" z",1', '6" pipe,b', 'a,"b"c,d', '"open, to the end\nx', '"",x', "a\rb", '"a""', ",,\n,,", 'é,"日本\n語"\n', "x" * 70_000 + ',"' + "y\n" * 30_000 + '"']
    mixed = ["".join(rng.choice(["a", "b c", ",", ",", "\n", "\r\n", '"', '"q,\n"', '"d""e"', " "]) for _ in range(25)) for _ in range(200)]
    rows = [*odd, *mixed]
    expect = [list(csv.reader(io.StringIO(r, newline=""))) for r in rows]
    got = values(spark, rows, "t string", payloads.csv_rows(text.col("t")))
    wrong = [(r[-80:], g[-3:], e[-3:]) for r, g, e in zip(rows, got, expect) if g != e]
    assert wrong == []


def test_weekly_csv_in_quotes(spark):
    body = '﻿Preamble, "x"\r\n\r\n application_number ,location1,location1,\r\nR1,"1, High\r\nStreet",again,y\r\n\r\nR2\r\n"R ""3""",  two   words ,\r\n'
    p = spark.createDataFrame([(1, base64.b64encode(body.encode()).decode().rstrip("=")), (2, base64.b64encode(b"no,header").decode()), (3, None)], "k int, body string")
    d = payloads.weekly_csv(p, "k", "body")
    assert sorted((r["k"], r["ordinal"], dict(r["cells"])) for r in d.collect()) == [(1, 3, {"application_number": "R1", "location1": "1, High Street", "": "y"}), (1, 5, {"application_number": "R2"}), (1, 6, {"application_number": 'R "3"', "location1": "two words"})]
