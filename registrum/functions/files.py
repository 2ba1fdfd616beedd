"""File typing from bytes, content types and names, as Column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.text import blank_to_null
from registrum.functions.urls import path_suffix, title_from_url


def _start(payload: Column) -> Column:
    return F.hex(F.substring(payload, 1, 16))


def magic_extension(payload: Column) -> Column:
    return F.coalesce(*[F.when(F.startswith(_start(payload), F.lit(h)), F.lit(e)) for h, e in fixed.MAGIC])


def content_type(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def content_extension(c: Column) -> Column:
    return F.coalesce(*[F.when(content_type(c).isin(*types), F.lit(e)) for e, types in fixed.CONTENT_TYPES.items()])


def known(suffix: Column) -> Column:
    return F.when(suffix.isin(*fixed.EXTENSIONS), suffix)


def extension(filename: Column, url: Column, kind: Column, payload: Column) -> Column:
    name = F.coalesce(blank_to_null(filename), title_from_url(url))
    own = F.lower(F.regexp_extract(name, r".(\.[^./\\]*)$", 1))
    return F.coalesce(known(own), known(path_suffix(url)), content_extension(kind), magic_extension(payload), F.lit(".bin"))


def looks_like_html(payload: Column, kind: Column) -> Column:
    text = F.lower(F.ltrim(F.decode(F.substring(payload, 1, 256), "ISO-8859-1")))
    starts = F.lit(False)
    for s in fixed.HTML_STARTS:
        starts = starts | F.startswith(F.regexp_replace(text, r"^\s+", ""), F.lit(s))
    return F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("html")) | starts


def is_real_file(payload: Column, kind: Column, url: Column) -> Column:
    """Empty and executable payloads, scripts and JSON fail; then bytes, markup, type, name decide in this order."""
    bad = F.coalesce(F.octet_length(payload), F.lit(0)) == 0
    exe = F.startswith(_start(payload), F.lit("4D5A")) | (path_suffix(url) == ".exe")
    t = content_type(kind)
    last = F.startswith(t, F.lit("application/")) | F.startswith(t, F.lit("image/"))
    return (
        F.when(bad | exe | t.isin(*fixed.NOT_FILES), False)
        .when(magic_extension(payload).isNotNull(), True)
        .when(looks_like_html(payload, kind), False)
        .when(content_extension(kind).isNotNull() | known(path_suffix(url)).isNotNull(), True)
        .otherwise(last)
    )


def name_from_headers(disposition: Column) -> Column:
    raw = F.regexp_extract(disposition, "(?i)filename\\*?=(?:UTF-8''|\"?)([^\";]+)", 1)
    return blank_to_null(F.regexp_extract(F.replace(F.coalesce(F.try_url_decode(raw), raw), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))


def unique_names(names: Column) -> Column:
    """Names of one folder, later equals (but for case) suffixed -2, -3 ... before the extension."""
    nth = lambda x, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda y: F.lower(y) == F.lower(x)))
    cut = lambda x, k: F.regexp_extract(x, r"^(.*?)(\.[^.]*)?$", k)
    return F.transform(names, lambda x, i: F.when(nth(x, i) == 1, x).otherwise(F.concat(cut(x, 1), F.lit("-"), nth(x, i).cast("string"), cut(x, 2))))
