"""Web page expressions: title, icon, file name, front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import strip
from recollect.functions.trust import url_netloc


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]+)</title>", 1)
    return F.when(found != "", strip(found)).otherwise(F.lit("Untitled"))


def favicon(html: Column, base_url: Column) -> Column:
    """Absolute address of the first link whose target mentions ``favicon``."""
    href = F.regexp_extract(html, r"""(?i)href=["']([^"']*favicon[^"']*)["']""", 1)
    scheme = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    site = F.concat(scheme, F.lit("//"), url_netloc(base_url))
    folder = F.regexp_replace(F.regexp_replace(F.substring(base_url, F.length(site) + 1, 1 << 30), r"[?#].*$", ""), r"[^/]*$", "")
    return (
        F.when(href == "", F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_filename(url: Column) -> Column:
    """File name for a saved page, before numbering of clashes."""
    domain = F.replace(F.replace(url_netloc(url), F.lit("."), F.lit("_")), F.lit("www_"), F.lit(""))
    path = F.btrim(url_path(url), F.lit("/"))
    path = F.when(path == "", F.lit("index")).otherwise(path)
    path = F.rtrim(F.regexp_replace(path, r"[^a-zA-Z0-9_\-./]", "_"), F.lit("/"))
    name = F.concat(domain, F.when(path == "", F.lit("/index")).otherwise(path), F.lit(".html"))
    flat = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?* ]', "_"), "_{2,}", "_")
    return F.substring(flat, 1, 150)


def numbered_name(name: Column, clash: Column) -> Column:
    """``stem.ext`` for the first bearer of a name, ``stem_<n>.ext`` for later ones."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ext = F.regexp_extract(name, r"\.[^.]*$", 0)
    return F.when(clash == 0, name).otherwise(F.concat(stem, F.lit("_"), clash.cast("string"), ext))


def page_document(url: Column, title: Column, saved_at: Column, project: Column, content: Column) -> Column:
    """Saved form of a page: front matter and the readable content."""
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("source: "), url),
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("saved_at: "), saved_at),
        F.when(F.coalesce(project, F.lit("")) != "", F.concat(F.lit("project: "), project)),
        F.lit("---"),
        F.lit(""),
    )
    return F.concat(head, content)
