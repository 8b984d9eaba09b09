"""Web address functions, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def host(url: Column) -> Column:
    """Lower-case host of an http(s) address without user and port, else null."""
    found = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def approved(url: Column, suffixes: tuple[str, ...], blocked: tuple[str, ...]) -> Column:
    """Whether the host is, or lies under, an approved suffix and is not blocked itself."""
    h = host(url)
    fits = reduce(lambda a, b: a | b, [(h == s) | F.endswith(h, F.lit("." + s)) for s in suffixes])
    return F.coalesce(fits & ~h.isin(*blocked), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.trim(F.regexp_replace(url, "#.*$", ""))


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` parts, of which none leads above the root."""
    parts = F.split(path, "/")
    left = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, part: F.when(part == "..", left(kept)).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    folded = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(folded, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))


def resolved(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, scheme-relative, root-relative, query or fragment alone, or relative to the folder, without dot segments."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain == root, F.lit("/")).otherwise(F.regexp_replace(F.substr(plain, F.length(root) + 1), r"[^/]*$", ""))
    path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
    whole = F.when(F.startswith(href, F.lit("/")), path).otherwise(F.concat(folder, path))
    dotted = whole.rlike(r"(?:^|/)\.{1,2}(?:/|$)")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(plain, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(root, F.when(dotted, without_dots(whole)).otherwise(whole), rest))
    )


def is_document(url: Column, link_text: Column) -> Column:
    return url.rlike(r"(?i)\.pdf(?:$|[?#])") | (url.rlike(V.PDF_HANDLER) & link_text.rlike(V.ORDER_WORD))


def page_kind(url: Column, text: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(is_document(url, text), "document")
        .when(F.contains(url, F.lit("dep_id=")) | F.contains(url, F.lit("godept_list.php")) | F.contains(low, F.lit("department")), "department_page")
        .when(F.contains(url, F.lit("go.php")) | F.contains(url, F.lit("go-search")) | F.contains(low, F.lit("gazette")), "listing")
        .when(low.rlike(r"\.(html|htm|php)$") | F.contains(low, F.lit("/document/")) | F.contains(low, F.lit("/documents")), "document_page")
        .otherwise("other")
    )


def file_name(url: Column, link_text: Column, go_number: str = r"(?i)g\.?o\.?[^0-9]{0,12}([0-9]{1,5})") -> Column:
    """A readable name: by order number and year, else by the path's last part."""
    plain = F.coalesce(F.try_url_decode(url), url)
    hay = F.concat(link_text, F.lit(" "), plain)
    number, year = F.regexp_extract(hay, go_number, 1), F.regexp_extract(hay, r"(19|20)[0-9]{2}", 0)
    base = stripped_name(F.regexp_extract(F.regexp_replace(plain, r"[?#].*$", ""), r"^[a-z]+://[^/]*(?:/.*)?/([^/]+)/?$", 1))
    named = F.when(F.endswith(F.lower(base), F.lit(".pdf")), base).otherwise(F.concat(base, F.lit(".pdf")))
    return F.when(number != "", F.concat(F.lit("GO-"), number, F.lit("-"), F.when(year != "", year).otherwise("unknown"), F.lit(".pdf"))).when(base != "", named).otherwise("document.pdf")


def stripped_name(base: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def status_cause(code: Column) -> Column:
    return F.when(code == 403, "HTTP_403_BLOCKED").when(code == 404, "HTTP_404").when((code >= 500) & (code < 600), "HTTP_500")


def is_pdf(content: Column, content_type: Column) -> Column:
    head = F.hex(F.substring(content, 1, 1024))
    return F.startswith(head, F.lit("255044462D")) | (F.contains(head, F.lit("255044462D")) & F.contains(content_type, F.lit("pdf")))


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def charset(header: Column) -> Column:
    found = F.regexp_extract(header, r"""(?i)charset\s*=\s*["']?([\w.-]+)""", 1)
    return F.when(found != "", F.lower(found))
