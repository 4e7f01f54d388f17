"""URL expressions. Resolution is staged over rows so that each step is computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.text import settle
from weblode.functions.fixed import (
    AUTH_SEGMENTS, MAX_URL_CHARS, MEDIA_EXTENSIONS, PRIVATE_HOSTS, STATIC_EXTENSIONS, TRACKING_PARAMS,
)

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
# characters that stay as they are; everything else is percent-encoded as UTF-8
PATH_KEEP = r"\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c-\x7c\x7e"
QUERY_KEEP = r"\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e"
FRAGMENT_KEEP = r"\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e"


def percent_encode(text: Column, keep: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{keep}]+|[^{keep}]+"), F.lit(0))
    encoded = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[{keep}]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))),
    )
    return F.when(text.rlike(f"[^{keep}]"), F.array_join(encoded, "")).otherwise(text)


def _remove_dots(path: Column) -> Column:
    up = r"^(?:\.|%2e|%2E){2}$"
    here = r"^(?:\.|%2e|%2E)$"
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s.rlike(up), F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        ).when(s.rlike(here), acc).otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segments, -1)
    closed = F.when(last.rlike(up) | last.rlike(here), F.array_append(kept, F.lit(""))).otherwise(kept)
    dotted = path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def with_resolved(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``out``: ``href`` resolved against ``base`` as a browser would; null when it cannot be.

    Non-hierarchical schemes (mailto, javascript, data, …) come back unchanged for the caller to reject.
    """
    c = F.col
    h = F.regexp_replace(F.regexp_replace(c(href), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    df = df.withColumn("_h", h)
    df = df.withColumns({
        "_hs": F.lower(F.regexp_extract("_h", SCHEME, 1)),
        "_bs": F.lower(F.regexp_extract(base, SCHEME, 1)),
        "_ba": F.regexp_extract(base, r"^[a-zA-Z][^:/?#]*://([^/?#\\]*)", 1),
        "_bp": F.regexp_extract(base, r"^[a-zA-Z][^:/?#]*://[^/?#\\]*([^?#]*)", 1),
        "_bq": F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1),
    })
    web = c("_hs").isin("http", "https")
    bare = F.regexp_replace("_h", SCHEME, "")
    absolute = web & (c("_h").rlike(SCHEME + r"[/\\]{2}") | (c("_hs") != c("_bs")))
    df = df.withColumns({
        "_opaque": (c("_hs") != "") & ~web,
        "_r": F.when(absolute, F.concat(F.lit("//"), F.regexp_replace(bare, r"^[/\\]+", "")))
        .when(web, bare).otherwise(c("_h")),
        "_s": F.when(absolute, c("_hs")).otherwise(c("_bs")),
    })
    own_auth = c("_r").rlike(r"^[/\\]{2}")
    after = F.when(own_auth, F.regexp_replace("_r", r"^[/\\]{2}[/\\]*[^/?#\\]*", "")).otherwise(c("_r"))
    df = df.withColumns({
        "_a": F.when(own_auth, F.regexp_extract("_r", r"^[/\\]{2}[/\\]*([^/?#\\]*)", 1)).otherwise(c("_ba")),
        "_own": own_auth,
        "_rest": after,
    })
    df = df.withColumns({
        "_p": F.replace(F.regexp_extract("_rest", "^([^?#]*)", 1), F.lit("\\"), F.lit("/")),
        "_q": F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)", 1),
        "_f": F.regexp_extract("_rest", r"(?s)^[^#]*(#.*)", 1),
    })
    merged = (
        F.when(c("_own") | c("_p").startswith("/"), c("_p"))
        .when(c("_p") == "", c("_bp"))
        .otherwise(F.concat(F.regexp_replace("_bp", "[^/]*$", ""), c("_p")))
    )
    df = df.withColumns({
        "_path": F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged)),
        "_query": F.when(~c("_own") & (c("_p") == "") & (c("_q") == ""), c("_bq")).otherwise(c("_q")),
        "_user": F.regexp_extract("_a", "^(.*@)", 1),
        "_host": F.lower(F.regexp_extract("_a", r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)),
        "_port": F.regexp_extract("_a", r":([^:\]]*)$", 1),
    })
    good = (
        c("_s").isin("http", "https")
        & (c("_host") != "")
        & ~c("_host").rlike(r"[\x00-\x20#/<>?@\\^|%]|^[^\[].*[\[\]:]")
        & c("_port").rlike("^[0-9]{0,5}$")
    )
    port = F.when(
        (c("_port") == "") | ((c("_s") == "http") & (c("_port") == "80")) | ((c("_s") == "https") & (c("_port") == "443")),
        F.lit(""),
    ).otherwise(F.concat(F.lit(":"), c("_port")))
    url = F.concat(
        c("_s"), F.lit("://"), c("_user"), c("_host"), port,
        percent_encode(_remove_dots(c("_path")), PATH_KEEP),
        percent_encode(c("_query"), QUERY_KEEP),
        percent_encode(c("_f"), FRAGMENT_KEEP),
    )
    df = settle(df, **{out: F.when(c("_opaque"), c("_h")).when(good, url)})
    return df.drop("_h", "_hs", "_bs", "_ba", "_bp", "_bq", "_opaque", "_r", "_s", "_a", "_own", "_rest", "_p", "_q",
                   "_f", "_path", "_query", "_user", "_host", "_port")


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?:"), F.lit(False))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*", "")


def host_of(url: Column) -> Column:
    """Host of an absolute URL, lower case, '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][^:/?#]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)", 1)


def segments_of(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null when absent or empty."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def canonical_url(url: Column) -> Column:
    """Crawl identity of a page: https, no tracking parameters, no fragment, no trailing slash."""
    whole = strip_fragment(url)
    secure = F.regexp_replace(F.regexp_replace(whole, "^http:", "https:"), "^(https://[^/?]*):443(?=[/?]|$)", "$1")
    head = F.regexp_extract(secure, r"^([^?]*)", 1)
    slim = F.regexp_replace(head, "^([a-z]+://[^/]*/.*)/$", "$1")
    pairs = F.filter(F.split(F.regexp_extract(secure, r"^[^?]*\?(.*)", 1), "&"), lambda p: p != "")

    def form(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))

    kept = F.filter(pairs, lambda p: ~form(F.substring_index(p, "=", 1)).isin(TRACKING_PARAMS))
    written = F.transform(
        kept,
        lambda p: F.concat(
            F.url_encode(form(F.substring_index(p, "=", 1))), F.lit("="),
            F.url_encode(form(F.regexp_replace(p, "^[^=]*=?", ""))),
        ),
    )
    query = F.when(F.contains(secure, F.lit("?")), F.array_join(written, "&")).otherwise("")
    return F.when(query == "", slim).otherwise(F.concat(slim, F.lit("?"), query))


def same_domain(url: Column, base: Column) -> Column:
    return bare_host(url) == bare_host(base)


def is_subdomain(url: Column, base: Column) -> Column:
    a, b = bare_host(url), bare_host(base)
    return (a != b) & F.endswith(a, F.concat(F.lit("."), b))


def url_extension(url: Column) -> Column:
    """Lower-case text after the last dot of the last path segment; null when there is none."""
    ext = F.regexp_extract(url, r"^[a-zA-Z][^:/?#]*://[^/?#]*/[^?#]*\.([^./?#]+)(?=$|[?#])", 1)
    return F.when(ext != "", F.lower(ext))


def is_media_extension(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(MEDIA_EXTENSIONS), F.lit(False))


def is_private_host(host: Column) -> Column:
    """True for an empty host, localhost and the private or reserved address ranges."""
    name = F.regexp_replace(F.lower(F.trim(host)), r"^\[(.*)\]$", "$1")
    return (name == "") | name.rlike("(?i)^(?:" + "|".join(PRIVATE_HOSTS) + ")")


def with_scheme(raw: Column) -> Column:
    """Trim and put https:// in front of input without a scheme."""
    text = F.trim(raw)
    return F.when((text == "") | text.rlike(SCHEME), text).otherwise(F.concat(F.lit("https://"), text))


def public_url_error(url: Column, parsed: Column) -> Column:
    """Reason a submitted URL is refused, null when it is public. ``parsed`` is its resolved form or null."""
    host = host_of(parsed)
    return (
        F.when(url == "", "empty")
        .when(F.length(url) > MAX_URL_CHARS, "too_long")
        .when(parsed.isNull(), "unparsable")
        .when(~is_http(parsed), "not_http")
        .when(host == "", "no_host")
        .when(is_private_host(host), "private_host")
        .when(~F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(":")), "undotted_host")
    )


def is_filtered_url(url: Column) -> Column:
    """Links never followed: non-http, static files, sign-in pages."""
    path = F.lower(path_of(url))
    static = F.lit(False)
    for ext in STATIC_EXTENSIONS:
        static = static | F.endswith(path, F.lit(ext))
    auth = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in AUTH_SEGMENTS]))
    return url.isNull() | ~is_http(url) | static | auth


def compact_url(url: Column) -> Column:
    path = path_of(url)
    return F.when(host_of(url) == "", url).otherwise(
        F.concat(host_of(url), F.when(path == "/", "").otherwise(path)))


def truncate_url(url: Column) -> Column:
    path = path_of(url)
    short = F.when(F.length(path) > 25, F.concat(F.substring(path, 1, 25), F.lit("..."))).otherwise(path)
    return F.when(host_of(url) == "", F.substring(url, 1, 35)).otherwise(F.concat(host_of(url), short))
