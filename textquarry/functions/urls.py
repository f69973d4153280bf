"""URL functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, host, port, path, query of an absolute http(s) URL.
ABSOLUTE = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]+)(:[0-9]+)?([^?#]*)(\\?[^#]*)?"
# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_url(url: Column) -> Column:
    return url.rlike(ABSOLUTE)


def host(url: Column) -> Column:
    """The lower-cased host name, null if the URL is not absolute."""
    return F.when(is_url(url), F.lower(F.regexp_extract(url, ABSOLUTE, 2)))


def path(url: Column) -> Column:
    """The path, at least a slash."""
    return F.when(is_url(url), F.regexp_replace(F.regexp_extract(url, ABSOLUTE, 4), "^$", "/"))


def website(url: Column) -> Column:
    """Scheme and host."""
    return F.when(is_url(url), F.concat(F.lower(F.regexp_extract(url, ABSOLUTE, 1)), F.lit("://"), host(url)))


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters and the last slash of a path other than the root; not a URL: unchanged."""
    names = "|".join(TRACKING)
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, f"(?<=[?&])(?:{names})(?:=[^&]*)?(?:&|$)", "")
    bare = F.regexp_replace(bare, "[?&]$", "")

    def whole(b: Column) -> Column:
        scheme_host = F.concat(F.lower(F.regexp_extract(b, ABSOLUTE, 1)), F.lit("://"), F.lower(F.regexp_extract(b, ABSOLUTE, 2)), F.regexp_extract(b, ABSOLUTE, 3))
        full = F.concat(scheme_host, F.regexp_replace(F.regexp_extract(b, ABSOLUTE, 4), "^$", "/"), F.regexp_extract(b, ABSOLUTE, 5))
        return F.regexp_replace(full, "^([^:]+://[^/]+/.*)/$", "$1")

    return F.when(is_url(url), let(bare, whole)).otherwise(url)


def url_id(url: Column) -> Column:
    """Host and the last two parts of the path (or home), other signs as dashes; not a URL: ``url-`` and a hash."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "-")
    slug = F.when(last == "", F.lit("home")).otherwise(last)
    named = F.regexp_replace(F.concat(host(url), F.lit("-"), slug), "(?i)[^a-z0-9-]", "-")
    return F.when(is_url(url), named).otherwise(F.concat(F.lit("url-"), F.sha2(F.coalesce(url, F.lit("")), 256)))


def org_id(url: Column) -> Column:
    """The host without www, dots as dashes."""
    return F.replace(F.regexp_replace(host(url), "^www\\.", ""), F.lit("."), F.lit("-"))


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for a reference found on a page of URL base; null if there is none.

    Dot segments are resolved, however many: ``..`` takes the segment before it, at the root nothing.
    """
    scheme = F.regexp_extract(base, ABSOLUTE, 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, ABSOLUTE, 2), F.regexp_extract(base, ABSOLUTE, 3))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = (
        F.when(is_url(href), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, folder, href))
    )
    return let(joined, lambda x: F.when(is_url(x), F.when(x.rlike("^[^?#]*/\\.\\.?(?:[/?#]|$)"), without_dots(x)).otherwise(x)))


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has no ``.`` and ``..`` segments: a fold over its segments."""
    parts = F.split(F.regexp_extract(url, ABSOLUTE, 4), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    origin = F.concat(F.regexp_extract(url, ABSOLUTE, 1), F.lit("://"), F.regexp_extract(url, ABSOLUTE, 2), F.regexp_extract(url, ABSOLUTE, 3))
    return F.concat(origin, F.lit("/"), F.array_join(F.concat(kept, ends), "/"), F.regexp_replace(url, "^[^?#]*", ""))


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal but for www, or one below the other."""
    bare_a, bare_b = F.regexp_replace(a, "^www\\.", ""), F.regexp_replace(b, "^www\\.", "")
    return below(bare_a, bare_b)


def below(a: Column, b: Column) -> Column:
    """Hosts equal, or one below the other, as written."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
