"""URL and host features as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content flags by pattern, and suffixes of two labels under which names are registered.
CONTENT_PATTERNS = {
    "path_has_js": r"\.js|/js/|script|sdk|lib|tag|gtm|gtag",
    "path_has_collect": r"collect|beacon|ping|pixel|track",
    "path_has_image": r"\.gif|\.png|\.jpg|pixel|1x1",
    "path_has_sync": r"sync|match|cookie|usersync",
    "path_has_ad": r"/ad/|/ads/|adserver|pagead|prebid",
    "path_has_api": r"/api/|/v[0-9]/|/collect|/event",
}
PUBLIC_SUFFIXES = (
    "co.uk", "com.br", "com.au", "co.jp", "com.mx", "co.in", "com.tr",
    "co.kr", "com.cn", "co.za", "com.ar", "net.br", "org.uk", "com.sg",
    "com.hk", "co.nz", "com.tw", "ne.jp", "or.jp", "com.pl", "com.ua",
)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(url: Column) -> Column:
    """url without white space at its ends; the regular expression is for those that have some."""
    some = reduce(or_, (F.startswith(url, F.lit(c)) | F.endswith(url, F.lit(c)) for c in " \t\n\r"))
    return F.when(some, F.regexp_replace(url, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).otherwise(url)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^/?#]*?://|//)?([^/?#]*)", 1)


_PLAIN_HOST = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)*)(?::[0-9]+)?(?:\z|[/?#].*)"


def any_host(url: Column) -> Column:
    """Host of any URL: no user, port, brackets or trailing dots; case kept; null if empty."""
    own = F.regexp_replace(authority(trimmed(url)), r"^.*@", "")
    bare = F.when(own.startswith("["), F.regexp_extract(own, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(own, r":[0-9]+$", ""))
    host = F.regexp_replace(bare, r"\.+$", "")
    return F.when(host != "", host)


def url_host(url: Column) -> Column:
    """Host as the matcher sees it, see any_host; one expression finds it where scheme, plain labels and at most a port are there."""
    return F.coalesce(F.get(F.regexp_extract_all(url, F.lit(_PLAIN_HOST), F.lit(1)), F.lit(0)), any_host(url))


def net_host(url: Column) -> Column:
    """Host as the warehouse's extraction gives it: lower-cased."""
    return F.lower(url_host(url))


def rule_path(url: Column) -> Column:
    """Path for prefix rules: from the first slash behind the authority; empty if there is none."""
    return F.regexp_extract(trimmed(url), r"^(?:[^/?#]*?://|//)?+[^/?#]*+(/[^?#]*)", 1)


def url_parts(url: Column) -> Column:
    """Host, path ('/' if empty) and query length with its question mark, as the estimator splits a URL."""
    rest = F.regexp_replace(url, r"#.*$", "")
    path = F.regexp_extract(rest, r"^(?:[^/?]*?://|//)?+[^/?]*+(/[^?]*)", 1)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.struct(F.lower(url_host(url)).alias("host"), F.coalesce(_some(path), F.lit("/")).alias("path"), F.length(query).alias("query_length"))


def url_path(url: Column) -> Column:
    """Path without query, null if there is none; an authority may run through a query."""
    return _some(F.regexp_extract(url, r"https?://[^/]+(\/[^?#]*)", 1))


def path_depth(url: Column) -> Column:
    return F.size(F.split(F.coalesce(url_path(url), F.lit("/")), "/")) - 1


def path_depth_or_null(url: Column) -> Column:
    return F.when(url_path(url).isNotNull(), F.size(F.split(url_path(url), "/")) - 1)


def file_extension(url: Column) -> Column:
    """Leftmost dot-suffix that ends at a query, fragment or the end of the whole URL."""
    return _some(F.lower(F.regexp_extract(url, r"\.([a-zA-Z0-9]+)(?:\?|#|$)", 1)))


def has_query(url: Column) -> Column:
    return F.contains(url, F.lit("?"))


def url_length(url: Column) -> Column:
    return F.length(url)


def num_query_params(url: Column) -> Column:
    """Parts of the query between ampersands; 1 without a query."""
    return F.size(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"))


def strip_query(url: Column, lower: bool = False) -> Column:
    bare = F.regexp_replace(url, r"[?#].*", "")
    return F.lower(bare) if lower else bare


_NOT_PLAIN = r"[#\s\x{85}\x{2028}\x{2029}]"  # a fragment, or what patterns trim or stop at


def plain_query(url: Column) -> Column:
    """url with letters of its query replaced, their number kept: host, path and query length stay as they are.

    URLs that differ in their query's text alone become equal; one with a fragment or white space stays itself.
    """
    plain = url.contains("?") & ~url.rlike(_NOT_PLAIN)
    return F.when(plain, F.rpad(F.concat(F.substring_index(url, "?", 1), F.lit("?")), F.length(url), F.lit("q"))).otherwise(url)


def estimator_extension(path: Column) -> Column:
    """What follows the last dot of the last path segment, if it has one to eight characters."""
    last = F.substring_index(path, "/", -1)
    ext = F.lower(F.substring_index(last, ".", -1))
    return F.when(last.contains(".") & (F.length(ext) <= 8), ext).otherwise("")


_TOKEN = r"(?<![0-9A-Za-z])(?:[0-9]{4,}|(?=[0-9A-Za-z]*[0-9])[0-9A-Za-z]{8,})(?![0-9A-Za-z])"


def template_segment(s: Column) -> Column:
    opaque = s.rlike(r"^[0-9A-Fa-f-]{8,}$") & s.rlike("[0-9]")
    return F.when(opaque, "#").otherwise(F.regexp_replace(s, _TOKEN, "#"))


def path_template(path: Column) -> Column:
    """Identifiers in path segments become '#'."""
    return F.array_join(F.transform(F.split(path, "/"), template_segment), "/")


def host_template(host: Column) -> Column:
    return F.array_join(F.transform(F.split(host, r"\."), template_segment), ".")


def path_prefix(template: Column) -> Column:
    """The first two segments of a path template."""
    return F.array_join(F.slice(F.split(template, "/"), 1, 3), "/")


def query_bucket(length: Column) -> Column:
    return F.least(F.floor(F.log2(length + 1)), F.lit(12)).cast("int")


def query_length_left(length: Column, host: Column, path: Column) -> Column:
    """Query length where only the URL's length was logged."""
    return F.greatest(length - F.length(host) - F.length(path) - 8, F.lit(0))


def url_tokens(url: Column) -> Column:
    """Lower-case tokens of two characters and more: split at delimiters, camel case and digits."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2"), r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[/?&=.\-_ ]+"), lambda t: F.length(t) >= 2)


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), r"[/\-_.]+"), lambda t: (F.length(t) > 0) & (F.length(t) < 20))


def holds(url: Column, pattern: str) -> Column:
    """url.rlike(pattern) for alternatives without groups: those without special characters are looked for as text, which is many times faster."""
    words, others = [], []
    for part in pattern.split("|"):
        text = part.replace(r"\.", "")
        (others if re.search(r"[\\.^$*+?{}\[\]()]", text) else words).append(part)
    found = [url.contains(part.replace(r"\.", ".")) for part in words] + [url.rlike(part) for part in others]
    return reduce(or_, found)


def content_flags(url: Column, ignore_case: bool = True) -> dict[str, Column]:
    return {name: url.rlike("(?i)" + pattern) if ignore_case else holds(url, pattern) for name, pattern in CONTENT_PATTERNS.items()}


def suffix_chain(host: Column, least: int = 1) -> Column:
    """A host and its parents, longest first, down to names of ``least`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.greatest(n - least + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, n), "."))


def cascade_chain(host: Column) -> Column:
    """Suffix chain that stops before bare top-level names and known two-label suffixes."""
    return F.filter(suffix_chain(host, 2), lambda s: ~s.isin(*PUBLIC_SUFFIXES))


def registrable(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(*PUBLIC_SUFFIXES), three).otherwise(two)


def is_opaque(host: Column) -> Column:
    """The leftmost label is a UUID or a long hexadecimal number."""
    uuid, start = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{8,}", "[0-9a-f]{8}-[0-9a-f]{4,}"
    return host.rlike(rf"(?i)^(?:{uuid}|[0-9a-f]{{16,}}|{start})\.")


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_third_party(host: Column, page_host: Column) -> Column:
    """Neither host equals the other or is a parent of it; false where one is missing."""
    a, b = F.lower(host), F.lower(page_host)
    related = (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))
    return F.coalesce((a != "") & (b != "") & ~related, F.lit(False))


def filler_query(length: Column, params: Column) -> Column:
    """A query of ``length`` characters, its '?' included, in ``params`` parts of even size (fewer if it is too short)."""
    length, params = length.cast("int"), params.cast("int")
    bars = F.least(F.greatest(params - 1, F.lit(0)), length - 1)
    letters = length - 1 - bars
    size, more = F.floor(letters / (bars + 1)).cast("int"), letters % (bars + 1)
    parts = F.transform(F.sequence(F.lit(0), bars), lambda i: F.repeat(F.lit("q"), size + F.when(i < more, 1).otherwise(0)))
    return F.when(length > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")


def rebuilt_url(host: Column, path: Column, length: Column, params: Column) -> Column:
    """A URL of the logged host and path with a filler query that has the logged length and number of parameters."""
    there = F.coalesce(path, F.lit("/"))
    left = query_length_left(F.coalesce(length, F.lit(0)), host, there)
    return F.concat(F.lit("https://"), host, there, filler_query(left, F.coalesce(params, F.lit(1))))


def under_any(host: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a host is one of the suffixes or below one; a null host is not."""
    low = F.lower(host)
    return F.coalesce(F.lit(False) if not suffixes else reduce(or_, ((low == x) | low.endswith("." + x) for x in suffixes)), F.lit(False))
