"""Request features: contexts, groups, flags and encodings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the estimator: contexts in code order, key groups, rates and the block markers of the browser.
CONTEXTS = ("script", "image", "video", "other", "audio", "css", "font", "html", "text", "wasm", "xml")
KEY_GROUPS = {"code": ("script", "css", "wasm"), "media": ("image", "video", "audio", "font"), "doc": ("html", "text", "xml"), "other": ("other",)}
BROWSER_CONTEXTS = {"document": "html", "stylesheet": "css", "image": "image", "media": "video", "font": "font", "script": "script", "texttrack": "text"}
PRIORITIES = {"Lowest": 0, "Low": 1, "Medium": 2, "High": 3, "Highest": 4}
RESOURCE_TYPES = ("script", "image", "other", "html", "text", "css", "video", "xml", "font")
INITIATORS = ("script", "parser", "other", "preflight")
METHODS = ("GET", "POST")
HTTP_VERSIONS = ("HTTP/2", "h3", "http/1.1")
EXTENSIONS = ("js", "gif", "html", "php", "jpg", "json", "png", "css")
TRACKING_FAILURES = ("NS_ERROR_TRACKING_URI", "NS_ERROR_SOCIALTRACKING_URI", "NS_ERROR_EMAILTRACKING_URI")
OTHER_FAILURES = ("NS_ERROR_CRYPTOMINING_URI", "NS_ERROR_FINGERPRINTING_URI")
CONTENT_GROUPS = {
    "application/javascript": "javascript", "text/javascript": "javascript", "application/x-javascript": "javascript",
    "image/gif": "image", "image/png": "image", "image/jpeg": "image", "image/svg+xml": "image", "image/webp": "image", "image/avif": "image",
    "text/html": "html", "text/plain": "text", "text/css": "css", "application/json": "json", "video/mp4": "video",
}
FAMILIES = {"Advertising": "ad", "Analytics": "analytics", "Social": "social", "Content": "content", "FingerprintingInvasive": "fingerprinting"}
KINDS = {"script": "script", "html": "frame", "image": "pixel", "other": "beacon"}


def mapped(c: Column, table: dict, default) -> Column:
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(c, F.lit(""))), F.lit(default))


def context_of(resource_type: Column) -> Column:
    """Context code of a logged resource type; anything unknown is 'other'."""
    return mapped(resource_type, {name: code for code, name in enumerate(CONTEXTS)}, CONTEXTS.index("other"))


def context_name(resource_type: Column) -> Column:
    return F.when(resource_type.isin(*CONTEXTS), resource_type).otherwise("other")


def browser_context(resource_type: Column) -> Column:
    return mapped(resource_type, BROWSER_CONTEXTS, "other")


def key_group(context: Column) -> Column:
    return mapped(context, {c: g for g, own in KEY_GROUPS.items() for c in own}, "other")


def is_bodyless(method: Column) -> Column:
    return F.coalesce(F.upper(method).isin("HEAD", "OPTIONS"), F.lit(False))


def protection_of(failure: Column) -> Column:
    some = lambda markers: F.expr("false") if not markers else [failure.contains(m) for m in markers]
    tracking, other = some(TRACKING_FAILURES), some(OTHER_FAILURES)
    return F.when(tracking[0] | tracking[1] | tracking[2], "tracking").when(other[0] | other[1], "cryptomining_fingerprinting").otherwise("other")


def one_hot(c: Column, values: tuple[str, ...], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{v.lower().replace('/', '').replace('.', '')}": F.coalesce((c == v).cast("int"), F.lit(0)) for v in values}


def priority_of(c: Column) -> Column:
    return mapped(c, PRIORITIES, 1)


def content_group(content_type: Column) -> Column:
    return mapped(content_type, CONTENT_GROUPS, "other")


def tracker_role(category: Column, context: Column) -> Column:
    return F.concat(mapped(category, FAMILIES, "other"), F.lit("-"), mapped(context, KINDS, "other"))
