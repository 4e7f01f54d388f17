"""Event payloads checked against declared schemas, over VARIANT: strict JSON types, nested objects and arrays, and a reason.

A field is described by the SQL of what is wrong with it, built from its path. Nothing is cast before its JSON type is known, so
``"3"`` is no number and ``3`` no text, a missing field is told from a null one, and members not declared are passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.fixed import MAX_URL_CHARS
from weblode.functions.text import let
from weblode.functions.urls import host_of, is_private_host, with_scheme


class Check(NamedTuple):
    """``fault`` goes from a value's variant and its JSON type (null where the member is missing) to the place and kind of its fault, null
    without one. ``addresses`` goes from the variant and its place to the addresses in it, which are all tested by one expression."""

    fault: Callable[[Column, Column], Column]
    addresses: Callable[[Column, Column], Column] | None = None


ADDRESSES = "array<struct<at:string,url:string>>"


def _fault(*tests: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for good, fault in reversed(tests):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(f": {fault}")
    return out


def text(least: int = 0) -> Check:
    if not least:
        return Check(lambda v, kind: _fault((kind == "STRING", "not a text")))
    return Check(lambda v, kind: _fault((kind == "STRING", "not a text"), (F.length(v.cast("string")) >= least, "too short")))


def enum(*values: str) -> Check:
    return Check(lambda v, kind: _fault((kind == "STRING", "not a text"), (v.cast("string").isin(*values), "not one of its values")))


def flag() -> Check:
    return Check(lambda v, kind: _fault((kind == "BOOLEAN", "not a boolean")))


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Check:
    def fault(v: Column, kind: Column) -> Column:
        value = v.cast("double")  # reached behind the type test only
        tests = [(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "not a number")]
        if whole:
            tests.append((value == F.floor(value), "not whole"))
        if low is not None:
            tests.append((value >= low, "too small"))
        if high is not None:
            tests.append((value <= high, "too large"))
        return _fault(*tests)

    return Check(fault)


def public_url() -> Check:
    """A public address, with or without its scheme, as a user may give it."""
    return Check(lambda v, kind: _fault((kind == "STRING", "not a text")),
                 lambda v, at: F.array(F.struct(at.alias("at"), F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).alias("url"))))


def nullable(inner: Check) -> Check:
    return Check(lambda v, kind: F.when(kind == "VOID", F.lit(None).cast("string")).otherwise(inner.fault(v, kind)), inner.addresses)


def optional(inner: Check) -> Check:
    return Check(lambda v, kind: F.when(kind.isNull(), F.lit(None).cast("string")).otherwise(inner.fault(v, kind)), inner.addresses)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def record(**fields: Check) -> Check:
    """An object; the reason names the first member, in the order declared, that is missing or wrong."""
    def fault(v: Column, kind: Column) -> Column:
        faults = []
        for name, inner in fields.items():
            # a member is looked up once, however often its tests name it
            found = let(_member(v, name), lambda member: let(F.schema_of_variant(member), lambda kind: inner.fault(member, kind)))
            faults.append(F.concat(F.lit(f".{name}"), found))
        return F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.coalesce(*faults)).otherwise(": not an object")

    inside = {name: inner for name, inner in fields.items() if inner.addresses}
    return Check(fault, (lambda v, at: F.concat(*[
        inner.addresses(_member(v, name), F.concat(at, F.lit(f".{name}"))) for name, inner in inside.items()])) if inside else None)


def _items(v: Column, kind: Column) -> Column:
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def array(inner: Check) -> Check:
    """A list; the reason names the first element that is wrong."""
    def place(i: Column) -> Column:
        return F.concat(F.lit("["), i.cast("string"), F.lit("]"))

    def fault(v: Column, kind: Column) -> Column:
        wrong = F.transform(_items(v, kind), lambda e, i: F.concat(place(i), inner.fault(e, F.schema_of_variant(e))))
        return F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.get(F.filter(wrong, lambda w: w.isNotNull()), 0)).otherwise(": not a list")

    def addresses(v: Column, at: Column) -> Column:
        found = F.flatten(F.transform(_items(v, F.schema_of_variant(v)), lambda e, i: inner.addresses(e, F.concat(at, place(i)))))
        return F.coalesce(found, F.array().cast(ADDRESSES))

    return Check(fault, addresses if inner.addresses else None)


def _not_public(raw: Column) -> Column:
    def tested(url: Column, host: Column) -> Column:
        return _fault((url != "", "empty"), (F.length(url) <= MAX_URL_CHARS, "too long"), (url.rlike("(?i)^https?:"), "not http"), (host != "", "no host"),
                      (~is_private_host(host), "private host"), (F.contains(host, F.lit(".")) | F.contains(host, F.lit(":")), "undotted host"))

    return let(with_scheme(F.regexp_replace(raw, r"^\s+|\s+$", "")), lambda url: let(host_of(url), lambda host: tested(url, host)))


# ---- fixed values: the members of every event kind and what makes them acceptable --------------------------------------
_COUNT = number(low=0, whole=True)
CONFIG = record(
    maxDepth=optional(number(1, 3, whole=True)), maxPages=optional(number(1, 50, whole=True)), maxConcurrent=optional(number(1, 10, whole=True)),
    followSameDomain=optional(flag()), followSubdomains=optional(flag()), followVideoPlatforms=optional(flag()), followExternal=optional(flag()),
    requestTimeout=optional(number(5000, 30000, whole=True)), skipNavigationLinks=optional(flag()))
MEDIA_ITEM = record(
    url=public_url(), type=enum("image", "video"), platform=nullable(text()), videoId=nullable(text()), title=nullable(text()),
    thumbnailUrl=nullable(public_url()), canonicalUrl=nullable(public_url()),
    contentKind=nullable(enum("video", "live", "short", "clip", "playlist", "channel", "embed")), confidence=nullable(number(0, 1)),
    duration=nullable(text()), source=text(1), downloadable=flag(), discoveredFrom=nullable(public_url()), discoveryReason=nullable(text()))
PAGE_RESULT = record(
    url=public_url(), depth=_COUNT, title=nullable(text()), media=array(MEDIA_ITEM), error=nullable(text()), possibleSpa=flag(),
    pageKind=enum("landing", "hub", "listing", "media", "platform", "unknown"), discoveredFrom=nullable(public_url()), discoveryReason=nullable(text()))
EVENT_SCHEMAS: dict[str, Check] = {
    "crawl_started": record(url=public_url(), config=CONFIG),
    "page_discovered": record(
        url=public_url(), category=enum("video_platform", "same_domain", "subdomain", "external"), depth=_COUNT,
        source=enum("anchor", "button", "data_attr", "data_settings", "onclick"), fromUrl=public_url(), discoveryReason=nullable(text())),
    "page_processing": record(url=public_url(), depth=_COUNT, pagesDone=_COUNT, pagesTotal=_COUNT),
    "media_found": record(pageUrl=public_url(), media=MEDIA_ITEM),
    "page_complete": record(url=public_url(), mediaCount=_COUNT, depth=_COUNT),
    "page_error": record(url=public_url(), error=text(1), depth=_COUNT),
    "crawl_complete": record(
        originalUrl=public_url(), totalPages=_COUNT, pagesWithErrors=_COUNT, totalMedia=_COUNT, results=array(PAGE_RESULT), crawlDurationMs=number(low=0)),
    "crawl_error": record(error=text(1)),
}


def fault_of(event: Column, payload: Column) -> Column:
    """What is wrong with an event whose payload is a variant (null where its text is no JSON); null for a good one.

    Missing members and wrong types come first, then the first address that is not public.
    """
    kind = F.schema_of_variant(payload)
    checks, found = F.lit("unknown event"), F.array().cast(ADDRESSES)
    for name, check in EVENT_SCHEMAS.items():
        checks = F.when(event == name, check.fault(payload, kind)).otherwise(checks)
        if check.addresses:
            found = F.when(event == name, check.addresses(payload, F.lit(""))).otherwise(found)
    asked = F.filter(found, lambda a: a.url.isNotNull())
    private = F.get(F.filter(F.transform(asked, lambda a: F.concat(a["at"], _not_public(a["url"]))), lambda x: x.isNotNull()), 0)
    return F.when(payload.isNull(), "not JSON").otherwise(F.ltrim(F.coalesce(checks, private), F.lit(".")))
