"""File names and media types."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weblode.functions.fixed import (
    ALLOWED_CONTENT_TYPES, IMAGE_EXTENSIONS, JS_SPACE, MIME_TO_EXTENSION, VIDEO_EXTENSIONS, VIDEO_SUFFIX,
)
from weblode.functions.text import let
from weblode.functions.urls import path_of, url_extension

MAX_FILE_NAME = 255
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(IMAGE_EXTENSIONS), "IMAGE").when(ext.isin(VIDEO_EXTENSIONS), "VIDEO")


def extension_from_mime(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TO_EXTENSION.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(F.substring_index(mime, ";", 1))))


def is_allowed_content_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike("|".join(ALLOWED_CONTENT_TYPES).replace("+", r"\+")), F.lit(False))


def looks_like_video(url: Column) -> Column:
    return F.coalesce(url.rlike(VIDEO_SUFFIX), F.lit(False))


def video_extension(url: Column) -> Column:
    ext = F.regexp_extract(url, VIDEO_SUFFIX, 1)
    return F.when(ext != "", F.lower(ext))


def file_name_from_url(url: Column, ordinal: Column) -> Column:
    """Decoded last path segment, or ``media-{ordinal}`` when it has no dot. ``ordinal`` counts from 1."""
    base = F.regexp_extract(path_of(url), "([^/]*)$", 1)
    decoded = F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B")))
    readable = F.when(F.contains(decoded, F.lit("�")), base).otherwise(F.coalesce(decoded, base))
    numbered = F.concat(F.lit("media-"), ordinal.cast("string"), F.lit("."), F.coalesce(url_extension(url), F.lit("bin")))
    return F.when(F.contains(base, F.lit(".")), readable).otherwise(numbered)


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Arrow-batched compatibility normalisation, for captures whose names are not already composed."""
    return names.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def sanitize_file_name(name: Column, fallback: Column) -> Column:
    """Safe file name of at most 255 characters that keeps its extension. A name may be a whole text: it is cleaned once, not in every branch."""
    text = F.translate(name, FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    text = F.regexp_replace(text, r"[<>:\"/\\|?*]", "_")
    text = F.trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " "))
    text = F.regexp_replace(text, r"\.\.+", "_")
    text = F.regexp_replace(text, rf"^[.{JS_SPACE}]+|[.{JS_SPACE}]+$", "")
    return let(text, lambda clean: let(F.when(clean == "", fallback).otherwise(clean), _fitted))


def _fitted(text: Column) -> Column:
    def cut(ext: Column) -> Column:
        room = F.greatest(F.lit(1), F.lit(MAX_FILE_NAME) - F.length(ext))
        return F.when(ext != "", F.concat(F.substring(F.regexp_replace(text, r"\.[^.]*$", ""), F.lit(1), room), ext)).otherwise(
            F.substring(text, 1, MAX_FILE_NAME))

    return F.when(F.length(text) <= MAX_FILE_NAME, text).otherwise(let(F.regexp_extract(text, r"(?s)^.+(\.[^.]*)$", 1), cut))


def content_disposition(name: Column) -> Column:
    return let(sanitize_file_name(name, F.lit("download")), _disposition)


def _disposition(safe: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(safe, r"[^\x20-\x7E]", "_"), r"[\"\\]", "_")
    encoded = F.replace(F.replace(F.url_encode(safe), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    encoded = F.replace(F.replace(encoded, F.lit("%21"), F.lit("!")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), encoded)


def disposition_name(disposition: Column) -> Column:
    """File name named by a Content-Disposition header, null when there is none."""
    raw = F.regexp_extract(disposition, r"filename[^;=\n]*=((['\"]).*?\2|[^;\n]*)", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, "['\"]", "")), F.lit(""))
