"""HTML as a table.

A page is cut into tokens by one linear-time regular expression (possessive quantifiers, no
backtracking). Its elements are then matched as intervals of its own token array in one linear pass
(``intervals``), and **nothing is shuffled** — the only wide data, the HTML itself, never leaves the
task that scanned it. Memory is bounded by the admission limit on page size, however many pages there
are and whatever site they come from.

Generators are the outer kind throughout: the inner kind makes the optimizer infer a non-empty filter
that evaluates the whole tokenisation a second time below the projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weblode.functions.fixed import (
    AD_WORDS, HEAD_ELEMENTS, META_VIDEO_PROPS, RAW_ELEMENTS, SVG_LEAVES, VOID_ELEMENTS,
)
from weblode.functions.text import (
    START_TAG, START_TAG_BODY, attr_names, attr_tokens, attr_values, built_once, collapse_space, decode_entities,
    has_word, let, trim_space, utf16_length,
)
from weblode.operators.intervals import OUT, intervals

# an opener without its end takes the rest of the page, so no part of a page is read twice
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<({'|'.join(RAW_ELEMENTS)})(?=[\s/>]){START_TAG_BODY}(?:>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\z)|.*+)|\z)"
    rf"|</?[a-z]{START_TAG_BODY}(?:>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|[^<]++|<"
)
TEXT, OPEN, CLOSE, VOID, RAW, SKIP = range(6)
KIND_NAMES = ["text", "open", "close", "void", "raw", "comment"]
CONTEXT_CHARS = 352  # 350 kept characters plus the spaces trimmed off both ends
PIECE = 1024  # characters of a piece of a page's text, so that the head of any stretch lies in two pieces

_WANTED_NAMES = [
    "a", "button", "img", "source", "video", "picture", "iframe", "embed", "object", "script", "style", "noscript",
    "amp-youtube", "lite-youtube", "amp-vimeo",
]
_WANTED_ATTRIBUTE = r"(?i)[\s\"'/](?:style|onclick|role|formaction|videoid|data-[a-z0-9_-]+)\s*="
META_PROPS = META_VIDEO_PROPS + ["og:image"]


def tokens_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def token_name(tok: Column) -> Column:
    return F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))


def token_kind(tok: Column, name: Column) -> Column:
    return (
        F.when(~tok.startswith("<") | (tok == "<"), TEXT)
        .when((name == "") | ~F.endswith(tok, F.lit(">")) & ~tok.rlike(rf"{START_TAG}"), SKIP)
        .when(tok.startswith("</"), CLOSE)
        .when(name.isin(VOID_ELEMENTS) | (name.isin(SVG_LEAVES) & F.endswith(tok, F.lit("/>"))), VOID)
        .when(name.isin(RAW_ELEMENTS), RAW)
        .otherwise(OPEN)
    )


def raw_body(tok: Column) -> Column:
    """Contents of a raw-text element."""
    return F.regexp_replace(F.regexp_replace(tok, START_TAG, ""), r"</[a-zA-Z]+[^<>]*>$", "")


def tag_table(pages: DataFrame) -> DataFrame:
    """One row per tag, comment or raw-text element, in document order. Narrow: no shuffle."""
    toks = pages.select("page_id", F.posexplode_outer(tokens_of(F.col("html"))).alias("pos", "token"))
    toks = toks.filter(F.col("token").isNotNull())
    toks = toks.withColumn("name", token_name(F.col("token")))
    toks = toks.withColumn("kind", token_kind(F.col("token"), F.col("name")))
    kinds = F.array(*[F.lit(k) for k in KIND_NAMES])
    return toks.filter(F.col("kind") != TEXT).select(
        "page_id", "pos", F.get(kinds, F.col("kind")).alias("kind"), "name", "token")


@built_once
def _attribute_columns(tag: str) -> tuple[Column, Column, Column]:
    return attr_tokens(F.col(tag)), attr_names(F.col("_at")), attr_values(F.col("_at"))


def with_attributes(df: DataFrame, tag: str) -> DataFrame:
    """Add aligned ``names`` / ``values`` arrays parsed once from a start tag."""
    parts, names, values = _attribute_columns(tag)
    return df.withColumn("_at", parts).withColumns({"names": names, "values": values}).drop("_at")


def with_inside(tags: DataFrame, *names: str, out: str = "inside") -> DataFrame:
    """Ancestor test over a stored tag table: is any of ``names`` open at this tag?

    Groups are single pages; a table clustered by ``page_id`` runs this without an exchange.
    """
    step = F.when(F.col("name").isin(*names), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1))
    upto = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return tags.withColumn(out, F.coalesce(F.sum(F.coalesce(step, F.lit(0))).over(upto), F.lit(0)) > 0)


# ---- classified tokens -----------------------------------------------------------------------------


def _classified(toks: Column, text: bool) -> Column:
    """What the pass over a page needs of each token. Attributes are looked at only in tags that have some."""
    def entry(i, n, k, w, ad, al, x) -> Column:
        return F.struct(i.alias("i"), n.alias("n"), k.alias("k"), w.alias("w"), ad.alias("ad"), al.alias("al"), x.alias("x"))

    no, none = F.lit(False), F.lit(None).cast("string")
    words = lambda tok: collapse_space(_text_of(tok)) if text else none

    def tag(tok: Column, i: Column) -> Column:
        given = F.contains(tok, F.lit("="))
        return let(token_name(tok), lambda n: let(token_kind(tok, n), lambda k: entry(
            i, n, k, (k != CLOSE) & (n.isin(_WANTED_NAMES) | (given & tok.rlike(_WANTED_ATTRIBUTE))),
            F.when((k == OPEN) & given & tok.rlike("(?i)[\\s\"'/](?:class|id|role)\\s*="), _region(tok)).otherwise(no),
            F.when(n == "img", (k != CLOSE) & tok.rlike(r"(?i)[\s\"'/]alt[\s=/>]")).otherwise(no) if text else no,
            F.when(k == RAW, words(tok)))))

    def one(tok: Column, i: Column) -> Column:
        mark = F.substring(tok, 2, 1)
        return F.when(~tok.startswith("<") | (mark == ""), entry(i, F.lit(""), F.lit(TEXT), no, no, no, words(tok))).when(
            mark.isin("!", "?"), entry(i, F.lit(""), F.lit(SKIP), no, no, no, none)).otherwise(tag(tok, i))

    return F.filter(F.transform(toks, one), lambda x: ~x.k.isin(*([SKIP] if text else [SKIP, TEXT])))


def _region(tok: Column) -> Column:
    """Ad-like class or id, or role=navigation."""
    def value(parts: Column, name: str) -> Column:
        return F.coalesce(
            F.get(attr_values(parts), F.array_position(attr_names(parts), name).cast("int") - 1), F.lit(""))

    hint = "(?i)ad-container|ads-|advert|sponsor|banner-ad|navigation"
    full = lambda p: (
        has_word(value(p, "class"), AD_WORDS) | has_word(value(p, "id"), AD_WORDS)
                      | (value(p, "role") == "navigation"))
    return F.when(tok.rlike(hint), let(attr_tokens(tok), full)).otherwise(F.lit(False))


def _page_text(classified: Column) -> Column:
    return collapse_space(F.array_join(F.transform(F.filter(classified, lambda x: x.x.isNotNull()), lambda x: x.x), ""))


def _implied_body(toks: Column) -> Column:
    """Where a page leaves ``<body>`` out: the characters of text before the body it implies. Null where the tag is there."""
    def begins(x: Column) -> Column:
        return F.when(x.k == TEXT, F.get(toks, x.i).rlike(r"\S")).otherwise(~x.n.isin(HEAD_ELEMENTS) & (x.k != CLOSE))

    at = F.array_position(F.transform("cls", begins), True).cast("int")
    head = F.slice("cls", F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.when(~F.exists("cls", lambda x: (x.n == "body") & (x.k == OPEN)), F.length(_page_text(head)))


def _rootless(x: Column) -> Column:
    no, none = F.lit(False), F.lit(None).cast("int")
    return F.struct(
        x.i.alias("i"), x.n.alias("n"), x.k.alias("k"), F.lit(0).alias("t"), F.lit(0).alias("e"), none.alias("et"), none.alias("ei"),
        F.lit(-1).alias("pp"), F.lit(0).alias("pt"), none.alias("pet"), no.alias("nav"), no.alias("ad"), no.alias("inpic"), none.alias("pic"),
        none.alias("vid"), no.alias("lead"), none.alias("alt"))


def _text_of(tok: Column) -> Column:
    name = token_name(tok)
    body = raw_body(tok)
    return F.when(
        tok.startswith("<") & (tok != "<"),
        F.when(name.isin("title", "textarea"), decode_entities(body)).otherwise(body),
    ).otherwise(decode_entities(tok))


def _is_text(tok: Column) -> Column:
    return token_kind(tok, token_name(tok)).isin(TEXT, RAW)


def _meta_values(toks: Column) -> Column:
    """For each known property: the content found by property first, and by name first."""
    metas = F.transform(
        F.filter(toks, lambda t: t.rlike(r"(?i)^<meta[\s/]")),
        lambda t: let(attr_tokens(t), lambda p: F.struct(attr_names(p).alias("n"), attr_values(p).alias("v"))),
    )

    def value(m: Column, name: str) -> Column:
        return F.get(m.v, F.array_position(m.n, name).cast("int") - 1)

    def content(ms: Column, key: str, prop: str) -> Column:
        return value(F.get(F.filter(ms, lambda m: value(m, key) == prop), 0), "content")

    def rows(ms: Column) -> Column:
        out = []
        for prop in META_PROPS:
            by_prop, by_name = content(ms, "property", prop), content(ms, "name", prop)
            out.append(F.struct(F.lit(prop).alias("prop"), F.coalesce(by_prop, by_name).alias("by_property"),
                                F.coalesce(by_name, by_prop).alias("by_name")))
        return F.array(*out)

    return let(metas, lambda ms: F.when(F.size(ms) > 0, rows(ms)))


def elements(pages: DataFrame, text: bool = False, outer: list[str] | None = None) -> DataFrame:
    """One row per element that can carry media, a link or an embed, with its ancestry. Narrow.

    Columns: page_id, page_url, pos, name, tag (start tag, or the whole raw-text element), names, values,
    in_picture (direct child), picture / video (token index of the enclosing one), lead_image (first image of
    its picture), video_tag; with ``text=True`` also nav, near_ad, own_text, parent_text and alt_tag.
    One extra row per page, named ``#meta``, carries the page's meta values. A table made with text serves media and embeds too.
    With ``outer``, those columns of the pages stay, and a page without any element keeps one row, whose pos is null.
    """
    kept = outer or []
    base = pages.select("page_id", F.col("url").alias("page_url"), *kept, tokens_of(F.col("html")).alias("toks"))
    for step in _steps(text):
        base = base.withColumns(step)
    out = base.select("page_id", "page_url", *kept, F.inline_outer("rows"))
    return with_attributes(out if outer is not None else out.filter(F.col("pos").isNotNull()), "tag")


@built_once
def _steps(text: bool) -> list[dict[str, Column]]:
    """The row-local columns of ``elements`` in the order they depend on each other."""
    first = {"cls": _classified(F.col("toks"), text)}
    if text:
        dom = intervals(F.col("cls"), OPEN, CLOSE)
    else:
        # without a picture or video there is no ancestry to know: nothing is matched
        nested = F.exists("cls", lambda x: x.n.isin("picture", "video"))
        flat = F.struct(F.lit(0).alias("t"), F.transform(F.filter("cls", lambda x: x.w), _rootless).alias("out")).cast(OUT)
        dom = F.when(nested, intervals(F.when(nested, F.col("cls")), OPEN, CLOSE)).otherwise(flat)
    toks = F.col("toks")
    second = {"dom": dom}
    if text:
        second["body_t"] = _implied_body(toks)
        second["words"] = F.regexp_extract_all(_page_text(F.col("cls")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    second["metas"] = _meta_values(toks)

    def joined(start: Column, stop: Column) -> Column:
        """The head of a stretch of the page's text."""
        def piece(i: Column) -> Column:
            return F.coalesce(F.get("words", i), F.lit(""))

        at = F.floor(start / PIECE).cast("int")
        head = F.substring(F.concat(piece(at), piece(at + 1)), start % PIECE + 1, F.least(stop - start, F.lit(CONTEXT_CHARS + 1)))
        return F.substring(F.trim(head), 1, CONTEXT_CHARS)

    def row(e: Column) -> Column:
        fields = [
            e.i.alias("pos"), e.n.alias("name"), F.get(toks, e.i).alias("tag"), e.inpic.alias("in_picture"),
            e.pic.alias("picture"), e.lead.alias("lead_image"), F.get(toks, e.vid).alias("video_tag"),
            e.vid.alias("video"),
            F.lit(None).cast("array<struct<prop:string,by_property:string,by_name:string>>").alias("meta"),
        ]
        if text:
            link = (e.n.isin("a", "button")) | F.get(toks, e.i).rlike(
                r"(?i)[\s\"'/](?:role|onclick|formaction|data-href|data-url|data-link|data-link-url|data-target-url"
                r"|data-settings)\s*=")
            total = F.col("dom.t")
            own_stop = F.when(e.k == VOID, e.t).when(e.k == RAW, e.e).otherwise(F.coalesce(e.et, total))
            own = F.when(link, joined(e.t, own_stop))
            root = F.col("body_t").isNotNull() & ((e.pp < 0) | F.get(toks, e.pp).rlike(r"(?i)^<html[\s>]"))
            parent = F.when(link, F.when(root, joined(F.col("body_t"), total)).when(e.pp < 0, F.lit("")).otherwise(
                joined(e.pt, F.coalesce(e.pet, total))))
            alt = F.when(link & (own == ""), F.get(toks, e.alt))
            fields += [e.nav.alias("nav"), e.ad.alias("near_ad"), own.alias("own_text"), parent.alias("parent_text"), alt.alias("alt_tag")]
        return F.struct(*fields)

    kinds = {"pos": "int", "name": "string", "tag": "string", "in_picture": "boolean", "picture": "int", "lead_image": "boolean",
             "video_tag": "string", "video": "int", "meta": "array<struct<prop:string,by_property:string,by_name:string>>"}
    if text:
        kinds |= {"nav": "boolean", "near_ad": "boolean", "own_text": "string", "parent_text": "string", "alt_tag": "string"}
    known = {"pos": F.lit(-1), "name": F.lit("#meta"), "tag": F.lit(""), "meta": F.col("metas")}
    of_page = F.struct(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])
    rows = F.transform(F.col("dom.out"), row)
    rows = F.when(F.col("metas").isNotNull(), F.array_append(rows, of_page)).otherwise(rows)
    return [first, second, {"rows": rows}]


# ---- page facts ----------------------------------------------------------------------------------


def _title(toks: Column) -> Column:
    first = F.get(F.filter(toks, lambda t: t.rlike(r"(?i)^<title[\s>]")), 0)
    return F.nullif(F.substring(trim_space(decode_entities(raw_body(first))), 1, 200), F.lit(""))


def _body_text(toks: Column) -> Column:
    def start(pattern: str) -> Column:
        return F.array_position(F.transform(toks, lambda t: t.rlike(pattern)), True)

    at = F.coalesce(F.nullif(start(r"(?i)^<body[\s>/]"), F.lit(0)), start(r"(?i)^</head")).cast("int")
    inside = F.slice(toks, at + 1, F.greatest(F.size(toks) - at, F.lit(0)))
    return trim_space(F.array_join(F.transform(F.filter(inside, _is_text), _text_of), ""))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title and trimmed body-text length of each page. Narrow."""
    base = pages.select("page_id", "url", tokens_of(F.col("html")).alias("toks"))
    return base.select(
        "page_id", "url", _title(F.col("toks")).alias("title"),
        utf16_length(_body_text(F.col("toks"))).cast("bigint").alias("text_length"))


__all__ = ["tag_table", "with_attributes", "with_inside", "elements", "page_facts"]
