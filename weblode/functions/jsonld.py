"""Structured data in pages: video nodes of a JSON-LD block and URL settings of an attribute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(node: Column, key: str) -> Column:
    """A string member; null for any other JSON type."""
    value = F.try_variant_get(node, f"$['{key}']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, f"$['{key}']", "string"))


def video_nodes(text: Column) -> Column:
    """Video objects of a JSON-LD text, in document order, as an array of structs; arrays and graphs nest at will."""
    item = "array<struct<v:variant,done:boolean>>"

    def todo(v: Column) -> Column:
        return F.struct(v.alias("v"), F.lit(False).alias("done"))

    def unfold(items: Column) -> Column:
        def one(it: Column) -> Column:
            elements = F.try_variant_get(it.v, "$", "array<variant>")
            graph = F.try_variant_get(it.v, "$['@graph']", "array<variant>")
            return (
                F.when(it.done, F.array(it))
                .when(elements.isNotNull(), F.transform(elements, todo))
                .otherwise(F.concat(
                    F.coalesce(F.transform(graph, todo), F.array().cast(item)),
                    F.array(F.struct(it.v.alias("v"), F.lit(True).alias("done")))))
            )

        return F.flatten(F.transform(items, one))

    # no array or graph lies deeper than brackets do, so this many steps unfold everything
    depth = F.aggregate(
        F.regexp_extract_all(text, F.lit(r"[\[\]]"), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, b: F.when(b == "[", F.struct((a.now + 1).alias("now"), F.greatest(a.most, a.now + 1).alias("most"))).otherwise(
            F.struct((a.now - 1).alias("now"), a.most.alias("most"))), lambda a: a.most)
    items = F.aggregate(F.sequence(F.lit(0), F.coalesce(depth, F.lit(0))), F.array(todo(F.try_parse_json(text))), lambda a, _: unfold(a))
    nodes = F.transform(F.filter(items, lambda it: it.done), lambda it: F.struct(
        F.lower(F.coalesce(
            _text(it.v, "@type"),
            F.array_join(F.try_variant_get(it.v, "$['@type']", "array<string>"), ","), F.lit(""))).alias("type"),
        _text(it.v, "contentUrl").alias("content_url"), _text(it.v, "embedUrl").alias("embed_url"),
        _text(it.v, "url").alias("url"), _text(it.v, "thumbnailUrl").alias("thumbnail")))
    return F.filter(nodes, lambda n: n.type.isin("videoobject", "video"))


SETTINGS_DEPTH = 5


def settings_urls(text: Column, key_pattern: str) -> Column:
    """String leaves at most five levels deep whose path ends in a URL-like key: array of (path, value).

    Members are visited in document order as far as the parsed form keeps it; arrays by index.
    """
    item = "array<struct<path:string,v:variant,ord:array<int>>>"
    leaf_t = "array<struct<path:string,value:string,ord:array<int>>>"

    def child(path: Column, v: Column, ord_: Column) -> Column:
        return F.struct(path.alias("path"), v.alias("v"), ord_.alias("ord"))

    def children(it: Column) -> Column:
        listed = F.try_variant_get(it.v, "$", "array<variant>")
        members = F.map_entries(F.try_variant_get(it.v, "$", "map<string,variant>"))
        return (
            F.when(listed.isNotNull(), F.transform(listed, lambda v, i: child(
                F.concat(it.path, F.lit("["), i.cast("string"), F.lit("]")), v, F.array_append(it.ord, i))))
            .when(members.isNotNull(), F.transform(members, lambda m, i: child(
                F.when(it.path == "", m.key).otherwise(F.concat(it.path, F.lit("."), m.key)), m.value,
                F.array_append(it.ord, i))))
            .otherwise(F.array().cast(item))
        )

    level = F.array(child(F.lit(""), F.try_parse_json(text), F.array().cast("array<int>")))
    leaves = []
    for depth in range(SETTINGS_DEPTH + 1):
        strings = F.filter(level, lambda it: F.schema_of_variant(it.v) == "STRING")
        leaves.append(F.transform(strings, lambda it: F.struct(
            it.path.alias("path"), F.trim(F.try_variant_get(it.v, "$", "string")).alias("value"),
            it.ord.alias("ord"))).cast(leaf_t))
        if depth < SETTINGS_DEPTH:
            level = F.flatten(F.transform(level, children))
    found = F.filter(F.concat(*leaves), lambda x: (x.value != "") & x.path.rlike(key_pattern))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(
        x.ord.alias("ord"), x.path.alias("path"), x.value.alias("value")))), lambda x: F.struct(
            x.path.alias("path"), x.value.alias("value")))
