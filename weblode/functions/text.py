"""Text expressions: whitespace, entities, word tests, attribute arrays. All Catalyst, no UDF."""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.fixed import C1_CHARACTERS, JS_SPACE

START_TAG_BODY = r"[^>\"']*+(?:(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))[^>\"']*+)*+"
START_TAG = rf"^<[a-zA-Z]{START_TAG_BODY}>"
ATTRIBUTE = (
    r"[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+"
)


def built_once(make):
    """Cache the Column expressions a function builds; they are unbound, so any frame can use them."""
    made: dict = {}

    @functools.wraps(make)
    def get(*args):
        session = SparkSession.getActiveSession()
        key = (session and session.sparkContext.applicationId, args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and later projections then read the values; without it the optimizer copies a long
    expression into every filter above it and computes it again there.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body`` (a one-element transform); used only inside row-local array work."""
    return F.transform(F.array(value), body)[0]


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{JS_SPACE}]+", " ")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit every size limit is stated in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference of any length, as the HTML standard reads it.

    Zero, surrogates and numbers beyond Unicode are the replacement character; 128 to 159 are read as windows-1252.
    """
    short = F.regexp_replace(digits, "^0+", "")
    number = F.conv(F.when((short == "") | (F.length(short) > 7), "0").otherwise(short), base, 10).cast("int")
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    control = F.get(F.array(*[F.lit(ord(c)) for c in C1_CHARACTERS]), number - 128)
    safe = F.when(bad, 0xFFFD).when(number.between(128, 159), control).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Character references: numeric ones and all names of HTML 5, the table coming from the standard library.

    Names that may stand without a semicolon are read so too, in an attribute only where no ``=`` or alphanumeric follows.
    """
    # one foldable call instead of some 2,000 literals: the optimizer turns it into a single map constant
    table = "\x1f".join(f"{name[:-1]}\x1e{value}" for name, value in sorted(html5.items()) if name.endswith(";"))
    names = F.str_to_map(F.lit(table), F.lit("\x1f"), F.lit("\x1e"))
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    short = f"^({bare})" + ("(?![=A-Za-z0-9])" if attribute else "")

    def one(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        legacy = F.regexp_extract(piece, short, 1)
        dec = F.regexp_extract(piece, "^#([0-9]+)", 1)
        hexa = F.regexp_extract(piece, "^#[xX]([0-9A-Fa-f]+)", 1)
        common = F.when(piece.startswith("amp;"), "&").when(piece.startswith("lt;"), "<").when(
            piece.startswith("gt;"), ">").when(piece.startswith("quot;"), '"').when(piece.startswith("apos;"), "'")
        named = F.coalesce(common, F.try_element_at(names, name))
        return (
            F.when(i == 0, piece)
            .when(named.isNotNull(), F.concat(named, F.regexp_replace(piece, "^[A-Za-z0-9]+;", "")))
            .when(legacy != "", F.concat(F.try_element_at(names, legacy), F.substr(piece, F.length(legacy) + 1)))
            .when(dec != "", F.concat(_character(dec, 10), F.regexp_replace(piece, "^#[0-9]+;?", "")))
            .when(hexa != "", F.concat(_character(hexa, 16), F.regexp_replace(piece, "^#[xX][0-9A-Fa-f]+;?", "")))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    return F.when(
        F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")
    ).otherwise(text)


def unescape_settings(text: Column) -> Column:
    """Second entity pass over JSON held in an attribute."""
    for old, new in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def has_word(text: Column, words: list[str]) -> Column:
    """ASCII word-boundary test, case-folded beyond ASCII.

    A boundary is a change between an ASCII word character and anything else, so a term that
    starts (or ends) with a non-ASCII letter needs an ASCII word character next to it.
    """
    word = "[A-Za-z0-9_]"

    def edge(ch: str, before: bool) -> str:
        ascii_word = ch.isascii() and (ch.isalnum() or ch == "_")
        look = "?<" if before else "?"
        return f"({look}{'!' if ascii_word else '='}{word})"

    terms = [f"{edge(w[0], True)}{w.replace('-', chr(92) + '-')}{edge(w[-1], False)}" for w in words]
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{t})" for t in terms)), F.lit(False))


# ---- attributes: parsed once per element into two aligned arrays -----------------------------


def attr_tokens(tag: Column) -> Column:
    """``name[=value]`` strings of a start tag (raw-text elements pass their whole text)."""
    head = F.regexp_extract(tag, START_TAG, 0)
    return F.regexp_extract_all(F.regexp_replace(head, r"^<[^\s/>]+|/?>$", ""), F.lit(ATTRIBUTE), F.lit(0))


def attr_names(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(F.regexp_extract(t, r"^([^\s=]+)", 1)))


def attr_values(tokens: Column) -> Column:
    return F.transform(
        tokens,
        lambda t: decode_entities(
            F.regexp_replace(F.regexp_replace(t, r"^[^\s=]+\s*=?\s*", ""), r"^\"(?s:(.*))\"$|^'(?s:(.*))'$", "$1$2"), attribute=True
        ),
    )


def attr(name: str, names: str = "names", values: str = "values") -> Column:
    """First value of an attribute; null when absent, '' when empty."""
    return F.get(F.col(values), F.array_position(F.col(names), name).cast("int") - 1)


def at_most(size: Column, most: int | None) -> Column:
    """``size <= most`` where a caller has set a bound."""
    return F.lit(True) if most is None else size <= most


def present(value: Column) -> Column:
    """Null for a missing or empty attribute."""
    return F.when(value != "", value)
