"""A page's elements as intervals of its tokens, matched in one linear pass.

Every start tag gets the token that ends it; ancestry is containment. What an element asks of its ancestors (a navigation region, an
ad-like one within eight, the enclosing picture or video) is handed down when its interval opens, so no stack of open elements is
ever copied or searched: an end tag whose name is not open is known from a count by name, and every interval ends once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.fixed import CLOSES_P

#: Tokens matched at once; a batch of many pages is taken in stretches of whole pages, so memory does not grow with the pages of a batch.
STRETCH = 1 << 16

OUT = (
    "struct<t:int,out:array<struct<i:int,n:string,k:int,t:int,e:int,et:int,ei:int,pp:int,pt:int,pet:int,nav:boolean,ad:boolean,inpic:boolean,"
    "pic:int,vid:int,lead:boolean,alt:int>>>")


def _matcher(opening: int, closing: int, closes_p: list[str], stretch: int = STRETCH):
    """The pass over a batch of pages. Nested whole, so that executors need no package of ours."""

    fields = [(n, "string" if n == "n" else "bool_" if n in ("nav", "ad", "inpic", "lead") else "int32") for n in (
        "i", "n", "k", "t", "e", "et", "ei", "pp", "pt", "pet", "nav", "ad", "inpic", "pic", "vid", "lead", "alt")]

    def run(column):
        import numpy as np
        import pyarrow as pa

        offsets = column.offsets.to_numpy()
        cuts, lo = [], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + stretch, "right")) - 1)
            cuts.append((lo, hi - lo))
            lo = hi
        return pa.concat_arrays([match(column.slice(*cut)) for cut in cuts or [(0, 0)]])

    def match(column):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        ends_p = frozenset(closes_p)
        closed_by = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
                     "option": {"option", "optgroup"}, "p": ends_p}
        regions = frozenset(("nav", "header", "footer"))

        def flat(field):
            return np.asarray(tokens.field(field).to_numpy(zero_copy_only=False))

        offsets = column.offsets.to_numpy()
        base = int(offsets[0])
        tokens = column.values.slice(base, int(offsets[-1]) - base)
        bounds = (offsets - base).tolist()
        names = tokens.field("n").to_pylist()
        kind, index, length = flat("k"), flat("i"), flat("len").astype(np.int64)
        wanted, ad, first, last, alt = (flat(f).astype(bool) for f in ("w", "ad", "sp", "es", "al"))
        # characters of the page's text before each token: a first space does not count after a token that ended with one
        carries = np.flatnonzero(length > 0)
        page = np.searchsorted(offsets - base, np.arange(len(kind)), "right")
        if len(carries):
            after_space = np.zeros(len(carries), bool)
            after_space[1:] = last[carries[:-1]] & (page[carries[1:]] == page[carries[:-1]])
            length[carries] -= after_space & first[carries]
        upto = np.concatenate([[0], np.cumsum(length)])
        active = np.flatnonzero((kind == opening) | (kind == closing) | wanted)
        cuts = np.searchsorted(active, bounds).tolist()
        active, kinds, wants, ads, positions, before = active.tolist(), kind.tolist(), wanted.tolist(), ad.tolist(), index.tolist(), upto.tolist()
        alts = np.flatnonzero(alt).tolist()
        end_at = {}
        rows, sizes, totals = [], [0], []
        for number, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            start = before[lo]
            top, open_by_name, lead = None, {}, None
            mine = []
            # an open element: (token, name, parent, depth, in region, depth of the nearest ad-like one, picture, video)
            for at in active[cuts[number]:cuts[number + 1]]:
                name, k = names[at], kinds[at]
                if k == closing:
                    if open_by_name.get(name):
                        while True:
                            end_at[top[0]] = at
                            open_by_name[top[1]] -= 1
                            found = top[1] == name
                            top = top[2]
                            if found:
                                break
                    continue
                if k == opening and top is not None and name in closed_by.get(top[1], ()):
                    end_at[top[0]] = at
                    open_by_name[top[1]] -= 1
                    top = top[2]
                if wants[at]:
                    image = name == "img" and top is not None and top[6] is not None
                    mine.append((at, top, image and lead != top[6]))
                if name == "img" and top is not None and top[6] is not None:
                    lead = top[6]
                if k == opening:
                    depth = 1 if top is None else top[3] + 1
                    i = positions[at]
                    top = (at, name, top, depth, name in regions or top is not None and top[4],
                           depth if ads[at] else 0 if top is None else top[5],
                           i if name == "picture" else None if top is None else top[6], i if name == "video" else None if top is None else top[7])
                    open_by_name[name] = open_by_name.get(name, 0) + 1
            for at, up, is_lead in mine:
                end = end_at.get(at)
                outer = None if up is None else end_at.get(up[0])
                inner = alts[bisect_right(alts, at)] if kinds[at] == opening and alts and at < alts[-1] else hi
                rows.append((
                    positions[at], names[at], kinds[at], before[at] - start, before[at + 1] - start,
                    None if end is None else before[end] - start, None if end is None else positions[end],
                    -1 if up is None else positions[up[0]], 0 if up is None else before[up[0]] - start, None if outer is None else before[outer] - start,
                    up is not None and up[4], up is not None and up[5] > 0 and up[5] >= up[3] - 7, up is not None and up[1] == "picture",
                    None if up is None else up[6], None if up is None else up[7], is_lead,
                    positions[inner] if inner < (hi if end is None else end) else None))
            sizes.append(len(rows))
            totals.append(before[hi] - start)
        columns = list(zip(*rows)) or [()] * len(fields)
        kept = pa.StructArray.from_arrays([pa.array(c, getattr(pa, kind)()) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])
        return pa.StructArray.from_arrays([pa.array(totals, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), kept)], names=["t", "out"])

    return run


def intervals(classified: Column, opening: int, closing: int) -> Column:
    """Total text length and the wanted elements of a page, from its classified tokens (see ``tokens``).

    Only names, kinds and lengths cross to Python; a null page gives no elements.
    """
    none = F.array().cast("array<struct<i:int,n:string,k:int,w:boolean,ad:boolean,al:boolean,x:string>>")
    slim = F.transform(F.coalesce(classified, none), lambda x: F.struct(
        x.i.alias("i"), x.n.alias("n"), x.k.alias("k"), x.w.alias("w"), x.ad.alias("ad"), x.al.alias("al"),
        F.coalesce(F.length(x.x), F.lit(0)).alias("len"), F.coalesce(x.x.startswith(" "), F.lit(False)).alias("sp"),
        F.coalesce(F.endswith(x.x, F.lit(" ")), F.lit(False)).alias("es")))
    return F.arrow_udf(_matcher(opening, closing, list(CLOSES_P)), OUT)(slim)
