"""Operators over HTML, on literal pages."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from weblode.config import INTERACTIVE
from weblode.functions.urls import url_extension
from weblode.operators.embeds import discover_embeds
from weblode.operators.links import discover_links, possible_spa
from weblode.operators.media import extract_media, page_links, player_videos
from weblode.operators.tokens import elements, page_facts, tag_table, with_inside

BASE = "https://site.example"


def assets(df):
    return [(r.url.replace(BASE, ""), r.source_tag, r.extension, r.file_name) for r in df.orderBy("page_id", "ord").collect()]


def test_media_sources(page):
    html = [
        '<img src="a.jpg" data-src="b.png">',
        '<img srcset="a.webp 1x, b.webp 2x">',
        '<picture><source type="image/webp" srcset="/x"><img src="c.jpg"><img src="late.jpg"></picture>',
        '<img src="/x"><picture><source type="image/webp" srcset="/x"></picture>',
        '<a href="/d.pdf">d</a><a href="/e.mov#t">e</a>',
        '<meta property="og:video" content="/v"><meta name="og:image" content="/i.png"><meta property="og:video" content="/w">',
        '<div style="background: url( \'/bg.gif\' )"></div><style>.a{background-image:url("/s.png")}</style>',
        '<noscript><img src="/n.gif"></noscript><iframe src="//www.youtube.com/embed/Q1"></iframe>',
        '<video data-src="/v.mp4" poster="/p.jpg"><source src="/s" type="video/webm"></video>',
        '<embed src="/e" type="video/mp4"><object data="/o.ogg"></object><p data-hls="/l.m3u8" data-mp4="http://z.example/q">',
        '<script type="application/ld+json">[{"@graph":[{"@type":["VideoObject"],"contentUrl":"https://m.example/1",'
        '"embedUrl":"https://vimeo.com/5","thumbnailUrl":"https://m.example/1.png"}]}]</script>',
        '<script>x={"video_url":"https://m.example/k.flv"};jw({file:\'/f.mp4\'});load({src:"/g.m3u8?t"})</script>',
    ]
    got = extract_media(page(*html)).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "url", "source_tag", "file_name"))).alias("a")).collect()
    by = {r.page_id: [(x.url.replace(BASE, ""), x.source_tag, x.file_name) for x in r.a] for r in got}
    assert by[0] == [("/p/a.jpg", "img[src]", "a.jpg"), ("/p/b.png", "img[data-src]", "b.png")]
    assert by[1] == [("/p/a.webp", "img[srcset]", "a.webp"), ("/p/b.webp", "img[srcset]", "b.webp")]
    assert by[2] == [("/x", "picture source[srcset]", "media-1.webp"), ("/p/c.jpg", "picture img[src]", "c.jpg")]
    assert 3 not in by  # first reference wins before its extension is looked at
    assert by[4] == [("/e.mov#t", "a[href]", "e.mov")]
    assert by[5] == [("/v", "meta[og:video]", "media-1.mp4"), ("/i.png", "meta[og:image]", "i.png")]
    assert by[6] == [("/bg.gif", "css[background-image]", "bg.gif"), ("/s.png", "css[background-image]", "s.png")]
    assert by[7] == [("/n.gif", "noscript img[src]", "n.gif"),
                     ("https://img.youtube.com/vi/Q1/maxresdefault.jpg", "iframe[src]", "maxresdefault.jpg")]
    assert by[8] == [("/v.mp4", "video[data-src]", "v.mp4"), ("/p.jpg", "video[poster]", "p.jpg"), ("/s", "source[src]", "media-3.webm")]
    assert by[9] == [("/e", "embed[src]", "media-1.mp4"), ("/o.ogg", "object[data]", "o.ogg"), ("/l.m3u8", "[data-hls]", "l.m3u8")]
    assert by[10] == [("https://m.example/1", "json-ld[contentUrl]", "media-1.mp4"),
                      ("https://m.example/1.png", "json-ld[thumbnailUrl]", "1.png")]
    assert by[11] == [("https://m.example/k.flv", "script", "k.flv"), ("/f.mp4", "script[jwplayer]", "f.mp4"),
                      ("/g.m3u8?t", "script[player]", "g.m3u8")]


def test_assets_are_bounded_only_on_request(page):
    many = "".join(f'<img src="/{i}.jpg">' for i in range(230)) + f"<script>{'x' * 600_000} file:'/late.mp4'</script>"
    assert extract_media(page(many)).count() == 231
    got = extract_media(page(many), limits=INTERACTIVE)
    assert got.count() == 200 and got.agg(F.max("ord")).first()[0] == 200


def test_json_ld_nested_deeply(page):
    def nest(levels):
        node = '{"@type":"VideoObject","contentUrl":"https://m.example/deep.mp4"}'
        for i in range(levels):
            node = f"[{node}]" if i % 2 else f'{{"@graph":[{node}]}}'
        return f'<script type="application/ld+json">{node}</script>'

    assert extract_media(page(*[nest(n) for n in (0, 1, 4, 5, 9, 30)])).count() == 6


def test_broken_markup(page):
    """Nothing is read twice, nothing fails: unclosed openers take the rest of the page, bad references become U+FFFD."""
    pages = page(
        '<a href="/a&#9999999;b&#xD800;&#0;&#128;&comma;&ampc">x</a>', '<a href="/ok">x</a><!-- <a href="/no">y</a>',
        '<a href="/ok">x</a><script>var a = "<a href=/no>"', '<a href="/ok">x</a><a href="/no>z</a>', '<title>t</title ><a href="/ok">x</a>')
    got = {}
    for r in page_links(pages).collect():
        got.setdefault(r.page_id, []).append(r.url.replace(BASE, ""))
    assert got == {0: ["/a%EF%BF%BDb%EF%BF%BD%EF%BF%BD%E2%82%AC,&ampc"], 1: ["/ok"], 2: ["/ok"], 3: ["/ok"], 4: ["/ok"]}
    for part in ("<!--", '<a "', "<script>", "<p x='"):
        assert tag_table(page(part * 200_000)).count() <= 1


def test_extension_needs_a_path(spark):
    urls = ["https://cdn.example.com", "https://cdn.example.com/", "https://cdn.example.com/a.mp4?x", "https://cdn.example.com?a.mp4"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_extension(F.col("u")).alias("e")).collect()
    assert [r.e for r in got] == [None, None, "mp4", None]


def test_player_scripts(spark, page):
    html = ('<script src="//scripts.converteai.net/aa-1/players/bb-2/v4/player.js"></script>'
            '<iframe src="https://scripts.converteai.net/aa-1/players/cc-3/embed.html"></iframe>'
            '<script>smartplayer("https://cdn.converteai.net/aa-1/ab-test/dd-4/player.js")</script>')
    scripts = spark.createDataFrame([
        ("https://scripts.converteai.net/aa-1/players/bb-2/v4/player.js", "text/javascript",
         'c={cdn:"cdn.example",oid:"aa-1",video:{x:1,id:"f0",poster:"https://i.example/p.jpg"}}'),
        ("https://scripts.converteai.net/aa-1/players/cc-3/player.js", "text/plain", 'mediaUrl="https://old.example/v.mp4";hls_url:"https://old.example/v.js"'),
        ("https://cdn.converteai.net/aa-1/ab-test/dd-4/player.js", "image/png", 'mediaUrl="https://no.example/v.mp4"'),
    ], "src string, content_type string, body string")
    rows = player_videos(page(html), scripts).orderBy("ref_order").collect()
    assert [(r.player_id, r.video_url, r.thumbnail) for r in rows] == [
        ("bb-2", "https://cdn.example/aa-1/f0/main.m3u8", "https://i.example/p.jpg"), ("cc-3", "https://old.example/v.mp4", None)]
    tags = [r.source_tag for r in extract_media(page(html), scripts).orderBy("ord").collect()]
    assert tags == ["vturb[bb-2]", "vturb[cc-3]"]


def test_links(page):
    html = ('<body><nav><a href="/n">Nav</a></nav><div class="x"><a href="/watchlist/" title="t">  Watch   it </a><a href="/watchlist">Acessar watch</a>'
            '<a href="/legal">Privacy</a><a href="https://t.me/a">chat</a><a href="/s">share us</a><a href="/login">in</a><a href="/f.css">f</a></div>'
            '<div id="banner-ad"><p><a href="/ad">ad</a></p></div>'
            '<p><button data-url="/b">Open</button></p><p><i role="button" formaction="/rb">go</i></p><p><b data-link="/dl">z</b></p>'
            '<p onclick="window.open( \'/w\' )">w</p><p data-settings=\'{"a":[{"youtube_url":"https://youtu.be/v1"}],"n":{"link":"/s5"},"q":"/no"}\'>s</p>'
            '<p><a href="http://sub.site.example/z"><img alt="An image" src="i.png"></a> <a href="https://other.example/video/12">o</a></p></body>')
    rows = {r.url.replace(BASE, ""): r for r in discover_links(page(html)).collect()}
    assert set(rows) == {"/n", "/watchlist", "/ad", "/b", "/rb", "/dl", "/w", "https://youtu.be/v1", "/s5", "http://sub.site.example/z",
                         "https://other.example/video/12"}
    assert rows["/n"].is_navigation and rows["/n"].priority == 5
    assert rows["/watchlist"].anchor_text == "Acessar watch" and rows["/watchlist"].priority == 1
    assert rows["/ad"].is_navigation
    assert (rows["/b"].source, rows["/b"].interactive, rows["/b"].priority) == ("button", True, 2)
    assert rows["/rb"].source == "button" and rows["/dl"].source == "data_attr" and rows["/dl"].priority == 3
    assert rows["/w"].discovery_reason == "onclick-navigation"
    assert rows["https://youtu.be/v1"].discovery_reason == "player-config" and rows["/s5"].discovery_reason == "data-settings-link"
    assert rows["http://sub.site.example/z"].category == "subdomain" and rows["http://sub.site.example/z"].anchor_text == "An image"
    assert rows["https://other.example/video/12"].category == "video_platform"


def test_embeds(page):
    html = ('<iframe data-lazy-src="https://youtu.be/y1"></iframe><iframe src="/clip.mp4?x"></iframe>'
            '<video poster="/p.jpg"><source src="/a"><source data-src="/b.webm"></video>'
            '<object data="https://vimeo.com/9"></object>'
            '<div class="elementor-widget-video" data-settings="{&quot;vimeo_url&quot;:&quot;https://vimeo.com/10&quot;}"></div>'
            '<lite-youtube videoid="L1"></lite-youtube><amp-vimeo data-videoid="77"></amp-vimeo><p data-video-id="D1"></p>'
            '<meta name="twitter:player" content="https://youtu.be/T1">'
            '<script>window.__NUXT__={u:"https://www.youtube.com/watch?v=N1;"};f("https://z.example/in.mp4")</script>')
    rows = discover_embeds(page(html)).orderBy("ord").collect()
    got = [(r.canonical_url.replace(BASE, ""), r.platform, r.confidence, r.source, r.discovery_reason) for r in rows]
    assert got == [
        ("https://www.youtube.com/watch?v=y1", "youtube", 0.99, "iframe", "iframe-embed"),
        ("/clip.mp4?x", "direct", 0.92, "iframe", "direct-iframe"),
        ("/a", "direct", 0.92, "video_tag", "html5-video-source"), ("/b.webm", "direct", 0.92, "video_tag", "html5-video-source"),
        ("/p.jpg", None, 0.9, "video_tag", "video-poster"),
        ("https://vimeo.com/9", "vimeo", 0.96, "object_tag", "object-embed"),
        ("https://vimeo.com/10", "vimeo", 0.96, "data_attr", "elementor-video-widget"),
        ("https://www.youtube.com/watch?v=L1", "youtube", 0.98, "data_attr", "light-youtube-player"),
        ("https://vimeo.com/77", "vimeo", 0.97, "data_attr", "light-vimeo-player"),
        ("https://www.youtube.com/watch?v=D1", "youtube", 0.98, "data_attr", "youtube-id-attribute"),
        ("https://www.youtube.com/watch?v=T1", "youtube", 0.99, "twitter_meta", "twitter-card"),
        ("https://www.youtube.com/watch?v=N1", "youtube", 0.98, "inline_script", "structured-player-state"),
        ("https://z.example/in.mp4", "direct", 0.92, "inline_script", "inline-direct-video"),
    ]


class Ancestry(HTMLParser):
    """Brute force: for each link whether it sits in a navigation region, and its text."""

    def __init__(self):
        super().__init__()
        self.stack, self.links, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("img", "br", "input", "meta"):
            return
        if tag == "a":
            link = {"href": dict(attrs).get("href"), "nav": any(t in ("nav", "header", "footer") for t in self.stack), "text": ""}
            self.links.append(link)
            self.open.append(link)
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            at = len(self.stack) - 1 - self.stack[::-1].index(tag)
            del self.stack[at:]
        if tag == "a" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for link in self.open:
            link["text"] += data


def test_fold_against_brute_force(spark, page):
    import random

    rng = random.Random(5)

    def tree(depth):
        if depth == 0:
            return rng.choice(["word ", "<br>", "<img src='i.png'>", " x\n "])
        kind = rng.choice(["div", "nav", "section", "header", "ul", "span", "a"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(1, 3)))
        if kind == "a":
            return f"<a href='/l{rng.randint(0, 999)}'>{rng.choice(['', 'go '])}t{rng.randint(0, 99)}</a>"
        return f"<{kind}>{inner}</{kind}>"

    htmls = ["<html><body>" + "".join(tree(5) for _ in range(4)) + "</body></html>" for _ in range(12)]
    want = []
    for i, h in enumerate(htmls):
        parser = Ancestry()
        parser.feed(h)
        want += [(i, x["href"], x["nav"], " ".join(x["text"].split())) for x in parser.links]
    els = elements(page(*htmls), text=True).filter("name = 'a'")
    got = [(r.page_id, r.values[r.names.index("href")], r.nav, r.own_text) for r in els.orderBy("page_id", "pos").collect()]
    assert got == want
    tags = with_inside(tag_table(page(*htmls)), "nav", "header", "footer").filter("name = 'a' AND kind = 'open'")
    assert [r.inside for r in tags.orderBy("page_id", "pos").collect()] == [w[2] for w in want]


def test_page_facts_and_links(page):
    pages = page("<title> A &amp; B </title><body> <script>x</script>hé <p>y</p></body>", "<p>none</p>")
    rows = page_facts(pages).orderBy("page_id").collect()
    assert [(r.title, r.text_length) for r in rows][0] == ("A & B", len("xhé y"))
    pages = page('<a href="/x#1">a</a><a href="/x#2">b</a><a href="mailto:q@x">m</a><a>n</a>')
    assert [r.url for r in page_links(pages).collect()] == [BASE + "/x"]
    assert possible_spa(pages, discover_links(pages)).first().possible_spa


def test_broken_html_survives(page):
    html = '<p>a<p>b<a href="/1">one</b></a><!-- <a href="/no"> --><script>"<a href=/no2>"</script><a href=/2 title="x>y">two</a><a href="/3'
    got = [r.url for r in discover_links(page(html)).orderBy("url").collect()]
    assert got == [BASE + "/1", BASE + "/2"]


def test_implied_body(page):
    """The parent of a top-level link is the body, written or not."""
    pages = page(
        '<a href="/x">go</a> watch live', '<html><head><title>T</title></head><a href="/x">go</a> watch live</html>',
        '<!DOCTYPE html><title>T</title>\n<a href="/x">go</a> watch live', '<html><head><title>T</title></head><body><a href="/x">go</a> watch live')
    got = {r.page_id: (r.context, r.priority, r.discovery_reason) for r in discover_links(pages).collect()}
    assert got == {i: ("go go watch live", 2, "content-hub") for i in range(4)}


def test_pages_are_matched_in_stretches(spark):
    """A batch's pages are matched a stretch at a time; where the stretches end changes nothing."""
    import pyarrow as pa

    from weblode.operators.intervals import _matcher

    def token(i, n, k, w=False):
        return {"i": i, "n": n, "k": k, "w": w, "ad": False, "al": False, "len": i, "sp": False, "es": False}

    page = [token(0, "nav", 1), token(1, "a", 1, True), token(2, "", 0), token(3, "a", 2), token(4, "nav", 2), token(5, "img", 3, True)]
    kind = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.string()), ("k", pa.int32()), *[(b, pa.bool_()) for b in ("w", "ad", "al")], ("len", pa.int32()),
                               *[(b, pa.bool_()) for b in ("sp", "es")]]))
    pages = pa.array([page, [], page[1:], page * 3, []], kind)
    whole = _matcher(1, 2, ["p"], 1 << 30)(pages)
    assert len(whole[0]["out"]) == 2
    for stretch in (1, 5, 7, 12):
        assert _matcher(1, 2, ["p"], stretch)(pages).to_pylist() == whole.to_pylist()
        assert _matcher(1, 2, ["p"], stretch)(pages.slice(1, 3)).to_pylist() == whole.to_pylist()[1:4]
    assert len(_matcher(1, 2, ["p"])(pages.slice(0, 0))) == 0
