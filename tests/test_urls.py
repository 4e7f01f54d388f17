from pyspark.sql import functions as F

from weblode.functions.files import content_disposition, file_name_from_url, nfkc, sanitize_file_name
from weblode.functions.platforms import with_platform
from weblode.functions.text import decode_entities, has_word, utf16_length
from weblode.functions.urls import canonical_url, is_private_host, public_url_error, with_resolved

RESOLVE = [
    ("a.jpg", "https://site.example/p/", "https://site.example/p/a.jpg"),
    ("../x/./y/..", "https://site.example/p/q?z=1#k", "https://site.example/x/"),
    ("//h.com:443/a b?q='x y'#é", "https://site.example/p/", "https://h.com/a%20b?q=%27x%20y%27#%C3%A9"),
    ("/für", "http://A.example/x", "http://a.example/f%C3%BCr"),
    ("?k=1", "https://a.b/c/d?x#y", "https://a.b/c/d?k=1"),
    ("#t", "https://a.b/c/d?x#y", "https://a.b/c/d?x#t"),
    ("", "https://a.b/c/d?x#y", "https://a.b/c/d?x"),
    ("mailto:x@y", "https://a.b/", "mailto:x@y"),
    ("HTTP://Exa.com", "https://a.b/", "http://exa.com/"),
    ("http:foo", "http://a.b/c/d", "http://a.b/c/foo"),
    ("http://a b/", "http://a.b", None),
    ("http://", "http://a.b", None),
    ("\\\\h\\p", "https://z.z", "https://h/p"),
    ("  /pad\n ", "https://z.z/q", "https://z.z/pad"),
    ("%2e%2e/x", "https://z.z/a/b/c", "https://z.z/a/x"),
    ("http://[::1]:90/x", "https://z.z", "http://[::1]:90/x"),
]


def test_resolution(spark):
    df = spark.createDataFrame(RESOLVE, "href string, base string, want string")
    for r in with_resolved(df, "href", "base", "got").collect():
        assert r.got == r.want, r


def test_crawl_key(spark):
    cases = [
        ("http://a.com/x/?utm_source=f&b=1#t", "https://a.com/x?b=1"), ("https://a.com/?a=b%20c&ref=x", "https://a.com/?a=b+c"),
        ("https://a.com/p?k", "https://a.com/p?k="), ("https://a.com/?utm_source=x", "https://a.com/"),
        ("http://a.com:443/x", "https://a.com/x"), ("https://a.com/x//", "https://a.com/x/"),
    ]
    df = spark.createDataFrame(cases, "u string, want string").withColumn("got", canonical_url(F.col("u")))
    assert [r.got for r in df.collect()] == [w for _, w in cases]


def test_private_hosts(spark):
    private = ["localhost", "127.0.0.1", "10.9.9.9", "172.16.0.1", "172.31.0.1", "192.168.1.1", "169.254.1.1", "0.0.0.0",
               "100.64.0.1", "100.127.1.1", "::", "::1", "[::1]", "fd00::1", "fe80::1", "::ffff:10.0.0.1", "::ffff:7f00:1",
               "::ffff:c0a8:101", ""]
    public = ["example.com", "172.32.0.1", "100.128.0.1", "11.0.0.1", "8.8.8.8", "2001:db8::1", "mylocalhost"]
    df = spark.createDataFrame([(h,) for h in private + public], "h string").withColumn("p", is_private_host(F.col("h")))
    assert [r.p for r in df.collect()] == [True] * len(private) + [False] * len(public)


def test_public_url_error_length(spark):
    df = spark.createDataFrame([("https://a.example/" + "x" * 2040,)], "u string")
    assert df.select(public_url_error(F.col("u"), F.col("u")).alias("e")).first().e == "too_long"


def test_names(spark):
    cases = [("a/b:c?.mp4", "a_b_c_.mp4"), ("  ..x..  ", "_x_"), ("", "fb"), ("a\tb\x01c", "abc"), ("ｆｕｌｌ.jpg", "full.jpg"),
             ("y" * 300 + ".png", "y" * 251 + ".png")]
    df = spark.createDataFrame(cases, "n string, want string").withColumn("got", sanitize_file_name(F.col("n"), F.lit("fb")))
    assert [r.got for r in df.collect()] == [w for _, w in cases]
    urls = spark.createDataFrame([("https://a.b/c/d%20e.jpg?x",), ("https://a.b/c/d",), ("https://a.b/x%zz.jpg",)], "u string")
    assert [r[0] for r in urls.select(file_name_from_url(F.col("u"), F.lit(3))).collect()] == ["d e.jpg", "media-3.bin", "x%zz.jpg"]
    got = spark.createDataFrame([("é 1.jpg",)], "n string").select(content_disposition(F.col("n"))).first()[0]
    assert got == "attachment; filename=\"_ 1.jpg\"; filename*=UTF-8''%C3%A9%201.jpg"
    assert spark.createDataFrame([("é",)], "n string").select(nfkc("n")).first()[0] == "é"


def test_text(spark):
    df = spark.createDataFrame([("a &amp;&amp; &copy; &#x1F600; &#233; &bogus; &",)], "t string")
    row = df.select(decode_entities(F.col("t")).alias("d"), utf16_length(decode_entities(F.col("t"))).alias("n")).first()
    assert row.d == "a && © 😀 é &bogus; &" and row.n == len(row.d) + 1
    words = [("see VÍDEO now", False), ("see x vídeo", True), ("play", True), ("xplay", False), ("a配信b", True), ("配信", False)]
    df = spark.createDataFrame(words[1:], "t string, want boolean").withColumn("got", has_word(F.col("t"), ["vídeo", "play", "配信"]))
    assert all(r.got == r.want for r in df.collect())


PLATFORMS = [
    ("https://youtu.be/abc", "youtube", "abc", "video", 0.99), ("https://www.youtube.com/shorts/s1", "youtube", "s1", "short", 0.98),
    ("https://youtube.com/watch?list=3&v=q", "youtube", "q", "video", 0.98), ("https://youtube.com/@me", "youtube", "@me", "channel", 0.85),
    ("https://www.nicovideo.jp/watch/sm9", "holodex", "sm9", "video", 0.96), ("https://any.example/p/Ab1", "instagram", "Ab1", "video", 0.92),
    ("https://bilibili.com/video/123", "tiktok", "123", "video", 0.94), ("https://vimeo.com/77", "vimeo", "77", "video", 0.96),
    ("https://scripts.converteai.net/a/players/b/v4/player.js", "vturb", "b", "video", 0.9), ("https://youtu.be/", None, None, None, None),
    ("/relative/watch/x", None, None, None, None),
]


def test_platforms(spark):
    df = spark.createDataFrame([(u,) for u, *_ in PLATFORMS], "u string")
    got = [(r.u, r.platform, r.video_id, r.kind, r.confidence) for r in with_platform(df, "u", "i").select("u", "i.*").collect()]
    assert got == PLATFORMS
    strict = {r.u: r.platform for r in with_platform(df, "u", "i", "strict").select("u", "i.platform").collect()}
    assert strict["https://www.nicovideo.jp/watch/sm9"] == "niconico" and strict["https://any.example/p/Ab1"] is None


def test_status_canonical_keeps_double_slash(spark):
    df = spark.createDataFrame([("https://x.com/u/status/12/",)], "u string")
    assert with_platform(df, "u", "i").select("i.canonical_url").first()[0] == "https://x.com//u/status/12"


def test_long_names_are_cleaned_once(spark):
    """A name may be a whole text: the branches that cut and encode it read the cleaned text, they do not clean it again."""
    for made in (sanitize_file_name(F.col("t"), F.lit("download")), content_disposition(F.col("t"))):
        df = spark.createDataFrame([("a/b " * 90 + "c.mp4",), ("..",), ("é" * 300,), (None,)], "t string").select(made.alias("n"))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 1
    names = spark.createDataFrame([("a/b " * 90 + "c.mp4",), ("..",), ("é" * 300,), ("x." + "y" * 300,), (None,)], "t string").select(
        sanitize_file_name(F.col("t"), F.lit("download"))).collect()
    assert [r[0] for r in names] == [("a_b " * 90)[:251] + ".mp4", "_", "é" * 255, "x." + "y" * 300, None]
