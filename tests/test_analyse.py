"""Admission and extraction in one pass."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from weblode.operators.analyse import analyse_pages
from weblode.operators.tokens import elements

LOG = "page_id bigint, url string, status int, content_type string, content_length bigint, body string, error string"
U = "https://s.example/"


def test_refused_pages_and_public_assets(spark):
    html = '<img src="/a.jpg"><img src="http://192.168.0.1/b.png"><img src="http://intranet/c.png">'
    log = [(1, U, 200, "text/html", None, html, None), (2, U, 404, "text/html", None, html, None), (3, U, 200, "image/png", None, html, None),
           (4, U, 200, "text/html", 99_000_000, html, None), (5, U, 200, "text/html", None, "", None), (6, U, None, None, None, None, "down"),
           (7, U, 200, "application/xhtml+xml", None, "no markup", None)]
    seen = Observation()
    assets, pages = analyse_pages(spark.createDataFrame(log, LOG), seen=seen)
    assert [(r.page_id, r.url, r.is_public) for r in assets.orderBy("page_id", "ord").collect()] == [
        (1, U + "a.jpg", True), (1, "http://192.168.0.1/b.png", False), (1, "http://intranet/c.png", False)]
    assert sorted((r.page_id, r.error_code, r.total_found, r.public_found) for r in pages.collect()) == [
        (1, None, 3, 1), (2, "FETCH_FAILED", 0, 0), (3, "NOT_HTML", 0, 0), (4, "HTML_TOO_LARGE", 0, 0), (5, "FETCH_FAILED", 0, 0), (6, "FETCH_FAILED", 0, 0), (7, None, 0, 0)]
    assert seen.get == {"pages": 7, "admitted": 2, "FETCH_FAILED": 3, "NOT_HTML": 1, "HTML_TOO_LARGE": 1}
    assert all(df.limit(0).count() == 0 for df in analyse_pages(spark.createDataFrame([], LOG)))


def test_deep_nesting_is_linear_and_right(spark):
    """Intervals of 20,000 nested elements, end tags that end nothing, and elements that nothing ends."""
    n = 20_000
    html = "<nav>" + "<div>" * n + "<picture><img src='a.jpg'></picture><a href='/x'>go</a>" + "</span></div>" * n + "</nav><a href='/y'>out</a><a href='/z'>"
    df = spark.createDataFrame([(1, U, html), (2, U, None), (3, U, "")], "page_id long, url string, html string")
    rows = elements(df, text=True).orderBy("pos").collect()
    links = [(r["values"][0], r.nav, r.own_text) for r in rows if r.name == "a"]
    assert links == [("/x", True, "go"), ("/y", False, "out"), ("/z", False, "")]
    assert [(r.in_picture, r.lead_image) for r in rows if r.name == "img"] == [(True, True)]
    assert elements(df).filter(F.col("picture").isNotNull()).count() == 1


def test_a_replayed_batch_leaves_equal_files(spark, tmp_path):
    from weblode.operators.media import extract_media
    from weblode.sources.pages import follow_assets, read_assets, stream_pages, write_assets

    pages = spark.createDataFrame([(i, U, f'<img src="/{i}.jpg"><video src="/{i}.mp4"></video>') for i in range(6)], "page_id long, url string, html string")
    for k in range(3):
        pages.filter(f"page_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda cp: follow_assets(stream_pages(spark, str(tmp_path / "in"), 1), extract_media, str(tmp_path / "out"), str(tmp_path / cp)).awaitTermination()
    rows = lambda: sorted((r.page_id, r.url, r.type, r.extension, r.file_name) for r in read_assets(spark, str(tmp_path / "out")).collect())
    run("cp")
    first = rows()
    direct = extract_media(pages)
    assert first == sorted((r.page_id, r.url, r.type, r.extension, r.file_name) for r in direct.collect()) and len(first) == 12
    run("cp")  # nothing new
    assert rows() == first
    run("lost")  # the checkpoint was lost: every batch is run again and replaces its own folder
    assert rows() == first
    write_assets(direct, str(tmp_path / "table"))
    back = read_assets(spark, str(tmp_path / "table"))
    assert sorted(map(tuple, back.select(direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.is_dir()) == ["type=IMAGE", "type=VIDEO"]
