"""Whole runs, sinks, sources, state and streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from weftline import cli
from weftline import config as profiles
from weftline.operators import changes, discovery, media, pages, quality
from weftline.sources import corpus, sinks
from weftline.streaming import incremental

SPEC = "<table><tr><td>Mass</td><td>3 kg</td></tr><tr><td>Size</td><td>9 mm</td></tr><tr><td>Tint</td><td>blue</td></tr></table>"


def _page(n):
    return f"<html><body><nav>menu</nav><main><h1>Thing {n}</h1><p>Some plain words about thing number {n}.</p>{SPEC}</main></body></html>"


def _profile(tmp_path, **more):
    base = profiles.PRESETS["product_specs_sitemap"]["config"]
    cfg = profiles.merged(base, {"site_id": "shop", "site_name": "Shop", "base_url": "https://shop.example", "output_root": str(tmp_path / "out"), **more})
    (tmp_path / "cfg").mkdir(exist_ok=True)
    (tmp_path / "cfg" / "common.json").write_text(json.dumps(cfg))
    return cfg


def _inputs(spark, tmp_path, numbers, name="pages"):
    spark.createDataFrame([(n, f"https://shop.example/products/thing-{n}.html", _page(n)) for n in numbers], incremental.PAGES).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
    urls = "".join(f"<url><loc>https://shop.example/products/thing-{n}.html</loc></url>" for n in numbers)
    (tmp_path / "map.xml").write_text(f"<urlset>{urls}<url><loc>https://other.example/products/x.html</loc></url></urlset>")


def test_run_then_incremental(spark, tmp_path):
    _profile(tmp_path, discovery={"product_pattern": "/products/"})
    _inputs(spark, tmp_path, [1, 2])
    args = ["run", "--config", str(tmp_path / "cfg"), "--pages", str(tmp_path / "pages"), "--sitemap", str(tmp_path / "map.xml")]
    assert cli.main([*args, "--init"]) == 0
    assert cli.main(args) == 0
    files = sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out" / "产品").rglob("*.md"))
    assert files == ["产品/All/Thing_1/Thing_1.md", "产品/All/Thing_2/Thing_2.md"]
    text = (tmp_path / "out" / files[0]).read_text()
    assert text.startswith("# Thing 1\n") and "menu" not in text and "技术参数 (Auto)" in text and "| Mass | 3 kg |" in text
    specs = json.loads((tmp_path / "out" / "_meta" / "_specs.json").read_text())
    assert specs["pages_with_specs"] == 2 and specs["total_specs"] == 6 and len(specs["records"]) == 2
    assert "Thing 1" in (tmp_path / "out" / "全库索引.md").read_text()
    _inputs(spark, tmp_path, [1, 2, 3])
    assert cli.main([*args, "--check"]) == 0
    assert cli.main([*args, "--incremental"]) == 0
    assert (tmp_path / "out" / "产品/All/Thing_3/Thing_3.md").exists()
    assert spark.read.parquet(str(tmp_path / "out/_meta/_baseline")).count() == 3
    assert cli.main([*args, "--quality-init"]) == 0 and cli.main([*args, "--quality-check"]) == 0
    (tmp_path / "out" / files[0]).write_text("# Thing 1\n")
    assert cli.main([*args, "--quality-check"]) == 1
    assert cli.main(["quality", str(tmp_path / "out")]) == 1
    assert json.loads((tmp_path / "out/_meta/_quality_report.json").read_text())["files_scored"] == 3
    assert cli.main(["library", str(tmp_path / "out")]) == 0


def test_empty_discovery_and_bad_profiles_fail(spark, tmp_path):
    _profile(tmp_path)
    _inputs(spark, tmp_path, [1])
    (tmp_path / "none.xml").write_text("<urlset/>")
    assert cli.main(["run", "--config", str(tmp_path / "cfg"), "--pages", str(tmp_path / "pages"), "--sitemap", str(tmp_path / "none.xml")]) == 1
    assert cli.main(["run", "--site", "../up"]) == 2
    _profile(tmp_path, base_url="https://user:word@shop.example")
    assert cli.main(["run", "--config", str(tmp_path / "cfg")]) == 2


def test_init_and_validate(tmp_path):
    (tmp_path / "home.html").write_text("<html lang=en><title>Shop | x</title><main id=m><p>hello</p></main>")
    (tmp_path / "map.xml").write_text("".join(f"<loc>https://shop.example/en-us/products/a-{n}</loc>" for n in range(30)))
    assert cli.main(["init", "https://www.shop.example", "--home", str(tmp_path / "home.html"), "--sitemap", str(tmp_path / "map.xml"), "--config-root", str(tmp_path)]) == 0
    path = tmp_path / "shop_example" / "common.json"
    made = json.loads(path.read_text())
    assert made["html_components"]["content_selector"] == "#m" and made["discovery"]["mode"] == "sitemap"
    assert cli.main(["validate", str(path), "--output-root", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "_config_validation.md").exists()


def test_init_probes_a_site(tmp_path):
    pages = {"/": ("text/html", "<html lang=de><title>Shop</title><main id=c>text<a href=/products/x>x</a></main></html>"), "/api/menu": ("application/json", "{}"), "/api/nav": ("text/html", "no"),
             "/sitemap.xml": ("text/xml", "<urlset><url><loc>https://h/products/a</loc></url></urlset>")}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, text = pages.get(self.path, ("", None))
            self.send_response(200 if text is not None else 404)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write((text or "").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    pages[""] = pages["/"]
    assert cli.main(["init", at, "--fetch", "--config-root", str(tmp_path)]) == 0
    server.shutdown()
    made = json.loads(next(tmp_path.rglob("common.json")).read_text())
    assert made["html_components"]["content_selector"] == "#c" and made["site_name"] == "Shop" and "field_mapping" in made  # the preset of interfaces
    seen = profiles.probed("https://s.example/de-de/", {"https://s.example/de-de/sitemap.xml": {"status": 200, "text": pages["/sitemap.xml"][1], "type": "text/xml"}})
    assert (seen["sitemap_urls"], seen["lang_path"], seen["suggested_mode"], seen["api_hits"]) == (1, "/de-de", "nav", {"sitemap": "/sitemap.xml"})


def test_stream_resumes_and_refreshes(spark, tmp_path):
    src, base, check = str(tmp_path / "in"), str(tmp_path / "base"), str(tmp_path / "check")
    seen = []
    for k, n in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i, f"u{i}", _page(i + 10 * k * (i == 2))) for i in n], incremental.PAGES).coalesce(1).write.mode("append").parquet(src)
        assert incremental.run(spark, src, base, check, lambda c, _: seen.extend((r.id, r.change_type) for r in c.collect())) == 1
    assert sorted(seen) == [("1", "new"), ("2", "changed"), ("2", "new"), ("3", "new")]
    assert incremental.run(spark, src, base, check) == 0
    assert spark.read.parquet(base).count() == 3


def test_tree_refuses_to_leave(spark, tmp_path):
    sinks.register(spark)
    rows = spark.createDataFrame([("../x.md", "a")], "path string, body string")
    with pytest.raises(Exception, match="outside"):
        rows.write.format("weft_tree").mode("append").save(str(tmp_path / "o"))
    assert not (tmp_path / "x.md").exists()


def test_replace_file_keeps_the_old_one(tmp_path):
    p = tmp_path / "a"
    sinks.replace_file(p, "one")
    with pytest.raises(UnicodeEncodeError):
        sinks.replace_file(p, "\ud800")
    assert p.read_text() == "one" and [x.name for x in tmp_path.iterdir()] == ["a"]


@pytest.mark.parametrize("broken_off", ["before", "between", "after"])
def test_state_survives_a_broken_replacement(spark, tmp_path, broken_off):
    path = str(tmp_path / "state")
    assert sinks.state_table(spark, path) is None
    sinks.replace_table(spark.range(2), path)
    spark.range(5).write.parquet(path + ".new-x")
    if broken_off != "before":
        (tmp_path / "state").rename(tmp_path / "state.old-x")
    if broken_off == "after":
        (tmp_path / "state.new-x").rename(tmp_path / "state")
    assert sinks.state_table(spark, path).count() == (2 if broken_off == "before" else 5)
    sinks.replace_table(sinks.state_table(spark, path).limit(1), path)  # from itself
    assert sinks.state_table(spark, path).count() == 1


def test_reports_go_where_spark_writes(spark, tmp_path):
    sinks.put_text(spark, f"file://{tmp_path}/a/b.txt", ["one ", "zwei\u00fc"])
    sinks.put_text(spark, f"{tmp_path}/a/b.txt", ["new \u4e00"])
    assert (tmp_path / "a/b.txt").read_text() == "new \u4e00" and [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b.txt"]
    docs = spark.createDataFrame([("product", "C", "1", "x"), ("industry", "", "2", "y")], "kind string, category string, id string, body string")
    sinks.write_table(docs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("kind = 'product'").count() == 1


def test_library_index_is_in_order(spark, tmp_path):
    rows = [("产品/b/x.md", "X", "product", "b", "about x", 1), ("产品/a/z.md", "Z", "product", "a", "", 1), ("产品/a/y.md", "Y", "product", "a", "", 1), ("else.md", "E", "other", "未分类", "", 1)]
    sinks.write_library(spark.createDataFrame(rows, "path string, title string, section string, category string, brief string, headings int"), str(tmp_path), "S", "2024-05-06")
    text = (tmp_path / "全库索引.md").read_text()
    parts = ["## 产品", "### a", "- [Y](产品/a/y.md)", "- [Z](产品/a/z.md)", "### b", "- [X](产品/b/x.md) - about x", "## 解决方案", "暂无解决方案文档", "## 行业", "## 其他", "- [E](else.md)"]
    assert [text.index(p) for p in parts] == sorted(text.index(p) for p in parts) and "### 未分类" not in text


def test_web_source(spark):
    hits = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            hits[self.path] = hits.get(self.path, 0) + 1
            body = b"x" * (100 if self.path == "/large" else 5)
            code = 503 if self.path == "/busy" and hits[self.path] < 2 else 404 if self.path == "/no" else 200
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    corpus.register(spark)
    urls = [f"{at}/ok", f"{at}/busy", f"{at}/no", f"{at}/large", "file:///etc/passwd"]
    rows = spark.read.format("weft_web").options(urls=json.dumps(urls), backoff=0.1, max_bytes=50, partitions=2).load().collect()
    server.shutdown()
    got = {r.url.removeprefix(at): (r.status, r.content and bytes(r.content), r.error) for r in rows}
    assert got["/ok"][1] == b"xxxxx" and got["/busy"][1] == b"xxxxx" and got["/no"][0] == 404 and got["/large"][2] == "more than 50 bytes"
    assert got["file:///etc/passwd"][2] == "only http(s) is fetched"


def test_menu_items_and_controls(spark, tmp_path):
    menu = {"data": {"productTypeList": [{"name": "A", "children": [{"id": 7, "name": "seven", "url": "u7"}, {"id": "8", "name": "eight", "url": "u8"}]}], "industryList": [{"id": 1, "name": "one", "url": "i1"}]}}
    (tmp_path / "m.json").write_text(json.dumps(menu))
    got = discovery.flatten_menu(corpus.menus(spark, str(tmp_path / "m.json")))
    assert [(r.kind, r.id, r.category) for r in got.orderBy("ord").collect()] == [("product", "7", "A"), ("product", "8", "A"), ("industry", "1", "")]
    assert [r.id for r in discovery.controlled(got, exclude=["seven"], max_pages=1).collect()] == ["8"]
    assert [r.id for r in discovery.of_types(got, ["solution"]).collect()] == ["1"]


def test_sitemap_index(spark):
    body = spark.createDataFrame([("<sitemapindex>" + "".join(f"<sitemap><loc> https://a.b/{n}.xml </loc></sitemap>" for n in ("p1", "docs", "p2")) + "<loc>https://c.d/p.xml</loc>",)], "value string")
    assert [r.url for r in discovery.sub_sitemaps(body, "https://a.b/sitemap.xml").collect()] == ["https://a.b/p1.xml", "https://a.b/p2.xml"]


def test_children_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "a")], "parent string, id string")
    got = pages.children(spark.createDataFrame([("a",)], "id string"), edges)
    assert {(r.id, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_table_functions(spark):
    pages.register(spark)
    spark.createDataFrame([(1, "https://a.b/c/", "<a href='d'>x</a><a href='#z'>y</a>" + SPEC)], incremental.PAGES).createOrReplaceTempView("p")
    assert [tuple(r) for r in spark.sql("select l.href, l.text from p, lateral html_links(url, html) l").collect()] == [("https://a.b/c/d", "x"), ("https://a.b/c/#z", "y")]
    assert spark.sql("select s.k from p, lateral html_specs(html) s").count() == 3
    assert [r.line for r in spark.sql("select * from md_lines('a\n\nb') order by pos").collect()] == ["a", "", "b"]


def test_broken_page_is_a_row(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "u", None)], incremental.PAGES)
    got = pages.extract(rows, {"html_components": {"content_selector": ":bad("}}, ["md", "error"]).orderBy("page_id").collect()
    assert "unsupported selector" in got[0].error and got[1].md == ""


def test_media(spark):
    big = bytearray(b"\x89PNG" + b"0" * 6000)
    rows = [("https://a/pic-one.png", big, "f", "p", 1), ("https://a/logo.png", big, "f", "p", 2), ("https://a/b.jpg", bytearray(b"small"), "f", "p", 3), ("https://a/two.jpg", big, "f", "p", 4)]
    blobs = spark.createDataFrame(rows, "url string, content binary, folder string, prefix string, ord int")
    kept = media.named_images(media.kept_images(blobs, ["logo"])).orderBy("ord").collect()
    assert [r.file for r in kept] == ["p_1.png", "p_2.jpg"]
    res = blobs.withColumn("disposition", blobs["prefix"]).withColumn("title", blobs["prefix"])
    assert [(r.file, r.bytes) for r in media.kept_resources(res).collect()] == [("pic-one.png", 6004)]


def test_sidecar_summaries(spark):
    rows = spark.createDataFrame([("1", "t", "a", "Auto", i, k, v) for i, (k, v) in enumerate([("x", "1"), ("y", "2"), ("x", "3")])], "page_id string, title string, rel_path string, source string, ord int, k string, v string")
    rec = sinks.spec_records(rows)
    assert rec.first().specs == {"x": "1", "y": "2"}
    assert sinks.spec_summary(rec, 3).first().asDict() == {"pages_with_specs": 1, "total_specs": 2, "avg_specs_per_page": 2.0, "spec_coverage": 0.333}


def test_broken_references(spark):
    docs = spark.createDataFrame([("p/a.md", "![x](图片/one.png) ![y](图片/two.png) [r](../资料/r.pdf) [s](资料/s.pdf)")], "path string, text string")
    files = spark.createDataFrame([("p/图片/one.png",), ("资料/r.pdf",)], "path string")
    assert {"broken-image x1", "broken-resource x1"} <= set(quality.quality_rows(docs, files).first().issues)


def test_baseline_merge(spark):
    old = spark.createDataFrame([("product", "1", "n", "c", "f")], corpus.RECORDS["baseline"])
    new = spark.createDataFrame([("product", "1", None, "d", None), ("product", "2", "m", "", "g")], corpus.RECORDS["baseline"])
    assert sorted(tuple(r) for r in changes.merged(old, new).collect()) == [("product", "1", "n", "d", "f"), ("product", "2", "m", "", "g")]
