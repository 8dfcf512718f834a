"""Runs from end to end: nothing is lost, and what profiles ask for acts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline import config as profiles
from weftline.functions.provider import Provider
from weftline.operators import pages
from weftline.plans import site
from weftline.sources import corpus

BASE = "https://shop.example"
CONFIG = profiles.normalised({"site_id": "shop", "site_name": "Shop", "base_url": BASE, "output_root": "x", "web_fallback": {"enabled": True}})
PIC, DOC = bytearray(b"\x89PNG" + b"7" * 6000), bytearray(b"%PDF" + b"5" * 3000)


def _config(**more):
    return profiles.merged(CONFIG, more)


def _pages(spark, rows):
    return spark.createDataFrame([(i, BASE + u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def _found(spark, rows):
    schema = "ord int, kind string, id string, name string, category string, url string, features string, cover string"
    return spark.createDataFrame([(i, k, n, n, c, BASE + u, f, v) for i, (k, n, c, u, f, v) in enumerate(rows)], schema)


def _docs(found, table, config, **more):
    return {r.id: r for r in site.documents(found, table, config, "2024-05-06", **more).collect()}


def test_no_page_is_lost(spark, tmp_path, capsys):
    folder = tmp_path / "cfg"
    folder.mkdir()
    config = _config(output_root=str(tmp_path / "out"), discovery={"mode": "url_list", "urls": [f"{BASE}/{x}" for x in ("good", "null", "gone", "large")]}, rate_limit={"max_response_bytes": 200})
    (folder / "common.json").write_text(json.dumps(config))
    _pages(spark, [("/good", "<main><p>Some words.</p></main>"), ("/null", None), ("/large", "<p>" + "x" * 300 + "</p>")]).write.parquet(str(tmp_path / "pages"))
    args = ["run", "--config", str(folder), "--pages", str(tmp_path / "pages")]
    assert cli.main(args) == 1
    said = capsys.readouterr().err
    assert f"{BASE}/null: no page" in said and f"{BASE}/gone: no page" in said and f"{BASE}/large: more than 200 bytes" in said
    assert [p.name for p in (tmp_path / "out").rglob("*.md") if "All" in str(p) or "Pages" in str(p)] == ["Good.md"]
    assert cli.main([*args, "--incremental"]) == 1
    assert spark.read.parquet(str(tmp_path / "out/_meta/_baseline")).count() == 1


def test_extract_reports_faults(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "x" * 50), (3, "u", "<p>a</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.md, r.error) for r in pages.extract(rows, want=["md", "error"], limit=20).collect()}
    assert got == {1: (None, "no page"), 2: (None, "more than 20 bytes"), 3: ("a", None)}
    assert {r.page_id: r.md for r in pages.extract(rows, want=["md"]).collect()}[1] == ""


def test_page_types_act(spark):
    html = "<div class=x><h3>Thing</h3><h4>Part</h4><p>Words of it.</p><span class=s>only here</span></div>"
    config = _config(page_types={"product": {"decompose_selectors": [".s"]}})
    found = _found(spark, [("product", "Thing", "C", "/a", None, None), ("industry", "Trade", "", "/a", None, None)])
    got = _docs(found, _pages(spark, [("/a", html)]), config)
    # a product's headings move up to level 2, its own name goes, and its type's selectors hold
    assert got["Thing"].md == "# Thing\n\n## Part\n\nWords of it."
    assert "only here" in got["Trade"].md and got["Trade"].md.startswith("# Trade 解决方案\n")
    assert got["Thing"].path == "产品/C/Thing/Thing.md" and got["Trade"].path == "解决方案/Trade/Trade/Trade.md"
    by_kind = {"industry": _config(html_components={"decompose_selectors": [".s"]})}
    assert "only here" not in _docs(found, _pages(spark, [("/a", html)]), _config(), by_kind=by_kind)["Trade"].md


def test_detail_content_by_precedence(spark):
    long = "Words of the site's own place. " * 10
    html = f"<body><div class=own>{{}}</div><article>General words.</article><div class=product-detail-content>Usual words.</div><p>Rest.</p></body>"
    found = _found(spark, [("product", "A", "C", "/a", None, None), ("product", "B", "C", "/b", None, None)])
    table = _pages(spark, [("/a", html.format(long)), ("/b", html.format("short"))])
    site_own = {"site_selectors": {"shop.example": ".own"}}
    got = _docs(found, table, _config(html_components={"content_selector": "article", **site_own}))
    assert "General" in got["B"].md and "short" not in got["B"].md
    got = _docs(found, table, _config(html_components=site_own))
    assert "own place" in got["A"].md and "Rest." not in got["A"].md and "Rest." in got["B"].md
    assert "Usual" in _docs(found, table, _config())["A"].md and "Rest." not in _docs(found, table, _config())["A"].md
    got = _docs(found, table, _config(html_components={"content_selector": "article"}, web_fallback={"selectors": {"product_html": ".own"}}))
    assert "own place" in got["A"].md and "General" not in got["A"].md


def test_images_and_resources(spark, tmp_path):
    html = "<article><p>Words.</p><img src='/i/one.png'><img src='/i/logo.png'><img src='/i/small.png'><a href='/f/sheet.pdf?download=1'>Sheet</a><a href='/f/again.pdf?download=1'>Again</a>"
    html += "<div class=gone><a href='/f/stashed.pdf?download=1'>Stashed</a></div><span class=lab>Files</span><div class=pan><a href='/f/tab.pdf?download=1'>Tab file</a></div></article>"
    comp = {"content_selector": "article", "decompose_selectors": [".gone"], "tab_label": ".lab", "tab_panel": ".pan", "download_tab_labels": ["Files"]}
    folder = tmp_path / "cfg"
    folder.mkdir()
    config = _config(
        output_root=str(tmp_path / "out"), discovery={"mode": "url_list", "urls": [{"url": f"{BASE}/a", "title": "Thing"}]}, html_components=comp,
        filters={"image_ignore_keywords": ["logo"]},
    )
    (folder / "common.json").write_text(json.dumps(config))
    _pages(spark, [("/a", html)]).write.parquet(str(tmp_path / "pages"))
    blobs = [("/i/one.png", PIC, None), ("/i/logo.png", PIC, None), ("/i/small.png", bytearray(b"x"), None), ("/f/sheet.pdf?download=1", DOC, None), ("/f/again.pdf?download=1", DOC, None)]
    blobs += [("/f/stashed.pdf?download=1", DOC + b"2", "attachment; filename=kept.pdf"), ("/f/tab.pdf?download=1", DOC + b"3", None)]
    spark.createDataFrame([(BASE + u, c, d) for u, c, d in blobs], "url string, content binary, disposition string").write.parquet(str(tmp_path / "blobs"))
    assert cli.main(["run", "--config", str(folder), "--pages", str(tmp_path / "pages"), "--blobs", str(tmp_path / "blobs")]) == 0
    out = tmp_path / "out"
    page = next(p for p in out.rglob("Thing.md"))
    text = page.read_text()
    assert "(图片/Thing_配图_1.png)" in text and "logo" not in text and "small" not in text
    assert text.count("(资料/sheet.pdf)") == 2  # equal contents are one file
    assert "- 📎 [Stashed](资料/kept.pdf)" in text and "- 📎 [Tab file](资料/tab.pdf)" in text and "## 资料下载" in text
    assert (page.parent / "图片/Thing_配图_1.png").read_bytes() == bytes(PIC) and (page.parent / "资料/kept.pdf").read_bytes() == bytes(DOC + b"2")
    records = json.loads((out / "_meta/_resources.json").read_text())
    assert records["total_resources"] == 3 and {r["filename"] for r in records["records"]} == {"sheet.pdf", "kept.pdf", "tab.pdf"}
    assert cli.main(["quality", str(out)]) in (0, 1)
    assert not any("broken" in i for r in json.loads((out / "_meta/_quality_report.json").read_text())["worst"] for i in r["issues"])


def test_cover_and_features(spark):
    config = _config(templates={"product_cover_image": "![{name}]({rel})", "product_features": "> {features}", "product_data_source": "Source: {site_name} {id} {date}"})
    found = _found(spark, [("product", "Thing", "C", "/a", "Fast and small.", f"{BASE}/i/c.jpg")])
    blobs = spark.createDataFrame([(f"{BASE}/i/c.jpg", PIC, None)], "url string, content binary, disposition string")
    got = site.outcome(found, _pages(spark, [("/a", "<body><p>Body words.</p></body>")]), config, "2024-05-06", blobs=blobs)
    md = got.docs.first().md
    assert md.splitlines()[0] == "# Thing" and md.index("![Thing](图片/Thing_主图.jpg)") < md.index("> Fast and small.") < md.index("Body words.")
    assert md.endswith("---\nSource: Shop Thing 2024-05-06")
    assert [r.path for r in got.files.collect()] == ["产品/C/Thing/图片/Thing_主图.jpg"]


def test_children_are_items_and_parts(spark):
    link = lambda *to: "<body><p>Words of {}.</p>" + "".join(f"<a class=sub href='{u}'>{n}</a>" for u, n in to) + "</body>"
    rows = [("/a", link(("/b", "Bee"), ("https://else.example/z", "Zed"), ("/c", "Cee")).format("A")), ("/b", link(("/d", "Dee")).format("B")), ("/c", link().format("C")), ("/d", link(("/a", "Aye")).format("D"))]
    menu = {"data": {"productTypeList": [{"name": "Cat", "children": [{"id": "a", "name": "Aye", "url": f"{BASE}/a"}]}], "industryList": []}}
    table = _pages(spark, rows)
    config = _config(web_fallback={"children_selector": "a.sub"}, html_components={"decompose_selectors": ["a.sub"]})
    found = site.items(spark, config, table, menu=corpus_menu(spark, menu))
    assert [(r.name, r.category, r.url) for r in found.orderBy("ord").collect()] == [("Aye", "Cat", f"{BASE}/a"), ("Bee", "Cat", f"{BASE}/b"), ("Cee", "Cat", f"{BASE}/c")]
    md = _docs(found, table, config)["a"].md
    assert [x for x in md.splitlines() if x.startswith("#")] == ["# Aye", "## 1 Bee", "### 1.1 Dee", "## 2 Cee"]
    assert [md.index(f"Words of {x}.") for x in "ABDC"] == sorted(md.index(f"Words of {x}.") for x in "ABDC") and md.count("\n---\n") == 3
    split = profiles.merged(config, {"output_structure": {"subproduct_mode": "split"}})
    docs = site.documents(found.filter("name = 'Aye'"), table, split, "2024-05-06").collect()
    assert {r.path for r in docs} == {"产品/Cat/Aye/Aye.md", "产品/Cat/Aye/Bee/Bee.md", "产品/Cat/Aye/Cee/Cee.md", "产品/Cat/Aye/Bee/Dee/Dee.md"}
    assert next(r for r in docs if r.name == "Dee").md.startswith("## Dee")


def corpus_menu(spark, menu):
    import tempfile
    from pathlib import Path

    path = Path(tempfile.mkdtemp(), "menu.json")
    path.write_text(json.dumps(menu))
    return corpus.menus(spark, str(path))


def test_menu_by_selectors(spark):
    html = "<ul><li class=cat>Pumps<a class=p data-id=7 href=/x/7>Seven</a><a class=p href='/x/eight/'>Eight</a></li><li class=cat>Fans<a class=p href=/x/nine>Nine</a></li></ul>"
    config = _config(web_fallback={"menu_url": "/menu", "product_url": "/p/{id}", "selectors": {"menu_categories": ".cat", "menu_items": "a.p"}})
    got = site.items(spark, config, _pages(spark, [("/menu", html)])).orderBy("ord").collect()
    assert [(r.id, r.name, r.url) for r in got] == [("7", "Seven", f"{BASE}/x/7"), ("eight", "Eight", f"{BASE}/x/eight/"), ("nine", "Nine", f"{BASE}/x/nine")]
    assert got[0].category == "PumpsSevenEight"
    with pytest.raises(ValueError, match="needs its input"):
        site.items(spark, _config(web_fallback={"enabled": False}), _pages(spark, []))


def test_sub_sitemaps_are_followed(spark, tmp_path):
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in (f"{BASE}/p1.xml", f"{BASE}/blog.xml", "https://else.example/p.xml")) + "</sitemapindex>")
    subs = spark.createDataFrame([(f"{u}", f"<loc>{BASE}/products/{n}.html</loc>") for u, n in ((f"{BASE}/p1.xml", "one"), (f"{BASE}/blog.xml", "two"), ("https://else.example/p.xml", "three"))], "url string, value string")
    config = _config(discovery={"mode": "sitemap", "sitemap_url": f"{BASE}/sitemap.xml"})
    got = site.items(spark, config, bodies=corpus.sitemap_bodies(spark, str(tmp_path / "index.xml")), sub_bodies=subs).collect()
    assert [r.url for r in got] == [f"{BASE}/products/one.html"]


def test_linked_specification_pages(spark):
    table = lambda *kv: "<table>" + "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in kv) + "</table>"
    own = "<body><p>See AB-1234, AB-1234 and CD-5678.</p>" + table(("Mass", "1 kg"), ("Size", "2 mm"), ("Tint", "red")) + "</body>"
    rows = [("/a", own), ("/spec/AB-1234", table(("Mass", "9 kg"), ("Power", "5 W"), ("Class", "B"), ("Noise", "low"))), ("/spec/CD-5678", table(("Only", "one")))]
    config = _config(spec_extraction={"enabled": True, "linked_page": {"url_template": "/spec/{catalog}", "catalog_pattern": r"[A-Z]{2}-\d{4}"}}, content_blocks=["body_html", "spec_tables"])
    doc = _docs(_found(spark, [("product", "Thing", "C", "/a", None, None)]), _pages(spark, rows), config)["Thing"]
    assert {s.k: (s.layer, s.v) for s in doc.specs} == {"Mass": ("Auto", "1 kg"), "Size": ("Auto", "2 mm"), "Tint": ("Auto", "red"), "Power": ("AB-1234", "5 W"), "Class": ("AB-1234", "B"), "Noise": ("AB-1234", "low")}
    assert doc.best_source == "AB-1234" and "## 技术参数 (AB-1234)" in doc.md and "| Power | 5 W |" in doc.md


def test_payloads_and_cases(spark, tmp_path):
    (tmp_path / "details").mkdir()
    (tmp_path / "cases").mkdir()
    (tmp_path / "details" / "Thing.json").write_text(json.dumps({"data": {"body": "<p>From the payload.</p>"}}))
    (tmp_path / "cases" / "Trade.json").write_text(json.dumps({"data": [{"title": "First", "summary": "In short", "html": "<p>One case.</p>"}, {"title": "Second", "html": "<p>More.</p>"}]}))
    config = _config(field_mapping={"product_html": "body"}, templates={"case_heading": "### {n}. {title}", "case_summary": "> {summary}", "industry_data_source": "From {base_url}"})
    found = _found(spark, [("product", "Thing", "C", "/a", None, None), ("industry", "Trade", "", "/b", None, None)])
    got = _docs(found, _pages(spark, [("/b", "<div class=solution-content><p>Of the trade.</p></div><p>rest</p>")]), config, details=corpus.details(spark, str(tmp_path / "details")), cases=corpus.cases(spark, str(tmp_path / "cases"), {}))
    assert got["Thing"].error is None and "From the payload." in got["Thing"].md
    md = got["Trade"].md
    assert [md.index(x) for x in ("# Trade 解决方案", "Of the trade.", "## 💡 应用案例", "### 1. First", "> In short", "One case.", "### 2. Second", "More.", f"From {BASE}")] == sorted(
        md.index(x) for x in ("# Trade 解决方案", "Of the trade.", "## 💡 应用案例", "### 1. First", "> In short", "One case.", "### 2. Second", "More.", f"From {BASE}")
    )
    assert "rest" not in md


def test_assembly_rules_hold_across_blocks(spark):
    html = "<body><h4>Deep</h4><p>Text.</p><h3>Notes</h3><p>More.</p></body>"
    config = _config(html_components={"subheading_demote_patterns": ["Notes"]})
    got = _docs(_found(spark, [("industry", "Trade", "", "/a", None, None)]), _pages(spark, [("/a", html)]), config)["Trade"].md
    assert got == "# Trade 解决方案\n\n## Deep\n\nText.\n\n### Notes\n\nMore."


def _answering(reply, code=200):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            body = json.dumps({"choices": [{"message": {"content": reply(asked.split("---\n", 1)[1])}}]}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def test_refinement(spark):
    words = " ".join(f"w{i}" for i in range(40))
    found, table = _found(spark, [("product", "Thing", "C", "/a", None, None)]), _pages(spark, [("/a", f"<body><p>{words}</p></body>")])
    server = _answering(lambda t: t.replace("w7 ", ""))
    call = Provider.of({"endpoint": f"http://127.0.0.1:{server.server_port}"})
    assert "w7 " not in _docs(found, table, _config(), provider=call)["Thing"].md
    server.shutdown()
    server = _answering(lambda t: "w1 w2")
    assert "w39" in _docs(found, table, _config(), provider=Provider.of({"endpoint": f"http://127.0.0.1:{server.server_port}"}))["Thing"].md  # too much lost
    server.shutdown()
    server.server_close()
    down = Provider.of({"endpoint": "http://127.0.0.1:9", "timeout": 2})
    assert "w39" in _docs(found, table, _config(), provider=down)["Thing"].md
    failed = _docs(found, table, _config(), provider=down, forced=True)["Thing"]
    assert failed.error and failed.md is None
    keyless = _docs(found, table, _config(), provider=Provider.of({"api_key_env": "NO_SUCH_KEY_HERE"}), forced=True)["Thing"]
    assert "NO_SUCH_KEY_HERE" in keyless.error


def test_pages_travel_in_batches_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://x.example/").alias("url"), F.repeat(F.lit("x"), 10_000).alias("kept"), F.lit("<p>a</p>").alias("html"))
    found = pages.extract(rows, want=["md"])
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.size for r in sizes) < 6 << 20
