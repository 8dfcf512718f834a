"""Command lines. ``python -m weftline.cli run|init|quality|library|validate ...``; non-zero exits tell of empty or failed work."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as profiles
from .functions.provider import Provider
from .operators import changes, quality
from .plans import site
from .sources import corpus, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _now() -> str:
    return datetime.now().isoformat(timespec="seconds")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="extract a site's pages")
    run.add_argument("--site", help="folder of profiles: --config-root/SITE")
    run.add_argument("--config-root", default="config")
    run.add_argument("--config", help="folder of the profile, instead of --site")
    run.add_argument("--page-type")
    run.add_argument("--pages", required=False, help="Parquet table of url, html")
    run.add_argument("--sitemap", help="file with the sitemap's text")
    run.add_argument("--menu", help="file with the interface's answer")
    run.add_argument("--baseline")
    run.add_argument("--sub-sitemaps", help="Parquet table of url, value: what an index of sitemaps points to")
    run.add_argument("--blobs", help="Parquet table of url, content, disposition: images and resources")
    run.add_argument("--details", help="folder of an interface's answers by item, {id}.json")
    run.add_argument("--cases", help="folder of an interface's cases by industry, {id}.json")
    run.add_argument("--llm-refine", action="store_true", help="refine texts by the profile's language model; its failure is an error")
    run.add_argument("--run-date", default=date.today().isoformat())
    run.add_argument("--format", choices=["md", "obsidian", "json"], default="md")
    for flag in ("--incremental", "--check", "--init", "--quality-init", "--quality-check"):
        run.add_argument(flag, action="store_true")
    init = sub.add_parser("init", help="make a profile from a preset and a home page")
    init.add_argument("base_url")
    init.add_argument("--home", help="file with the home page")
    init.add_argument("--fetch", action="store_true", help="fetch the home page, the sitemap and the usual interfaces")
    init.add_argument("--sitemap", help="file with the sitemap's text")
    init.add_argument("--preset", choices=sorted(profiles.PRESETS))
    init.add_argument("--output-root", default="output")
    init.add_argument("--config-root", default="config")
    for name in ("quality", "library"):
        q = sub.add_parser(name)
        q.add_argument("root")
        q.add_argument("--site", default="")
        q.add_argument("--run-at", default=_now())
        q.add_argument("--expect-specs", action="store_true")
        q.add_argument("--expect-resources", action="store_true")
    v = sub.add_parser("validate")
    v.add_argument("config")
    v.add_argument("--output-root")
    v.add_argument("--run-at", default=_now())
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return {"run": _run, "init": _init, "quality": _quality, "library": _library, "validate": _validate}[args.command](args)


def _run(args) -> int:
    if args.site and not profiles.is_identifier(args.site):
        print(f"not a site: {args.site}", file=sys.stderr)
        return 2
    folder = args.config or str(Path(args.config_root, args.site or ""))
    try:
        config = profiles.load(folder, args.page_type)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    spark, root = _session(), config["output_root"]
    state = str(Path(root, "_meta"))
    if args.quality_init or args.quality_check:
        now = quality.metrics(corpus.markdown_tree(spark, root))
        path = f"{state}/_quality_baseline"
        if args.quality_init:
            sinks.replace_table(now, path)
            return 0 if spark.read.parquet(path).head(1) else 1
        before = sinks.state_table(spark, path)
        if before is None:
            return 1
        totals = quality.regression_totals(quality.regressions(now, before)).first()
        print(json.dumps(totals.asDict()))
        return int(bool(totals.regressions or totals.missing_items))
    pages = spark.read.parquet(args.pages) if args.pages else None
    bodies = corpus.sitemap_bodies(spark, args.sitemap) if args.sitemap else None
    menu = corpus.menus(spark, args.menu) if args.menu else None
    subs = spark.read.parquet(args.sub_sitemaps) if args.sub_sitemaps else None
    found = site.items(spark, config, pages, bodies, menu, subs)
    if pages is None:
        print("--pages is needed", file=sys.stderr)
        return 2
    baseline_path = args.baseline or f"{state}/_baseline"
    failed = 0
    if args.check or args.incremental or args.init:
        kept = None if args.init else sinks.state_table(spark, baseline_path)
        old = kept if kept is not None else spark.createDataFrame([], corpus.RECORDS["baseline"])
        diff, now = site.changed(found, pages, old)
        if args.init:
            sinks.replace_table(now.filter("fp is not null"), baseline_path)
            return 0 if spark.read.parquet(baseline_path).head(1) else 1
        if args.check:
            for r in diff.orderBy("kind", "id").toLocalIterator():
                print(f"{r.change_type} {r.kind} {r.id}")
            return int(bool(diff.filter("change_type = 'error'").head(1)))
        for r in diff.filter("change_type = 'error'").orderBy("kind", "id").toLocalIterator():
            print(f"failed: {r.kind} {r.id}: its page can't be used", file=sys.stderr)
            failed = 1
        found = found.join(changes.to_process(diff).select("kind", "id"), ["kind", "id"], "left_semi")
    if args.llm_refine:
        config = profiles.merged(config, {"llm_refine": {"enabled": True}})
    refining = config.get("llm_refine") or {}
    made = site.outcome(
        found, pages, config, args.run_date, args.format, by_kind=_by_kind(folder, config) if not args.page_type else None,
        blobs=spark.read.parquet(args.blobs) if args.blobs else None, details=corpus.details(spark, args.details) if args.details else None,
        cases=corpus.cases(spark, args.cases, config.get("field_mapping")) if args.cases else None,
        provider=Provider.of(refining) if refining.get("enabled") else None, forced=args.llm_refine,
    )
    docs = made.docs.persist()
    try:
        counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
        if not counts.n:
            return failed if args.incremental else 1
        for r in docs.filter("error is not null").select("kind", "id", "error").orderBy("kind", "id").toLocalIterator():
            print(f"failed: {r.kind} {r.id}: {r.error}", file=sys.stderr)
        site.write(docs, root, made.files)
        if args.incremental:
            done = docs.filter("error is null").select("kind", "id", "name", "category", "fp")
            sinks.replace_table(changes.refreshed(old, done), baseline_path)
        if "specs" in docs.columns:
            fine = docs.filter("error is null")
            rows = fine.select(F.col("id").alias("page_id"), F.col("name").alias("title"), F.regexp_replace("path", "/[^/]*$", "").alias("rel_path"), F.col("best_source").alias("source"), F.explode("specs").alias("s"))
            sinks.write_sidecar(sinks.spec_records(rows.select("page_id", "title", "rel_path", "source", "s.ord", "s.k", "s.v")), root, "specs", args.run_date)
        if made.resources is not None:
            sinks.write_sidecar(sinks.resource_records(made.resources), root, "resources", args.run_date)
        if args.format == "md" and (config.get("document") or {}).get("generate_index", True):
            sinks.write_library(site.library_of(spark, root, config), root, config["site_name"], args.run_date, config["base_url"])
        return int(bool(counts.failed) or failed)
    finally:
        docs.unpersist()


def _by_kind(folder: str, config: dict) -> dict[str, dict]:
    """Profiles of the kinds of pages that have a file of their own; where output goes stays the run's."""
    named = set(profiles.page_types(folder))
    kinds = [k for k in ("product", "industry") if k in named or (k == "industry" and "solution" in named)]
    shared = {k: config[k] for k in ("output_root", "output_structure", "llm_refine") if k in config}
    return {k: profiles.load(folder, k) | shared for k in kinds}


def _init(args) -> int:
    base = args.base_url.rstrip("/")
    if args.fetch:
        spark = _session()
        corpus.register(spark)
        urls = [base, *(base + p for p in profiles.API_PROBES.values())]
        rows = spark.read.format("weft_web").options(urls=json.dumps(urls), partitions=4, max_retries=1).load().collect()  # some addresses
        answers = {r.url: {"status": r.status, "type": r.type, "text": bytes(r.content or b"").decode("utf-8", "replace")} for r in rows}
    else:
        read = lambda path: {"status": 200, "text": Path(path).read_text(encoding="utf-8")} if path else {}
        answers = {base: read(args.home), f"{base}/sitemap.xml": read(args.sitemap)}
    probe = profiles.probed(base, answers)
    samples = probe["sample_urls"]
    if not args.home and not args.fetch:
        probe = {k: v for k, v in probe.items() if k in ("suggested_mode", "sitemap_urls")}
    preset = args.preset or profiles.preset_for(probe["suggested_mode"])
    config = profiles.generated(args.base_url, args.output_root, preset, probe, samples)
    folder = Path(args.config_root, config["site_id"])
    folder.mkdir(parents=True, exist_ok=True)
    sinks.replace_file(folder / "common.json", json.dumps(config, ensure_ascii=False, indent=2))
    print(folder)
    return 0


def _quality(args) -> int:
    spark = _session()
    rows = site.score(spark, args.root).persist()
    meta = Path(args.root, "_meta")
    read = lambda name: json.loads((meta / name).read_text(encoding="utf-8")) if (meta / name).exists() else {}
    specs, res = read("_specs.json"), read("_resources.json")
    small = lambda d: {k: v for k, v in d.items() if isinstance(v, (int, float))}
    report = sinks.write_quality_report(rows, args.root, args.site, args.run_at, small(specs), small(res), (args.expect_specs, args.expect_resources))
    print(report["agent_verdict"]["next_action"])
    return int(not report["agent_verdict"]["ok"])


def _library(args) -> int:
    spark = _session()
    docs = site.library_of(spark, args.root, {})
    sinks.write_library(docs, args.root, args.site or "资料库", args.run_at)
    return 0


def _validate(args) -> int:
    config = profiles.read_json(args.config)
    report = profiles.validation_report(config.get("site_id", ""), config.get("base_url", ""), config, args.run_at)
    if args.output_root:
        sinks.write_validation_report(report, args.output_root)
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return int(bool(report["config_errors"]))


if __name__ == "__main__":
    sys.exit(main())
