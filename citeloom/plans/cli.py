"""The command line: python -m citeloom.plans.cli <command>."""

from __future__ import annotations

import argparse
import shutil
import sys

from pyspark.sql import SparkSession

from citeloom.operators import embed
from citeloom.operators.answer import Engine, ModelUnavailable
from citeloom.plans import manifest, registry
from citeloom.plans.ingest import Busy, Ingest
from citeloom.plans.settings import Settings, load
from citeloom.sources.spans import plain_text


def human(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citeloom")
    for name in ("--config", "--home", "--kb", "--pdf-dir", "--model", "--log-level"):
        top.add_argument(name)
    sub = top.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--only", default="")
    for flag in ("--force", "--no-prune", "--dry-run"):
        ingest.add_argument(flag, action="store_true")
    again = sub.add_parser("reindex")
    again.add_argument("--only", default="")
    for flag in ("--failed", "--stale", "--dry-run", "--rebuild", "--yes"):
        again.add_argument(flag, action="store_true")
    sub.add_parser("query").add_argument("words", nargs="+")
    sub.add_parser("watch").add_argument("--no-initial-sync", action="store_true")
    sub.add_parser("status")
    sub.add_parser("doctor")
    reset = sub.add_parser("reset")
    for flag in ("--images", "--yes"):
        reset.add_argument(flag, action="store_true")
    kb = sub.add_parser("kb").add_subparsers(dest="action", required=True)
    kb.add_parser("list")
    add = kb.add_parser("add")
    add.add_argument("name")
    add.add_argument("pdf_dir")
    add.add_argument("--description", default="")
    add.add_argument("--replace", action="store_true")
    for name in ("remove", "use"):
        kb.add_parser(name).add_argument("name")
    return top


def unavailable(_system: str, _prompt: str):
    raise ModelUnavailable("no language model is configured")
    yield


def run(args: argparse.Namespace, spark: SparkSession | None = None, extractor=plain_text, generate=unavailable, out=print) -> int:
    """Runs a parsed command; the exit code is 0, or 1 for a failure."""
    home = args.home or "."
    base_settings = load(args.config or f"{home}/config.json", pdf_dir=args.pdf_dir, model=args.model, log_level=args.log_level)
    bases = registry.read(f"{home}/registry.json", base_settings)
    try:
        if args.command == "kb":
            return _kb(args, bases, home, out)
        own = registry.overrides(bases, args.kb or bases.active)
        settings = load(args.config or f"{home}/config.json", **own | {k: v for k, v in (("pdf_dir", args.pdf_dir), ("model", args.model)) if v})
        if args.command == "doctor":
            return _doctor(settings, out)
        spark = spark or SparkSession.builder.appName("citeloom").getOrCreate()
        return _with_store(args, settings, Ingest(spark, settings, extractor, progress=out), generate, out)
    except (KeyError, ValueError, Busy) as problem:
        out(f"error: {problem.args[0] if problem.args else problem}")
        return 1


def _kb(args, bases: registry.Bases, home: str, out) -> int:
    if args.action == "list":
        for name in registry.in_order(bases):
            own = bases.folders[name]
            out(f"{'*' if name == bases.active else ' '} {name}  {own['pdf_dir']}  {own['description']}".rstrip())
        return 0
    if args.action == "add":
        bases = registry.put(bases, args.name, registry.at_home(args.name, args.pdf_dir, home, args.description), args.replace)
    else:
        bases = (registry.drop if args.action == "remove" else registry.activate)(bases, args.name)
    registry.write(f"{home}/registry.json", bases)
    return 0


def _doctor(settings: Settings, out) -> int:
    import pyspark

    java, free = shutil.which("java"), shutil.disk_usage(".").free
    out(f"python {sys.version.split()[0]}  pyspark {pyspark.__version__}  java {java or 'missing'}")
    out(f"free disk {human(free)}{'  (low)' if free < 5 * 2**30 else ''}")
    have = memory()
    if "MemAvailable" in have:
        out(f"free memory {human(have['MemAvailable'])}{'  (low)' if have['MemAvailable'] < 3 * 2**30 else ''}")
    if have.get("SwapTotal"):
        out(f"free swap {human(have['SwapFree'])}{'  (low)' if have['SwapFree'] < 0.05 * have['SwapTotal'] else ''}")
    embed.embedder(settings.embedding_backend)
    out(f"embedding {settings.embedding_backend}:{settings.embedding_model}:{settings.embedding_dim}")
    return 0 if java else 1


def memory() -> dict[str, float]:
    """The bytes of memory and swap of this machine, where it tells: MemTotal, MemAvailable, SwapTotal, SwapFree."""
    try:
        with open("/proc/meminfo") as lines:
            return {name: float(rest.split()[0]) * 1024 for name, _, rest in (line.partition(":") for line in lines)}
    except OSError:
        return {}


def _with_store(args, settings: Settings, ingest: Ingest, generate, out) -> int:
    store = ingest.store
    if args.command == "ingest":
        report = ingest.sync(manifest.Selector(args.only), args.force, not args.no_prune, args.dry_run)
    elif args.command == "reindex":
        chosen = manifest.Selector(args.only, args.failed, args.stale)
        if args.rebuild:
            if chosen.is_narrowed:
                raise ValueError("--rebuild takes all documents and no selector")
            if not args.yes:
                raise ValueError("--rebuild empties the store: confirm it with --yes")
            report = ingest.rebuild()
        else:
            out(f"re-indexing {chosen.describe()}")
            report = ingest.sync(chosen, force=True, dry_run=args.dry_run)
    elif args.command == "watch":
        from citeloom.streaming.feed import follow

        follow(ingest, initial_sync=not args.no_initial_sync).awaitTermination()
        return 0
    elif args.command == "reset":
        if not args.yes:
            raise ValueError("reset empties the store: confirm it with --yes")
        ingest.reset()
        if args.images:
            shutil.rmtree(settings.images_dir, ignore_errors=True)
        return 0
    elif args.command == "status":
        row = manifest.status(store.read("manifest"), store.read("chunks"), store.read("figures"), store.fingerprint).first()
        for name, value in row.asDict().items():
            out(f"{name}: {value}")
        size = store.read("images").selectExpr("coalesce(sum(length(data)), 0)").first()[0]
        out(f"images: {human(size)}")
        for r in manifest.by_status(store.read("manifest"), "failed").limit(15).collect():
            out(f"failed: {r['document_name']}: {r['error']}")
        return 0
    else:
        load_encoder = embed.embedder(settings.embedding_backend, settings.embedding_model, settings.embedding_dim)
        engine = Engine(ingest.spark, store.read("chunks"), store.read("figures"), load_encoder(), generate, settings.model, settings)
        answer = engine.answer(" ".join(args.words))
        out(answer.text)
        if answer.citations:
            out("Sources:")
        for c in answer.citations:
            out(f"  {'+' if c['verified'] else '?'} {c['raw']}")
        for w in answer.warnings:
            out(f"warning: {w}")
        out(f"{sum(c['verified'] for c in answer.citations)}/{len(answer.citations)} citations verified, {answer.seconds:.1f} s")
        return 0
    for name in report.planned:
        out(f"would ingest {name}")
    for word, found in (("failed", report.errors), ("warning", report.warnings)):
        for name, problem in found:
            out(f"{word}: {name}: {problem}")
    if report.failed > len(report.errors):
        out(f"failed: {report.failed - len(report.errors)} more")
    out(report.summary())
    return 1 if report.failed and not report.indexed else 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
