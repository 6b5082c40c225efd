import json
import os

import pytest
from pyspark.sql import functions as F

from citeloom.operators import answer
from citeloom.plans import cli, manifest, registry
from citeloom.plans.ingest import Busy, Ingest, ingest_lock
from citeloom.plans.settings import Settings, load
from citeloom.plans.store import BackendChanged, Store, orphans
from citeloom.sources.spans import plain_text


@pytest.fixture()
def base(tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "solar.pdf").write_text("Solar cells convert light\nThe panel efficiency reached twenty percent\n" + "filler line about panels\n" * 80)
    (docs / "sub" / "wind.pdf").write_text("Wind turbines spin\nTurbine blades are made of composite\fSecond page on gearboxes")
    (docs / ".hidden.pdf").write_text("no")
    (docs / "bad.pdf").write_bytes(b"\0\1")
    (docs / "blank.pdf").write_text("  \n ")
    return Settings(pdf_dir=str(docs), store_dir=str(tmp_path / "store"), state_dir=str(tmp_path / "state"), images_dir=str(tmp_path / "img"), embedding_dim=32)


def test_sync_is_incremental(spark, base):
    ingest = Ingest(spark, base, plain_text)
    plan = ingest.sync(dry_run=True)
    assert plan.planned == ["bad.pdf", "blank.pdf", "solar.pdf", "wind.pdf"] and plan.summary() == "would re-ingest 4 document(s), skip 0"
    first = ingest.sync()
    assert (first.scanned, first.indexed, first.failed) == (4, 2, 2)
    assert dict(first.errors)["blank.pdf"] == "no extractable text" and "not a text file" in dict(first.errors)["bad.pdf"]
    chunks = ingest.store.read("chunks")
    assert {r["document_name"] for r in chunks.select("document_name").distinct().collect()} == {"solar.pdf", "wind.pdf"}
    assert chunks.where("document_name = 'wind.pdf'").count() == 2
    again = ingest.sync()
    assert (again.skipped, again.indexed, again.failed) == (2, 0, 2)
    os.remove(f"{base.pdf_dir}/sub/wind.pdf")
    with open(f"{base.pdf_dir}/solar.pdf", "a") as f:
        f.write("one more line")
    os.remove(f"{base.pdf_dir}/bad.pdf")
    narrowed = ingest.sync(manifest.Selector("solar*"))
    assert (narrowed.indexed, narrowed.removed) == (1, 0)
    last = ingest.sync()
    assert last.removed == 2 and ingest.store.read("manifest").count() == 2
    assert ingest.store.read("chunks").where("document_name = 'wind.pdf'").count() == 0
    changed = Ingest(spark, Settings(**{**base.__dict__, "embedding_dim": 16}), plain_text)
    with pytest.raises(BackendChanged):
        changed.sync()
    assert changed.rebuild().indexed == 1

    said = []

    def generate(system, prompt):
        said.append(prompt)
        yield from ["<think>x</think>It is [solar.pdf, Page 1, ", "Line 1-3] and [nope.pdf, Page 1, Line 1]"]

    encode = lambda texts: [[0.0] * 15 + [1.0]] * len(texts)
    engine = answer.Engine(spark, changed.store.read("chunks"), changed.store.read("figures"), encode, generate)
    kinds = [e.kind for e in engine.stream("panel efficiency?")]
    assert kinds[0] == "context" and kinds[-1] == "done" and "CONTEXT PASSAGES" in said[0]
    got = engine.answer("panel efficiency?")
    assert got.text.endswith("[nope.pdf, Page 1, Line 1] [unverified]") and [c["verified"] for c in got.citations] == [True, False] and got.warnings
    down = answer.Engine(spark, changed.store.read("chunks"), changed.store.read("figures"), encode, cli.unavailable).answer("panel?")
    assert down.text.startswith("The local LLM is unavailable") and all(c["verified"] for c in down.citations)
    empty = answer.Engine(spark, changed.store.read("chunks").limit(0), changed.store.read("figures"), encode, generate).answer("panel?")
    assert empty.warnings == ["empty retrieval"]


def test_equal_names_and_strange_roots(spark, tmp_path):
    docs = tmp_path / "a+b (1) [x] {y} q.1"
    (docs / "sub").mkdir(parents=True)
    (docs / "b.pdf").write_text("the text of the root")
    (docs / "sub" / "b.pdf").write_text("the text of the folder")
    s = Settings(pdf_dir=str(docs), store_dir=str(tmp_path / "s"), state_dir=str(tmp_path / "t"), embedding_dim=8)
    ingest = Ingest(spark, s, plain_text)
    assert ingest.sync().indexed == 2
    got = {r["source_path"].removeprefix(str(docs)): r["text"] for r in ingest.store.read("chunks").collect()}
    assert got == {"/b.pdf": "the text of the root", "/sub/b.pdf": "the text of the folder"}
    assert {r["rel_path"] for r in ingest.store.read("manifest").collect()} == {"b.pdf", "sub/b.pdf"}
    assert not os.listdir(tmp_path / "s" / "work")
    for i in range(3):
        ingest.store.set_meta("x", str(i))
        ingest.store.write(manifest=ingest.store.read("manifest"))
    assert sum(n.startswith("manifest-") for n in os.listdir(tmp_path / "s")) == 2


def page_extractor():
    """An extractor of pages with lines, a table, a caption, a raster and an unreadable page."""

    def extract(path, content):
        word = content.decode()
        line = lambda no, text, x0=50.0: {"page_number": 1, "block": no, "line": 0, "span": 0, "kind": "text", "text": text, "dir_y": 0.0, "x0": x0, "y0": 60.0 + 14 * no, "x1": 560.0, "y1": 70.0 + 14 * no, "width": 612.0, "height": 792.0}
        yield from (line(i, f"{word} line {i} of the page") for i in range(6))
        yield line(7, "Figure 2: a photograph of the thing")
        yield line(9, "text goes on right below it")
        yield {"page_number": 1, "block": 0, "kind": "table", "x0": 50.0, "y0": 88.0, "x1": 560.0, "y1": 112.0}
        for r, row in enumerate((["name", "n"], [word, "1"])):
            yield from ({"page_number": 1, "block": 0, "line": r, "span": c, "kind": "cell", "text": t} for c, t in enumerate(row))
        if word != "plain":
            yield {"page_number": 1, "block": 1, "line": 0, "span": 0, "kind": "image", "text": "JPG", "x0": 100.0, "y0": 210.0, "x1": 200.0, "y1": 240.0, "pixels": 90_000, "data": word.encode()}
        yield {"page_number": 2, "error": "page lost"}

    return extract


def test_tables_and_images_are_stored_and_removed(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "one.pdf").write_text("alpha")
    (docs / "two.pdf").write_text("beta")
    s = Settings(pdf_dir=str(docs), store_dir=str(tmp_path / "s"), state_dir=str(tmp_path / "t"), images_dir="/img", embedding_dim=8)
    ingest = Ingest(spark, s, page_extractor())
    report = ingest.sync()
    assert (report.indexed, report.tables, report.chunks, report.figures) == (2, 2, 4, 2)
    assert report.warnings == [("one.pdf", "page 2 unreadable: page lost"), ("two.pdf", "page 2 unreadable: page lost")]
    assert report.summary().startswith("indexed=2 skipped=0 failed=0 removed=0 chunks=4 figures=2 tables=2 in ")
    table = ingest.store.read("chunks").where("content_type = 'table' and document_name = 'one.pdf'").first()
    assert table["text"].endswith("| name | n |\n| --- | --- |\n| alpha | 1 |") and (table["line_start"], table["line_end"], table["chunk_index"]) == (3, 4, 1)
    image = ingest.store.read("figures").where("document_name = 'one.pdf'").first()
    name = f"/img/one_{image['doc_uid'][:8]}_p0001_img000.jpg"
    assert image["image_path"] == name and image["caption"].startswith("Figure 2") and image["kind"] == "image"
    assert {r["image_path"]: bytes(r["data"]) for r in ingest.export_images().collect()}[name] == b"alpha"
    assert {r["page_count"] for r in ingest.store.read("manifest").collect()} == {1}
    (docs / "one.pdf").write_text("plain")
    os.remove(docs / "two.pdf")
    report = ingest.sync()
    assert (report.indexed, report.removed, report.images_removed) == (1, 1, 2) and ingest.store.read("images").count() == 0


def test_a_write_that_dies_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "f")
    one = store.read("manifest")
    row = spark.createDataFrame([("u", "d.pdf", "s", "r", "", 1, 1.0, "indexed", 1, 1, 1, 1, "1.1.0", "", "", "")], one.schema)
    store.write(manifest=row)
    broken = row.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write(manifest=broken)
    assert store.read("manifest").count() == 1
    store.write(manifest=row.unionByName(row.withColumn("doc_uid", F.lit("v"))))
    assert store.read("manifest").count() == 2
    store.check_backend()
    assert store.get_meta("fingerprint") == "f"


def test_interrupted_documents_are_recovered(spark, base):
    ingest = Ingest(spark, base, plain_text)
    ingest.sync()
    rows = ingest.store.read("manifest").withColumn("status", F.when(F.col("document_name") == "wind.pdf", "indexing").otherwise(F.col("status")))
    ingest.store.write(manifest=rows)
    report = ingest.sync()
    assert report.recovered == 1 and report.indexed == 1


def test_lock_is_exclusive(tmp_path):
    path = str(tmp_path / "x" / "lock")
    with ingest_lock(path), pytest.raises(Busy), ingest_lock(path):
        pass
    with ingest_lock(path):
        pass


def test_orphans_stay_inside(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "image_path string")
    assert [r[0] for r in orphans(df("/i/a", "/i/b", "/etc/p", "/i/../x", ""), df("/i/b"), "/i").collect()] == ["/i/a"]


def test_settings_by_precedence(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"top_k": 7, "candidates": "30", "extract_images": "no", "unknown": 1, "lexical_weight": "x"}))
    s = load(str(path), {"CITELOOM_TOP_K": "9", "CITELOOM_MODEL_FALLBACKS": "a, b"}, pdf_dir="p")
    assert (s.top_k, s.candidates, s.extract_images, s.lexical_weight, s.model_fallbacks, s.pdf_dir) == (9, 30, False, 0.35, ("a", "b"), "p")
    s.save(str(tmp_path / "out.json"))
    assert load(str(tmp_path / "out.json"), {}) == s
    path.write_text("{")
    assert load(str(path), {}) == Settings()


def test_registry(tmp_path):
    path = str(tmp_path / "r.json")
    first = registry.read(path, Settings())
    assert first == registry.alone(Settings()) and registry.overrides(first, "default")["pdf_dir"] == Settings().pdf_dir
    two = registry.put(registry.put(first, "z", registry.at_home("z", "p", "h")), "b", registry.at_home("b", "p", "h", "papers"))
    assert registry.in_order(first) == ["default"] and two.folders["b"]["store_dir"] == "h/bases/b/store"
    with pytest.raises(ValueError):
        registry.put(two, "b", {})
    with pytest.raises(KeyError):
        registry.activate(two, "nothing")
    registry.write(path, registry.activate(two, "z"))
    again = registry.read(path, Settings())
    assert registry.in_order(again) == ["z", "b", "default"] and again.folders == two.folders
    last = registry.drop(registry.drop(again, "z"), "b")
    assert last.active == "default"
    with pytest.raises(ValueError):
        registry.drop(last, "default")
    for broken in ('{"active": "gone", "bases": [{"name": "half"}, 7]}', "[]", "{", '{"bases": null}'):
        (tmp_path / "r.json").write_text(broken)
        assert registry.read(path, Settings()) == first


def test_models_by_preference():
    pick = answer.resolve_model
    assert pick("x", ["b", "c:1"], ["c"]) == "b" and pick("x", ["b", "c"], ["d", "c"]) == "c"
    assert pick("a", ["b", "a"]) == "a" and pick("a", ["b", "a:7b"]) == "a:7b" and pick("x", ["b"]) == "b" and pick("x", []) == "x"


def test_command_line(spark, base, tmp_path):
    home = str(tmp_path / "home")
    said: list[str] = []
    call = lambda *argv: cli.run(cli.parser().parse_args(["--home", home, *argv]), spark, out=said.append)
    assert call("kb", "add", "one", base.pdf_dir) == 0 and call("kb", "use", "one") == 0
    assert call("kb", "list") == 0 and said[0].startswith("* one")
    assert call("ingest") == 0 and "indexed=2" in said[-1]
    assert call("query", "turbine", "blades") == 0 and any("wind.pdf" in x for x in said)
    assert call("status") == 0 and "documents: 2" in said
    assert call("reindex", "--rebuild", "--failed") == 1 and call("reset") == 1 and call("reset", "--yes") == 0
    assert call("kb", "remove", "nothing") == 1 and call("doctor") == 0


def test_buckets_follow_the_corpus_and_a_change_rewrites_its_own(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "f")
    store.sized(100 << 30)
    assert store.buckets == 400 and Store(spark, store.root).buckets == 400
    row = lambda uids: spark.createDataFrame([(u, "x.pdf", "indexed") for u in uids], "doc_uid string, document_name string, status string")
    full = lambda rows: store.read("manifest").limit(0).unionByName(rows, allowMissingColumns=True)
    store.write(manifest=full(row([f"u{i}" for i in range(50)])))
    store.sized(1 << 50)
    before = store._state()["tables"]["manifest"]
    assert store.buckets == 400 and len(before) > 20
    store.replace_documents(store.read("chunks"), store.read("figures"), manifest=full(row(["u7"]).withColumn("document_name", F.lit("y.pdf"))))
    after = store._state()["tables"]["manifest"]
    assert [b for b in after if after[b] != before.get(b)] == [str(b) for b in store.touched(row(["u7"]))]
    assert {r["document_name"]: r["count"] for r in store.read("manifest").groupBy("document_name").count().collect()} == {"x.pdf": 49, "y.pdf": 1}
    store.reset()
    store.sized(1 << 50)
    assert store.buckets == 16_384 and store.read("manifest").count() == 0
