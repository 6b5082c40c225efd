import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.operators import chunking, citations, context, embed, figures, layout, retrieval, tables


@given(st.lists(st.text("ab c", max_size=40), max_size=40), st.integers(1, 80), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_windows_cover_every_line_and_move_on(lines, target, overlap):
    parts = chunking.windows(lines, target, overlap)
    firsts = [a for a, _, _ in parts]
    assert firsts == sorted(set(firsts))
    covered = {n for a, b, _ in parts for n in range(a, b + 1)}
    assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= covered
    for a, b, text in parts:
        assert text == "\n".join(lines[a - 1 : b]).strip()
        assert sum(len(x) + 1 for x in lines[a - 1 : b - 1]) < target


def test_runt_is_folded_with_its_overlap():
    assert chunking.folded([(1, 4, "x" * 200), (4, 5, "tail")]) == [(1, 5, "x" * 200 + "\ntail")]
    assert chunking.folded([(1, 2, "tail")]) == [(1, 2, "tail")]


def model_order(lines, width):
    """Reading order by loops: (col, band order) of lines (x0, x1, y0, id)."""
    side = {}
    for x0, x1, _, i in lines:
        tol, mid = 0.08 * width, width / 2
        side[i] = -1 if x0 < mid - tol and x1 > mid + tol else 0 if (x0 + x1) / 2 < mid else 1
    n = len(lines)
    if min(sum(s == 0 for s in side.values()), sum(s == 1 for s in side.values())) < 0.15 * n:
        side = dict.fromkeys(side, 0)
    out, left, right = [], [], []
    for _, _, _, i in sorted(lines, key=lambda r: (round(r[2] / 3.0), r[0], r[3])):
        if side[i] == -1:
            out += left + right + [i]
            left, right = [], []
        else:
            (right if side[i] else left).append(i)
    return out + left + right


def test_reading_order_equals_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(30):
        lines = []
        for i in range(rng.randrange(1, 25)):
            x0 = rng.choice([50.0, 50.0, 320.0])
            x1 = x0 + rng.choice([200.0, 240.0, 510.0])
            lines.append((x0, x1, rng.randrange(0, 60) * 1.5, i))
        want[page] = model_order(lines, 612.0)
        rows += [(page, *line, 612.0) for line in lines]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, y0 double, id int, width double")
    got: dict = {}
    for r in sorted(layout.reading_order(df, ["page"], "id").collect(), key=lambda r: (r["page"], r["line_number"])):
        got.setdefault(r["page"], []).append(r["id"])
    assert got == want


def test_line_ranges_at_the_edges(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 20.0, 10.0, 30.0)], "page int, line_number int, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame([(1, 0, 12.0, 0.0, 20.0, 5.0), (1, 1, 12.1, 0.0, 20.0, 5.0), (1, 2, 50.0, 15.0, 60.0, 15.0), (2, 3, 0.0, 0.0, 9.0, 9.0)], "page int, rect_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r["rect_id"]: (r["line_start"], r["line_end"]) for r in layout.line_ranges(rects, lines, ["page"]).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (1, 1), 3: (0, 0)}


def test_captions(spark):
    texts = ["Figure 3: A plot\nmore", "Figures 1 and 2", "TABLE iv. Sizes", "scheme12", "See Figure 1", "  fig. 7b  x", "Figure iva x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, block_text string")
    got = {r["id"]: (r["kind"], r["label"], r["caption"]) for r in figures.captions(rows).collect()}
    assert got == {0: ("figure", "Figure 3", "Figure 3: A plot more"), 2: ("table", "Table iv", "TABLE iv. Sizes"), 3: ("figure", "Scheme 12", "scheme12"), 5: ("figure", "Fig 7b", "fig. 7b x")}


def test_clamp_needs_a_gap(spark):
    for gap, fits in ((34.0, False), (35.0, True), (36.0, True)):
        bands = spark.createDataFrame([(1, 0, 0.0, 100.0, 300.0, 320.0, 792.0, False)], "page int, rect_id int, bx0 double, bx1 double, y0 double, y1 double, height double, below boolean")
        lines = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 300.0 - gap - 3.0)], "page int, x0 double, y0 double, x1 double, y1 double")
        assert (figures.clamped(bands, lines, ["page"], ["rect_id"]).first()["top"] is not None) == fits


def test_accepted_regions_do_not_meet(spark):
    rows = [(1, i, 10.0 * i, 0.0, 10.0 * i + 200, 200.0) for i in range(60)] + [(2, 0, 0.0, 0.0, 9.0, 9.0)]
    got = figures.accepted(spark.createDataFrame(rows, "page int, rect_id int, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert sorted(r["rect_id"] for r in got) == [0, 20, 40]


def test_markdown(spark):
    cases = [
        ([["a", "", " b "], [None, "", "2\n3"], ["", None, ""]], "| a | b |\n| --- | --- |\n|  | 2 3 |"),
        ([["only"]], ""), ([["a"], ["b"]], ""), ([], ""), ([["", "h"], ["x", "y|z", "w"]], "| col1 | h | col3 |\n| --- | --- | --- |\n| x | y|z | w |"),
        ([["h", "k"]] + [["r", str(i)] for i in range(90)], "| h | k |\n| --- | --- |\n" + "\n".join(f"| r | {i} |" for i in range(79))),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, rows array<array<string>>")
    got = {r["id"]: r["md"] for r in df.select("id", tables.markdown(F.col("rows")).alias("md")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_hybrid_ties_keep_dense_order_and_blank_questions_have_none(spark):
    corpus = spark.createDataFrame([(i, "same words here", [1.0, 0.0]) for i in range(9)] + [(20, "zero", [0.0, 0.0]), (21, "none", None)], "row_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "words", [1.0, 0.1]), (2, "  ", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    got = retrieval.hybrid(corpus, asked, top=3).orderBy("hit_rank").collect()
    assert [(r["query_id"], r["row_id"]) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert got[0]["lexical_score"] == 1.0


HITS = "query_id long, hit_ord int, hit_rank int, document_name string, page_number int, line_start int, line_end int, content_type string, text string, caption string"


def test_citations(spark):
    text = "x [A.pdf, Page 1, Line 9–3] [a.PDF, Page 1, Line 2] [ B.pdf , pages 2,lines 7 ] [b.pdf, Page 2, Line 7-7] [C.pdf, Page 1, Line 26] [C.pdf, Page 1, Line 27] [D.pdf, Page 9, Line 1]"
    answers = spark.createDataFrame([(1, 1, text), (2, 1, "none")], "answer_id long, query_id long, text string")
    cited = citations.parse(answers)
    got = [(r["document_name"], r["page"], r["line_start"], r["line_end"]) for r in cited.orderBy("ord").collect()]
    assert got == [("A.pdf", 1, 3, 9), ("B.pdf", 2, 7, 7), ("C.pdf", 1, 26, 26), ("C.pdf", 1, 27, 27), ("D.pdf", 9, 1, 1)]
    hits = spark.createDataFrame([(1, 0, 1, "b.PDF", 2, 40, 50, "text", "t0", ""), (1, 1, 2, "C", 1, 30, 21, "text", "t1", ""), (1, 2, 3, "C.pdf", 1, 10, 21, "text", "t2", ""), (1, 3, 4, "a.pdf", 1, 1, 2, "text", "t3", "")], HITS)
    checked = {r["ord"]: (r["verified"], r["hit_ord"]) for r in citations.verify(cited, hits).collect()}
    assert checked == {1: (True, 3), 2: (False, 0), 3: (True, 2), 4: (False, 2), 5: (False, None)}
    marked = {r["answer_id"]: r["text"] for r in citations.annotate(answers, citations.verify(cited, hits)).collect()}
    assert marked[2] == "none" and marked[1].count("[unverified]") == 3 and "[C.pdf, Page 1, Line 27] [unverified]" in marked[1]
    counts = {r["answer_id"]: r["coverage"] for r in citations.coverage(answers, citations.verify(cited, hits)).collect()}
    assert counts == {1: 0.4, 2: 1.0}


def test_stem_fallback_takes_the_first_document(spark):
    answers = spark.createDataFrame([(1, 1, "[Doc.pdf, Page 1, Line 1]")], "answer_id long, query_id long, text string")
    hits = spark.createDataFrame([(1, 0, 1, "other.pdf", 1, 1, 2, "text", "no", ""), (1, 1, 2, "DOC", 1, 1, 2, "text", "yes", "")], HITS)
    assert citations.verify(citations.parse(answers), hits).first()["snippet"] == "yes"


def test_packing_is_a_prefix_and_keeps_the_first(spark):
    rows = [(1, i, i + 1, "d.pdf", 1, 1, 2, "text", "w" * n, "c") for i, n in enumerate([5000, 10]) ] + [(2, i, i + 1, "d.pdf", 1, 1, 2, "table", "w" * n, "c") for i, n in enumerate([1000, 1000, 3000, 10])]
    hits = spark.createDataFrame(rows, HITS)
    packed = context.pack_passages(hits)
    assert sorted((r["query_id"], r["hit_rank"]) for r in packed.collect()) == [(1, 1), (2, 1), (2, 2)]
    pics = context.pack_figures(hits, packed).collect()
    assert sorted((r["query_id"], r["entry_no"]) for r in pics) == [(2, 3), (2, 4), (2, 5), (2, 6)]
    assert context.pack_figures(hits, packed.limit(0)).where("query_id = 1 and entry_no = 1").count() == 1


def test_embedders(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    rows = {r["id"]: r["embedding"] for r in embed.embed(df, embed.embedder("hashing", dim=16)).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and not any(rows[2])
    try:
        embed.embedder("nothing")
    except ValueError:
        pass
    else:
        raise AssertionError


def test_embedding_functions_get_few_texts_at_once(spark):
    df = spark.range(1200, numPartitions=1).selectExpr("id", "string(id) as text")
    rows = embed.embed(df, lambda: lambda texts: np.array([[len(texts), int(t)] for t in texts])).collect()
    assert [(r["id"], r["embedding"][1]) for r in rows] == [(i, i) for i in range(1200)]
    assert max(r["embedding"][0] for r in rows) <= embed.ROWS
    assert embed.embed(df.limit(0), embed.embedder("hashing")).collect() == []
