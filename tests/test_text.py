import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.answer import ThinkFilter
from citeloom.sources.listing import is_scanned, is_watched


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_white_space_and_lines(spark):
    odd = "  a b \n c\t"
    assert one(spark, tx.strip_u(F.col("t")), t=odd) == odd.strip()
    assert one(spark, tx.collapse(F.col("t")), t=odd) == " ".join(odd.split())
    for t in ("a\nb", "a\x0bb", "a b", "a\x85b", "only"):
        assert one(spark, tx.first_line(F.col("t")), t=t) == t.splitlines()[0]


def test_content_words(spark):
    assert sorted(one(spark, tx.content_words(F.col("t")), t="The ÜBER model's 42 v100 v100 of it is ab")) == ["ber", "model", "v100"]


def test_ids_and_labels(spark):
    import hashlib

    assert one(spark, tx.doc_uid(F.col("p")), p="a/ü.pdf") == hashlib.sha1("a/ü.pdf".encode()).hexdigest()[:16]
    assert one(spark, tx.row_id(F.col("u"), F.lit(3), "f", F.lit(0)), u="x") == "x:p3:f0"
    assert one(spark, tx.image_stem(F.col("d")), d="with space (1).pdf") == "with_space_1_"
    assert len(one(spark, tx.image_stem(F.col("d")), d="n" * 70 + ".pdf")) == 60


def test_names_that_are_taken(spark):
    names = ["a.pdf", "sub/b.pdf", ".hidden.pdf", "~$lock.pdf", "C.PDF", "d.pdf.tmp", "s/.x/e.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], ["p"]).select("p", is_scanned(F.col("p")), is_watched(F.col("p"))).collect()
    assert [r[0] for r in rows if r[1]] == ["a.pdf", "sub/b.pdf", "s/.x/e.pdf"]
    assert [r[0] for r in rows if r[2]] == ["a.pdf", "sub/b.pdf", "C.PDF", "s/.x/e.pdf"]


@given(st.text("ab.*?[]!-/+x", max_size=8), st.text("ab.-/+x!", max_size=8))
@settings(max_examples=400, deadline=None)
def test_globs_match_as_shell_patterns(pattern, name):
    try:
        got = re.match(tx.glob_to_regex(pattern), name) is not None
    except re.error:
        return  # a reversed range, which matches nothing
    assert got == fnmatch.fnmatchcase(name, pattern)


@given(st.lists(st.sampled_from(["<think>", "</think>", "a", "<", "th", " b\n"]), max_size=8), st.lists(st.integers(1, 5), max_size=30))
@settings(max_examples=300, deadline=None)
def test_think_filter_is_independent_of_fragments(parts, cuts):
    text = "".join(parts)
    whole = ThinkFilter()
    want = whole.feed(text) + whole.flush()
    cut, out, at = ThinkFilter(), "", 0
    for n in [*cuts, len(text)]:
        out += cut.feed(text[at : at + n])
        at += n
    assert out + cut.flush() == want
    assert want == re.sub(r"(?s)<think>.*$", "", re.sub(r"(?s)<think>.*?</think>", "", text))
