"""Operator 11 against plain Python."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickflow.llm import fim


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition, without pieces."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = (
    [(k, "äöü€😀 word " * (k % 13)) for k in range(200)]
    + [(k, None) for k in (500, 501)] + [(None, None), (None, "no id"), (None, "no id"), (None, "other")]
    + [(7, "same id, other text"), (7, "same id, other text")] + [(600, "holds <M> itself"), (601, "<P>"), (602, "almost < P> <S <<M"), (603, "<"), (604, "<S" * 50)]
    + [(k, "x<" * 5000) for k in range(700, 710)] + [(k, "a copy") for k in range(800, 830)] * 3
)


@pytest.mark.parametrize("units", [1, 3, 8192])
def test_outputs_equal_plain_python(spark, units):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id bigint, text string, key string, place int").repartition(5)
    rows = ROWS if units > 1 else [r for r in ROWS if not r[1] or len(r[1]) < 1000]
    docs = docs if units > 1 else docs.where("text is null or length(text) < 1000")
    found = fim.fill_in_middle(docs, with_output=True, units=units).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in found), key=repr)
    want = []
    for doc_id, text in rows:
        made = plainly(doc_id, text)
        want.append((doc_id, *made, hashlib.sha256(made[-1].encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_very_long_text_streams_in_pieces(spark):
    text = "0123456789é" * 300_000
    docs = spark.createDataFrame([(k, text) for k in range(3)], "doc_id bigint, text string")
    pieces = fim.output_pieces(docs).selectExpr("max(length(piece)) as most", "count(*) as n").first()
    assert pieces.most <= fim.UNITS + 3 and pieces.n > 1000
    for r in fim.fill_in_middle(docs).collect():
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    found = fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found.count() == 0 and "output" not in found.columns


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>ab", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]), st.integers(1, 5))
def test_restored_whatever_the_text_and_pieces_are(text, a, b, form, units):
    low, high = sorted((min(a, len(text)), min(b, len(text))))
    if any(m in text for m in fim.MARKS):
        form = "plain"
    parts, parser = [], fim.Parser(form)
    for piece in fim.pieces(text, form, low, high, units):
        parts += parser.feed(piece)
    parts += parser.end()
    assert "".join(t for _, t in sorted(parts, key=lambda p: p[0])) == text
    assert fim.restore("".join(fim.pieces(text, form, low, high, units)), form) == text
