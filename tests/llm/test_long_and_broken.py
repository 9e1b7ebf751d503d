"""Texts and pages that once took quadratic time or the stack of the engine, and persons under several writings."""

import random
import time

from ruleweave.llm import html, pii


def test_long_runs_are_searched_in_linear_time(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6)).capitalize()
    texts = {
        "names": "Mr " + " ".join(word() for _ in range(60_000)),
        "labels": "x@" + ".".join(f"abc{i}" for i in range(40_000)) + ".com",
        "letters": "".join(rnd.choices("ghijkl0123456789+", k=400_000)),
        "dotted": "a." * 200_000,
        "titles": "Dr " * 100_000 + "Smith",
        "particles": "Mr " + "de " * 100_000 + "Gaulle",
        "mail": "x" * 200_000 + "@" + "y" * 200_000 + ".com",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(4)
    began = time.perf_counter()
    found = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert time.perf_counter() - began < 240
    assert {k: r.n_entities for k, r in found.items()} == {"names": 1, "labels": 1, "letters": 0, "dotted": 0, "titles": 1, "particles": 1, "mail": 1}
    assert all(found[k].text == texts[k] for k in ("letters", "dotted"))
    assert len(found["names"].text.split()) == 3 and not set(found["names"].text.split()[1:]) & set(texts["names"].split())
    assert found["mail"].text.endswith(".com") and found["mail"].text != texts["mail"] and len(found["labels"].text.split(".")) == 40_001


def test_one_person_under_several_writings(spark):
    rows = [
        (1, "Mr John Smith’s car. Mr John Smith left, said Smith; SMITH'S dog, Smith's cat."),
        (2, "Dr. Maria Garcia came. Prof. Wilhelmina Vos, too."),
        (3, "Mrs Wilhelmina Kok"),
        (4, "Baker and Smith are words here."),
        (5, "_d@y.org_, ..d@y.org and d@y.org. c@x.com.5 ends"),
    ]
    found = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    given, family = found[1].split("’")[0].split()[1:]
    assert found[1] == f"Mr {given} {family}’s car. Mr {given} {family} left, said {family}; {family.upper()}'S dog, {family}'s cat."
    women = set(pii.NAMES["latin"]["f"])
    assert found[2].split()[1] in women and found[2].split()[5] in women  # by the lists, and by the title of another document
    assert found[4] == rows[3][1]
    mail = found[5].split(" and ")[1].split(". ")[0]
    assert found[5].startswith(f"_{mail}_, ..{mail} and {mail}. ") and mail != "d@y.org" and found[5].endswith(".com.5 ends")


def test_broken_pages_are_read_in_linear_time():
    for page in ("<a " * 300_000, '<a href="' * 100_000, "<a<a" * 200_000, "<script>" + "</script " * 100_000, "<a '\" " * 150_000, "<!--" * 250_000):
        began = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - began < 20


def test_markup_by_hand():
    """What is text and what markup, by hand-made expectations."""
    cases = {
        "<p>a<b>b</b> c</p>": ["ab c"],
        "<p title='x>y'>a</p>": ["a"],
        '<p title="x>a</p>': ['<p title="x>a'],  # the quote never ends, so this is no tag
        "a < b and c<d": ["a < b and c<d"],
        "x<!-- <p>no</p> -->y": ["xy"],
        "x<!-- never ends": ["x"],
        "<!doctype html><p>a": ["a"],
        "a<script>if (x<y) {}</script>b": ["ab"],
        "a<script>never": ["a"],
        "a<script src='x'/>b": ["ab"],
        "<P>A</P><DIV>B</DIV>": ["A", "B"],
        "a<br>b<br/>c": ["a b c"],
        "&lt;p&gt; &amp;": ["<p> &"],
        "<é>a": ["<é>a"],
        "</ p>a": ["</ p>a"],
    }
    for page, want in cases.items():
        assert [t for t, _ in html.blocks(page)] == want, page
