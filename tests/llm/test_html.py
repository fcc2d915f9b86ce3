import itertools
import random
import re
import pytest

from tidegauge.llm.html_text import extract_text, html_to_text

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a &amp; b &lt;c&gt; &copy;", "a & b <c> ©"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Q<tr><td>apple pie<td>3</table>", "Name       Q\napple pie  3"),
    ("<table><tr><td>a<br>b<td>c<tr><td><p>d</p><td>eee</table>", "a  c\nb\nd  eee"),
    ("<pre> x\n  y </pre>z", " x\n  y \n\nz"), ("a <b> b</b>  c", "a b c"),
    ("<head><title>t</title></head><body>b", "b"), ("<script>x<p>y</script>z", "z"), ("<style>a</style><!-- c -->d<!-- e", "d"),
    ('<p hidden>a<p>b<span style="display: none">c</span><i style="VISIBILITY:hidden">d</i>', "b"), ('<a href="x>y">l</a>', "l"),
    ("1 < 2 <3", "1 < 2 <3"), ("</p>x</div>y", "xy"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<p>a<div>b</div>c", "a\n\nb\nc"),
    ("<textarea>a<b></textarea>", "a<b>"), ("<template>x</template><noscript>y</noscript>z", "z"), ("<svg><path/></svg>t", "t"), ("<b>unclosed", "unclosed"), ("<a <b>x", "x"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_layout(source, want):
    assert html_to_text(source) == want


def test_deep_and_long_pages():
    assert html_to_text("<div>" * 50_000 + "x").strip() == "x"
    assert html_to_text("<p>" + "word " * 200_000).count("word") == 200_000
    assert html_to_text('<a href="' + "x" * 100_000) is not None
    assert html_to_text("<" * 100_000).count("<") == 100_000


def test_all_words_of_pages_stay(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_text(pages).collect():
        assert r.n_chars == len(r.text) and "<p>" not in r.text and "track(" not in r.text
    odd = spark.createDataFrame([(None, "<p>a", "t"), (1, None, "t"), (1, None, "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract_text(odd).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert extract_text(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ("<table><tr>note<td>x", "note\nx"), ("<table><tr><form><td>Name</td></form></tr></table>", "Name"), ("<table><form hidden><tr><td>a</form><td>b</table>c", "a  b\n\nc"),
    ("<table><tr><div>k<td>x</td></div><td>y</table>", "k\nx  y"), ("<table><tr><td>a</td><script>s</script>t<i hidden>no</i><td>b</tr></table>", "t\na  b"),
    ("<table><colgroup>cg<col><tr><td>a<td>b</table>", "cg\na  b"), ("<table><tr><td>a<p>b<form>f<td>c</form></table>", "a  c\nb\nf"), ("<table><tr hidden>n<td>x<tr><td>y</table>", "y"),
])
def test_rows_keep_what_is_not_a_cell(source, want):
    assert html_to_text(source) == want


def tree(rng, depth, shown, counter):
    """A random tree as HTML, with the words that it shows: written here apart from the extractor."""
    source, seen = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth == 0:
            word = f"w{next(counter)}"
            source += f" {word} "
            seen += [word] if shown else []
            continue
        name = rng.choice(["div", "span", "b", "section", "ul", "blockquote", "custom-x"])
        attribute, inner = "", shown
        if kind < 0.5:
            attribute, inner = rng.choice([' hidden', ' style="color:red;display: none"']), None
        elif kind < 0.6:
            attribute, inner = " style='visibility:hidden'", False if shown is not None else None
        elif kind < 0.7:
            attribute, inner = ' style="Visibility: visible"', True if shown is not None else None
        body, words = tree(rng, depth - 1, inner, counter)
        source += f"<{name}{attribute}>{body}</{name}>"
        seen += words
    return source, seen


def test_words_of_random_trees():
    for seed in range(300):
        source, seen = tree(random.Random(seed), 6, True, itertools.count())
        assert re.findall(r"w\d+", html_to_text(source)) == seen, source


def test_tables_with_implied_rows_and_spans():
    assert html_to_text("<table><td>a<td>b</table>") == "a  b"
    assert html_to_text("<table><tbody><td>a<td>b<tr><td>cc<td>d</table>") == "a   b\ncc  d"
    assert html_to_text("<table><tr><td colspan=2>head<tr><td>a<td>b</table>") == "head\na  b"
    assert html_to_text("<table><tr><td colspan=2>wide heading<tr><td>a<td>b<td>c</table>") == "wide heading\na  b" + " " * 10 + "c"
    assert html_to_text("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>") == "x  1\n   2"
    assert html_to_text("<ol><li>a<li value=5>b<li>c</ol>") == "1. a\n5. b\n6. c"


def test_any_depth():
    assert html_to_text("<div>" * 450 + "<p hidden>secret</p>" + "tail") == "tail"
    assert html_to_text("<b><div>" * 60_000 + "x") == "x"
    assert html_to_text("<p><button>" + "<div>" * 100_000 + "x") == "x"
    assert html_to_text("<table><tr><td>" * 2000 + "x") == "x"
