import itertools
import random
import time

from skarn.llm.blocks import INDEX, leaf_blocks
from skarn.llm.extract import extract_text, labelled_blocks, train


def texts(page):
    return [t for t, _ in leaf_blocks(page)]


def test_blocks_of_careless_markup():
    assert texts("<p>a <b>b</b>c<br>d<p>e &amp; f&nbsp;g</p>h") == ["a bc d", "e & f g", "h"]
    assert texts("<script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert texts("<head><title>t</title></head><body>x</body>") == ["x"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>cut <a hre") == ["cut"] and texts("<p>x<script>never ends") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts('<div title="a > b">1 < 2</div>') == ["1 < 2"]
    assert texts("") == [] and texts("plain\n\n text") == ["plain text"]


def test_comments_end_as_in_a_browser():
    for odd in ("<!-->", "<!--->", "<!-- x --!>", "<!-- a > b -- c -->", "<!---->", "<!-- <!-- -->", "<!doctype html>", "<!x>", "<?php ?>", "</ x>"):
        assert texts(f"<p>a</p>{odd}<p>b</p><p>c</p>") == ["a", "b", "c"], odd
    assert texts("<p>a</p><!-- never ends <p>b</p>") == ["a"] and texts("<p>a</p><!--x--!<p>b</p>-->c") == ["a", "c"]
    assert texts("wo<!-- x -->rd wo<!--->rd") == ["word word"]
    page = "<html><body><article>" + "".join(f"<p>Paragraph number {k} of this article has some words in it, and it ends here.</p><!-->" for k in range(5)) + "</article></body></html>"
    assert train().extract(page).count("\n") == 4
    began = time.perf_counter()
    leaf_blocks("<!--->" * 200_000 + "<!-- x -->" * 100_000 + "--!>")
    leaf_blocks("<!-- x -->" * 100_000)
    assert time.perf_counter() - began < 10


def test_inline_boxes_do_not_glue_words():
    assert texts("<div>a<button>go</button>text<input type=text>more<select><option>x</select>end<textarea>no</textarea>z</div>")[0].startswith("a go text more")
    assert texts("<div>left<textarea>no</textarea>right</div>") == ["left right"] and texts("<div>left<iframe>no</iframe>right</div>") == ["left right"]
    assert texts("<div>wo<b>r</b>d</div>") == ["word"]


def test_held_out_pages():
    model = train()
    wrong = total = 0
    for seed in range(50_000, 50_200):
        masks, labels, _ = labelled_blocks(seed)
        wrong += sum(a != b for a, b in zip(model.decode(masks), labels))
        total += len(labels)
    assert wrong / total < 0.01, (wrong, total)


def test_furniture_goes():
    page = """<html><head><title>T</title></head><body><header><div class=logo>Site</div><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies here. Agree?</p></div><form action=/s><label>Search</label></form><div class="ad">Buy this now.</div>
    <article><h1>The title</h1><p>First   paragraph with <i>some</i> words.</p><p>Second one, which is longer than the first, and ends here.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article very much.</p></div></section>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/r>Another story</a></ul></aside><footer>&copy; 2020 Site</footer><script>track()</script></body></html>"""
    assert train().extract(page) == "The title\nFirst paragraph with some words.\nSecond one, which is longer than the first, and ends here."


def test_pages(spark, sf):
    out = extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(out) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in out)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "y"), (1, "u", "<p>" + "word " * 100_000 + "</p>", "z")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in extract_text(odd).collect()), key=str)
    assert len(got) == 3 and (None, None, 0) in got and (1, "u", 0) in got
    assert extract_text(odd.limit(0)).count() == 0


def test_raw_elements_do_not_swallow_what_follows():
    texts = lambda page: [t for t, _ in leaf_blocks(page)]
    assert texts('<p>a</p><svg class="i"/><p>b</p><p>c</p>') == texts("<p>a</p><math/><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts('<p>a<svg><path d="x"></p><p>b</p>') == texts("<div><p>a</p><template><p>x</div><p>b</p>") == ["a", "b"]
    assert texts("<div><object data=x><p>a</p></div><noscript><p>b</p>") == ["a", "b"]
    assert texts("<head><title>t</title><p>a</p><p>b</p>") == texts("<head><meta charset=utf-8><title>t<p>a<p>b") == ["a", "b"]
    assert texts("<p>a <math><mi>x</mi></math> b <object>c</object> <noscript>d</noscript></p>") == ["a x b c d"]
    assert texts("<p>a</p><svg><title/></svg><p>b</p><svg><title>t</title><text>s</text></svg><template><div>u</div></template>") == ["a", "b"]


def test_custom_elements_and_attributes_go_by_their_whole_name():
    for odd in ("<svg-icon></svg-icon>", "<title-bar>", "<script-x>", "<style-guide></style-guide>", '<svg class="i"/>', '<iframe src="x"/>', "<textarea-x/>"):
        assert texts(f"{odd}<article><p>kept</p></article>") == ["kept"], odd
    hidden = INDEX["hidden"]
    mask = lambda attrs: leaf_blocks(f"<div {attrs}>x</div>")[0][1]
    assert not mask('aria-hidden="false"') >> hidden & 1 and not mask('title="hidden gem"') >> hidden & 1
    assert mask("hidden") >> hidden & 1 and mask('style="display: none"') >> hidden & 1
    ad = INDEX["named ad"]
    assert not mask('data-class="ad"') >> ad & 1 and mask("class=ad") >> ad & 1 and mask("CLASS='box ad'") >> ad & 1
    assert texts('<p>a<a href=/>b</a>c</p><p title="x > y" data-q=\'<p>\'>d') == ["abc", "d"]
    assert texts('<p>a</p><p title="never closed>b</p><p>c</p>') == ["a", "b", "c"]


def test_careless_pages_take_linear_time_and_no_recursion():
    for page in ('<a "' * 100_000, "<a x='" * 100_001, '<a x="' * 100_001, "<head><body>" * 10_000, "<title>" * 50_000, "<div" * 100_000, "<!-" * 100_000, "<a " + "b " * 200_000, "</" * 100_000):
        began = time.perf_counter()
        leaf_blocks(page)
        assert time.perf_counter() - began < 3, page[:20]


def test_viterbi_equals_enumeration():
    model, r = train(), random.Random(4)
    for _ in range(40):
        masks = labelled_blocks(60_000 + r.randrange(1000))[0]
        at = r.randrange(max(1, len(masks) - 9))
        masks = masks[at : at + r.randint(1, 9)]
        e = [model.score(m) for m in masks]
        value = lambda y: model.begin[y[0]] + sum(e[k][y[k]] for k in range(len(y))) + sum(model.move[y[k - 1]][y[k]] for k in range(1, len(y)))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(masks)), key=value)
        assert abs(value(best) - value(model.decode(masks))) < 1e-9
