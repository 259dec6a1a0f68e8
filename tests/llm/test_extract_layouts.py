"""Pages written by hand, in layouts that the generator of training pages does not know, with the text that is expected."""

import pytest

from skarn.llm.extract import train

A = "The river rose overnight, and by the morning most of the lower fields were under water, as they had been ten years before."
B = "Farmers moved their animals to the hills while it was still dark; nobody was hurt, but several barns were lost."
C = "\"We knew that it would come,\" said one of them, \"but not how fast it would be here when it did.\""
D = "The council meets again on Thursday to decide about the old dam, which engineers had called unsafe in two reports."
E = "Until then the road along the bank stays closed."
TITLE = "High water takes the valley by surprise"


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = {
    "bare html of the nineties": (f"<html><body bgcolor=white><table width=100%><tr><td><a href=/>Start</a> | <a href=/map>Map</a> | <a href=/mail>Mail</a></td></tr></table><h1>{TITLE}</h1><p>{A}<p>{B}<p>{C}<hr><font size=1>&copy; 1998 The Valley Web</font></body></html>", [TITLE, A, B, C]),
    "layout by tables": (f"<table><tr><td class=menu><a href=/a>News</a><br><a href=/b>Sport</a><br><a href=/c>Weather</a></td><td class=content><h2>{TITLE}</h2>{p(A, B, D)}</td><td class=sidebar><b>Related</b><ul><li><a href=/x>Other story</a></li></ul></td></tr></table>", [TITLE, A, B, D]),
    "blog": (f"<body class=blog><div id=masthead><a href=/>My valley diary</a></div><div id=primary><div class=post><h2 class=entry-title>{TITLE}</h2><div class=entry-content>{p(A, B, C, D)}</div></div><div id=comments><h3>2 comments</h3><ol class=commentlist><li><p>Great post, thanks a lot!</p></li><li><p>I was there too.</p></li></ol></div></div><div id=secondary class=widget-area><h3>Archives</h3><ul><li><a href=/1>May</a></li></ul></div><div id=colophon>Powered by words</div></body>", [TITLE, A, B, C, D]),
    "html5 with two navs": (f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><main><article><header><h1>{TITLE}</h1></header>{p(A, B)}<h2>What comes next</h2>{p(D, E)}</article></main><nav class=pagination><a href=/2>Next page</a></nav><footer><p>All rights reserved.</p></footer></body>", [TITLE, A, B, "What comes next", D, E]),
    "divs only": (f"<div class=page><div class=topbar><a href=/>Home</a><a href=/login>Sign in</a></div><div class=story><div class=headline>{TITLE}</div><div class=body><div>{A}</div><div>{B}</div><div>{C}</div></div></div><div class=bottom><a href=/privacy>Privacy</a><a href=/terms>Terms</a></div></div>", [TITLE, A, B, C]),
    "quote and list in the text": (f"<article><h1>{TITLE}</h1>{p(A)}<blockquote><p>{C}</p></blockquote><ul><li>{B}</li><li>{D}</li></ul>{p(E)}</article><aside class=related><ul><li><a href=/q>More about rivers</a></li></ul></aside>", [TITLE, A, C, B, D, E]),
    "cookie wall and newsletter": (f"<div id=cookie-consent role=dialog><p>We use cookies to make this page better for you. Do you agree with that?</p><button>Yes</button></div><main><h1>{TITLE}</h1>{p(A, B)}<div class=newsletter-signup><p>Get our letter every morning, free of charge.</p><form><input type=email><button>Subscribe</button></form></div>{p(D)}</main>", [TITLE, A, B, D]),
    "share buttons between paragraphs": (f"<article><h1>{TITLE}</h1><div class=share-buttons><a href=#>Tweet</a> <a href=#>Share</a></div>{p(A, B)}<div class=social-share><a href=#>Tweet</a></div>{p(C, D)}</article>", [TITLE, A, B, C, D]),
    "advert in the text": (f"<article><h1>{TITLE}</h1>{p(A)}<div class=ad-slot><span>Advertisement</span><p>Buy two boats and pay for one, only this week.</p></div>{p(B, C)}</article><footer>Contact us</footer>", [TITLE, A, B, C]),
    "breadcrumbs and tags": (f"<ol class=breadcrumb><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ol><div class=article><h1>{TITLE}</h1>{p(A, B, D)}<ul class=tags><li><a href=/t/r>river</a></li><li><a href=/t/f>flood</a></li></ul></div>", [TITLE, A, B, D]),
    "comments by readers": (f"<main><article><h1>{TITLE}</h1>{p(A, B)}</article><section class=comment-section><h2>Comments</h2><article class=comment><p>My grandfather told us about the flood of the year that he was born in, and it was just like this one.</p></article></section></main>", [TITLE, A, B]),
    "figure and caption links": (f"<article><h1>{TITLE}</h1>{p(A)}<figure><img src=a.jpg></figure>{p(B, D)}</article><div class=recommended><h4>Recommended</h4><a href=/1>One</a><a href=/2>Two</a></div>", [TITLE, A, B, D]),
    "links in the text": (f"<main><h1>{TITLE}</h1><p>The <a href=/river>river</a> rose overnight, and by the morning most of the <a href=/f>lower fields</a> were under water, as they had been ten years before.</p>{p(B)}</main><footer><ul><li><a href=/a>About</a></li></ul></footer>", [TITLE, A, B]),
    "scripts and styles everywhere": (f"<html><head><style>p {{ color: red }}</style><script>var a = '<p>no</p>';</script></head><body><script>f()</script><article><h1>{TITLE}</h1><p>{A}<script>track('x')</script></p><style>b{{}}</style>{p(B)}</article><noscript></noscript></body></html>", [TITLE, A, B]),
    "character references": ("<article><h1>Fish &amp; water</h1><p>Prices rose by 5&nbsp;&euro; in a week, said the shop&#8217;s owner, who had sold&#x20;nearly all of the boats that he had left by then.</p>" + p(B) + "</article>", ["Fish & water", "Prices rose by 5 € in a week, said the shop’s owner, who had sold nearly all of the boats that he had left by then.", B]),
    "white space and breaks": (f"<article><h1>\n  {TITLE}\n</h1><p>{A.replace(' ', chr(10) + '   ')}</p><p>{B.replace('; ', ';<br>')}</p></article>", [TITLE, A, B]),
    "search form and login": (f"<header><form role=search><label>Search</label><input name=q><button>Go</button></form><div class=login><a href=/in>Sign in</a></div></header><main><article><h1>{TITLE}</h1>{p(A, B, C)}</article></main>", [TITLE, A, B, C]),
    "unclosed paragraphs": (f"<div id=content><h1>{TITLE}</h1><p>{A}<p>{B}<p>{D}</div><div id=footer>Copyright 2011 Valley Press</div>", [TITLE, A, B, D]),
    "sections": (f"<article><h1>{TITLE}</h1><section><h2>The night</h2>{p(A, B)}</section><section><h2>The day after</h2>{p(C, D)}</section></article><aside><h3>Most read</h3><ol><li><a href=/1>Storm</a></li></ol></aside>", [TITLE, "The night", A, B, "The day after", C, D]),
    "odd comments": (f"<article><!--><h1>{TITLE}</h1><!---><p>{A}</p><!-- ad --!><p>{B}</p></article>", [TITLE, A, B]),
    "menu only": ("<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/c>Contact</a></li></ul></nav><footer><p>&copy; 2020</p></footer>", []),
    "a page for phones": (f"<div class=m-header><a class=logo href=/>Valley</a><a class=menu-toggle href=#>Menu</a></div><div class=m-article><h1>{TITLE}</h1><div class=text>{p(A, B, C)}</div></div><div class=m-footer><a href=/full>Full site</a></div>", [TITLE, A, B, C]),
}


def words(lines):
    return [w for line in lines for w in line.split()]


@pytest.fixture(scope="module")
def results():
    model = train()
    return {name: (model.extract(page).split("\n") if model.extract(page) else [], want) for name, (page, want) in PAGES.items()}


def test_most_layouts_come_out_exactly(results):
    wrong = [name for name, (got, want) in results.items() if got != want]
    assert len(wrong) <= 3, wrong


def test_paragraphs_stay_and_furniture_goes(results):
    right = kept = expected = 0
    for got, want in results.values():
        have, need = words(got), words(want)
        expected, kept = expected + len(need), kept + len(have)
        pool = list(need)
        for w in have:
            if w in pool:
                pool.remove(w)
                right += 1
    assert right / expected > 0.98 and right / kept > 0.98, (right, kept, expected)
