"""Page extraction: classes against vectors that are gathered, texts against what the pages were made of."""

import random
from collections import Counter, defaultdict

import pytest
from chronogrid.llm import page_text
from chronogrid.llm.page_blocks import blocks


def text_of(page):
    return page_text.main_text(blocks(page)[0], {})


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Hello &amp world&nbsp;x<p>two<br>three<div class='sidebar'>no</div><footer>f</footer>", "Hello & world x two three"),
        ("<header>top</header><article><header><h1>T</h1><span>by</span></header>x<b>y</b>z<div id=comments><p>c</div></article> tail", "T xyz"),
        ("<script>a</scr", ""), ("<style>p{}</STYLE >b", "b"), ("<p title=\"un>closed", "\"un>closed"),
        ("<main>m<form>f</form> n<section class='comment-list'><article>c</article></section></main><aside>q</aside>", "m n"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<![CDATA[x<y&lt;]]>z <!-- never closed", "x<y&lt;z"), ("a < b &lt; c", "a < b < c"), ("&am<b>p;</b>", "&amp;"),
        ("<div class='page sidebar-right'><article>in</article></div>", "in"), ("<nav><article>no</article></nav>yes", "yes"),
        ("<div hidden>h</div><p style='display: none'>h</p><p>s", "s"), ("<script>var t='</p><article>no</article>'</script><p>y</p></div></p>", "y"),
        ("", ""), ("   \n\t ", ""), ("plain", "plain"), ("<article></article><p>outside</p>", "outside"),
        ("<article><div class=ad>Buy</div><p>a\n\n b</p><div class='cookie-notice'>c</div><aside>d</aside><p>e</article>", "a b e"),
        ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_single_pages(page, text):
    assert text_of(page) == text


def site(rng, host, n, article=True):
    """Pages of one host with a fixed frame and wording, and their texts."""
    out = []
    for k in range(n):
        paragraphs = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        menu = "".join(f"<li><a href=/{rng.random()}>m{rng.randrange(99)}</a>" for _ in range(rng.randint(1, 6)))
        inner = f"<h1>head{k}</h1>{body}<div class=x1>Sent to you by {host} daily</div>"
        frame = f"<article>{inner}</article>" if article else f"<div class=b7>{inner}</div>"
        head = "<div class=q4>Welcome to our pages</div>"
        out.append((f"http://{host}/{k}", f"<html><body><ul class=menu>{menu}</ul>{head}{frame}<footer>&copy; {host}</footer>" + "</body></html>" * (k % 3 > 0), " ".join([f"head{k}", *paragraphs])))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = site(rng, "hot.example.org", 60) + site(rng, "plain.example.org", 20, article=False) + site(rng, "few.example.org", 3)
    copy = site(rng, "copies.example.org", 1)[0]
    made += [copy] * 9 + [(None, "<p>no url", "no url"), ("http://none.example", None, ""), ("not a url", "<p>x", "x"), ("http://none.example", "", "")]
    return [(k if k % 11 else None, *r) for k, r in enumerate(made)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 5) for i, u, h, _ in rows], "page_id long, url string, html string, token string, site int").repartition(5)


def test_texts_without_template_wording(spark, rows):
    want = []
    for i, url, _, text in rows:
        fixed = ["Sent to you by few.example.org daily"] if url and "few." in url else ["Sent to you by copies.example.org daily"] if url and "copies." in url else []
        want.append((i, url, " ".join([text, *fixed]), len(" ".join([text, *fixed]))))
    got = [tuple(r) for r in page_text.extract(pages(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_same_by_exchange(spark, rows):
    a = page_text.extract(pages(spark, rows), settings=page_text.Settings(broadcast_bytes=0, salts=3))
    b = page_text.extract(pages(spark, rows))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_classes_are_those_of_gathered_vectors(spark, rows):
    settings = page_text.Settings()
    sited = page_text._sited(pages(spark, rows), "page_id", "url", "html")
    got = defaultdict(set)
    for r in page_text.classes(sited, settings).collect():
        got[r.site, r["class"], r.everywhere].add(r.token)
    vectors = defaultdict(dict)
    hosts = defaultdict(list)
    for k, r in enumerate(sited.where("site IS NOT NULL AND html <> ''").collect()):
        hosts[r.site].append(r.html)
        for t, n in Counter(page_text.page_tokens(*blocks(r.html))).items():
            vectors[r.site, t][k] = n
    want = defaultdict(set)
    for (s, t), v in vectors.items():
        if len(set(hosts[s])) >= 5 and len(v) >= max(5, len(hosts[s]) / 2):
            want[s, tuple(sorted(v.items())), len(v) == len(hosts[s]) and max(v.values()) == 1].add(t)
    assert sorted((s, e, sorted(m)) for (s, _, e), m in got.items()) == sorted((s, e, sorted(m)) for (s, _, e), m in want.items())
    assert len(want) > 3


def test_a_class_out_of_order_is_not_valid(spark):
    rows = [(k, f"http://h.example/{k}", f"<div><p>text{k} one</p><p class=y>{'beta alpha' if k == 3 else 'alpha beta'}</p></div>", "") for k in range(8)]
    got = {r.page_id: r.text for r in page_text.extract(pages(spark, rows)).collect()}
    assert got == {k: "text3 one beta alpha" if k == 3 else f"text{k}" for k in range(8)}


def test_order_repeats_and_gaps():
    members = {1: ("all", 0, True), 2: ("all", 1, True), 3: ("row", 0, False), 4: ("row", 1, False), 5: ("one", 0, False)}
    keep = {1: True, 2: True}
    assert page_text.valid_here([1, 3, 9, 4, 3, 4, 2], members) == keep | {3: False, 4: False}
    assert page_text.valid_here([1, 3, 4, 3, 2], members) == keep
    assert page_text.valid_here([1, 3, 2, 4], members) == keep
    assert page_text.valid_here([2, 5, 1], members) == {5: False}


def test_empty_table(spark):
    assert page_text.extract(pages(spark, [])).count() == 0
