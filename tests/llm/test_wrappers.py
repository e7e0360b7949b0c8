import random

from tablemend.llm import wrappers as W

from .conftest import words


def extract(source, others=()):
    wrapper = W.folded(W.page(source))
    for other in others:
        W._join(wrapper, W.folded(W.page(other)))
    return W.extract(source, {k: frozenset(v) for k, v in W.slots_of(wrapper).items()})


def site(rng, body, extra=""):
    menu = "".join(f'<li><a href="/{i}">{words(rng, 1)}</a></li>' for i in range(rng.randint(2, 7)))
    return (
        f"<!DOCTYPE html><html><head><title>{words(rng, 4)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        f"<body><nav><ul>{menu}</ul></nav><!-- <p>no</p> --><div class='ad'>{words(rng, 5)}</div>{extra}"
        f"<article>{body}</article><footer>&copy; {words(rng, 3)}</footer></body></html>"
    )


def test_article_without_what_surrounds_it():
    page = (
        '<body><div class="cookie-notice">We use <b>cookies</b></div><main><div class="sidebar">x</div><article>'
        "<h1>T &amp; t&#233;</h1><p>A <a href=x>li</a>nk\n  b<p>C<br>d&nbsp;e <div id=comments><p>reader</p></div>"
        "<aside>side</aside></article></main><form>q<input></form><script>if (a<b) {}</script></body>"
    )
    assert extract(page) == "T & té A link b C d e"


def test_odd_sources():
    assert [extract(s) for s in (None, "", "   ", "plain &lt; text", "<p>a<p>b<nav>n", "a < b > c", "<p title='x>y'>z")] == [
        "", "", "", "plain < text", "a b", "a < b > c", "z",
    ]
    assert extract("<article><p>open <b>never closed") == "open never closed"
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert extract(deep) == "core"


def test_template_text_without_landmarks():
    rng = random.Random(1)
    pages = [f"<body><div>Welcome to the site</div><section><p>{words(rng, 30)}</p></section><div>All rights kept</div></body>" for _ in range(6)]
    assert extract(pages[0], pages[1:]) == pages[0].split("<p>")[1].split("</p>")[0]


def test_wrapper_is_an_expression_with_groups():
    first = W.folded(W.page("<ul><li>a</li><li>b</li></ul><h2>x</h2><p>1</p><h2>y</h2><p>2</p>"))
    assert W.expression(first) == "<ul>(<li>#</>)+</>(<h2>#</>)+(<p>#</>)+"
    W._join(first, W.folded(W.page("<ul><li>a</li></ul><hr><div>new</div><h2>z</h2><p>3</p>")))
    assert W.expression(first) == "<ul>(<li>#</>)+</>(<div>#</>)?(<h2>#</>)+(<p>#</>)+"
    again = W.Block.unpacked(first.packed())
    assert W.expression(again) == W.expression(first)


def test_pages_by_host(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for i in range(120):
        paragraphs = [words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        title = words(rng, 3)
        host = "hot.example.org" if i % 3 else f"h{i % 9}.example.net"
        extra = f"<div class='notice'>{words(rng, 3)}</div>" if i % 5 == 0 else ""
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"https://{host}/{i}?x=1", site(rng, body, extra), "clash", 3))
        expected[i] = " ".join([title, *paragraphs])
    rows += [(500, None, None, "", 0), (501, "nonsense", "", "", 0), (502, "", "<p>loose", "", 0), (3, *rows[3][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int").repartition(5)
    found = W.extracted(pages).collect()
    assert len(found) == len(rows) and all(r.text == expected[r.page_id] for r in found if r.page_id < 500)
    assert {r.page_id: r.text for r in found if r.page_id >= 500} == {500: "", 501: "", 502: "loose"}
    assert W.extracted(pages.limit(0)).count() == 0


def test_wrappers_joined_when_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/", site(rng, f"<p>text {i}</p>")) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in W.extracted(pages).collect()} == {i: f"text {i}" for i in range(8)}


def test_only_whole_raw_names_are_left_out():
    for odd in ("<svg-icon name=x></svg-icon>", "<title-bar></title-bar>", "<select-box></select-box>", "<svg width=1 />", "<object data='x'/>"):
        assert extract(f"<body>{odd}<article><p>one</p>{odd}<p>two</p><svg><g><path/></g><text>no</text></svg></article></body>") == "one two"
    for odd in ("<svg><path d=1>no", "<object>no", "<select><option>no"):
        assert extract(f"<article><div>{odd}</div><p>rest</p></article>") == "rest"


def test_roles_and_ends_at_any_depth():
    for n in (39, 45, 2000):
        deep = "<div>" * n + "<nav>menu</nav><p>core</p><aside>side</aside>" + "</div>" * n
        assert extract(f"<div><article><p>before</p>{deep}<p>after</p></article>tail</div>") == "before core after"
        assert extract("<div>" * n + "<p>loose</p><article>core</article>" + "</div>" * n) == "core"
    wrapper = W.folded(W.page("<div>" * 2000 + "core"))
    W._join(wrapper, W.folded(W.page("<div>" * 2000 + "other")))
    assert W._load(W.json.dumps(wrapper.packed())).packed() == wrapper.packed()


def test_names_alone_drop_no_part_of_an_article():
    body = (
        '<div class="article-header"><h1>T</h1></div><figure><img src=x><figcaption>caption</figcaption></figure>'
        '<section id="related-work"><p>earlier work</p></section><section id="discussion"><p>we find</p></section>'
    )
    own = '<div class="related"><a href=x>more of this</a></div><div class="sidebar">x</div><div id="search"><form>q</form></div>'
    assert extract(f"<article>{body}{own}</article>") == "T caption earlier work we find"
    pages = [f"<article><p>text {i}</p><div class='alert'>same words</div></article>" for i in range(5)]
    assert extract(pages[0], pages[1:]) == "text 0"


def test_copies_are_no_evidence():
    one = "<body><h1>Title</h1><p>whole text</p></body>"
    for n in range(1, 9):
        assert extract(one, [one.replace("<body>", f"<body><!-- {i} --><nav>at {i}</nav>") for i in range(n - 1)]) == "Title whole text"
