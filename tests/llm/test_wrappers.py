import html
import random
import re

import pytest

WORDS = "the of ende straße où qu'il año wind river stone light x&y a<b 100% “so” naïve".split()


def say(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 7, "y") for i, u, h in rows], "page_id long, url string, html string, host string, n long, wrapper string")


def of(df):
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in df.collect()), key=repr)


def test_streams():
    from turnframe.llm.wrappers import parsed

    def shape(page):
        def short(n):
            return n[4] if n[0] == "#" else [n[0], *map(short, n[3])]

        return [short(n) for n in parsed(page)]

    assert shape("<div class='a1 B'><p>x <b>y</b>z<p>q</div>r") == [["div.a.b", ["p", "x yz"], ["p", "q"]], "r"]
    assert shape("<ul><li>a<li>b</ul><p>c<br>d &amp; e&nbsp;&#x41;&lt;p&gt;") == [["ul", ["li", "a"], ["li", "b"]], ["p", "c d & e A<p>"]]
    assert shape("<script>if (a<b) '</p>'</script>x<!-- <p>no</p> -->y<style>z") == ["xy"]
    assert shape("</p></div>a</b>") == ["a"] and shape("") == [] and shape("a < b > c") == ["a < b > c"]
    assert shape("<p title=\"a>b\">x</p><p title=don't>y</p><div class=\"z") == [["p", "x"], ["p", "y"]]
    assert shape("<!-- open <p>x") == [] and shape("a<!-- b --") == ["a"]
    assert shape("<div>" * 300 + "deep" + "</div>" * 300)[0][0] == "div"
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == [["table", ["tr", ["td", "a"], ["td", "b"]], ["tr", ["td", "c"]]]]


def test_inference_of_optional_and_repeated_groups():
    from turnframe.llm.wrappers import merged, parsed, wrapper_of

    def expression(nodes):
        out = []
        for label, optional, repeated, kids, *_ in nodes:
            own = ("=" if kids[0] else "#") if label == "#" else f"({expression(kids)})" if label == "*" else f"<{label}>{expression(kids)}"
            out.append(own + ("+" if repeated else "") + ("?" if optional else ""))
        return " ".join(out)

    def wrapper(*pages):
        whole = wrapper_of(parsed(pages[0]))
        for p in pages[1:]:
            whole = merged(whole, wrapper_of(parsed(p)))
        return expression(whole)

    assert wrapper("<h1>a</h1><p>b</p>") == "<h1>= <p>="
    assert wrapper("<h1>a</h1><p>b</p>", "<h1>a</h1><p>c</p>") == "<h1>= <p>#"
    assert wrapper("<h1>a</h1><p>b</p>", "<h1>a</h1><div>n</div><p>c</p>") == "<h1>= <div>=? <p>#"
    assert wrapper("<h1>a</h1><div>n</div><p>c</p>", "<h1>a</h1><p>b</p>") == "<h1>= <div>=? <p>#"
    assert wrapper("<h1>a</h1><p>b</p>", "<h1>c</h1><p>b</p><p>d</p><p>e</p>") == "<h1># <p>#+"
    assert wrapper("<ul><li>a<li>b</ul>", "<ul><li>a<li>b</ul>") == "<ul><li>=+"  # a repeated part of the template
    group = wrapper("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>e</h2><p>f</p>", "<h2>x</h2><p>y</p><p>z</p><h2>v</h2>")
    assert group.startswith("(<h2>") and group.endswith(")+") and "<p>" in group
    wide = "".join(f"<div class='{chr(97 + k // 26)}{chr(97 + k % 26)}'>t{k}</div>" for k in range(200))
    assert wrapper(wide).startswith("(<div.aa>") and wrapper(wide).endswith(")+")


def article(r, n):
    title, body = say(r, 6), [say(r, r.randrange(8, 60)) for _ in range(n)]
    return title, body, " ".join([title, *body])


def esc(t):
    return html.escape(t, quote=False)


def semantic(r, k):
    title, body, want = article(r, r.randrange(1, 6))
    ads = f"<div class='ad-slot'>{esc(say(r, 9))}</div>" if r.random() < 0.5 else ""
    paragraphs = [f"<p>{esc(b)}</p>" if r.random() < 0.7 else f"<p>{esc(b)}" for b in body]
    paragraphs.insert(r.randrange(len(body) + 1), ads)
    comments = "".join(f"<article class='comment'><p>{esc(say(r, 20))}</p></article>" for _ in range(r.randrange(4)))
    return (
        f"<html><head><title>{esc(title)}</title><script>var p='<p>no</p>';</script></head><body class='has-sidebar'><header><h1>The Daily</h1></header><nav><a href=/>Home</a> <a href=/x>X</a></nav>"
        f"<main><article class='post'><header><h1>{esc(title)}</h1></header>{''.join(paragraphs)}<form action=/s><label>Mail</label><input name=a> Subscribe</form><footer>Tags: stone</footer></article>"
        f"<section id='comments'><h3>{r.randrange(9)} comments</h3>{comments}</section></main><aside><p>{esc(say(r, 12))}</p></aside><div class='cookie-notice' role='dialog'>We use cookies &amp; more.</div><footer>&copy; Daily</footer></body></html>",
        want,
    )


def named(r, k):
    title, body, want = article(r, r.randrange(2, 7))
    return (
        f"<body><div id='site-header'>The Site</div><ul class='mainMenu'><li><a href=/>Home</a><li><a href=/b>B</a></ul><div id='wrap'><div class='post-content'><h1>{esc(title)}</h1>{''.join(f'<div>{esc(b)}</div>' for b in body)}"
        f"<div class='share-buttons'>Share this</div></div><div class='sidebar'><p>{esc(say(r, 30))}</p></div></div><div class='reader-comments'><p>{esc(say(r, 25))}</p></div><script>x()</script></body>",
        want,
    )


def unnamed(r, k):
    title, body, want = article(r, r.randrange(3, 8))
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("News", "Sport", "Culture"))
    return f"<body><div class='c1'><ul>{menu}</ul></div><div class='c2'><h1>{esc(title)}</h1>{''.join(f'<p>{esc(b)}</p>' for b in body)}<div>All rights reserved by the house.</div></div><div class='c3'>Call us at any hour of the day.</div></body>", want


@pytest.mark.parametrize("template", [semantic, named, unnamed])
def test_main_text_of_templates(spark, template):
    from turnframe.llm.wrappers import main_texts

    r = random.Random(7)
    pages = [(k, f"https://{'big' if k % 3 else f'h{k % 2}'}.example.org/{k}", *template(r, k)) for k in range(90)]
    want = sorted(((i, u, w, len(w)) for i, u, _, w in pages), key=repr)
    df = frame(spark, [p[:3] for p in pages])
    assert of(main_texts(df.repartition(7))) == want
    assert of(main_texts(df.coalesce(1), broadcast=10)) == want


def test_many_parts_of_a_host(spark, monkeypatch):
    from turnframe.llm import wrappers

    r = random.Random(8)
    monkeypatch.setattr(wrappers, "FAN", 2)
    pages = [(k, "http://one.example.org/", *(semantic if k % 2 else named)(r, k)) for k in range(60)]
    df = frame(spark, [p[:3] for p in pages]).repartition(24)
    assert wrappers.host_wrappers(df.withColumn("host", wrappers.host_of(df.url))).count() == 1
    assert of(wrappers.main_texts(df)) == sorted(((i, u, w, len(w)) for i, u, _, w in pages), key=repr)


def test_edges(spark):
    from turnframe.llm.wrappers import op13_wrappers

    rows = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (None, None, "<p>x"), (None, None, "<p>x"), (2**60 + 1, "no url", "plain"), (5, "http://b.example", "<nav>only</nav>"), (6, "http://c.example", "\x00 ퟿ <p>é")]
    want = [(1, "http://a.example/x", "", 0), (2, "http://a.example/x", "", 0), (None, None, "x", 1), (None, None, "x", 1), (2**60 + 1, "no url", "plain", 5), (5, "http://b.example", "", 0), (6, "http://c.example", "\x00 ퟿ é", 5)]
    assert of(op13_wrappers(frame(spark, rows))) == sorted(want, key=repr)
    assert of(op13_wrappers(frame(spark, []))) == []
    long = "<article><h1>t</h1>" + "".join(f"<p>{k} word</p><ul><li>{k}</ul>" for k in range(20000)) + "</article><nav><p>no</p></nav>"
    copies = [(k, "http://d.example/", long if k == 3 else "<article><h1>same</h1><p>same text</p></article><div class=ad>same ad</div>") for k in range(6)]
    got = of(op13_wrappers(frame(spark, copies)))
    assert [x[2] for x in got if x[0] != 3] == ["same same text"] * 5
    assert [x[2] for x in got if x[0] == 3] == [" ".join(["t", *(f"{k} word {k}" for k in range(20000))])]


def test_given_pages(spark):
    from turnframe.llm.wrappers import op13_wrappers

    at = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = []
    for r in at.collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<(?=/?(?:p|br|h1)\b)[^>]*>", " ", re.sub(r"</?b>", "", own))).split())
        want.append((r.page_id, r.url, text, len(text)))
    assert of(op13_wrappers(at)) == sorted(want, key=repr)
