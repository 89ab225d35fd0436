import html
import random
import time
from html.parser import HTMLParser

from factorlake.llm.html_extract import infer, main_text, main_texts, region, shape, stream

CHROME = {
    "nav": "<nav><ul>{}</ul></nav>",
    "div": '<div class="menu"><a href="/x">m</a>{}</div>',
}


def page(rnd, style, n):
    words = lambda k: " ".join(rnd.choice(["alpha", "béta", "R&D", "<tag>", "x  y", "\n"]) for _ in range(k))
    blocks = [words(rnd.randint(3, 30)) for _ in range(n)]
    want = "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)
    body = "".join(f"<p>{html.escape(b)}" + ("</p>" if rnd.random() < 0.7 else "") for b in blocks)
    links = "".join(f'<li><a href="/{i}">{rnd.random()}</a></li>' for i in range(rnd.randint(1, 6)))
    main = f"<article>{body}</article>" if style == 0 else f'<div id="content"><div class="text">{body}</div></div>'
    page_ = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h2>Site</h2></header>" + CHROME["nav" if style == 0 else "div"].format(links)
    page_ += f"<!-- {words(2)} --><div class='ad'>{html.escape(words(9))}</div><div class='cookie-notice'>Accept</div>{main}<form><p>Your mail</p><input></form>"
    return page_ + f'<div class="comments"><div class="comment"><p>{html.escape(words(12))}</p></div></div><aside><p>more</p></aside><footer>&copy; {rnd.random()}</footer>' + ("</body></html>" if rnd.random() < 0.8 else ""), want


def test_two_templates(spark):
    rnd = random.Random(9)
    data, want = [], {}
    for i in range(80):
        text, w = page(rnd, i % 2, rnd.randint(1, 9))
        data.append((i, f"https://h{i % 2}.example.com/{i}", text))
        want[i] = w
    data += [(100, None, None), (101, "http://h0.example.com", ""), (102, "x", "just text &amp; more"), (103, "x", "<p>cut <b>off"), (3, data[3][1], data[3][2])]
    want |= {100: "", 101: "", 102: "just text & more", 103: "cut off"}
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as region")
    for limit in (100_000, 0):
        got = main_texts(df, broadcast_limit=limit).collect()
        assert len(got) == len(data)
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert main_texts(df.limit(0)).count() == 0


def test_wrapper_has_slots_optional_and_repeated_groups():
    a = "<body><ul><li>1</li><li>2</li></ul><article><h1>A</h1><p>x</p></article></body>"
    b = "<body><ul><li>3</li></ul><hr><article><h1>B</h1><p>y</p><p>z</p></article></body>"
    kinds = {x[0] for x in infer([a, b])}
    assert {"<", ">", "s", "+", "?"} <= kinds and region(infer([a, b])) == "article"
    assert [*map(shape, infer([a, a]))] == [*map(shape, stream(a))]


def test_article_with_noise_inside():
    t = '<html><body><article><header><h1>T</h1></header><p>one<br>two &lt;x&gt;</p><aside>no</aside><div class="share">no</div><table><tr><td>a<td>b</table></article></body></html>'
    assert main_text(t, "article") == "T\none two <x>\na\nb"


def test_text_outside_the_biggest_block_stays():
    rnd = random.Random(4)
    words = lambda k: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.random()) for _ in range(k))
    shapes = {
        "title": ('<div id="content"><h1>{}</h1><div class="text"><p>{}</p></div></div>', (3, 60)),
        "lead": ('<div class="c"><p>{}</p><div class="text"><p>{}</p><p>{}</p></div></div>', (9, 40, 40)),
        "sections": ("<div><section class='a'><p>{}</p></section><section class='b'><p>{}</p></section></div>", (70, 30)),
        "list": ('<div class="c"><div class="text"><p>{}</p></div><ul><li>{}</li><li>{}</li></ul></div>', (50, 5, 5)),
    }
    for form, sizes in shapes.values():
        pages = []
        for _ in range(6):
            t = [words(k) for k in sizes]
            pages.append(("<body><div class='menu'>m</div>" + form.format(*t) + "<footer>f</footer></body>", "\n".join(t)))
        where = region(infer([p for p, _ in pages]))
        assert [main_text(p, where) for p, _ in pages] == [w for _, w in pages]


def test_a_long_list_page_is_no_region():
    lists = "<body><div class='text'><ul>" + "".join(f"<li>item {i}</li>" for i in range(500)) + "</ul></div></body>"
    prose = "<body><div class='text'><p>one</p><ul><li>a</li></ul><p>two</p></div></body>"
    for tag in ("ul", "table", "dl", "pre", "blockquote"):
        a, b = (x.replace("ul>", f"{tag}>") for x in (lists, prose))
        where = region(infer([a, b]))
        assert where == "/body div.text" and main_text(b, where) == "one\na\ntwo"


def test_every_page_of_a_host_is_inferred_from(spark):
    rnd = random.Random(8)
    words = lambda k: " ".join(str(rnd.random()) for _ in range(k))
    data, want = [], {}

    def add(host, page_, text):
        data.append((len(data), f"http://{host}/{len(data)}", f"<html><body>{page_}</body></html>"))
        want[data[-1][0]] = text

    for h in range(4):
        for i in range(40):  # one page alone has another text in the line that seems to be the template's
            line, a, b = "The daily" if i != 5 * h else "Only here", words(20), words(30)
            add(f"line{h}", f'<div class="line">{line}</div><div class="text"><p>{a}</p><p>{b}</p></div>', f"{line}\n{a}\n{b}")
        for i in range(20):  # the template's own text stays out where all pages agree
            a = words(20)
            add(f"same{h}", f'<div class="line">The daily</div><div class="text"><p>{a}</p></div>', a)
        for i in range(30):  # a second template, with an article as a teaser beside the text
            a, b = words(20), words(3)
            other = i == 3 * h
            add(f"two{h}", f'<article><p>{b}</p></article><div class="text"><p>{a}</p></div>' if other else f"<article><p>{a}</p></article>", f"{b}\n{a}" if other else a)
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for parts in (1, 7):
        assert {r.page_id: r.text for r in main_texts(df.repartition(parts)).collect()} == want


def test_long_records_are_one_repeated_group():
    record = "".join(f"<h2>{{0}}</h2><div class='c{i}'><p>{{0}}</p></div>" for i in range(9))  # 72 nodes
    for n in (2, 3, 7):
        got = stream("<article>" + "".join(record.format(k) for k in range(n)) + "</article>")
        assert [x[0] for x in got] == ["<", "+", ">"] and len(got[1][1]) == 72
        assert {x[0] for x in got[1][1]} == {"<", ">", "s"}


class Plain(HTMLParser):
    """A second reader for well-formed pages: everything of the article or the body that is not in a nav, aside, form and so on."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], []

    def end(self):
        t = " ".join("".join(self.now).split())
        self.blocks += [t] * bool(t)
        self.now = []

    def handle_starttag(self, tag, attrs):
        c = set((dict(attrs).get("class") or "").split())
        if tag not in ("b", "i", "a", "span", "br"):
            self.end()
        if tag not in ("br", "hr", "img", "input"):
            self.open.append((tag, tag in ("nav", "aside", "form", "footer", "header", "head", "script", "style") or bool(c & {"ad", "menu", "comments", "cookie-notice"})))
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "span", "br"):
            self.end()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n for _, n in self.open):
            self.now.append(data)


def test_matches_a_plain_reader(spark):
    rnd = random.Random(12)
    words = lambda k: " ".join(rnd.choice(["alpha", "béta", "R&amp;D", "&lt;x&gt;", "x &nbsp; y", "\n", "<b>bold</b>", "<i>it</i>al", "one<br>two"]) for _ in range(k))

    def block(depth):
        kind = rnd.choice(["p", "p", "h2", "div", "ul", "table", "blockquote", "section"])
        if kind in ("div", "section", "blockquote") and depth:
            return f"<{kind}>" + "".join(block(depth - 1) for _ in range(rnd.randint(1, 3))) + f"</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(3)}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{words(2)}</td>" for _ in range(3)) + "</tr></table>"
        return f"<{kind}>{words(8)}</{kind}>"

    data, want = [], {}
    for i in range(120):
        noise = rnd.sample([f"<nav><ul><li>{words(2)}</li></ul></nav>", f"<aside>{words(4)}</aside>", f"<form><p>{words(3)}</p></form>", f'<div class="ad">{words(5)}</div>', f'<div class="comments"><p>{words(40)}</p></div>', f'<div class="cookie-notice">{words(2)}</div>', f"<footer>{words(2)}</footer>", "<script>if (a < b) c('</p>');</script>"], 5)
        main = "".join(block(2) for _ in range(rnd.randint(2, 6))) + f"<p>{words(30)}</p>"
        t = f"<html><head><title>T</title></head><body>{noise[0]}{noise[1]}<article>{main}{noise[2]}</article>{noise[3]}{noise[4]}</body></html>"
        data.append((i, f"http://h{i % 3}/{i}", t))
        plain = Plain()
        plain.feed(t)
        plain.close()
        plain.end()
        want[i] = "\n".join(plain.blocks)
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == want


def test_article_text_is_not_lost():
    cases = {
        '<div class="page side-panel-open"><p>all of it</p></div>': "all of it",
        '<body class="has-comments"><div class="with-sidebar"><p>one</p><p>two</p></div></body>': "one\ntwo",
        '<div id="search"><h1>T</h1><p>about searching</p></div><div class="related">more</div>': "T\nabout searching",
        '<div class="share"><article><p>kept</p></article></div><div class="comments"><p>a very long comment that is longer than all</p></div>': "kept",
        "<article><p>let <math><mi>x</mi></math> be</p></article>": "let x be",
        "<article><p>a</p><fieldset><p>b</p></fieldset><dialog>c</dialog><label>d</label><menu><li>e</li></menu></article>": "a\nb\nc\nd\ne",
        '<article><p title="it>broken</p><p>next</p></article>': "broken\nnext",
        "<article><p title='x>y'>quoted</p><p a=\"1\" b>z</p></article>": "quoted\nz",
        '<article><p>text</p></article><dialog>subscribe</dialog><select><option>en</option></select><button>ok</button>': "text",
    }
    for page_, text in cases.items():
        assert main_text(page_, None) == text, page_


def test_long_pages_take_seconds():
    rnd = random.Random(1)
    began = time.process_time()
    pages = []
    for k in range(4):
        body = "".join(rnd.choice([f"<p>{rnd.random()} " + "w " * 30 + "</p>", f"<h2>{rnd.random()}</h2>", f"<ul><li>{rnd.random()}</li></ul>", f"<div class='c{rnd.randrange(9)}'><p>{rnd.random()}</p></div>"]) for _ in range(12_000))
        pages.append(f"<body><div class='text'>{body}</div></body>")
    assert sum(map(len, pages)) > 2_000_000
    where = region(infer(pages))
    assert where.startswith("/body div.text") and len(main_text(pages[0], where).split("\n")) == 12_000
    assert time.process_time() - began < 60
