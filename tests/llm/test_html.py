import random

from lexloom.llm import html


def page(seed: int, host: str = "a.example.com", kind: str = "article") -> tuple[str, str, str]:
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    blocks, text = [], []
    for _ in range(rnd.randrange(1, 9)):
        t = words(rnd.randrange(5, 40))
        if rnd.random() < 0.3:
            blocks.append(f"<p><b>{t} &amp; x<br>")
            text.append(f"{t} & x")
        else:
            blocks.append(f"<p>{t}<i>y</i>\n  z</p>")
            text.append(f"{t}y z")
    links = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(rnd.randrange(2, 7)))
    open_, close = ("<article>", "</article>") if kind == "article" else ('<div class="story">', "</div>")
    source = (
        f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{links}</ul></nav><!-- c --><div class='ad'>{words(8)}</div>"
        f"{open_}<h1>T{seed}</h1>{''.join(blocks)}<aside>{words(5)}</aside><div class=\"comments\"><p>{words(6)}</p></div>{close}<footer>{words(9)}</footer>" + ("</body></html>" if seed % 3 else "")
    )
    return f"https://{host}/p/{seed}", source, " ".join([f"T{seed}", *text])


def test_wrapper_of_a_host_is_short_and_general():
    host = html.Host()
    for seed in range(120):
        host.learn(html.Page(page(seed)[1]))
    shown = html.shown(host.wrapper)
    assert "(<li> <a> # </a> </li>)+" in shown and "<article>" in shown and len(shown) < 2000 and "</body> </html>)?" in shown


def test_alignment_makes_optionals_and_repeats():
    s = lambda text: html.folded([("s", t) for t in text.split()])
    assert html.shown(html.aligned(s("<a # </a"), s("<a </a"))) == "<a> (#)? </a>"
    assert html.shown(s("<u <l # </l <l # </l </u")) == "<u> (<l> # </l>)+ </u>"
    assert html.shown(html.aligned(s("<u <l # </l <l # </l </u"), s("<u <l # </l </u"))) == "<u> (<l> # </l>)+ </u>"


def test_partial_wrappers_join_in_any_order():
    packed = []
    for part in range(4):
        host = html.Host()
        for seed in range(part * 20, part * 20 + 20):
            host.learn(html.Page(page(seed)[1]))
        packed.append(host.packed())
    for order in (packed, packed[::-1]):
        whole = html.Host()
        for p in order:
            whole.join(p)
        assert whole.pages == 80 and whole.main_paths() == ["html/body/article"]


def extract(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    return {r.page_id: r for r in html.extracted(frame, *html.learned(frame, html.shared_dir(spark))).collect()}


def test_main_text(spark):
    pages = [page(i, "a.example.com") for i in range(40)] + [page(i, "b.example.com", "div") for i in range(40, 60)]
    rows = [(i, url, source, "clash") for i, (url, source, _) in enumerate(pages)]
    out = extract(spark, rows)
    for i, (_, _, text) in enumerate(pages):
        assert out[i].text == text and out[i].n_chars == len(text)


def test_odd_pages(spark):
    rows = [(1, None, None, ""), (2, "u", "", ""), (3, "http://x.org/a", "plain text, no tags", ""), (4, "http://x.org/b", "<p>un<b>closed &lt;tag <div class='", ""), (5, "http://y.org", "<script>only()</script>", ""), (None, "http://y.org", "<article> </article>", ""), (7, "http://z.org", "<p>x</p>" * 30_000, "")]
    out = extract(spark, rows)
    assert out[1].text == "" and out[2].text == "" and out[3].text == "plain text, no tags" and out[5].text == "" and out[None].text == ""
    assert out[7].n_chars == 59_999 and "unclosed <tag" in out[4].text
    assert html.wrappers(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = html.op3_wrappers(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) and "<p>" not in r.text for r in out)


def test_slots_tell_template_text_and_link_groups_apart(spark):
    rows, texts = [], []
    for i in range(12):
        _, source, text = page(i)
        notice = "<h5>Printed on paper of our own mill</h5>" if i % 2 else ""
        links = "".join(f"<dd><a href='/{i}-{n}'>more {i * n}</a></dd>" for n in range(2 + i % 3))
        rows.append((i, "http://slots.org/a", source.replace("</article>", f"{notice}<dl>{links}</dl></article>"), ""))
        texts.append(text)
    out = extract(spark, rows)
    assert [out[i].text for i in range(12)] == texts


def test_every_page_matches_the_wrapper_of_its_host():
    host, pages = html.Host(), [html.Page(page(seed)[1]) for seed in range(60)]
    for p in pages:
        host.learn(p)
    automaton = html.Automaton(host.wrapper)
    for p in pages:
        positions = automaton.match(p.symbols)
        assert [automaton.symbols[at] for at in positions] == p.symbols
        assert all(b in automaton.after(a, s) for a, b, s in zip(positions, positions[1:], p.symbols[1:]))
    assert automaton.match(["<unheard", "<html"])[0] == -1


def test_a_host_of_several_templates_keeps_every_article(spark):
    own = [page(i, "mixed.org", "article" if i % 3 == 0 else "div") for i in range(30)]
    own = [(u, s.replace("article>", "main>") if i % 6 == 0 else s, t) for i, (u, s, t) in enumerate(own)]
    rare = [page(i, "rare.org", "div") for i in range(40)]
    rare = [(u, s.replace('class="story"', 'class="post"') if i % 4 == 0 else s, t) for i, (u, s, t) in enumerate(rare)]
    pages = own + rare + [(None, s, t) for _, s, t in own]
    out = extract(spark, [(i, url, source, "") for i, (url, source, _) in enumerate(pages)])
    assert [out[i].text for i in range(len(pages))] == [text for _, _, text in pages]


def test_a_host_whose_pages_all_say_the_same_keeps_its_text(spark):
    rows = [(i, "http://same.org", f"<nav>{i}</nav><p>We are away.</p>", "") for i in range(5)]
    assert {r.text for r in extract(spark, rows).values()} == {"We are away."}


def test_any_word_of_any_element_leaves_text_out_but_frames_do_not(spark):
    inside = ['<div id="x1" class="ad">%s</div>', '<div class="box comments"><p>%s</p></div>', '<p class="notice">%s', '<dl class="menu"><dt>%s<dd>%s</dl>', 'z%s <span class="big promo">%s<span>%s</span></span>', '<p role="note" id=cookie-notice>%s</p>']
    frames = ['<body class="no-sidebar wide">%s</body>', '<div class="nav-open x">%s</div>', '<body><div id="page" class="has-footer">%s</div><p>%s</p></body>', '<section data-id="menu">%s</section>']
    rows, texts = [], []
    for frame in frames:
        for extra in inside:
            for i in range(4):
                n = len(rows)
                word = f"leak{n}"
                body = f"<nav>a{n}</nav><div class='story'><h1>T{n}</h1><p>Some text of page {n}.</p>" + extra.replace("z%s", f"z{n}").replace("%s", word) + f"<p>More of the text, {n * 7}.</p></div>"
                rows.append((n, f"http://h{frames.index(frame)}-{inside.index(extra)}.org", frame.replace("%s", body, 1).replace("%s", "by us"), ""))
                texts.append(f"T{n} Some text of page {n}. {f'z{n} ' if extra[0] == 'z' else ''}More of the text, {n * 7}.")
    out = extract(spark, rows)
    assert [out[i].text for i in range(len(rows))] == texts


def plainly(pages: list[tuple[str, str]], monkeypatch=None) -> list[str]:
    """The texts of one host's pages, without Spark."""
    host, all_slots = html.Host(), html.Slots()
    own = [html.Page(source) for source in pages]
    for p in own:
        host.learn(p)
    automaton = html.Automaton(host.wrapper)
    for p in own:
        all_slots.learn(p, automaton)
    boilerplate, known = html.main_of(all_slots.packed())
    return [html.main_text(p, automaton, set(boilerplate), known) for p in own]


def test_the_alignment_decides_what_is_text(monkeypatch):
    """A note without a telling name stands among paragraphs of its kind, on some pages only, always with the same words."""
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    pages, texts = [], []
    for i in range(24):
        title, one, two = f"T{i}", words(12), words(15)
        note = "<p class=k7>Read on with a subscription</p>" if i % 3 else ""
        pages.append(f"<body><div class=story><h2>{title}</h2><p>{one}</p>{note}<p>{two}</p></div></body>")
        texts.append(f"{title} {one} {two}")
    assert plainly(pages) == texts
    monkeypatch.setattr(html.Host, "meet", lambda self, nodes: setattr(self, "wrapper", [("s", "<body")]))
    assert plainly(pages) != texts


def test_alignments_of_any_length_keep_both_sides():
    rnd = random.Random(3)

    def accepts(wrapper, symbols):
        automaton = html.Automaton(wrapper)
        at = automaton.match(symbols)
        return all(p >= 0 for p in at) and all(b in automaton.after(a, s) for a, b, s in zip(at, at[1:], symbols[1:], strict=False))

    for _ in range(60):
        one = [f"<{rnd.choice('abcdefghij')}" for _ in range(rnd.randrange(1, 40))]
        two = [x for x in one if rnd.random() < 0.8] + [f"<{rnd.choice('xyz')}" for _ in range(rnd.randrange(5))]
        pair = [html.folded([("s", x) for x in t]) for t in (one, two)]
        for cells in (1 << 16, 16):
            html.CELLS, before = cells, html.CELLS
            try:
                wrapper = html.aligned(*pair)
            finally:
                html.CELLS = before
            assert accepts(wrapper, one) and accepts(wrapper, two)


def test_long_units_fold():
    unit = [f"<t{i}" for i in range(40)]
    assert html.folded([("s", x) for x in unit * 3]) == [("+", tuple(("s", x) for x in unit))]


def test_a_hundred_thousand_tags_take_seconds():
    import time

    rnd = random.Random(5)
    names = [f"{a}{b}" for a in "bcdfgklmnp" for b in "aeiou"]
    random_tags = lambda n: "".join(f"<{rnd.choice(names)}>x" for _ in range(n))
    nested = "<div class='a1'>" * 50_000 + "deep" + "</div>" * 50_000
    began = time.time()
    out = plainly([f"<article><p>{random_tags(100_000)}</article>", f"<article>{random_tags(100_000)}</article>", f"<article>{nested}</article>", "<article>" + "<p>a<p>b" * 50_000 + "</article>"])
    assert time.time() - began < 90
    assert len(out[0].split()) >= 1 and out[2] == "deep" and len(out[3].split()) == 100_000


def test_text_of_real_pages_is_that_of_the_article(spark):
    """By another way: the standard library's parser, on all pages of a small table whose article is marked."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in html.INLINE:
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag not in html.INLINE:
                self.parts.append(" ")

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = {r.page_id: r.text for r in html.op3_wrappers(spark, sf).collect()}
    assert set(out) == set(pages)
    for number, source in pages.items():
        if (source or "").count("<article") == 1 and "<aside" not in source and 'class="c' not in source:
            parser = Article()
            parser.feed(source)
            parser.close()
            assert out[number] == " ".join("".join(parser.parts).split()), number
