from mnemora.llm import html_text

LONG = "The river of the town was wide and it ran to the sea in the night, and the people of the place were there with us."


def text(page):
    return " ".join(html_text.main_text(page))


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="menu-open">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">{LONG}</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">{LONG}</div>
    <article class="post"><header><h1>A  short\n title</h1></header><p>{LONG}<p>Short &lt;one&gt;<br>line<!-- no --></p><div class="share-bar">{LONG}</div>
    <form>{LONG}<input value="</article>"></form><p>Zwölf &#233;t&eacute; <b>bold</b></p><p style="display: none">{LONG}</p><footer>{LONG}</footer></article>
    <aside>{LONG}</aside><section class="comments"><article class="comment"><p>{LONG}</p></article></section><footer>&copy; {LONG}</footer></body></html>"""
    assert text(page) == f"A short title {LONG} Short <one> line Zwölf été bold"


def test_block_rules_without_an_article():
    assert text(f"<div>Menu</div><div><a href=x>{LONG}</a></div><h2>Near</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>Tail.</p>") == f"Near {LONG} Short. {LONG} Tail."
    assert text(f"<p>{LONG}</p><p>{'xq zw ' * 60}</p>") == LONG
    assert text("<p>Short only</p>") == ""


def test_broken_and_empty_pages():
    assert text(None) == text("") == text(" \n") == text("<") == text("<p") == text("<!--") == text("<script>x") == text("</p></div>") == ""
    assert text(f"<article><p>{LONG}</p><p>cut <b") == f"{LONG} cut"
    assert text("<article><p>a < b and 3<4</p></article>") == "a < b and 3<4"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(text("<article><p>" + "word &amp; " * 200_000 + "</p></article>")) == 7 * 200_000 - 1


def test_rows(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "x", 1), (1, "u", f"<article>{LONG}</article>", "x", 1), (None, None, None, None, None), (2, "v", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "", ""), (1, "u", LONG), (1, "u", LONG), (2, "v", "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_short_pages_without_markup():
    assert text("<div><p>Short article text.</p></div>") == "Short article text."
    assert text(f"<nav>{LONG}</nav><h1>Title</h1><p>One short line.</p><footer>{LONG}</footer>") == "Title One short line."


def test_other_languages_and_tables():
    chinese = "这条河很宽，夜里流向大海，镇上的人们都在那里和我们在一起。" * 4
    russian = "Река в городе была широкой и ночью текла к морю, а жители посёлка стояли на берегу и долго смотрели на воду."
    polish = "Rzeka w mieście była szeroka i nocą płynęła do morza, a ludzie z okolicy stali na brzegu i długo patrzyli na wodę."
    names = ", ".join(f"Anna Kowalska {i}" for i in range(12))
    for body in (chinese, russian, polish, names):
        assert text(f"<nav>Menu</nav><div>{body}</div><div>{body}</div>") == f"{body} {body}"
    assert text(f"<div>{russian}</div>" * 6 + f"<div>{LONG}</div>") == f"{russian} " * 6 + LONG


def test_names_of_layouts_and_whole_attributes():
    for name in ("layout has-sidebar", "no-sidebar", "sidebar-layout", "menu-open"):
        assert text(f'<div class="{name}"><nav>{LONG}</nav><article><p>{LONG}</p><div class="sidebar">{LONG}</div></article></div>') == LONG
    assert text(f"<div class='no-sidebar'><p>{LONG}</p></div>") == LONG
    assert text(f'<div title="The hidden class=menu river" data-hidden data-class="menu"><p>{LONG}</p></div>') == LONG
    assert text(f'<main><h1>Title</h1><div class="sidebar-layout"><article><p>{LONG}</p></article></div></main>') == f"Title {LONG}"
    assert text(f'<article><p>{LONG}</p></article><div class="related"><article>Teaser of another.</article></div>') == LONG
    assert text(f'<div hidden class="menu"><article><p>{LONG}</p></article></div><p>{LONG}</p>') == LONG
    assert text(f'<div class="comments"><article><p>{LONG}</p></article></div>') == ""


CHINESE = "这条河很宽，夜里流向大海，镇上的人们都在那里和我们在一起。" * 4
FRENCH = "La rivière de la ville était large et les gens du quartier sont venus dans la nuit avec nous pour voir les bateaux sur le port."
PLAIN = "zorv quib mantel " * 8
TAGS = "red green blue cotton linen wool small medium large boots shirts hats gloves scarves belts socks jackets coats"
PLACES = "Berlin 030 5550 Paris 01 5551 Madrid 91 5552 Roma 06 5553 Wien 01 5554 Praha 02 5555 Oslo 22 5556"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Another story of the day, number {i}</a></li>" for i in range(5)) + "</ul>"

#: Layout, and the text that belongs to it.
LAYOUTS = [
    (f"<nav>{LONG}</nav><main><h1>Title</h1><p>{LONG}</p><p>Short.</p>{LINKS}<p>{LONG}</p></main><footer>{LONG}</footer>", f"Title {LONG} Short. {LONG}"),
    (f"<div class=top><a href=/>Home</a></div><h1>Title</h1><p>{LONG}</p><p>So.</p><p>{LONG}</p>{LINKS}<p>Call us</p>", f"Title {LONG} So. {LONG}"),
    (f'<div class="content-sidebar-wrap"><div><p>{LONG}</p><p>{FRENCH}</p></div></div>', f"{LONG} {FRENCH}"),
    (f"<form id=page><div class=menu>{LONG}</div><article><h2>Title</h2><p>{LONG}</p><form>{LONG}<input></form></article></form>", f"Title {LONG}"),
    (f"<form id=page><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG} {LONG}"),
    (f'<article><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', f"{LONG} Related work {LONG}"),
    (f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section></article>', f"{LONG} Discussion {LONG}"),
    (f'<article><p>{LONG}</p><section class="responses"><div><span class="author">Ann</span><p>{LONG}</p></div></section></article>', LONG),
    (f'<article><p>{LONG}</p></article><div id="discussion"><p>{LONG}</p></div>', LONG),
    (f'<article><p>{LONG}</p><svg width="1"/><p>{FRENCH}</p><svg><title>x</title><path d=""></svg><p>End.</p><math><p>{LONG}', f"{LONG} {FRENCH} End. {LONG}"),
    (f"<div>Menu</div><div><p>{CHINESE}</p><p>{CHINESE}</p></div>", f"Menu {CHINESE} {CHINESE}"),
    (f'<div class="social-history"><p>{LONG}</p><p>{PLAIN}</p></div>', LONG),
    (f"<article><p>{LONG}</p><p>{PLAIN}</p><p>{LONG}</p></article>", f"{LONG} {PLAIN.strip()} {LONG}"),
    (f"<table><tr><td><a href=/>Home</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"{LONG} {LONG}"),
    (f'<div class="teasers"><article>One.</article></div><div><p>{LONG}</p><p>{FRENCH}</p></div>', f"One. {LONG} {FRENCH}"),
    (f"<div>{TAGS}</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div>{PLACES}</div>", f"Title {LONG} {LONG}"),
    (f"<p>{FRENCH}</p><p>Oui.</p><p>{FRENCH}</p><div>{TAGS}</div><div>Contact</div>", f"{FRENCH} Oui. {FRENCH}"),
    (f"<table><tr><td>{PLACES}</td></tr></table><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div>{PLACES}</div><div>Top</div>", f"{LONG} Yes. {LONG}"),
    (f'<div class="x1"><p>{LONG}</p><p>{FRENCH}</p></div><div class="x2">{TAGS}</div><div class="x3">{PLACES}</div>', f"{LONG} {FRENCH}"),
    (f"<div>{PLACES}</div><div>Prices</div><div>{TAGS}</div><h2>Story</h2><p>{LONG}</p>", f"Story {LONG}"),
    (f"<p>{LONG}</p><div>{TAGS}</div><p>{LONG}</p><div>{PLACES}</div>", f"{LONG} {LONG}"),
    (f"<dl><dt>Sizes</dt><dd>{TAGS}</dd></dl><blockquote>{LONG}</blockquote><p>{FRENCH}</p>", f"{LONG} {FRENCH}"),
    (f"<div>{TAGS}<br>{PLACES}</div><section><h3>One</h3>{LONG}<h3>Two</h3>{LONG}</section>", f"One {LONG} Two {LONG}"),
    (f"<center>{PLACES}</center><p>{FRENCH}</p><p>{LONG}</p><address>{PLACES}</address>", f"{FRENCH} {LONG}"),
    (f"<h1>Head</h1><p>{LONG}</p><p>{TAGS}</p><p>Fin</p>", f"Head {LONG}"),
    (f'<div id="cookie-banner">{LONG}</div><div class="ad-slot-3">{LONG}</div><p>{LONG}</p><div class="comment-list"><p>{FRENCH}</p></div>', LONG),
]


def restated(every, rules, use_stop_words=True, use_context=True):
    """Both passes in plain words, quadratic; either can be left out."""
    stop = lambda b: sum(w.strip(html_text._EDGES).lower() in html_text.STOP_WORDS for w in b.text.split()) / len(b.text.split()) if use_stop_words else 0.0
    dense = [2 * b.linked > len(b.text) for b in every]
    big = [len(b.text) >= 70 and not d for b, d in zip(every, dense, strict=True)]
    read = sum(len(b.text) for b, x in zip(every, big, strict=True) if x and stop(b) >= 0.15)
    served = read > 0 and read >= 0.2 * sum(len(b.text) for b, x in zip(every, big, strict=True) if x)
    labels = []
    for b, d in zip(every, dense, strict=True):
        if d:
            labels.append(None if b.main and not b.item else False)
        elif len(b.text) < 70:
            labels.append(None)
        elif not served:
            labels.append(True if use_stop_words else None)
        elif stop(b) >= 0.3 or (stop(b) >= 0.15 and len(b.text) >= 200 and not b.weak):
            labels.append(True)
        else:
            labels.append(None if stop(b) >= 0.15 or b.main else False)
    if not use_context:
        return [x is True for x in labels]
    if True not in labels:
        marked = any(b.main for b in every)
        sentence = any(x is None and b.text.endswith(html_text._SENTENCE_ENDS) for b, x in zip(every, labels, strict=True))
        return [x is None and (marked or sentence) for x in labels]
    out = []
    for i, (b, x) in enumerate(zip(every, labels, strict=True)):
        if x is None:
            left = [j for j in range(i) if labels[j] is not None][-1:]
            right = [j for j in range(i + 1, len(every)) if labels[j] is not None][:1]
            near = min(abs(i - j) for j in left + right)
            at = [j for j in left + right if abs(i - j) == near]
            x = labels[at[-1] if b.heading else at[0]]
            x = x or (b.main and any(labels[j] for j in (at if len(b.text) < 70 else left + right)))
        out.append(bool(x))
    return out


def test_layouts_and_both_passes():
    rules = html_text.BlockRules()
    same = {"all": 0, "no stop words": 0, "no second pass": 0}
    for page, want in LAYOUTS:
        assert text(page) == want, page
        every = html_text.candidates(html_text.blocks(page), rules)
        kept = lambda labels: " ".join(b.text for b, x in zip(every, labels, strict=True) if x)
        assert restated(every, rules) == html_text.second_pass(every, html_text.first_pass(every, rules), rules)
        for name, labels in (("all", restated(every, rules)), ("no stop words", restated(every, rules, use_stop_words=False)), ("no second pass", restated(every, rules, use_context=False))):
            same[name] += kept(labels) == want
    assert same["all"] == len(LAYOUTS)
    assert same["no stop words"] <= len(LAYOUTS) - 10 and same["no second pass"] <= len(LAYOUTS) - 10, same


def test_passes_equal_their_restatement_on_all_pages():
    import pyarrow.parquet as pq

    rules, lost = html_text.BlockRules(), 0
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    for page in pages:
        every = html_text.candidates(html_text.blocks(page or ""), rules)
        first = html_text.first_pass(every, rules)
        assert restated(every, rules) == html_text.second_pass(every, first, rules)
        lost += any(x is None for x in first)
    assert lost > len(pages) // 2  # the second pass decides blocks on most pages
