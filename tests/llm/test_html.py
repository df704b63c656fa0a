from ravelin.llm import htmltext


def test_blocks_and_references():
    page = "<html><head><title>t</title><style>p{}</style></head><body><article><h1>A &amp; B</h1><p>one\n  two<br>three<!-- x --><script>var a='</p>'</script> four<p>five &copy</article>"
    assert [b[0] for b in htmltext.blocks(page)] == ["A & B", "one two three four", "five ©"]
    assert htmltext.blocks("") == [] and htmltext.blocks("plain")[0][0] == "plain"


def test_labelled_pages_are_learned():
    chain = htmltext.Chain().train(htmltext.labelled())
    for rows, labels in htmltext.labelled():
        assert chain.decode(rows) == labels


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    chain = htmltext.Chain()
    rng = np.random.default_rng(4)
    chain.w, chain.t, chain.s = rng.normal(size=chain.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    rows = [[int(x)] for x in rng.integers(0, len(htmltext.FEATURES), 7)]
    e = chain.scores(rows)
    score = lambda y: chain.s[y[0]] + sum(e[i][k] for i, k in enumerate(y)) + sum(chain.t[a][b] for a, b in zip(y, y[1:]))
    assert tuple(chain.decode(rows)) == max(itertools.product((0, 1), repeat=7), key=score)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    chain = htmltext.fit(pages)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", "<article><p>Some words, which are a text.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract(odd, chain).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "Some words, which are a text.", 29), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert htmltext.extract(odd.where("false"), chain).collect() == []
    assert htmltext.fit(odd.where("false")).decode([]) == []


def test_open_and_embedded_tags_lose_no_text():
    texts = lambda page: [b[0] for b in htmltext.blocks(page)]
    assert texts("<head><title>t</title><meta charset=x><body><p>one</p><p>two") == ["one", "two"]
    assert texts("<head><title>t</title><p>one</p>") == ["one"]
    assert texts("<p>one</p><svg viewBox='0 0 1 1'/><p>two</p><svg><path d='x'/><script/></svg><p>three</p>") == ["one", "two", "three"]
    assert texts("<article><p>a <math><mi>x</mi></math> b</p><object><p>c</p></object><noscript><p>d</p></noscript></article>") == ["a x b", "c", "d"]
    assert texts("<p>one</p><iframe src=x><p>two</p><video><p>three") == ["one", "two", "three"]
    assert texts("<p>one</p><script>var a = '<p>two'") == ["one"] and texts("<title>t<body><p>one</p><svg><title>x</title></svg>")[-1] == "one"


def test_quotes_that_open_no_value():
    texts = lambda page: [b[0] for b in htmltext.blocks(page)]
    assert texts("<p data=it's>One.</p><p>Two's.</p>") == ["One.", "Two's."]
    assert texts('<p><a href="x>three</a></p>') == ["three"]
    assert texts("<p title='a > b' x = \"c > d\" y= '>' it's \">four</p><p>five</p>") == ["four", "five"]
    assert texts("<p class=\"a\"id='b'>six</p><p =x>seven<p a==b>eight") == ["six", "seven", "eight"]


def test_deep_and_hostile_pages_take_linear_time():
    import time

    deep = "".join(f"<div class='menu side'>x{k}" for k in range(8000))
    pages = [deep, deep + "</p></section>" * 8000, "<p>" + "<a x='" * 20000, "<p a=" + '"' * 20001 + "z", "<p>" + "= " * 50000 + "<b " + "=" * 50000, "<p " + "=  " * 50000]
    began = time.perf_counter()
    assert len(htmltext.blocks(deep)) == 8000
    assert time.perf_counter() - began < 0.5
    for page in pages:
        htmltext.blocks(page)
    assert time.perf_counter() - began < 5


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}, which says something of some length.</p>" for k in range(5000)) + "</article><footer>© us</footer>"
    chain = htmltext.Chain().train(htmltext.labelled())
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert htmltext.extract(pages, chain).first().text.count("\n\n") == 4999
