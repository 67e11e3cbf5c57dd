import random

from corpusloom.llm import htmltext


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        for bits in (1 << 30, 4):
            hit = htmltext.shared(a, b, bits)
            assert sum(hit) == lcs(a, b)
            rest = iter(b)
            assert all(any(x == y for y in rest) for x, h in zip(a, hit, strict=True) if h)


def text(html, neighbour=None):
    return htmltext.main_text(htmltext.lines_of(html), neighbour and htmltext.lines_of(neighbour))


def test_markup():
    assert text(None) == text("") == text("<p>") == ""
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>One<br>  two&nbsp;three <i>in</i>line<p>Next a &lt; b &copy 1 < 2
    <div id='comments'><p>Nice</p></div><form><input name=q><button>Go</button></form><ul><li>x<li>y</ul></article>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Head & line\nOne two three inline\nNext a < b © 1 < 2\nx\ny"
    assert text("<div class=cookie-notice>We use</div><main><p>kept &am</p><p>cut <a hre") == "kept &am\ncut"
    assert text('<article><p>a</p><ol class="commentlist"><li>no</li></ol><div class="advertisement-box">no</div><p class="lead">b</p></article>') == "a\nb"
    assert text("<p hidden>no</p><p>yes</p><div style='display: none'>no</div>") == "yes"


def test_no_mark_empties_a_page():
    for page, wanted in [
        ('<body class="post has-sidebar"><article><p>Hello world</p></article>', "Hello world"),
        ('<article class="post share"><p>Body</p></article>', "Body"),
        ('<div class="content search-results"><p>Body</p></div><div class="share">no</div>', "Body"),
        ('<div class="search-results"><p>Body</p></div><nav>no</nav>', "Body"),
        ('<article><div class="commentary"><p>Match commentary</p></div></article>', "Match commentary"),
        ("<form><article><p>In a form</p><button>Go</button></article></form>", "In a form"),
        ("<article><form><p>Your mail</p></form><p>Text</p></article>", "Text"),
        ("<article><p title=it's>First</p><p>Second part</p></article>", "First\nSecond part"),
        ('<article><p class="ad">buy<p>Real text one<p>Real text two</article>', "Real text one\nReal text two"),
        ('<article><ul><li class="ad">buy<li>one</ul><p>two</article>', "one\ntwo"),
        ("<article><p>a<b and c</p><p>1 < 2</article>", "a<b and c\n1 < 2"),
        ('<article><p>t</p></article><ol class="commentlist"><li><article class="comment-body"><p>Nice</p></article></ol>', "t"),
        ('<div class="widget"><article><p>t</p></article></div>', "t"),
        ('<p a="x>y" b=\'<\'>q</p>', "q"),
    ]:
        assert text(page) == wanted, page


def test_long_pages_and_tags_without_end():
    assert text("<article>" + "<p>word " * 20000 + "</article>").count("word") == 20000
    assert text("<article><p>" + "x " * 300000 + "</p></article>").count("x") == 300000
    assert text("<p>a" + "<b a='" * 3000) is not None and text("<p " + 'a="' * 3000 + ">z") is not None


def test_differencing_of_open_lines():
    a = "<div>Site</div><p>Mine</p><p>Shared</p><div>Bottom</div>"
    b = "<div>Site</div><p>Yours</p><div>Bottom</div>"
    assert text(a, b) == "Mine\nShared"
    passage = " ".join(["quoted"] * htmltext.LONG)
    one, two, three = (f"<div>Site</div><p>{own}</p><p>{passage}</p>" for own in ("Mine", "Yours", "Theirs"))
    other = "<div>Site</div><p>Other</p>"
    lines = htmltext.lines_of
    assert htmltext.main_text(lines(one), lines(two), lines(other)) == f"Mine\n{passage}"  # quoted by one neighbour
    assert htmltext.main_text(lines(one), lines(two), lines(three)) == htmltext.main_text(lines(one), lines(two)) == "Mine"
    assert htmltext.main_text(lines(other), lines(other + "<p>More</p>")) == "Site\nOther"  # a variant of the page
    assert text("<article><p>quoted</p></article>", "<article><p>quoted</p></article><p>x</p>") == "quoted"


def test_rows(spark):
    page = "<div>Site menu</div><p>{}</p><div>Bottom</div>"
    rows = [(i, f"http://www.h{i % 2}.example/a/{i:03}", page.format(f"text {i}")) for i in range(40)]
    rows += [(100, "http://h0.example/a/002", page.format("text 2")), (101, None, "<p>alone</p>"), (102, "http://x.example/", None), (103, "nonsense", ""), (None, "http://y.example", "<p>null id</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, lines int")
    for parts in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out = htmltext.extract(df).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.page_id is not None and r.page_id < 100:
                assert r.text == f"text {r.page_id}"
        by_id = {r.page_id: r.text for r in out}
        assert (by_id[101], by_id[102], by_id[103], by_id[None]) == ("alone", "", "", "null id")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert htmltext.extract(df.limit(0)).count() == 0


def in_parts(spark, parts, rows):
    """Texts by page id, with the pages dealt out to so many partitions that nothing joins."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


PAGE = "<div>Site menu</div><p>{}</p><div>Bottom</div>"


def test_copies_over_several_partitions(spark):
    """A host's copies fill whole partitions: their neighbours lie in others."""
    rows = [(i, f"http://h.example/b/{i:04}", PAGE.format("same")) for i in range(400)]
    for extra in ([(1000, "http://h.example/a", PAGE.format("first"))], [(1001, "http://h.example/c", PAGE.format("last"))]):
        others = [(2000 + i, f"http://g{i}.example/x", PAGE.format("alone")) for i in range(3)]
        found = in_parts(spark, 9, rows + extra + others)
        assert {found[i] for i in range(400)} == {"same"}
        assert found[extra[0][0]] in ("first", "last")
        assert {found[2000 + i] for i in range(3)} == {"Site menu\nalone\nBottom"}


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(3)}.example/{rng.choice('abc')}/{i:03}", PAGE.format(f"text {rng.randrange(6)}")) for i in range(60)]
    whole = in_parts(spark, 1, rows)
    assert all(in_parts(spark, n, rows) == whole for n in (2, 7, 40))


def test_extract_against_plain_pairing(spark):
    """Pages sorted on the driver, runs of equal lines put together, neighbours chosen by hand."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    made = lambda: "".join(f"<p>{' '.join(rng.choice(words) for _ in range(rng.choice((1, 2, 18))))}</p>" for _ in range(rng.randrange(1, 5)))
    bodies = [made() for _ in range(20)]
    rows = []
    for i in range(90):
        u = rng.choice([None, f"http://H{rng.randrange(2)}.example/{rng.choice('ab')}/{rng.randrange(9)}", f"http://www.h1.example/{rng.randrange(30)}/"])
        rows.append((i, u, rng.choice(["<div>Menu</div>", "<div>Menu</div><nav>n</nav>"]) + rng.choice([*bodies, made(), made()])))
    lines = {i: htmltext.lines_of(h) for i, _, h in rows}
    order = sorted(rows, key=lambda r: (*htmltext.host_and_path(r[1]), r[0]))
    wanted = {}
    for at, (i, u, _) in enumerate(order):
        host, path = htmltext.host_and_path(u)
        around = []
        for side in (order[:at][::-1], order[at + 1 :]):
            for j, v, _ in side:
                if htmltext.host_and_path(v)[0] != host or lines[j] != lines[i]:
                    around.append((htmltext.host_and_path(v)[1], lines[j]) if htmltext.host_and_path(v)[0] == host else None)
                    break
            else:
                around.append(None)
        before, after = around
        late = after and (not before or htmltext.common_segments(path, after[0]) > htmltext.common_segments(path, before[0]))
        near, other = (after, before) if late else (before, after)
        wanted[i] = htmltext.main_text(lines[i], near and near[1], other and other[1])
    for parts in (1, 4, 32):
        assert in_parts(spark, parts, rows) == wanted


def test_neighbour_with_the_longer_common_path(spark):
    """The first page of a section is compared with the section's next page, not with another section's last."""
    page = "<div>Site</div><div>{} notice</div><p>{}</p>"
    rows = [(i, f"http://h.example/{s}/{i}", page.format(s, f"text {i}")) for s, ids in (("en", (1, 2, 3)), ("fr", (4, 5, 6))) for i in ids]
    for parts in (1, 6):
        assert in_parts(spark, parts, rows) == {i: f"text {i}" for i in range(1, 7)}
    assert htmltext.common_segments("/fr/1", "/fr/2") == 2 and htmltext.common_segments("/fr/1", "/free/1") == 1
