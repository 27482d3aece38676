import html
import re

from nightjar.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text int, host string"


def extract(spark, rows):
    return [(r.page_id, r.text, r.n_chars) for r in H.extract(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)).collect()]


def test_templates_go_and_shared_passages_stay(spark):
    same = "<p>One passage that all pages share.</p>"
    rows = [(i, f"http://h.test/{i}", f"<div class='top'>Best site &amp; shop</div><div class='body'><h1>Title {i}</h1>{same}<p>Own {i}</p><ul><li>Help</li></ul></div>") for i in range(12)]
    got = {i: t for i, t, _ in extract(spark, rows)}
    assert got[3] == "Title 3\nOwn 3"  # without an article element, prose on every page is template too
    rows = [(i, f"http://h.test/{i}", f"<div>Best site</div><article><h1>Title {i}</h1>{same}<div class='x'>Read on</div><p>Own {i}</p></article><div>Bye</div>") for i in range(12)]
    got = {i: t for i, t, _ in extract(spark, rows)}
    assert got[3] == "Title 3\nOne passage that all pages share.\nOwn 3"


def test_equal_articles_on_many_pages_stay(spark):
    page = "<html><body><nav>Menu</nav><article><h1>A</h1><p>Same article</p></article></body></html>"
    got = extract(spark, [(i, "http://h.test/", page) for i in range(30)])
    assert len(got) == 30 and {t for _, t, _ in got} == {"A\nSame article"}


def test_a_hot_host_and_small_hosts(spark):
    rows = [(i, "http://hot.test/a", f"<div>Site</div><div>Text {i}</div>") for i in range(200)] + [(1000 + i, f"http://h{i}.test/", f"<div>Site</div><div>Text {i}</div>") for i in range(100)]
    got = {i: t for i, t, _ in extract(spark, rows)}
    assert all(got[i] == f"Text {i}" for i in range(200)) and all(got[1000 + i] == f"Site\nText {i}" for i in range(100))


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (2, "nonsense", "a < b &amp; c &lt;d&gt; &copy &#228; &#x1F600;"), (3, "http://x.test/", "<p>" * 5000 + "deep"), (3, "http://x.test/", "<div>" * 3000 + "deep"),
            (4, "http://x.test/", "<article><p>" + "long  \n text " * 50_000), (5, "http://x.test", "<script>if (a < b) '</p>'</script><style>p{}</style><!-- x --><p>One<br>two</i> <b>three</p><p>four <a href='a>b'>five</a>"),
            (6, "http://x.test", "<main><p>kept</p><form>no</form><section class='user-comments'><article class=comment>no</article></section></main>out")]
    got = extract(spark, rows)
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert by[None] == "" and by[1] == "" and by[2] == "a < b & c <d> © ä 😀"
    assert [t for i, t, _ in got if i == 3] == ["deep", "deep"]
    assert by[4] == " ".join(["long text"] * 50_000)
    assert by[5] == "One two three\nfour five" and by[6] == "kept"
    assert extract(spark, []) == []


def test_whole_table_against_the_article_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_copies_of_a_page_cast_one_vote(spark):
    lists = "<article><h1>A</h1><ul><li>One</li></ul><table><tr><td>Two</td></tr></table><div>Three</div><div class='x'>Four</div></article>"
    bare = "<div class='text'><h1>Copied</h1><p>Same words</p></div><div>More words</div>"
    rows = [(i, "http://h.test/a", lists) for i in range(9)] + [(100 + i, "http://n.test/", f"<div>Site</div>{bare}") for i in range(5)]
    rows += [(200 + i, "http://n.test/", f"<div>Site</div><p>Own {i}</p>") for i in range(11)]
    got = {i: t for i, t, _ in extract(spark, rows)}
    assert got[3] == "A\nOne\nTwo\nThree\nFour"
    assert got[102] == "Copied\nSame words\nMore words" and got[203] == "Own 3"


def test_parts_of_different_articles_stay(spark):
    parts = "<ul class='l'><li>Salt</li></ul><table><tr><td>1</td></tr></table><div>Plain</div><div id='d'><p>In p</p></div><section class='s'><dl><dt>T</dt></dl></section><p>Press <kbd>Q</kbd> <del>a</del></p>"
    got = {i: t for i, t, _ in extract(spark, [(i, "http://h.test/", f"<article><h1>T{i}</h1>{parts}</article>") for i in range(20)])}
    assert got[7] == "T7\nSalt\n1\nPlain\nIn p\nT\nPress Q a"


def test_names_roles_and_forms_around_an_article_keep_it():
    article = "<article class='post comments-open'><p>Text</p></article>"
    for before, after in [("<div class='layout has-sidebar'>", "</div>"), ("<div id='page' class='with-navigation'>", "</div>"), ("<div class='widget'>", "</div>"),
                          ("<form id=aspnetForm>", "</form>"), ("<div role=navigation>", "</div>"), ("<main><div class='sidebar'><h1>no</h1>", "</div></main>")]:
        assert H.Page(f"<body><div class='social-share'>no</div><nav>no</nav>{before}{article}{after}</body>").text(set()) == "Text"
    assert H.Page("<article class=notice><p>Only</p></article>").text(set()) == "Only"
    assert H.Page("<article><p>Text</p></article><article class=comment><p>no</p></article>").text(set()) == "Text"
    assert H.Page("<main><p>Text</p><div class=comments><article>no</article></div></main>").text(set()) == "Text"
    assert H.Page("<body><form><nav>no</nav><h1>A</h1><p>Text of a page</p></form></body>").text(set()) == "A\nText of a page"
    assert H.Page("<body><p>Text</p><form><p>Name</p></form><div class='comments-list'>no</div></body>").text(set()) == "Text"
    assert H.Page("<article><p>So <math><mi>x</mi><annotation>no</annotation></math> holds</p></article>").text(set()) == "So x holds"


def test_templates_of_a_few_pages_of_a_large_host_go(spark):
    def page(i):
        notice = f"<div>Notice {i // 6}</div><ul><li>Menu {i // 6}</li></ul>" if i < 12 else "<div><p>Terms of a section</p></div>" if i < 60 else ""
        chance = "<p>Quoted twice over</p>" if 60 <= i < 72 else ""
        return f"<body>{notice}{chance}<p>Own {i}, <em>not</em> other</p></body>"
    got = {i: t for i, t, _ in extract(spark, [(i, "http://hot.test/", page(i)) for i in range(1300)])}
    assert got[3] == "Own 3, not other" and got[30] == "Own 30, not other"
    assert got[65] == "Quoted twice over\nOwn 65, not other"


def test_template_sets_are_joined_by_subtree(spark):
    rows = [(str(i).encode(), f"h{i % 2}", f"<div>{i // 12}</div><article><div>{i}</div></article>" if i < 60 else f"<div>{i // 12}</div>{i}") for i in range(240)]
    found = {bytes(r.page): r for r in H.page_templates(spark.createDataFrame(rows, "page binary, host string, html string")).collect()}
    assert found.keys() == {p for p, _, _ in rows[60:]}  # the text of an article depends on no subtree outside
    assert all(len(r.template) == 1 and not r.prose for r in found.values())
