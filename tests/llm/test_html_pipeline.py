import re
import time

import pytest

import corpus_pipeline
from waymesh.llm import html_extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu entry</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, for you, always.</p></div>
<div id="sidebar"><p>Side text that is long, really long, with commas, and more.</p></div>
<article><h1>A &amp; B</h1><p><b>First   paragraph, with
white space.<br><p>Second &lt;tag&gt; &eacute;&#233;&nbsp;x.<ul><li>one<li>two</ul><!-- <p>hidden</p> --><form><p>Subscribe now, please, do.</p></form>
<div class="ad">Buy this, now, cheap.</div><aside>Aside, with commas, too.</aside><p>Short.</p></article>
<section class="comments"><p>Nice post, I liked it, a lot, really.</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_extract.main_text(PAGE) == "A & B\n\nFirst paragraph, with white space.\n\nSecond <tag> éé x.\n\none\n\ntwo\n\nShort."


def test_without_article():
    page = "<body><div class=menu><a>Home</a> <a>News</a></div><div class=content>" + "".join(f"<p>Paragraph {k}, with some text, and marks. It goes on.</p>" for k in range(5)) + "<p>Tiny.</p></div><div><a>x</a></div></body>"
    text = html_extract.main_text(page)
    assert text.split("\n\n") == [*(f"Paragraph {k}, with some text, and marks. It goes on." for k in range(5)), "Tiny."]


def test_articles_take_nothing_away():
    story = [f"Story {k}, " + "told at length, with commas, and stops. " * 15 for k in range(10)]
    cards = [f"Card {k}, " + "told too, with commas, and stops. " * 15 for k in range(6)]
    page = "<body>" + "".join(f"<div>{x}</div>" for x in story) + "".join(f"<article><p>{x}</p></article>" for x in cards) + "</body>"
    assert {x.strip() for x in story} <= set(html_extract.main_text(page).split("\n\n"))
    page = "<body><main><h1>Title</h1><p>Lead, short.</p><article>" + "".join(f"<p>{x}</p>" for x in story) + "</article></main></body>"
    assert html_extract.main_text(page).split("\n\n") == ["Title", "Lead, short.", *(x.strip() for x in story)]
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in story) + "</article><article><p>Second, short, but told, too.</p></article></body>"
    assert html_extract.main_text(page).endswith("Second, short, but told, too.")


LONG = "A sentence with words, and marks, and more of both. " * 6
STORY = "".join(f"<p>{k} {LONG}</p>" for k in range(5))


def parts(page):
    return html_extract.main_text(page).split("\n\n")


def test_ratios_decide(monkeypatch):
    """Boilerplate without telling elements or names goes by the ratios of its paths alone."""
    page = f"<body><div><div>Home</div><div>Contact us</div></div><div id=c><h2>Title</h2>{STORY}<ul><li>short item</ul></div><table><tr><td>12<td>34</table><div><span>Posted Monday</span></div></body>"
    story = [f"{k} {LONG}".strip() for k in range(5)]
    assert parts(page) == ["Title", *story, "short item"]
    monkeypatch.setattr(html_extract, "content_paths", lambda page, blocks: {b.path for b in blocks})
    assert parts(page) == ["Home", "Contact us", "Title", *story, "short item", "12", "34", "Posted Monday"]


def test_headings_go_with_what_follows():
    """A title beside the element that holds the text, and headings of a list that isn't content."""
    page = f'<body><div class=w><div class=p><h1>Title</h1><div class=meta>Monday</div><div class=c>{STORY}<h2>Part</h2><p>Short.</p></div></div><div class=q><h3>Elsewhere</h3><div>one</div><div>two</div></div></div></body>'
    assert parts(page) == ["Title", *(f"{k} {LONG}".strip() for k in range(5)), "Part", "Short."]
    assert plainly(page) == parts(page)


def test_links_count_against_a_path():
    links = "".join(f"<p><a href=x>Linked {LONG}</a></p>" for _ in range(3))
    assert not any(x.startswith("Linked") for x in parts(f"<body><div id=more>{links}</div><div id=c>{STORY}</div></body>"))
    assert sum(x.startswith("Linked") for x in parts(f"<body><article>{STORY}{links}</article></body>")) == 3
    assert parts(f"<body><div id=c><h1><a href=x>Title</a></h1>{STORY}</div></body>")[0] == "Title"


@pytest.mark.parametrize("name", ["read-more", "related-work", "notice", "alert", "header-note", "menu-of-the-day"])
def test_names_inside_articles(name):
    page = f'<article><p>One, two.</p><div class="{name}"><p>The rest, of it.</p></div><section id="{name}"><p>And then, the end.</p></section></article>'
    assert parts(page) == ["One, two.", "The rest, of it.", "And then, the end."]


@pytest.mark.parametrize("name", ["ad", "comments", "sponsored", "reader-comments"])
def test_adverts_and_comments_inside_articles(name):
    assert parts(f'<article>{STORY}<div class="{name}">{STORY}</div></article>') == [f"{k} {LONG}".strip() for k in range(5)]


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "site-header", "siteFooter", "nav", "breadcrumbs", "menu", "comments", "ads"])
def test_names_outside_articles(name):
    assert parts(f"<body><div class=\"{name}\"><p>{LONG}</p></div><div class=c>{STORY}</div></body>") == [f"{k} {LONG}".strip() for k in range(5)]


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-header", "post comments-open"])
def test_wrappers_stay(name):
    assert parts(f'<body><div class="{name}"><h1>Title</h1>{STORY}</div></body>')[0] == "Title"


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a ="' * 200_000, "<div>x" * 150_000, "<div>" * 100_000 + "<li>x</li>" * 50_000, "<li><ul>" + "<div>" * 100_000 + "<li>x" * 50_000, "<span class=ad>" * 60_000 + "<hr>" * 60_000, "<a<" * 300_000, '<p><div class="x">y' * 50_000, "<!--" * 250_000, "<script>" * 120_000, "<a " + "=" * 1_000_000, "=\t" * 400_000, "&" * 500_000])
def test_odd_pages_end_in_seconds(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 10


def test_inline_bars_end():
    """A barred inline element ends at its tag, whatever lies open in it."""
    assert parts("<body>" + "<span class=ad><div>" + "<b>" * 20 + "buy</span>" + STORY + "</body>") == [f"{k} {LONG}".strip() for k in range(5)]


def plainly(source):
    """Ratios by the definition, path by path, over (path, text, link share, in an article) of blocks."""
    page = html_extract.Page(source)
    def names(p):
        return () if not p else (*names(page.parent[p]), page.label[p])
    blocks = [(names(b.path), b.text, b.linked, b.article) for b in page.blocks]
    own = {}
    for path, text, linked, article in blocks:
        own.setdefault(path, []).append((text, linked, article))
    marks = lambda t: sum(c in ".,;:!?…。、，！？؟،" for c in t)
    ratio = {p: sum(len(t) for t, *_ in x) / len(x) * (1 + sum(marks(t) for t, *_ in x) / len(x)) for p, x in own.items()}
    size = {p: sum(len(t) for t, *_ in x) for p, x in own.items()}
    def level(p):
        whole = {x.split(".")[0] for x in p} & {"article", "main"}
        near = [q for q in own if (q[: len(p)] == p if whole else q == p or q[:-1] == p and q)]
        here = sum(ratio[q] * size[q] for q in near) / sum(size[q] for q in near) if near else 0
        return max(here, 0.9 * level(p[:-1])) if p else here
    def value(p):
        v = max(ratio[p], 0.9 * level(p[:-1]) if p else 0)
        if own[p][-1][2] or p and p[-1].split(".")[0] in {"h1", "h2", "h3", "h4", "h5", "h6"}:
            return v
        return v * (1 - sum(len(t) * share for t, share, _ in own[p]) / size[p])
    top = {}
    level_of = lambda p: int(p[-1][1]) if p and p[-1].split(".")[0] in {"h1", "h2", "h3", "h4", "h5", "h6"} else 7
    for i, (path, *_) in enumerate(blocks):
        if level_of(path) < 7:
            under = []
            for later, text, *_ in blocks[i + 1 :]:
                if level_of(later) <= level_of(path) or later[: len(path) - 1] != path[:-1]:
                    break
                if level_of(later) == 7:
                    under.append((value(later) * len(text), len(text)))
            if under:
                top[path] = max(top.get(path, 0), sum(x for x, _ in under) / sum(n for _, n in under))
    last = {p: max(value(p), 0.9 * top.get(p, 0)) for p in own}
    mean = sum(last[p] * size[p] for p in own) / sum(size.values())
    return [text for path, text, *_ in blocks if last[path] >= 0.5 * mean]


def test_whole_pages_equal_plain_ratios(spark):
    """The registered query over a whole table, against the definition on pages without the barred elements."""
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in html_extract.op5_html_extract(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.sub(r'<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<title>.*?</title>|<script>.*?</script>|<style>.*?</style>', "", r.html, flags=re.S)
        assert got[r.page_id] == "\n\n".join(plainly(inner))


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<", "a<"), ("<p>x</p></div></p>", "x"), ("<nav>only menu</nav>", ""), ("a < b and c > d", "a < b and c > d"), ("<p>unclosed <b>bold <i>x", "unclosed bold x"), ("<script>never ends", "")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_extract(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 2), (None, None, None, 3), (2, "v", "<p>" + "long text, of course. " * 50_000 + "</p>", 4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == len("long text, of course. " * 50_000) - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    bench = "the quick brown fox jumps over the lazy dog while seven more foxes watch"
    line = "This very line is in many of the documents here."
    rows = []
    for k in range(40):
        words = " ".join(f"the{'ing' * (k % 3)}{'abcdefghij'[(k * j) % 10]}and{'xyz'[(k + j) % 3]}{k * j % 97 or 'er'}" for j in range(60))
        rows.append((k, words + (f"\n{line}" if k % 4 == 0 else ""), "en", "s"))
    rows += [(50, rows[3][1], "en", "s"), (51, f"start of it {bench} and its end", "en", "s"), (52, "12345 67890", "en", "s"), (53, None, "en", "s"), (54, rows[5][1] + " one more", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        seen[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["language ID"] == set(kept) - {52, 53}
    assert ids["line dedup"] == ids["language ID"]
    texts = {r.doc_id: r.text for r in seen["line dedup"]}
    assert sum("This very line" in t for t in texts.values()) == 1 and "This very line" in texts[36]
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    assert ids["n-gram Jaccard join"] == ids["line dedup"] - {50, 54}
    assert ids["benchmark decontamination"] == ids["n-gram Jaccard join"] - {51}
    assert ids["best-fit packing"] == ids["benchmark decontamination"]
    run = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == {(r.doc_id, r.piece, r.ids_crc32) for r in seen["best-fit packing"]}


def filler(seed, n=40):
    return " ".join(f"theing{'abcdefghij'[(seed * j) % 10]}and{'xyzw'[(seed + j) % 4]}{seed}er" for j in range(n))


def test_rows_have_their_own_fate(spark, folder):
    """A clean row doesn't save a contaminated one of the same id, nor the other way round; rows without an id are judged, too; further columns stay."""
    bench = "the quick brown fox jumps over the lazy dog while seven more foxes watch"
    rows = [(60, filler(1)), (60, filler(2) + " " + bench), (None, filler(3)), (None, bench), (61, None), (62, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, [k]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, hits int, rest array<int>")
    found = corpus_pipeline.leaks(spark, docs, folder)
    assert found.columns == docs.columns
    assert sorted((r.rest[0], r.doc_id, r.text, r.hits) for r in found.collect()) == [(k, *rows[k], 5) for k in (0, 2, 4, 5)]
    seen = spark.createDataFrame([(i % 7, filler(i)) for i in range(40)], "doc_id long, text string").selectExpr("*", "IF(doc_id < 4, 'en', 'de') AS lang")
    more = seen.unionByName(spark.createDataFrame([(1, "123", "en"), (None, filler(5), None), (None, "--", "en"), (3, None, "en")], "doc_id long, text string, lang string"))
    kept = corpus_pipeline.language(spark, more, folder).collect()
    assert len(kept) >= 40 and not {r.text for r in kept} & {"123", "--", None} and sum(r.doc_id is None for r in kept) == 1


def test_filters_shuffle_no_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.language, corpus_pipeline.leaks):
        assert "Exchange" not in stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    # line dedup and the n-gram join: one part of the union moves, the texts that lose a line or share an id with one that goes
    for stage in (corpus_pipeline.lines, corpus_pipeline.near):
        plan = stage(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        below = [x for x in plan if "MapInArrow" in x or "Join" in x]
        assert plan[0].startswith(("Union", "Project")) and sum("Join" in x for x in below) == 1 and any("Join" not in x for x in below[-1:])


def test_near_rows_of_one_id(spark, folder):
    """Rows that share an id: each is kept or not by its own text; rows alike in both stay or go together."""
    rows = [(1, filler(7)), (70, filler(7) + " more"), (70, filler(8)), (80, filler(9)), (80, filler(9)), (None, filler(7)), (90, None), (91, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h1 string")
    kept = corpus_pipeline.near(spark, docs, folder)
    assert kept.columns == docs.columns
    want = [r for r in rows if r != (70, filler(7) + " more")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_extract_reads_its_columns_only(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "t", 7, "p", [1])] * 2
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, path string, blocks array<int>")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, LONG.strip(), len(LONG.strip()))] * 2


KEPT = [
    ('<p title="the hidden valley">Lost one, and more of it, as we said.</p>', "Lost one"),
    ('<p><a title="A hidden cost" href=x>Lost link</a> stands here, in a sentence of words.</p>', "Lost link"),
    ('<p data-kicker="our hidden style" data-b=\'class="ad"\'>Lost kick, with all of the words, here.</p>', "Lost kick"),
    ('<pre>x = 1 <span class="hljs-comment"># lost code</span></pre>', "lost code"),
    ('<pre>x = 1 <span class="comment"># lost code</span></pre>', "lost code"),
    ('<section id="code-comment"><p>Lost section, which was long, and had words.</p></section>', "Lost section"),
    ('<div class="adHoc"><p>Lost adhoc, which was long, and had words.</p></div>', "Lost adhoc"),
    ('<p aria-hidden="true">Lost aria, which was long, and had words.</p>', "Lost aria"),
    ("<p>So <math><mi>lostx</mi><mo>=</mo><mn>1</mn></math> holds, as was shown before.</p>", "lostx"),
    ("<xmp>lost <b>xmp</b> &amp; text, which is long, and has words</xmp>", "lost <b>xmp</b> &amp; text"),
]
GONE = [
    ('<div class="comments"><p>Reader one says that this is fine, as ever, and long enough.</p></div>', "Reader one"),
    ('<div id="comment-list"><p>Reader two says that this is fine, as ever, and long enough.</p></div>', "Reader two"),
    ('<div class="ad-slot"><p>Buy this now, it is very good, as ever.</p></div>', "Buy this"),
    ('<p class="x" class="y" hidden>Not seen, as it is hidden, whatever else it says.</p>', "Not seen"),
]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_attributes_are_read_in_order_and_names_as_wholes(tag):
    text = "".join(f"<p>The river rose again in spring {i}, and the whole village, as ever, watched it from the bridge.</p>" for i in range(6))
    for inner, words in KEPT + GONE:
        found = html_extract.main_text(f"<html><body><nav><a href=x>Home</a></nav><{tag}><h1>Title of it</h1>{text}{inner}</{tag}><footer>foot</footer></body></html>")
        assert (words in found) == ((inner, words) in KEPT) and "spring 5" in found and "Home" not in found
