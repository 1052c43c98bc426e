import duckdb
import pytest

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>First\n  one.<p>x</article><div class='comments'><p>me too</p></div><footer>f</footer>"


def test_main_text():
    from strandlake.llm.html_extract import main_text

    assert main_text(PAGE) == "A & B\nFirst one.\nx"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    long = "words of the article, " * 8
    assert main_text(f"<div class=menu>m</div><div><p>{long}</p><p>Short.</p></div><div id=sidebar>s</div>") == f"{long.strip()}\nShort."


def test_chats(spark):
    from strandlake.llm.chat_format import OP10_SQL, op10_chat_format

    rows = [(1, 0, "user", "a <s>[b]\\1 \\0"), (1, 1, "assistant", "é</s>"), (1, 1, "assistant", "é</s>"), (2, 0, None, None), (2, 1, "assistant", ""), (3, None, "system", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = sorted(tuple(r[n] for n in names) for r in op10_chat_format(frame).collect())
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({OP10_SQL})").fetchall())


def test_reply_paths(spark):
    from strandlake.llm.chat_format import reply_paths

    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6: the second branch scores more.
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 2.0), ("t", 3, 1, 0.5), ("t", 4, 2, 1.0), ("t", 5, 3, None), ("t", 6, 5, 9.0)]
    got = reply_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double")).collect()
    assert sorted((r.depth, r.node) for r in got) == [(0, 1), (1, 3), (2, 5), (3, 6)]
    assert {r.leaf for r in got} == {6}


def test_split_pages_and_title_ids():
    from strandlake.llm.html_extract import main_text

    long, short = "words of a long section, " * 72, "a closing section of few words, " * 6
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(4))
    adverts = "<div class=ad>buy</div>" * 4
    opening = f"<h1>Title</h1><p>{short}</p>"
    page = f"<div>{opening}<ul>{links}</ul><p>{long}</p>{adverts}<p>Only a line.</p>{adverts}<h2>End</h2><p>{short}</p></div>"
    assert main_text(page) == "\n".join(["Title", short.strip(), long.strip(), "Only a line.", "End", short.strip()])
    article = "<div class='article-header'><h1>T</h1></div><h2 id='related-work'>Related work</h2><p>x</p><section id='search-methods'><p>y</p></section>"
    clutter = "<section id='comments'>c</section><div id='related-posts'>r</div><section class='share'>s</section>"
    assert main_text(f"<article>{article}{clutter}</article>") == "T\nRelated work\nx\ny"


def test_surges_decide():
    """What no name gives away is told by the lines' lengths: without the method these would stay."""
    from strandlake.llm.html_extract import lines_of, main_text

    long = "a sentence of the main text. " * 9
    page = f"<body><div>Home About Contact</div><div><h1>Title</h1></div><div><p>{long}</p><p>Short.</p></div><div><div><p>{long}</p></div></div><div>Links</div><div>Imprint</div></body>"
    assert main_text(page) == "\n".join(["Title", long.strip(), "Short.", long.strip()])
    assert [x[0] for x in lines_of(page)][0] == "Home About Contact"
    teasers = "<article><h2>Other</h2><p>teaser</p></article>" * 3
    assert main_text(f"<article><h1>T</h1><p>{long}</p><section><p>End.</p></section></article>{teasers}") == f"T\n{long.strip()}\nEnd."


def test_names_with_other_words_stay():
    from strandlake.llm.html_extract import main_text

    long = "words of the text, " * 20
    for name in ("social-history", "article-header", "has-sidebar", "form-of-government"):
        assert main_text(f"<div class='{name}'><p>{long}</p></div>") == long.strip()
    for name in ("social", "sidebar-left", "post-comments", "related-posts", "site-header"):
        assert main_text(f"<div class='x {name}'><p>{long}</p></div><div><p>x</p></div>") == "x"


def test_extract_handles_odd_pages(spark):
    from strandlake.llm.html_extract import extract_main_text, op5_html_extract

    long = "word " * 200_000
    rows = [(1, "a", None), (2, None, ""), (None, "b", f"<article>{long}</article>"), (4, "c", "<p" * 5000), (5, "d", "<div>" * 3000 + "x"), (5, "d", "<div>" * 3000 + "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in op5_html_extract(frame).collect()), key=str)
    assert got == sorted([(1, "a", 0), (2, None, 0), (None, "b", len(long) - 1), (4, "c", 0), (5, "d", 1), (5, "d", 1)], key=str)
    assert op5_html_extract(frame.limit(0)).count() == 0
    odd = extract_main_text(frame.withColumnRenamed("url", "text"))
    assert odd.columns == ["page_id", "text", "html", "_text"] and odd.filter("text = 'c'").count() == 1


def test_query_against_plain_reading(spark):
    """The given pages mark one article without clutter inside, so a plain reading of it is the answer."""
    import html
    import re

    from strandlake.llm.queries import queries

    def plain(page: str) -> str:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inside)
        texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
        return "\n".join(t for t in texts if t)

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries()["op5_html_extract"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class=story><h1>T</h1><p>Short one.</p></div><div class=imprint>Imprint of the firm in the town</div>", "T\nShort one."),
        ("<div id='main-content'><p>Alpha beta gamma.</p><a href=x>Delta</a></div><div class=box>" + "Other words here. " * 20 + "</div><div class='teaser-list'><p>No</p></div>", None),
        ("<p>" + "One two three. " * 12 + "</p><p><a href=x>A paragraph that is wholly a link.</a></p><p>" + "Four five six. " * 12 + "</p>", "One two three. " * 12 + "\nA paragraph that is wholly a link.\n" + "Four five six. " * 12),
        ("<p>" + "One two three. " * 12 + "</p><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>" + "Four five six. " * 12 + "</p>", "One two three. " * 12 + "\n" + "Four five six. " * 12),
    ],
)
def test_pages_without_article_elements(page, want):
    from strandlake.llm.html_extract import main_text

    got = main_text(page)
    if want is None:
        assert "Alpha beta gamma." in got
    else:
        assert got == "\n".join(x.strip() for x in want.split("\n"))


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "comment-thread", "discussion", "responses", "comments", "readerComments"])
@pytest.mark.parametrize("inside", [True, False])
def test_reader_comments_go(name, inside):
    from strandlake.llm.html_extract import main_text

    text, comments = "<p>" + "The story goes on. " * 10 + "</p>", f"<div class='{name}'><p>{'I think so too. ' * 10}</p></div>"
    page = f"<article>{text}{comments}</article>" if inside else f"<article>{text}</article>{comments}"
    assert main_text(page) == ("The story goes on. " * 10).strip()
