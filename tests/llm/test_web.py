"""WARC, URL filters, main text."""

import gzip
import hashlib
import html
import io
import os
import re
import time
import zlib

import pytest

from shelfmate.llm import html_wrappers, url_filters, warc

from .helpers import SF_DIR

PAGES = "page_id long, url string, html string, host string, payload string"


def awkward_pages(spark):
    big = "<p>" + "x" * 2000
    rows = [
        (1, "http://a.com/x", big, None, None), (5, "http://a.com/y", big, None, None), (3, None, big, None, None), (5, "http://a.com/y", big, None, None),
        (None, "http://b.com", big, None, None), (6, "http://b.com/é?q=\r\nX: y", "small", None, None), (7, "bad url", "small", None, None),
        (8, "http://b.com", None, None, None), (9, "http://b.com", "", None, None), (10, "http://b.com", "é" * 600, None, None),
        (11, "http://b.com", "\x1f\x8b\x08 WARC/1.1\r\n" + "z" * 3000, None, None), (12, "HTTP://User@B.com:80/p/q", "<div>" * 3000 + "deep", None, None),
    ]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("range_bytes", [300, 8 << 20])
def test_warc_round_trip(spark, tmp_path, range_bytes):
    pages = awkward_pages(spark)
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"), range_bytes=range_bytes)
    got = warc.pages_of(records).collect()
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    assert len(got) == len(rows)
    want = []
    for key, text in rows:
        data = text.encode()
        keys = [k for k, t in rows if t == text and k is not None]
        top = max(keys) if len(data) >= 1000 and len([1 for _, t in rows if t == text]) > 1 and keys else None
        revisit = top is not None and top != key
        want.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    payloads = {r.headers[warc.KEY_FIELD]: bytes(r.payload).decode() for r in records.where("warc_type = 'response'").collect() if warc.KEY_FIELD in r.headers}
    assert payloads["11"].startswith("\x1f") and payloads["10"] == "é" * 600


def test_archive_is_plain_gzip(spark, tmp_path):
    warc.write_archive(awkward_pages(spark).coalesce(1), str(tmp_path / "w"))
    part = next(p for p in os.listdir(tmp_path / "w") if p.startswith("part-"))
    data = gzip.open(tmp_path / "w" / part).read()
    types = [fields["WARC-Type"] for fields, _ in warc.parse_records(data)]
    assert types.count("warcinfo") == 1 and len(types) == 13


def test_members_have_one_owner():
    """Whatever the ranges, every member is found once, also with magic numbers inside payloads."""
    records = [warc.page_record(i, "u", bytes([31, 139, 8]) * i + os.urandom(50 * i), None, False, "d") for i in range(40)]
    members = [warc._member(r) + b"\0" for r in records]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # not compressed: the magic numbers stand in the file
    members.append(stored.compress(records[39]) + stored.flush())
    data = b"".join(members)
    for step in (1, 7, 100, 1000, len(data)):
        found = []
        for start in range(0, len(data), step):
            found += [x for _, x in warc.owned_members(io.BytesIO(data), start, min(start + step, len(data)))]
        assert found == [*records, records[39]]
    with pytest.raises(ValueError, match="damaged"):
        list(warc.owned_members(io.BytesIO(data[:-20]), 0, len(data) - 20))


def test_member_above_16_mb():
    record = b"WARC/1.1\r\nContent-Length: 17000000\r\n\r\n" + bytes(17_000_000) + b"\r\n\r\n"
    data = warc._member(record) + b"\0"
    assert gzip.decompress(data) == record
    assert [x for _, x in warc.owned_members(io.BytesIO(data), 0, len(data))] == [record]


def test_warc_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.pages_of(warc.read_archive(spark, str(tmp_path / "w"))).count() == 0


def test_url_filters_by_hand(spark):
    from datetime import date, timedelta

    day = lambda n: date(2024, 1, 1) + timedelta(n)
    entries = [
        ("hosts", "block", "domain", "b.com", "add", day(5)), ("hosts", "block", "domain", "b.com", "remove", day(9)),
        ("hosts", "block", "domain", "b.com", "add", day(20)), ("hosts", "block", "domain", "b.com", "add", day(25)),
        ("hosts", "block", "domain", "a.b.com", "add", day(1)), ("hosts", "block", "domain", "a.b.com", "remove", day(1)),
        ("paths", "block", "prefix", "c.com/x/y", "add", day(3)), ("urls", "block", "url", "http://d.com/?q=1", "add", day(0)),
        ("ok", "allow", "domain", "good.b.com", "add", day(22)), ("hosts", "block", None, "e.com", "add", day(0)),
        ("hosts", "block", "domain", "e.com", "add", None),
    ]
    captures = [
        (1, "http://www.b.com/p", day(4)), (2, "http://www.b.com/p", day(5)), (3, "http://www.b.com/p", day(9)), (4, "http://B.com:80/", day(30)),
        (5, "http://good.b.com", day(30)), (6, "http://a.b.com", day(3)), (7, "http://c.com/x/y/z?q", day(3)), (8, "http://c.com/x/yy", day(3)),
        (9, "http://d.com/?q=1", day(0)), (10, None, day(0)), (11, "http://b.com", None), (12, "no url", day(9)), (13, "http://notb.com", day(6)),
        (14, "http://e.com", day(6)), (15, "http://c.com/x/y", day(2)), (2, "http://www.b.com/p", day(5)),
    ]
    log = spark.createDataFrame(entries, "list string, verdict string, kind string, pattern string, action string, dated date")
    seen = spark.createDataFrame([(*c, 0, "x") for c in captures], "page_id long, url string, fetched_at date, n_active int, host string")
    got = url_filters.judge(seen, log).collect()
    assert len(got) == len(captures)
    assert {r.page_id for r in got if r.blocked} == {2, 4, 7, 9}
    assert {r.page_id: r.lists for r in got if r.n_active} == {2: "hosts", 4: "hosts", 5: "hosts,ok", 7: "paths", 9: "urls"}
    assert url_filters.judge(seen, log.limit(0)).where("blocked").count() == 0
    assert url_filters.judge(seen.limit(0), log).count() == 0


def test_url_intervals_are_joined_as_of(spark):
    """A pattern with many intervals meets a capture once: those that do not hold leave no rows in the join."""
    from datetime import date, timedelta

    days = [date(2024, 1, 1) + timedelta(n) for n in range(100)]
    log = [("hosts", "block", "domain", "b.com", "remove" if n % 2 else "add", day) for n, day in enumerate(days)]
    entries = spark.createDataFrame(log, "list string, verdict string, kind string, pattern string, action string, dated date")
    seen = spark.createDataFrame([(n, "http://b.com/", day) for n, day in enumerate(days)], "page_id long, url string, fetched_at date")
    judged = url_filters.judge(seen, entries)
    assert {r.page_id for r in judged.collect() if r.blocked} == set(range(0, 100, 2))
    joins = [line for line in judged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert any("valid_from" in line and "valid_to" in line for line in joins)


def test_main_text_of_tables(spark):
    """The tables' pages mark their article, so a plain expression gives the same text."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r.text for r in html_wrappers.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", b).strip(" ") for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def site(title, paragraphs, number):
    return (
        f"<html><body><div id='top-menu'><a href=/>Home</a><a href=/a>All</a></div><div class=wrap><h2>{title}</h2>"
        + "".join(f"<p>{p}" for p in paragraphs)
        + (f"<ul><li>one {number}<li>two</ul>" if number % 2 else "")
        + "<div>Follow this site for more stories</div></div>"
        + "<div class='comments'><p>Great story, thanks a lot for this, really</div><form><p>Search here</form><footer>Imprint</footer></body></html>"
    )


def test_wrapper_without_article_tag(spark):
    rows = [(i, f"http://news.example/{i}", site(f"Title {i}", [f"Paragraph {i} {j} &amp; more text" for j in range(i % 4 + 1)], i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        lines = [f"Title {i}", *(f"Paragraph {i} {j} & more text" for j in range(i % 4 + 1))] + ([f"one {i}", "two"] if i % 2 else [])
        assert got[i] == "\n\n".join(lines)


def texts_of(spark, pages):
    rows = [(i, f"http://news.example/{i}", page) for i, page in enumerate(pages)]
    got = html_wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


@pytest.mark.parametrize("copies", [5, 50])
def test_copies_of_a_page_are_no_boilerplate(spark, copies):
    page = "<html><body><div><h1>Title</h1><p>The whole text of this page</p></div></body></html>"
    assert texts_of(spark, [page] * copies) == ["Title\n\nThe whole text of this page"] * copies
    # One group of copies has a quotation that no other page has.
    others = [site(f"Title {i}", [f"Paragraph {i} and more text"], 0) for i in range(20)]
    quoted = others[0].replace("<p>", "<blockquote>A quotation</blockquote><p>", 1)
    got = texts_of(spark, others + [quoted] * copies)
    assert got[3] == "Title 3\n\nParagraph 3 and more text"
    assert got[20:] == ["Title 0\n\nA quotation\n\nParagraph 0 and more text"] * copies


def test_unchanging_places_are_on_most_pages(spark):
    """Six of twenty distinct pages share a quotation; a page of nothing but unchanging text keeps it."""
    pages = [f"<body><div><p>Text {i} of the page</p>{'<blockquote>Shared words</blockquote>' if i < 6 else ''}</div></body>" for i in range(20)]
    assert texts_of(spark, pages) == [f"Text {i} of the page" + ("\n\nShared words" if i < 6 else "") for i in range(20)]
    pages = [f"<body><!-- {i} --><div><h1>T</h1><p>text</p></div></body>" for i in range(6)]
    assert texts_of(spark, pages) == ["T\n\ntext"] * 6


def test_text_beside_the_largest_element_stays(spark):
    """Titles, ledes and notes outside the element that holds most of the text; unlabelled menus and fixed lines go."""
    menu = "<ul><li><a href=/>Home</a><li><a href=/a>All the stories</a></ul>"
    body = lambda i: "".join(f"<p>Paragraph {j} of page {i}, with some more words</p>" for j in range(5))
    text = lambda i: "\n\n".join(f"Paragraph {j} of page {i}, with some more words" for j in range(5))
    pages = [f"<html><body>{menu}<h1>Title {i}</h1><div>{body(i)}</div><p>Imprint</p></body></html>" for i in range(8)]
    assert texts_of(spark, pages) == [f"Title {i}\n\n{text(i)}" for i in range(8)]
    pages = [f"<div><h1>Title {i}</h1><p>Lede {i}</p><section>{body(i)}</section></div>{f'<p>Note {i}</p>' if i % 2 else ''}" for i in range(8)]
    assert texts_of(spark, pages) == [f"Title {i}\n\nLede {i}\n\n{text(i)}" + (f"\n\nNote {i}" if i % 2 else "") for i in range(8)]
    # A page on its own.
    page = f"<html><body>{menu}<header><h1>Title</h1></header><div>{body(0)}</div></body></html>"
    assert texts_of(spark, [page]) == [f"Title\n\n{text(0)}"]
    # The whole page is links.
    assert texts_of(spark, [menu]) == ["Home\n\nAll the stories"]


@pytest.mark.parametrize(
    "opening",
    [
        "<article class='post category-social'>", "<article class='post tag-search'>", "<main class='content no-sidebar'>", "<div class='article has-related'>",
        "<article class='category-social'>", "<div class='layout no-sidebar'>", "<div class='layout no-sidebar'><article>", "<main class=search>",
    ],
)
def test_parts_of_names_do_not_hide_articles(spark, opening):
    def page(i):
        text = f"<h1>Title {i}</h1><p>Text {i} of the article, with more words than there are around it</p>"
        return f"<body><div class='main-menu'><a href=/>Home</a></div>{opening}{text}<div class='related-posts'><p>Others {i}</p></div></article></main></div><div class=comments><p>{'Long comment ' * 20}</p></div></body>"

    if opening == "<main class=search>":
        pages = [page(i).split("<div class=comments")[0] for i in range(3)]
    else:
        pages = [page(i) for i in range(3)]
    want = [f"Title {i}\n\nText {i} of the article, with more words than there are around it" for i in range(3)]
    assert texts_of(spark, pages) == want


def test_wrapper_expression():
    pages = ["<ul><li>a</ul>", "<ul><li>b<li>c</ul><p>x", "<h1>t</h1><ul></ul>"]
    whole = html_wrappers.own_wrapper(html_wrappers.parse(pages[0]))
    for page in pages[1:]:
        html_wrappers._merge(whole, html_wrappers.own_wrapper(html_wrappers.parse(page)))
    assert whole.expression() == "(<h1>#text</h1>)? <ul>(<li>#text</li>)*</ul> (<p>#text</p>)?"


def test_main_text_awkward(spark):
    got = {r.page_id: r.text for r in html_wrappers.main_text(awkward_pages(spark)).collect()}
    assert got[8] == "" and got[9] == "" and got[12].endswith("deep") and got[6] == "small"
    assert html_wrappers.main_text(awkward_pages(spark)).count() == awkward_pages(spark).count()
    assert html_wrappers.main_text(spark.createDataFrame([], PAGES)).count() == 0
    many = "".join(f"<t{i % 40}>w{i}</t{i % 40}>" for i in range(500))
    assert html_wrappers.extract(html_wrappers.parse(many), None).count("w") == 500


def text_of(page):
    return html_wrappers.extract(html_wrappers.parse(page), None)


def test_pages_of_any_depth():
    nest, out = "<div>" * 400, "</div>" * 400
    assert text_of(f"<article><p>Before</p>{nest}<p>inner</p>{out}<p>After the nest</article>") == "Before\n\ninner\n\nAfter the nest"
    assert text_of(f"<article>{nest}<nav>menu</nav>deep{out}end</article>") == "deep\n\nend"
    assert text_of(f"<p>side</p>{nest}<article>deep<header>by<h1>Title</h1></header></article>{out}") == "deep\n\nTitle"


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a<" * 350_000, '<a "' * 250_000 + ">", "<a '" * 100_000 + '"' * 100_000 + ">", "<div>" * 200_000 + "x" + "</span>" * 100_000,
     "<ul><li><ul>" + "<b>" * 100_000 + "<li></li>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000],
)
def test_malformed_pages_take_linear_time(page):
    start = time.time()
    text_of(page)
    assert time.time() - start < 30


def test_tags_end_outside_quotes():
    assert text_of("<p title='a > b' class=\"x>y\">one</p><p>a < b and <c") == "one\n\na < b and <c"
    assert text_of('<p>one <a href="x> two</p>') == 'one <a href="x> two'


def test_warc_ranges_follow_the_total():
    assert warc.range_size(0) == warc.range_size(10**9) == warc.RANGE_BYTES
    assert warc.range_size(10**14) == 10**9 and 10**14 / warc.range_size(10**14) <= warc.MOST_RANGES
