"""Main text extraction and WARC archives."""

import gzip
import hashlib
import io
import random
import time
from collections import Counter

import pytest

from repolytics.llm import extract, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav>
<div class="top-banner">{ad}</div><div class="story"><h1>{title}</h1><p>First &amp; <b>bo</b>ld<br>line &lt;{n}&gt;<p>Second&nbsp;para {n}</div><div class=legal>All rights reserved</div>
<div id="comments"><p>nice {n}</p></div><form>Name <input></form><script>var x = "</p>";</script><footer>&copy; {ad}</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://news.example.org/a/{i}", PAGE.format(ad="Buy", title=f"Title {i}", n=i), "x") for i in range(12)]
    rows += [(20, None, None, "x"), (21, "::odd", "", "x"), (22, "http://b.example.org", "just text <article>kept <p>one</article> dropped", "x"), (23, "https://news.example.org/a/1", PAGE.format(ad="Buy", title="Title 1", n=1), "x")]
    rows += [(24, "http://c.example.org/", "x" * 300_000 + "<p>" + "y" * 100, "x"), (25, "http://c.example.org/", "short", "x"), (26, "http://c.example.org/", "short", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(2, "url")


def test_template_and_markup_are_dropped(pages):
    for most in (200_000, 0):  # broadcast and joined wrappers
        got = {r["page_id"]: r for r in extract.extract(pages, most).collect()}
        for i in range(12):
            assert got[i]["text"] == f"Title {i} First & bold line <{i}> Second para {i}"
        assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "kept one"
        assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == 19


def test_siblings_of_one_label_get_their_own_verdicts(spark):
    one = "<body><p>story {0} told</p><p>Follow us</p><p>All rights reserved</p></body>"
    many = "<body>" + "".join(f"<p>part {k} of {{0}}</p>" for k in range(10)) + "<p>All rights reserved</p></body>"
    rows = [(i, f"http://{h}.example.org/{i}", page.format(i)) for at, (h, page) in enumerate((("one", one), ("many", many))) for i in range(at * 10, at * 10 + 8)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2, "url").coalesce(1)).collect()}
    assert all(got[i] == f"story {i} told" for i in range(8))
    assert all(got[i] == " ".join(f"part {k} of {i}" for k in range(10)) for i in range(10, 18))


def test_pages_of_a_host_meet_from_any_split(spark):
    page = "<body><p>story {0} told</p><div>All rights reserved</div></body>"
    rows = [(i, f"http://h{i % 3}.example.org/{i}", page.format(i)) for i in range(60)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 60), "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract.extract(frame).collect()} == {i: f"story {i} told" for i in range(60)}


def test_alignment_pairs_in_order():
    a, b = (extract.measured(extract.parse(f"<div><h1>a</h1>{x}<p>1</p><ul></ul></div>")) for x in ("", "<table></table>"))
    assert [x.tag for x, _ in extract.align(a[0], b[0])] == ["#", "div", "h1", "p", "ul"]


def test_constant_siblings_align_wherever_they_stand():
    a = extract.measured(extract.parse("<p>one</p><p>two</p><p>three</p><p>all rights reserved</p>"))
    b = extract.measured(extract.parse("<p>uno</p><p>all rights reserved</p>"))
    assert ("all rights reserved", "all rights reserved") in [(x.text(), y.text()) for x, y in extract.align(a[0], b[0])]


def best(us, vs):
    """By definition: the weight of the best pairing in order of two lists of labels with subtrees."""
    if not us or not vs:
        return 0
    u, v = us[0], vs[0]
    weight = 0
    if u.label == v.label:
        shared = sum((Counter(c.label for c in u.children) & Counter(c.label for c in v.children)).values())
        weight = (u.size if u.shape == v.shape else 1 + shared) + (u.size if u.full == v.full else 0)
    return max(best(us[1:], vs), best(us, vs[1:]), weight + best(us[1:], vs[1:]) if weight else 0)


def test_pairs_weigh_most():
    r = random.Random(8)
    inner = lambda: "".join(f"<{t}>{r.randrange(2)}</{t}>" for t in r.choices(["p", "ul", "h2"], k=r.randint(0, 3)))
    page = lambda: extract.measured(extract.parse("".join(f"<{t}>{r.randrange(2)}{inner()}</{t}>" for t in r.choices(["div", "section"], k=r.randint(0, 6)))))
    for _ in range(60):
        a, b = page()[0], page()[0]
        for cells in (4_000_000, 3):
            found = extract.matched(a.children, b.children, cells)
            assert all(x.label == y.label for x, y in found)
            places = [(a.children.index(x), b.children.index(y)) for x, y in found]
            assert places == sorted(places) and len({x for x, _ in places}) == len({y for _, y in places}) == len(places)
            assert sum(best([x], [y]) for x, y in found) == best(a.children, b.children)


STORY = "<body class='single has-sidebar'><div><div>{menu}</div><p>{one}</p><div>Subscribe now</div><p>{two}</p></div><div>Imprint and terms</div></body>"


def stories(n, hosts=1):
    return [(i, f"https://h{i % hosts}.example.org/{i}", STORY.format(menu="Home News Sport", one=f"story {i} begins", two=f"and ends with {i * 7}")) for i in range(n)]


def extracted(spark, rows, parts, **more):
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract.extract(frame, **more).collect()}


def test_alignment_alone_finds_the_content(spark):
    rows = stories(24)
    assert extracted(spark, rows, 4) == {i: f"story {i} begins and ends with {i * 7}" for i in range(24)}
    assert all("Subscribe" in extract.content(html) and "Imprint" in extract.content(html) for _, _, html in rows)


def test_results_depend_on_the_pages_alone(spark):
    rows = stories(90, 3) + [(200 + i, "http://one.example.org/", f"<p>alone {i}</p><p>x</p>") for i in range(2)]
    want = extracted(spark, rows, 1, run=8)
    for parts, seed in ((64, 1), (7, 2)):
        assert extracted(spark, random.Random(seed).sample(rows, len(rows)), parts, run=8) == want
        assert extracted(spark, rows, parts, run=8, most_broadcast=0) == want


@pytest.mark.parametrize(
    "html,text",
    [
        ('<body class="single has-sidebar"><p>hello world</p></body>', "hello world"),
        ('<article class="post comments-open"><p>hello</p></article>', "hello"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>x</p></article>', "Title x"),
        ('<article><header><h1>Title</h1></header><p>x</p><footer>share</footer></article>', "Title x"),
        ('<article><div class="ad-free-story"><p>kept</p></div></article>', "kept"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
        ('<p>one</p><div class="comment-list"><p>me too</p></div><div id="site-footer">foot</div><div class="top-banner">ad</div>', "one"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li><p>y<li>z</ul><dl><dt>t<dd>d</dl>", "a b c x y z t d"),
        ("a &lt; b < c &amp;&#233; <b>bold</b>er<br>next<p>un<i>fin</i>ished", "a < b < c &é bolder next unfinished"),
        ("<p title='a>b'>one</p><p title=\"it's\">two</p><p x=a'b>three</p>", "one two three"),
        ("<p title='never closed>one</p><p>two</p>", "one two"),
        ("one<!-- two --><!---->three<?x y?><!DOCTYPE z></ >four<scr", "onethreefour"),
        ("<noscript><p>no</p></noscript><svg/><svg><text>no</text></svg><p>yes</p><script>if (a</p>b) </SCRIPT >x", "yes x"),
        ("<SCRIPT>never closed <p>gone", ""),
        (None, ""),
    ],
)
def test_markup(html, text):
    assert extract.content(html) == text


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    wide = "".join(f"<p>{i}</p>" for i in range(3_000))
    for html in ("<a " * 100_000, "<a x='>'" * 50_000 + "'", '<a b="' * 50_000, "<" * 200_000, "<!--" * 50_000, "</p>" * 50_000, "<p><article><div>" * 5_000 + "</p>" * 20_000, "&" * 100_000, "= " * 100_000, deep, "<svg>" * 20_000 + "</div>" * 20_000):
        extract.content(html)
        extract.measured(extract.parse(html))
    trees = [extract.measured(extract.parse(html)) for html in (deep, deep.replace("x", "y"), wide, wide.replace("<p>", "<p>n"), "".join(f"<h{i % 6 + 1}>{i}</h{i % 6 + 1}>" for i in range(3_000)))]
    for a, b in ((0, 1), (2, 3), (3, 4)):
        extract.align(trees[a][0], trees[b][0])
    assert extract.content(deep) == "x" and time.perf_counter() - began < 30


def test_odd_rows_of_pages(spark):
    rows = [(None, "http://a.example/", "<p>x</p>"), (1, None, None), (1, None, None), (2, "::", ""), (3, "http://a.example/", "<p>x</p>"), (3, "http://a.example/", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as run", "2 as path", "'t' as text", "3 as n")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract.extract(frame).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "x", 1), ("3", "x", 1), ("None", "x", 1)]


def test_archives_round_trip(pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    for split in (997, 4 << 20):
        rows = sorted(warc.read_archives(manifest, split, payloads=True).collect())
        want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
        first = {}
        for i in sorted(want):
            first.setdefault(want[i], i)
        assert [r["page_id"] for r in rows] == sorted(want)
        for r in rows:
            body = want[r["page_id"]]
            later = len(body) >= 100 and first[body] != r["page_id"]
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest() and r["digest_ok"]
            assert (r["record_type"], r["refers_to"]) == (("revisit", first[body]) if later else ("response", None))
            assert later or bytes(r["payload"]) == body


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_chance_magic_is_no_record():
    member = warc.record(1, "http://x/", b"body", "d", None)
    noise = b"\x1f\x8b\x08\x00junk" * 5
    data = noise + member + noise + warc.record(2, "http://y/", b"", "e", None)
    for cut in range(0, len(data), 7):
        found = [warc.page_of(f["warc-record-id"]) for a, b in ((0, cut), (cut, len(data))) for f, _, _ in warc.records_in(Source(data), a, b)]
        assert found == [1, 2]


def test_each_row_of_a_page_id_is_judged_by_its_payload(spark, tmp_path):
    a, b = "A" * 150, "B" * 150
    rows = [(1, a), (5, a), (5, b), (5, "tiny"), (1, a), (7, b), (9, "tiny"), (None, a), (2, None)]
    frame = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.write_archives(frame, f"file://{tmp_path}/r"), payloads=True).collect()
    found = sorted(((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert found == sorted([("1", 150, "response", None)] * 2 + [("5", 150, "revisit", 1), ("5", 150, "response", None), ("5", 4, "response", None), ("7", 150, "revisit", 5), ("9", 4, "response", None), ("None", 150, "response", None), ("2", 0, "response", None)], key=str)
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {a.encode(), b.encode(), b"tiny", b""}


def foreign(kind: str, block: bytes, **more: str) -> bytes:
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC-Type": kind, **more, "Content-Length": str(len(block))}.items())
    return gzip.compress(b"WARC/1.0\r\n" + head.encode("latin-1") + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers_are_read(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    data = foreign("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields")
    data += foreign("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>")
    data += foreign("response", http + b"body", WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://caf\xe9.example/", Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:AAAA")
    data += gzip.compress(b"no record at all")
    data += foreign("revisit", http, WARC_Record_ID="<urn:uuid:3>", WARC_Refers_To="<urn:uuid:2>", Content_Type="application/http")
    (tmp_path / "other.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", 5, len(data))], "path string, records long, bytes long")
    for split in (100, 1 << 20):
        rows = sorted(warc.read_archives(manifest, split, payloads=True).collect(), key=lambda r: r["offset"])
        assert [(r["record_type"], r["page_id"], r["record_id"], r["refers_record"]) for r in rows] == [("response", None, "<urn:uuid:2>", None), ("revisit", None, "<urn:uuid:3>", "<urn:uuid:2>")]
        assert bytes(rows[0]["payload"]) == b"body" and rows[0]["url"] == "http://caf\xe9.example/" and rows[0]["digest_ok"]


def test_op7_equals_its_sql(spark):
    import duckdb

    from repolytics.llm import queries
    from tests.conftest import SF

    duckdb.sql(f"create or replace view pages as select * from '{SF}/pages.parquet'")
    want = duckdb.sql(warc.ORACLE)
    got = queries.op7_warc(spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_empty_tables(pages, tmp_path):
    none = pages.limit(0)
    assert extract.extract(none).count() == 0
    assert warc.read_archives(warc.write_archives(none, f"file://{tmp_path}/e")).count() == 0
