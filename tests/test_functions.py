"""Literal cases of the URL, HTML, text, bin and selector functions."""

import pytest
from pyspark.sql import functions as F

from newsgrain.functions import bins, dom
from newsgrain.functions import html as H
from newsgrain.functions import text as X
from newsgrain.functions import url as U


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


PATHS = {
    "/a/12.34abc": "/a/00.a",
    "/a/12.34-abc": "/a/IDa",
    "/12_34/": "/a/",
    "/12.3_4/": "/ID/",
    "/2014/05/01/foo-bar.html": "/0000/00/00/a.html",
    "/x/20140501-12": "/a/ID",
    "/n.12/3.php5": "/a.00/0.php5",
    "/a.b.c": "/a.a.c",
    "": "",
}


def test_path_signature(spark):
    assert values(spark, U.path_signature, list(PATHS)) == list(PATHS.values())


def test_url_signature(spark):
    url = "http://www.people.com/people/package/0,,20395222,00.html"
    got = values(spark, U.signature_parts, [url, "http://x.org/a=1/b;c=2?q=1&r=2", None])
    assert tuple(got[0]) == ("people.com", "/a/a/ID.html", "")
    assert got[1]["query"] == "q&r"
    assert values(spark, U.signature, [url]) == ["people.com/a/a/ID.html/"]
    assert values(spark, lambda c: U.signature(c, "legacy"), [url]) == ["people.com/a/a/ID.html?"]


def test_registrable(spark):
    hosts = ["http://news.bbc.co.uk/x", "a.b.example.com", "localhost", "http://10.0.0.1/", "co.uk", "x.co.de", "www.nasa.gov", "a.internal", None]
    assert values(spark, U.registrable, hosts) == ["bbc.co.uk", "example.com", "localhost", "10.0.0.1", "co.uk", "co.de", "nasa.gov", "internal", None]


DIFFERENCES = [
    ("http://a.com/x", "http://a.com/x", "<same>"),
    ("-", "http://a.com/x", "-"),
    ("https://a.com/x", "http://a.com/x", "https://<same>"),
    ("http://m.a.com/x", "http://www.a.com/x", "<scheme>://m.<domain+>/<path>"),
    ("http://m.a.com:80/x", "http://www.a.com/x", "<scheme>://m.a.com:80/<path>"),
    ("http://m.b.co.uk/x", "http://m.a.co.uk/x", "<scheme>://<subdomain>.b.<suffix>/<path>"),
    ("http://a.com/x/", "http://a.com/x", "<scheme>://<netloc>/<path>/"),
    ("http://a.com/q/x", "http://a.com/z/x", "<scheme>://<netloc>/q/<basename>"),
    ("http://a.com/z/q/y", "http://a.com/z/x", "<scheme>://<netloc>/<dir1>/q/y"),
    ("http://a.com/p/p/y", "http://a.com/p/q/p/x", "<scheme>://<netloc>/<dir3>/<dir3>/y"),
    ("http://a.com/x?a=1&b=2", "http://a.com/x?a=1", "<scheme>://<netloc>/<path>?<query>&b%3D2"),
    ("http://a.com/x?c=3", "http://a.com/x?a=1", "<scheme>://<netloc>/<path>?c=3"),
    ("http://a.com/x#f", "http://a.com/x#g", "<scheme>://<netloc>/<path>#f"),
    (None, "http://a.com/x", None),
    ("http://a.com/x", None, None),
]


def test_difference(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(DIFFERENCES)], "i int, new string, old string")
    got = df.select("i", U.url_difference(F.col("new"), F.col("old")).alias("d")).sort("i").collect()
    assert [r["d"] for r in got] == [d for *_, d in DIFFERENCES]


def test_registrable_by_list(spark, tmp_path):
    (tmp_path / "list").write_text("// public suffixes\ncom\nuk\nco.uk  note\n*.ck\n!www.ck\n")
    rules = U.listed_suffixes(spark, str(tmp_path / "list"))
    hosts = {"http://news.bbc.co.uk/x": "bbc.co.uk", "a.b.com": "b.com", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", "host.unknown": "unknown", "co.uk": "co.uk"}
    df = spark.createDataFrame([(h,) for h in [*hosts, None, "a.b.com"]], "host string")
    got = [(r["host"], r["registrable"]) for r in U.with_registrable(df, "host", rules).collect()]
    assert len(got) == len(hosts) + 2 and dict(got) == {**hosts, None: None}


def test_compress(spark):
    cases = {"foo<script hello=world>foo </script>bar": "foobar", "foo \nbar": "foo\nbar", "foo  \n  \n  bar": "foo\n\nbar", "foo \n \n \n bar": "foo\n\nbar", " <!-- c -->x ": "<!-- c -->x"}
    assert values(spark, H.compress, list(cases)) == list(cases.values())


def test_canonical(spark):
    base = F.lit("http://a.com/b/c")
    pages = ['<meta property="og:url" content="http://x.com/?a=1&amp;b=2"><link rel="canonical" href="http://y.com">', "<link rel='canonical' href=http://y.com/z>", "<p>none</p>", '<link rel="canonical" href="/relative">']
    assert values(spark, lambda c: H.social_canonical(c, base), pages) == ["http://x.com/?a=1&b=2", "http://y.com/z", None, None]


def test_base_and_refresh(spark):
    page = '<html><head><base href="/r/"><title>t</title></head></html>'
    assert values(spark, lambda c: H.with_base(c, F.lit("http://a.com/x")), [page, "<p>no head</p>"]) == ['<html><head><base href="http://a.com/r/"><title>t</title></head></html>', "<p>no head</p>"]
    assert values(spark, H.refresh_target, ['<meta http-equiv="refresh" content="3; url=/next">', "<meta content='x'>"]) == ["/next", None]
    assert [tuple(x) for x in values(spark, H.meta_fields, ['<meta name="b" content="2"><meta property="c" content="1"><meta content="1&amp;2" name="a">'])[0]] == [("a", "1&2"), ("b", "2")]


def test_dates(spark):
    got = values(spark, X.parse_date, ["2001-05-01", "1 May 2014", "2014-05-01 yyyy-mm-dd", "whenever", None])
    assert [d.isoformat()[:10] if d else None for d in got] == ["2001-05-01", "2014-05-01", "2014-05-01", None, None]


def test_bins(spark):
    x = [None, 0, 1, 2, 3, 4, 9, 10, 3_981_071, 3_981_072, 5_000_001]
    assert values(spark, bins.bin_of, x, "bigint") == [None, 0, 1, 5, 6, 8, 11, 11, 67, 68, 68]
    assert bins.FINE[:12] == (0, 1, 1, 1, 1, 2, 3, 3, 5, 6, 7, 10)
    assert values(spark, bins.log_shares, [0, 100], "bigint") == [None, 2.0]


def test_text(spark):
    assert X.camelcase("Ünïted we_stand, o'neill!") == "UnitedWestandOneill"
    assert values(spark, X.word_count, [" a\tb\n", "", None]) == [2, 0, 0]
    assert values(spark, X.export_text, ["é\nb", None]) == ["e\r\nb\r\n", ""]
    df = spark.createDataFrame([(None, "<b>", "a ; b")], "n string, m string, p string")
    row = df.select(*[c.alias(k) for k, c in X.flags({"n": ("null", "markup"), "m": ("markup", "noniso"), "p": ("loosepunc",)}).items()]).first()
    assert row.asDict() == {"n_has_null": 1, "n_has_markup": 0, "m_has_markup": 1, "m_has_noniso": 1, "p_has_loosepunc": 1}


PAGE = """<html><head><title>T</title></head><body><div id=main class="story big"><h1>Head <b>line</b></h1><p>One<p>Two<br>lines
 here</div><ul><li>a<li>b</ul><span itemprop="author">Ann</span><time datetime="2014-01-01">x</time></body></html>"""


@pytest.mark.parametrize(
    ("program", "values_", "which"),
    [
        ("((text))h1", ["Head line"], 0),
        ("((text)).none; ((text))h1", ["Head line"], 1),
        ("<domain><default>((text))h1", ["Head line"], 0),
        ("((comment a;b)) time::attr(datetime)", ["2014-01-01"], 0),
        ("h1 > b::text", ["line"], 0),
        ("((text))div.story p", ["One", "Two\nlines here"], 0),
        ("((text))#main > p + p", ["Two\nlines here"], 0),
        ("((text))h1 ~ p", ["One", "Two\nlines here"], 0),
        ("li", ["a", "b"], 0),
        ("((text))[itemprop=author], h1", ["Head line", "Ann"], 0),
        ("((xpath))//span[@itemprop='author']/text()", ["Ann"], 0),
        ("((xpath))//time/@datetime", ["2014-01-01"], 0),
        ("[class^=story]::attr(id)", ["main"], 0),
        ("[class~=big]::attr(id)", ["main"], 0),
        ("", None, None),
        (".none", None, None),
    ],
)
def test_selectors(program, values_, which):
    assert dom.extract(program, dom.parse(PAGE)) == (values_, which)


def test_selector_errors():
    assert dom.compiles("a > b; ((xpath))//a")
    assert not dom.compiles("a:hover")
    assert not dom.compiles("((xpath))count(//a)")


def test_paths_and_annotations():
    root = dom.parse('<div class="a b"><p itemprop="x">t</p></div>')
    assert dom.paths(root) == {"html", "html/div", "html/div/[@class=a]", "html/div/[@class=b]", "html/div/p", "html/div/p/[@itemprop=x]"}
    assert dom.annotations(root) == [("microdata", "itemprop", 1, ["x"])]
    body = "<div id=nav><a>x</a></div><div id=c><p>" + "long text, with commas, " * 9 + "</p><p>" + "more, " * 20 + "</p></div>"
    assert dom.main_content(dom.parse(body)).attrs["id"] == "c"


def test_decoding():
    meta = b'<meta http-equiv="content-type" content="text/html; charset=utf-8">'
    assert H.decode_page(meta + "é".encode(), "text/html; charset=iso-8859-1").endswith("é")
    assert H.decode_page("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert H.decode_page("“x”".encode(), "text/html; charset=iso-8859-1") == "“x”"
    assert H.decode_page(b"\x93x", None) == "“x"
    assert H.decode_page(b"x", "text/html; charset=nonsense") == "x"
    assert H.decode_page(None, None) is None
