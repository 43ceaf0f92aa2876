import gzip
import hashlib
import html
import random
import zlib
from pathlib import Path

import pytest

from quarry.llm.warc import derivatives, derive, links, parsed, plain_text, read_warc, responses, serialized, write_warc

HTML = '<html><head><title>A &amp; B</title><script>var x = "<p>";</script></head><body><!-- no --><h1>Head</h1><p>One <b>two</b><br>three &quot;x&quot;</p><a class="l" href="/a">go</a> <a href="http://b/?q=1">b</a></body></html>'


@pytest.fixture
def pages(spark):
    rows = [(1, "http://x/1", HTML), (2, None, None), (3, "http://x/3", ""), (1, "http://x/1", HTML), (None, "u", "<p>" + "word " * 30000)]
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, block string, digest int")


def sha(b):
    return "sha256:" + hashlib.sha256(b).hexdigest()


def test_derivatives(pages):
    source = {r["page_id"]: r for r in responses(pages).collect()}
    got = derive(responses(pages)).collect()
    assert len(got) == 10
    one = {r["warc_type"]: r for r in got if r["page_id"] == 1}
    for r in one.values():
        assert r["refers_to"] == source[1]["record_id"] and r["payload_digest"] == sha(HTML.encode()) and r["target_uri"] == "http://x/1"
        assert r["block_digest"] == sha(r["block"]) and r["content_length"] == len(r["block"])
    assert one["conversion"]["block"].decode() == 'A & B\nHead\nOne two\nthree "x"\ngo b'
    assert one["metadata"]["block"].decode().split("\r\n") == [
        "http-status: 200",
        "http-header-Content-Type: text/html; charset=utf-8",
        f"http-header-Content-Length: {len(HTML)}",
        "title: A & B",
        "outlink: /a",
        "outlink: http://b/?q=1",
        "",
    ]
    assert {r["block"] for r in got if r["page_id"] in (2, 3) and r["warc_type"] == "conversion"} == {b""}
    assert len({r["record_id"] for r in got}) == 8  # repeated pages give the same ids


def test_files_round_trip(spark, pages, tmp_path):
    records = responses(pages).drop("page_id")
    records = records.unionByName(derive(records))
    write_warc(records, f"file://{tmp_path}/w")
    back = read_warc(spark, f"file://{tmp_path}/w")
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(records.columns).collect())
    assert key(back) == key(records)
    again = lambda df: sorted((r["record_id"], r["block_digest"]) for r in derive(df).collect())
    assert again(back) == again(responses(pages).drop("page_id"))


def test_other_records(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nPNG"
    rows = [("r1", "response", head), ("r2", "request", head), ("r3", "response", "HTTP/1.1 404 Not Found\r\nX-A: b"), ("r4", "response", "HTTP/1.0 200 OK\r\nContent-type: TEXT/PLAIN\r\n\r\na <b> c"), ("r5", "response", None)]
    df = spark.createDataFrame([(i, t, "u", "d", None, b) for i, t, b in rows], "record_id string, warc_type string, target_uri string, date string, payload_digest string, block string")
    got = {(r["refers_to"], r["warc_type"]): r["block"].decode() for r in derive(df).collect()}
    assert set(got) == {("r1", "metadata"), ("r3", "metadata"), ("r4", "metadata"), ("r4", "conversion"), ("r5", "metadata")}
    assert got["r4", "conversion"] == "a <b> c" and got["r3", "metadata"].startswith("http-status: 404\r\nhttp-header-X-A: b\r\n")


def test_files_of_all_kinds(spark, tmp_path):
    """Blocks that hold record separators and any bytes, members of a record each, whole files, files that break off."""
    rng = random.Random(2)
    blocks = [b"", b"x\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", bytes(range(256)) * 3, rng.randbytes(70_000), b"\0\0\0", "né 字".encode()]
    rows = [(f"<urn:{i}>", "resource", f"http://x/{i}", None, None, None, None, None, len(b), "X-Own: 1\r\n", b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "record_id string, warc_type string, target_uri string, date string, content_type string, refers_to string, payload_digest string, block_digest string, content_length long, fields string, block binary")
    for compression in ("gzip", "none"):
        write_warc(df.repartition(2), f"file://{tmp_path}/{compression}", compression=compression)
        back = {r["record_id"]: (bytes(r["block"]), r["fields"], r["content_length"]) for r in read_warc(spark, f"file://{tmp_path}/{compression}").collect()}
        assert back == {r[0]: (r[10], r[9], r[8]) for r in rows}
    for part in Path(tmp_path, "gzip").glob("part-*"):
        data, members = part.read_bytes(), 0
        while data:  # strictly one member after another
            d = zlib.decompressobj(31)
            assert d.decompress(data).startswith(b"WARC/1.0\r\n")
            data, members = d.unused_data, members + 1
        assert members > 0
    whole = b"".join(serialized(r.asDict()) for r in df.collect())
    assert [r["block"] for r in parsed(gzip.compress(whole))] == [r["block"] for r in parsed(whole)] == blocks
    assert [r["block"] for r in parsed(whole[: len(whole) // 2])] == blocks[:3]
    assert [r["block"] for r in parsed(gzip.compress(whole)[:-40_000])] == blocks[:3]


def test_plain_text():
    rows = [
        ("a\n\n b", "a b"), ("<div>a</div><div> b </div>", "a\nb"), ("<style>x</style>y", "y"), ("&unknown; &amp;lt;", "&unknown; &lt;"), ("<SCRIPT src=x>1</SCRIPT >z", "z"),
        ("caf&eacute; &#8212; &#xE9;&euro;&nbsp;&#160;x", "caf\u00e9 \u2014 \u00e9\u20ac  x"), ("<p title='a > b'>c</p><p title=\"'>\">d", "c\nd"),
        ("a<script>if (x < 1) document.write('</p>')", "a"), ("a<!-- b", "a"), ("a<noscript>b", "ab"), ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"), ("<script>'<!--'</script>b", "b"), ("<!-- <script> -->c", "c"),
    ]
    for page, want in rows:
        assert plain_text(page) == want, page
    long = "<p>" + "word " * 400_000 + "<b>" * 1000 + "&eacute;</p><script>"
    assert plain_text(long) == "word " * 400_000 + "\u00e9"


def test_all_references_like_the_library():
    names = [*html.entities.html5, *(f"#{n};" for n in (8217, 160000, 33, 128, 0)), "#x1F600;"]
    for name in names:
        if name.strip(";").lower() not in ("nbsp", "nonbreakingspace"):
            want = html.unescape(f"&{name}")
            assert plain_text(f"<p>a&{name}b</p>") in (f"a{want}b".strip(), plain_text(f"a{want}b"), html.unescape(f"a&{name}b")), name


def test_links():
    page = """<a href="/a?x=1&amp;y=2">1</a><A class=k HREF='b c'>2</A><a data-href="no" href=d>3</a><a name=x>4</a><!-- <a href="e"> --><a\nhref = "f">5</a><abbr href="g">"""
    assert links(page) == ["/a?x=1&y=2", "b c", "d", "f"]


@pytest.mark.parametrize(
    ("headers", "payload", "want"),
    [
        ("Content-Type: text/html; charset=iso-8859-1", "<p>é€</p>".encode("cp1252"), "é€"),
        ("Content-Type: text/html", '<meta charset="windows-1251"><p>Привет</p>'.encode("cp1251"), "Привет"),
        ("Content-Type: text/html", '<meta http-equiv="Content-Type" content="text/html; charset=shift_jis"><p>日本</p>'.encode("shift_jis"), "日本"),
        ("Content-Type: text/html", "<p>é</p>".encode("cp1252"), "é"),
        ("Content-Type: text/html; charset=nonsense", "<p>é</p>".encode(), "é"),
        ("Content-Type: text/plain", b"\xff\xfe" + "字 é".encode("utf-16-le"), "字 é"),
        ("content-type: text/html\r\nTransfer-Encoding: chunked", b"4;x=1\r\n<p>a\r\n6\r\nb c d \r\n0\r\n\r\n", "ab c d"),
        ("Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(b"<p>zip</p>"), "zip"),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(b"<p>zip</p>"), "zip"),
        ("Content-Type: text/html\r\nContent-Encoding: gzip", b"broken", None),
        ("Content-Type: text/html\r\nContent-Encoding: br", b"any", None),
        ("Content-Type: image/png", b"PNG", None),
    ],
)
def test_payloads(headers, payload, want):
    digest, made = derivatives("r", f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + payload)
    got = [b.decode() for kind, _, b in made if kind == "conversion"]
    assert digest == sha(payload) and got == ([] if want is None else [want])


def test_nothing(spark, pages):
    assert derive(responses(pages.where("false"))).isEmpty()
