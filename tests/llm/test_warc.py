import base64
import glob
import gzip
import hashlib
import html
import re

from casegate.llm import warc
from casegate.llm.queries import op9_warc
from tests.llm.helpers import SF


def parse(data):
    """Records of WARC bytes, by their lengths alone."""
    at, records = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        block = data[begin : begin + int(fields["Content-Length"])]
        assert data[begin + len(block) :][:4] == b"\r\n\r\n"
        at = begin + len(block) + 4
        records.append((fields, block))
    return records


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_query_round_trip(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op9_warc(spark, SF).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    concurrent = {}
    for r in rows:
        page = pages[r.page_id]
        ((fields, block),) = parse(r.record.encode())
        assert fields["WARC-Type"] == r.record_type and fields["WARC-Record-ID"] == r.record_id
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Target-URI"] == page.url
        assert fields["WARC-Block-Digest"] == sha1(block) == r.block_digest and len(block) == r.content_length
        assert fields["WARC-Source-Payload-Digest"] == sha1(page.html.encode()) == r.source_digest
        concurrent[r.record_id] = fields["WARC-Concurrent-To"]
        if r.record_type == "conversion":
            body = page.html[page.html.index("<body>") :]
            body = re.sub("<!--.*?-->", " ", body, flags=re.S)
            words = html.unescape(re.sub("<[a-z/][^>]*(?:>|$)|</?$", lambda m: "" if m[0] in ("<b>", "</b>", "</a>") or m[0][:3] == "<a " else " ", body)).split()
            assert block.decode().split() == words
        else:
            lines = block.decode().split("\r\n")
            assert f"source-payload-length: {len(page.html.encode())}" in lines
            assert "source-header: Content-Type: text/html; charset=utf-8" in lines
            assert sum(line.startswith("outlink: http") for line in lines) == page.html.count("<a href")
    assert all(concurrent[concurrent[i]] == i for i in concurrent)
    ids = {r.page_id: r.refers_to for r in rows}
    assert len(set(ids.values())) == len(pages)


def test_text_and_edge_cases(spark):
    assert warc.plain_text("<p>a&amp;b <b>c</b>\n d</p><p>e<br>f<script>x<y</script>g<!-- z --><style>q") == "a&b c\nd\ne\nf\ng"
    rows = [(None, None, None, None, None), ("<urn:x>", "http://[bad", "2024-01-01T00:00:00Z", "A: b\r\n\r\nC: d", "<a href='http://[x'>y</a>" * 3)]
    rows += [rows[1], ("<urn:y>", "http://e.org/a/", "d", "", "<title>T\n t</title><html lang=de><a href=b>x" + "é" * 100_000)]
    names = "record_id string, target_uri string, date string, headers string, payload string, key string, record string"
    responses = spark.createDataFrame([(*r, "k", "z") for r in rows], names)
    made = warc.derivatives(responses, "key").collect()
    assert len(made) == 8 and {r.key for r in made} == {"k"}
    for r in made:
        ((fields, block),) = parse(r.record.encode())
        assert fields["WARC-Block-Digest"] == sha1(block) and fields.get("WARC-Refers-To") == r.refers_to
    blocks = [parse(r.record.encode())[0][1].decode() for r in made if r.refers_to == "<urn:y>" and r.record_type == "metadata"]
    assert "title: T t\r\nlanguage: de\r\n" in blocks[0] and "outlink: http://e.org/a/b L a/@href" in blocks[0]
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_heads_end_at_what_cannot_stand_in_them():
    head = "<html><head>\n<title>T</title><!-- </head> --><meta content='a > b'><script src=x>'<p>'</script>\n"
    for page in ("<body class=a><p>b<p>c", "<p>b</p>c", "b<br>c", "</head><body>b<p>c", "<section>b</section><h1>c", "</head>b<p>c"):
        assert warc.plain_text(head + page) == "b\nc", page
    assert warc.plain_text(head) == warc.plain_text(head + "</head></html>") == ""
    assert warc.plain_text("<head><title>T</head><body>b") == "b"
    assert warc.plain_text("<header>a</header><p>b") == "a\nb"


def test_quotes_hold_values_and_links_are_those_of_anchors():
    assert warc.plain_text('<p title="x > y">Hello <b title=\'a>b\'>you</b><br title="1>0">z<i =">"/>') == "Hello you\nz\"/>"
    page = """<!-- <a href=c1> --><script>'<a href=c2>'</script><a data-href=d1 title="href='d2'" href="r1">1</a>
    <A\nHREF = 'r2'>2</A><a name=x>3</a><a href=r3/x>4</a><abbr href=no>5</abbr><a title=">" href=r4>6</a><a href>7</a><a href=''>8</a>"""
    assert list(warc.links(page)) == ["r1", "r2", "r3/x", "r4", ""]


def test_files_hold_the_records(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.derivatives(warc.responses_of(pages), "page_id")
    warc.write(made, str(tmp_path / "warc"))
    found = [r for f in glob.glob(str(tmp_path / "warc" / "*.gz")) for r in parse(gzip.open(f).read())]
    assert sorted(f["WARC-Record-ID"] for f, _ in found) == sorted(r.record_id for r in made.select("record_id").collect())
