"""Derivative records against SQL, and their links and bytes."""

import hashlib
import html
import html.entities

import parity

from chatterlake.llm import derivatives, queries

SMALL = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    query = queries.QUERIES["op9_derivatives"](spark, SMALL)
    assert parity.differences(query, parity.duck(SMALL), queries.ORACLES["op9_derivatives"]) == []


def test_records_of_odd_pages(spark):
    pages = spark.createDataFrame([
        (1, "http://a/", "<html lang=\"de\"><TITLE> A\n b</TITLE><script>x<p></script><p>One &amp;lt; two<br>3 < 4<b>5</b>"
                         "<!-- no --><a href=\"/q\">L</a></html>", "x"),
        (2, None, None, "y"), (2, None, None, "y"), (None, "http://b/", "", "z"), (5, "http://c/", "<p" * 50000, "z"),
    ], "page_id long, url string, html string, block string")
    source = derivatives.responses(pages)
    records = derivatives.derive(source)
    rows = records.collect()
    assert len(rows) == 10
    ids = {r.record_id for r in source.collect()}
    assert {r.refers_to for r in rows} == ids and len(ids) == 4
    first = {r.warc_type: r for r in rows if r.page_id == 1}
    assert first["conversion"].block == "A\nb\nOne &lt; two\n3 < 45L"
    assert first["metadata"].block.split("\r\n")[:2] == ["title: A b", "lang: de"]
    assert "outlink: /q\r\n" in first["metadata"].block
    for r in rows:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
    assert [r.block for r in rows if r.page_id == 2 and r.warc_type == "conversion"] == ["", ""]
    assert derivatives.derive(derivatives.responses(pages.limit(0))).count() == 0
    for raw, r in zip(derivatives.serialized(records).collect(), rows):
        head, body = bytes(raw.record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Type"] == r.warc_type
        assert body[:int(fields["Content-Length"])].decode() == r.block and body.endswith(b"\r\n\r\n")
        assert ("WARC-Target-URI" in fields) == (r.target_uri is not None)


def test_every_reference_is_decoded(spark):
    texts = [f"a {name if name[-1] == ';' else name + ' '} b" for name in ("&" + n for n in html.entities.html5)]
    texts += ["&copy; 2024 &middot; &#169;&#xA9;&#XA9;", "&amp;copy; &#0; &#xD800; &#1114112; &#128; &unknown; & &;", "plain"]
    pages = spark.createDataFrame([(i, "u", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.block for r in derivatives.derive(derivatives.responses(pages)).collect() if r.warc_type == "conversion"}
    for i, t in enumerate(texts):
        assert " ".join(got[i].split()) == " ".join(html.unescape(t).split()), t
    footer = [r.block for r in queries.QUERIES["op9_derivatives"](spark, SMALL).collect() if r.warc_type == "conversion"]
    assert footer and not any("&copy;" in b or "&middot;" in b for b in footer) and any("©" in b for b in footer)
