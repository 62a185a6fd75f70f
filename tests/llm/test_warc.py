import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.llm import warc
from voltlake.llm.oracle import WARC

PAGES = [
    (1, "http://a.example/x", '<html lang="en"><head><title> A &amp; B\n</title><style>p{}</style></head>'
     '<body><header>Top</header><script>var t="</p><a href=\\"no\\">";</script><p>One <b>two</b>&nbsp; three'
     '<br>four &lt;tag&gt; &amp;lt;</p><!-- gone --><a class="k" href="/y">y</a></body></html>'),
    (2, None, None),
    (3, "", ""),
    (4, "http://b.example/\r\nX-Injected: 1", "no markup   at all\n\n\nsecond line"),
    (5, "u", "<p>open <script>never closed <p>x"),
    (None, "u", "<ul><li>a<li>b</ul>" + "<p>long</p>" * 20_000),
    (7, "same", "<p>twice</p>"),
    (7, "same", "<p>twice</p>"),
    (8, "q", "<HTML class=k lang='de'><head><script>a='<!--'</script></head><body><a href='/x?a=1&amp;b=2'>"
     "x&#8217;s</a> <a data-href=no href=/y>caf&eacute;</a> &#x41;&#X1F600;&#150;&#160;&#10;&#0;&#xD800;&#129;"
     "&#1114112;&amp;eacute; &nope; &amp &;<a rel=z href = \"/z\">z</a>"),
]


@pytest.fixture(scope="module")
def source(spark):
    rows = [(i, u, h, "x", "y") for i, u, h in PAGES]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string, record_id string")
    return warc.responses(pages)


def test_derivatives_link_to_their_response(source):
    made = {r.record_id: r for r in source.collect()}
    assert len(made) == len(PAGES) - 1  # the repeated page has the same identifier
    out = warc.derivatives(source).collect()
    assert len(out) == 2 * len(PAGES)
    for r in out:
        response = made[r.refers_to]
        assert r.payload_digest == response.block_digest
        assert r.target_uri == response.target_uri and "\n" not in r.target_uri
        raw = r.block.encode()
        assert r.content_length == len(raw)
        assert r.block_digest == "sha256:" + hashlib.sha256(raw).hexdigest()
    assert len({r.record_id for r in out}) == 2 * len(made)


def test_text_and_fields(source):
    out = {(r.page_id, r.warc_type): r.block for r in warc.derivatives(source).collect()}
    assert out[1, "conversion"] == "Top\nOne two three\nfour <tag> &lt;\ny"
    fields = out[1, "metadata"].split("\r\n")
    assert fields[:2] == ["title: A & B", "languages-declared: en"]
    assert fields[-2:] == ["outlink: /y", ""]
    assert out[2, "conversion"] == out[3, "conversion"] == ""
    assert out[4, "conversion"] == "no markup at all second line"
    assert out[5, "conversion"] == "open"
    assert out[None, "conversion"].startswith("a\nb\nlong\nlong")
    assert out[8, "conversion"] == "x’s café A\U0001f600– &#0;&#xD800;&#129;&#1114112;&eacute; &nope; &amp &;z"
    fields = out[8, "metadata"].split("\r\n")
    assert fields[1] == "languages-declared: de"
    assert fields[4:] == ["outlink: /x?a=1&b=2", "outlink: /y", "outlink: /z", ""]


def test_sql_gives_the_same_rows(spark, source):
    """Also for attributes, references and scripts that the test tables do not hold."""
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841
    want = duckdb.sql(WARC)
    got = warc.derivatives(source).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_source_headers_go_through_both_records(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            (1, "u", "<p>a</p>", {"WARC-IP-Address": "192.0.2.1", "X-Note": "a\r\nWARC-Type: no", "warc-date": "no",
                                  "bad name": "no", "X-Null": None}),
            (2, "u", "<p>b</p>", None),
        ],
        "page_id bigint, url string, html string, sent map<string,string>",
    )
    records = warc.derivatives(warc.responses(pages, headers=F.col("sent")))
    want = {1: {"WARC-IP-Address": "192.0.2.1", "X-Note": "a WARC-Type: no"}, 2: {}}
    assert [r.headers for r in records.collect()] == [want[r.page_id] for r in records.collect()]
    path = str(tmp_path / "warc")
    warc.write_warc(records, path)
    back = [r.headers for r in warc.read_warc(spark, path).collect()]
    assert len(back) == 4 and sum(h.get("WARC-IP-Address") == "192.0.2.1" for h in back) == 2
    assert {h["WARC-Date"] for h in back} == {warc.FETCHED}


def test_one_kind_alone(source):
    texts = warc.derivatives(source, ("conversion",))
    assert {r.warc_type for r in texts.collect()} == {"conversion"}
    assert texts.count() == len(PAGES)


def test_files_round_trip(spark, source, tmp_path):
    path = str(tmp_path / "warc")
    records = warc.derivatives(source)
    warc.write_warc(records, path)
    back = warc.read_warc(spark, path).select(
        F.col("headers")["WARC-Record-ID"], F.col("headers")["WARC-Refers-To"],
        F.col("headers")["Content-Length"].cast("bigint"), "block",
    )
    want = records.select("record_id", "refers_to", "content_length", "block")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_empty_table(source):
    assert warc.derivatives(source.filter("false")).collect() == []
