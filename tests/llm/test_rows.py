"""Operators that keep whole rows: names of other columns never matter; odd markup and headers."""

import html.parser
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from bandwise.llm import decontam, linededup, mixing, ngram_join, warc
from tests.llm.conftest import SF

AWKWARD = ["target", "epochs", "source_size", "at", "cut", "mean_weight", "score", "_scored_text", "_lines", "_id", "_th", "_n", "_runs", "_bad_id",
           "_bad_th", "copies", "_size", "_key", "_weight", "bucket", "_b", "_s", "place", "component", "n", "th", "a.b", "back`tick", "_col0_", "label_id", "y"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, f"one two three four five six seven line {i % 4}\nshared line of text here", "ab"[i % 2]) for i in range(12)]
    rows += [(50, "", "a"), (51, None, "a"), (52, " \n ", None), (3, rows[3][1], rows[3][2])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(AWKWARD)])


def test_mix_with_any_names(awkward):
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert all(tuple(r)[3:] == tuple(range(len(AWKWARD))) for r in out.collect())


def test_empty_documents_are_taken_once_an_epoch(spark):
    rows = [(i, "w " * 5, "a") for i in range(9)] + [(20 + i, "", "a") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs).groupBy("doc_id").count().filter("count <> 1").count() == 0  # one source: its target is its size
    assert mixing.mix(docs).count() == 18


def test_keep_lines_with_any_names(awkward):
    d = awkward.withColumn("kept", F.lit("old")).withColumn("n_lines", F.lit(-1))
    out = linededup.keep_lines(d, linededup.line_bitmaps(d.select("doc_id", "text"), 10))
    assert out.columns == [*awkward.columns, "n_lines", "n_dropped", "kept"]
    want = {(r["doc_id"], r["kept"]) for r in linededup.keep_lines(awkward.select("doc_id", "text"), linededup.line_bitmaps(awkward.select("doc_id", "text"), 10)).collect()}
    assert {(r["doc_id"], r["kept"]) for r in out.collect()} == want


def test_clean_with_any_names(spark, awkward):
    bench = spark.createDataFrame([(1, "one two three four five six seven line 2"), (None, None)], "item_id long, text string")
    out = decontam.clean(awkward, bench, percent=100)
    assert out.columns == awkward.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(12) if i % 4 != 2} | {50, 51, 52}


def test_keep_one_with_any_names(awkward):
    out = ngram_join.keep_one(awkward)
    assert out.columns == awkward.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 50, 51, 52]


def test_quality_stage_with_any_names(spark, awkward):
    out = cp.quality_classifier(spark, awkward.withColumn("lang", F.lit("en")), SF)
    assert out.columns == [*awkward.columns, "lang"] and out.count() <= awkward.count()


class _Plain(html.parser.HTMLParser):
    """Title, links and words of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.text, self.inside = "", [], [], []

    def handle_starttag(self, tag, attrs):
        self.inside.append(tag)
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append("".join(dict(attrs)["href"].split()))

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        elif not {"script", "style", "template", "noscript", "head"} & set(self.inside):
            self.text.append(data)


def test_text_and_facts_against_another_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r["html"]]
    assert pages
    for page in pages:
        plain = _Plain()
        plain.feed(page)
        plain.close()
        bare = warc.without_scripts(page)
        title, links = warc.page_facts(bare)
        assert title == " ".join(plain.title.split()) and links == plain.links
        assert "".join(warc.visible_text(bare).split()) == "".join("".join(plain.text).split())


@pytest.mark.parametrize("junk", ["<!--", "<a ", "<script", "<script>", "<p ", "<title>", "<head>", "<![CDATA[", '<a href="', "</script ", "<a href='x", "<style>a</styl"])
def test_unclosed_markup_takes_linear_time(junk):
    def seconds(n):
        t = time.perf_counter()
        bare = warc.without_scripts(junk * n)
        warc.visible_text(bare)
        warc.page_facts(bare)
        return time.perf_counter() - t
    seconds(100)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)


def test_line_breaks_in_headers(spark):
    h = {"WARC-Type": "response", "WARC-Record-ID": "x", "WARC-Target-URI": "http://a\r\n b\nc", "Content-Length": "2"}
    back, block = warc.parse(warc.serialise(h, b"ok"))
    assert back == h | {"WARC-Target-URI": "http://a b c"} and block == b"ok"
    assert warc.parse(b"WARC/1.1\r\nA: 1\r\n folded\r\nno colon\r\nB:2\r\n\r\nbody\r\n\r\n") == ({"A": "1 folded", "B": "2"}, b"body")
    pages = spark.createDataFrame([(1, "http://a\r\nb", "<p>x"), (2, "\n", None)], "page_id long, url string, html string")
    got = warc.derivative_digest(pages).collect()
    assert len(got) == 4 and {r["target_uri"] for r in got if r["page_id"] == 1} == {"http://a b"}
