"""Each operator against brute force, on odd rows, empty tables and the small tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bandwise.llm import decontam, graph, langid, linededup, mixing, ngram_join, pii, quality, tokenids, vectors, warc
from tests.llm import brute
from tests.llm.conftest import SF, same

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


# 1

def test_mix_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "source", "text").collect()
    size = lambda t: len(brute.words(t))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = brute.quality_targets(sizes, names)
    got = mixing.mix_report(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in got) == sorted(
        (str(r["doc_id"]), size(r["text"]), sizes[r["source"]]) for r in rows)
    assert sorted({(r["source_size"], round(r["target"], 4)) for r in got}) == sorted({(sizes[s], round(want[s], 4)) for s in names})
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = {}
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    for s in names:
        assert abs(taken[sizes[s]] - want[s]) <= max(size(r["text"]) for r in rows if r["source"] == s)
    again = mixing.mix_report(odd_docs.repartition(5)).collect()
    same(again, got)


def test_mix_returns_whole_rows_as_often_as_reported(odd_docs):
    report = {}
    for r in mixing.mix_report(odd_docs.filter("doc_id > 8")).collect():
        report[r["doc_id"]] = r["taken"] // r["size"] if r["size"] else 0
    out = mixing.mix(odd_docs.filter("doc_id > 8"))
    assert out.columns == odd_docs.columns
    got = dict(map(tuple, out.groupBy("doc_id").count().collect()))
    assert got == {d: n for d, n in report.items() if n}


def test_an_end_bucket_of_a_whole_source_is_spread_over_ranges(spark, odd_docs, docs, monkeypatch):
    wants = [mixing.mix_report(df).collect() for df in (odd_docs, docs)]
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        for df, want in zip((odd_docs, docs), wants):
            same(mixing.mix_report(df).collect(), want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_mix_prefers_documents_of_high_weight(spark):
    good, bad = "word " * 10, "w!!! " * 10
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "a") for i in range(400)] + [(1000 + i, good, "b") for i in range(10)], "doc_id long, text string, source string")
    got = mixing.mix_report(docs).filter("source_size = 4000").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    t = {r["good"]: r["t"] for r in got}
    assert t[1] > 1.05 * t[0]


# 2

def test_line_dedup(odd_docs, rows_of, docs):
    same(linededup.line_dedup_digest(odd_docs).collect(), brute.line_dedup(rows_of))
    same(linededup.line_dedup_digest(docs).collect(), brute.line_dedup(pairs(docs)))


def test_line_bitmaps_are_runs(spark):
    line = "a line that is common"
    docs = spark.createDataFrame([(1, f"{line}\nother"), (2, f"x\n{line}\n{line}\ny\n{line}")], "doc_id long, text string")
    (row,) = linededup.line_bitmaps(docs).collect()
    assert row["doc_id"] == 2 and [tuple(r) for r in row["dropped"]] == [(1, 2), (4, 4)]


# 3

def test_personal_data(spark, docs):
    rng = random.Random(3)
    parts = ["a.b@c.de", "@x.y@z.org", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234",
             "+1", "++49 30 1234567", "1234567890123456789012", "é", "\n", " ", ".", "@", "-", "a_b%c", "0", "11", "+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "1" * 5000, "a" * 5000 + "@b.c", "1." * 3000]
    rows = list(enumerate(texts)) + pairs(docs)
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    import hashlib
    for i, (_, t) in enumerate(rows):
        base = brute.personal(t)
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        if not r["found"]:
            assert r["spans"] == said


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"some words call me: +1 555 010 {1000 + i} and more") for i in range(30)]
    rows += [(100, "words call me: 555 010 7777 soon"), (101, "a count of 555 010 7777 items"), (102, "nothing here")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:15:27" and got[100]["found"] == 1 and got[100]["n_phone"] == 0
    assert got[101]["spans"] == "" and got[102]["spans"] == ""


def _discovered(spark, texts, **settings):
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **settings).collect()
    out = set()
    for r in got:
        base = {(a, b, k) for a, b, k in brute.personal(texts[r["doc_id"]])}
        every = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert every == sorted(every, key=lambda x: (x[0], pii.KINDS.index(x[2]))) and len(every) == len(base) + r["found"]
        out |= {(r["doc_id"], *x) for x in every if x not in base}
    return out


def test_bootstrapping_reaches_what_no_seed_stands_beside(spark):
    """Seeds teach ``call``; instances found there teach ``hotline``, where no base span stands."""
    rows = [f"please call +1 555 010 {1000 + i} now" for i in range(100)]
    rows += [f"please call 555-020-{1000 + i} now" for i in range(10)]
    rows += [f"the hotline 555-020-{1000 + i} is open" for i in range(10)] + ["the hotline 555-030-7777 is open"]
    rows += [f"mail to user{i}@mail.org soon" for i in range(40)] + [f"mail to user{i} [at] mail [dot] org soon" for i in range(3)]
    planted = len(rows)
    rows += [f"item 555-040-{1000 + i} costs much" for i in range(30)] + ["order number 1234567890 came", "in 2024 there were 17 of 99 left"]
    found = _discovered(spark, rows)
    assert found == brute.bootstrapped(rows)
    assert {i for i, *_ in found} == {*range(100, 121), *range(161, planted)}
    assert all(k == ("phone" if i < 121 else "email") for i, _, _, k in found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bootstrapping_against_plain_python(spark, seed):
    rng = random.Random(seed)
    kinds = {"call": lambda: f"+1 555 {rng.randint(100, 130)} {rng.randint(1000, 1003)}", "dial": lambda: f"555-{rng.randint(100, 130)}-{rng.randint(1000, 1003)}",
             "host": lambda: f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 300)}", "node": lambda: f"10.0.{rng.randint(0, 3)}.{rng.randint(250, 300)}",
             "mail": lambda: f"u{rng.randint(0, 30)}@x.org", "write": lambda: f"u{rng.randint(0, 30)} (at) x (dot) org", "pay": lambda: f"4111 1111 1111 {rng.randint(1000, 1040)}",
             "odd": lambda: rng.choice(["(12345678", "99-", "[1.2.3.4567]", "+", "@", "7" * 90, "x" * 200 + "12345", "(030) 1234 567)"])}
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            word = rng.choice(list(kinds))
            parts += [rng.choice(["so", "and", "the", "the", "w" * 70]), word if rng.random() < 0.9 else rng.choice(list(kinds)), kinds[word]() + rng.choice(["", "", ",", ".", ")"]), rng.choice(["ok", "is", "\n", ""])]
        texts.append(rng.choice([" ", " ", "  "]).join(parts))
    texts += [None, "", " ", texts[0], texts[1]]
    for settings in ({}, {"min_seeds": 2, "min_score": 0.5}):
        found = _discovered(spark, texts, **settings)
        assert found == brute.bootstrapped(texts, **settings)
    assert found


def test_slots_take_linear_time():
    import time
    start = time.time()
    for junk in ("1 " * 100_000, "1" * 300_000, "a" * 300_000 + "@", "a[at]" * 50_000, "(" * 300_000 + "1", "\t" * 300_000 + "12345678", "x1\u00e9." * 50_000):
        for a, b, _ in pii.candidates(junk, [])[:1000]:
            pii.patterns(junk, a, b)
    assert time.time() - start < 20


# 4

@pytest.mark.parametrize("k,percent,cap", [(3, 90, 1024), (5, 80, 4)])
def test_jaccard(odd_docs, rows_of, docs, k, percent, cap):
    for df, rows in [(odd_docs, rows_of)] + ([(docs, pairs(docs))] if cap == 4 else []):
        same(ngram_join.jaccard_components(df, k, percent, cap).collect(), brute.jaccard(rows, k, percent)[0])


def test_jaccard_of_short_sets_at_the_border(spark):
    """Sets of 9 to 30 shingles, one more or fewer: links at exactly 90 of 100 must be found."""
    rng = random.Random(9)
    rows = []
    for n in [*range(9, 32)] * 6:
        w = [f"w{rng.randrange(10**6)}" for _ in range(n + 2)]
        for v in (w, w + ["tail"], w + ["tail", "two"], ["head"] + w, w[1:], w[2:], ["a", "b"] + w[:-1]):
            rows.append((len(rows), " ".join(v)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    same(got, brute.jaccard(rows, 3, 90)[0])


def test_an_oversized_island_is_taken_apart_before_a_task_holds_it(spark, monkeypatch):
    """Two passages tie 120 documents into one island; no task may get more than REFINED sets of it."""
    rng = random.Random(4)
    passages = [[f"p{i}x{j}" for j in range(25)] for i in range(2)]
    rows = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        w[20:20] = passages[i % 2] + (passages[1] if i == 0 else [])
        for v in (w, w + ["tail"], w[:50] + [f"w{rng.randrange(10**6)}" for _ in range(35)]):
            rows.append((len(rows), " ".join(v)))
    refine, cut, left = ngram_join._refine, ngram_join._cut_islands, []

    def watched(batches, percent):
        held = list(batches)
        islands = [i for b in held for i in b.column("island").to_pylist()]
        assert all(islands.count(i) <= 20 for i in set(islands)), "an island above REFINED in one task"
        yield from refine(iter(held), percent)

    def cut_counted(large, percent):
        left.append(large.count())
        return cut(large, percent)

    monkeypatch.setattr(ngram_join, "REFINED", 20)
    monkeypatch.setattr(ngram_join, "_refine", watched)
    monkeypatch.setattr(ngram_join, "_cut_islands", cut_counted)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 20).collect()
    same(got, brute.jaccard(rows, 5, 80)[0])
    assert left == [0]


@pytest.mark.parametrize("refined", [1, 3])
def test_jaccard_with_islands_that_stay_oversized(odd_docs, rows_of, monkeypatch, refined):
    monkeypatch.setattr(ngram_join, "REFINED", refined)
    same(ngram_join.jaccard_components(odd_docs, 3, 80, 4).collect(), brute.jaccard(rows_of, 3, 80)[0])


def test_repeated_rows_enter_an_island_once(spark, monkeypatch):
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w + ["tail"] * i)) for i in range(6)] + [(2, " ".join(w + ["tail"] * 2))] * 40 + [(None, " ".join(w[1:]))] * 5
    cut, seen = ngram_join._cut_islands, []

    def once(large, percent):
        seen.append((large.count(), large.select("cid").distinct().count()))
        return cut(large, percent)

    monkeypatch.setattr(ngram_join, "_cut_islands", once)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_components(df, 3, 90, 2).collect(), brute.jaccard(rows, 3, 90)[0])
    assert seen[0][0] == seen[0][1] > 2


def test_keep_one(odd_docs, rows_of):
    out = ngram_join.keep_one(odd_docs, 5, 80)
    assert out.columns == odd_docs.columns
    want, u = brute.jaccard(rows_of, 5, 80)
    best = {}
    for i, (d, t) in enumerate(rows_of):
        group = ("empty", i) if want[i][1] == 0 else u.find(i)
        best.setdefault(group, []).append(2**63 if d is None else d)
    got = [2**63 if d is None else d for d, _ in pairs(out)]
    assert sorted(got) == sorted(min(v) for v in best.values())


# 5

def test_cosine_links(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        c = rng.standard_normal(24)
        for j in range(rng.integers(1, 8)):
            rows.append((len(rows), (c + rng.standard_normal(24) * rng.choice([0, 0.1, 0.25, 0.4])).tolist(), int(g % 3)))
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [1.0, None] * 12, 1), (5004, [float("nan")] * 24, 1), (5005, [float("inf")] + [0.0] * 23, 1),
             (5006, rows[0][1], None), (5007, [1e300] * 24, 1), (5008, [2e-300] * 24, 1), (5009, rows[0][1][:12], 0), (7, rows[7][1], rows[7][2])]
    got = vectors.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=3).collect()
    same(got, brute.cosine(rows, 0.93))


def test_cosine_recall_at_the_threshold(spark):
    """Pairs at cosine 0.93 to 0.94 among unrelated vectors: at least 999 of 1000 are found."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(2000):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        z = rng.standard_normal(64)
        z -= a * (z @ a)
        z /= np.linalg.norm(z)
        c = rng.uniform(0.9301, 0.94)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * z).tolist(), 1)]
    got = vectors.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).filter("n_links = 1").count()
    assert got >= 2 * 1998


# 6

def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    hit, n = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and hit > 0.97


def test_languages_odd_rows(spark, odd_docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(odd_docs).collect()}
    for d in (1, 2, 3, 6, 7):
        assert (d, "und") in got
    assert {p for _, p in got} <= {"und", "en", "de", "fr"}
    nothing = langid.predict_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}


# 7

def test_tokens(odd_docs, rows_of, docs):
    whole = [r for r in rows_of if r[0] is not None and r[0] != 4]
    got = sorted(map(tuple, tokenids.token_digest(odd_docs.filter("doc_id is not null and doc_id != 4"), PATH).collect()))
    assert got == brute.tokens(sorted(whole, key=lambda r: r[0]), PATH)
    got = sorted(map(tuple, tokenids.token_digest(docs, PATH).collect()))
    assert got == brute.tokens(sorted(pairs(docs)), PATH)


def test_pieces_encode_like_whole_texts():
    enc = tokenids.Encoder(open(PATH, "rb").read())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "don't", "'ll", "é", "ñ", "中", "1", "22", "...", "!!", " ", " ", "\x1c", "\x85", "<|endoftext|>", "x y", " z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_hold_repeated_and_null_ids(odd_docs):
    folder, manifest = tokenids.write_tokens(odd_docs, PATH)
    rows = tokenids.read_tokens(odd_docs.sparkSession, folder, manifest).orderBy("start").collect()
    assert len(rows) == odd_docs.count() and [r["doc_id"] for r in rows[:2]] == [None, None]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and all(len(r["ids"]) == r["n_tokens"] for r in rows)


# 8

def test_contamination(spark, odd_docs, rows_of, docs):
    w = next(t for d, t in rows_of if d == 45 or (t and len(t) > 2000)).split()
    items = [(1, " ".join(w[:40])), (1, " ".join(w[5:30])), (2, "one two"), (3, None), (4, ""), (None, " ".join(w[10:21])), (5, "no such words stand in any text at all"),
             (6, " ".join(w[:18] + ["other"] + w[19:40])), (7, "a very common line of text")]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n long")
    got = decontam.contaminated(odd_docs, bench).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = {}
    for d, t in rows_of:
        for one in brute.contained([(d, t)], items):
            want[one[:3]] = max(one[3], want.get(one[:3], 0))
    assert sorted(map(tuple, got), key=key) == sorted(((*k, v) for k, v in want.items()), key=key) and got
    bad = {d for d, *_ in want}
    left = decontam.clean(odd_docs, bench)
    assert left.columns == odd_docs.columns
    kept = [(d, t) for d, t in rows_of if not any(100 * len(brute.shingles(x, 5) & brute.shingles(t, 5)) >= 80 * len(brute.shingles(x, 5)) for _, x in items if brute.shingles(x, 5))]
    assert bad and sorted(map(str, pairs(left))) == sorted(map(str, kept))


# 9

def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_predictions(docs, labels).join(labels, "doc_id").filter("held_out")
    hit, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 300 and hit > 0.97


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)] + [(None, 1, 0), (12, None, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in quality.quality_predictions(d, labels).collect()) for d in (odd_docs, odd_docs.repartition(5)))
    assert one == two and len(one) == odd_docs.count() and all(0 <= s <= 1 for _, s in one)
    none = quality.quality_predictions(odd_docs, labels.filter("doc_id < 0")).collect()
    assert {r["score"] for r in none} == {0.5}


# 10

def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(900, "http://a/é?x=1&y=2", "<html><head><title>T &amp; t</title></head><body><p>one<br>two<script>no()</script><a href='u&amp;v'>l</a>"),
                                 (901, None, None), (902, "", ""), (None, "http://b/", "plain"), (900, "http://a/2", "x" * 300000)], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").unionByName(odd)
    resp = warc.responses(every)
    sources = {r["record_id"]: r for r in resp.collect()}
    folder, manifest = warc.write_records(warc.derive(resp))
    back = warc.read_records(folder, manifest).collect()
    direct = {r["record_id"]: r for r in warc.derive(resp).collect()}
    assert len(back) == 2 * every.count() == 2 * len(sources)
    for r in back:
        h, src = r["headers"], sources[r["headers"]["WARC-Refers-To"]]
        assert (bytes(r["block"]), r["headers"]) == (bytes(direct[r["record_id"]]["block"]), direct[r["record_id"]]["headers"])
        assert h["WARC-Source-Payload-Digest"] == src["headers"]["WARC-Payload-Digest"] and h["WARC-Block-Digest"] == warc.digest(bytes(r["block"]))
        assert h.get("WARC-Target-URI") == src["headers"].get("WARC-Target-URI") and h["WARC-Type"] == r["type"]
    text = {r["headers"]["WARC-Refers-To"]: bytes(r["block"]).decode() for r in back if r["type"] == "conversion"}
    rid = next(i for i, r in sources.items() if b"T &amp; t" in bytes(r["block"]))
    assert text[rid] == "one\ntwol"
    meta = next(bytes(r["block"]).decode() for r in back if r["type"] == "metadata" and r["headers"]["WARC-Refers-To"] == rid)
    assert "title: T & t\r\n" in meta and "outlink: u&v\r\n" in meta and "source-Content-Type: text/html; charset=utf-8\r\n" in meta and "http-status: 200\r\n" in meta
    assert warc.derivative_digest(every).count() == 2 * every.count()


def test_warc_takes_other_records_as_they_are(spark):
    rec = [("a", "request", {"WARC-Type": "request"}, b"GET / HTTP/1.1\r\n\r\n"), ("b", "response", {}, b"no header block \xff"),
           ("c", "response", {"WARC-Date": "2020-01-01T00:00:00Z"}, b"HTTP/1.0 404 Not Found\nContent-Type: text/html;\n charset=latin-1\n\ncaf\xe9")]
    got = warc.derive(spark.createDataFrame(rec, warc.RECORD)).collect()
    text = {r["headers"]["WARC-Refers-To"]: bytes(r["block"]).decode() for r in got if r["type"] == "conversion"}
    assert text == {"b": "no header block �", "c": "café"}


# empty tables

def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "five words are in here")], "item_id long, text string")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (mixing.mix_report(none), mixing.mix(none), linededup.line_dedup_digest(none), pii.find_personal_data(none), ngram_join.jaccard_components(none),
               ngram_join.keep_one(none), vectors.cosine_links(vecs), langid.predict_languages(none), tokenids.token_digest(none, PATH), decontam.contaminated(none, bench),
               decontam.clean(none, bench), quality.quality_predictions(none, labels), warc.derivative_digest(pages)):
        assert df.collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == [] and decontam.clean(docs, bench.limit(0)).count() == docs.count()
