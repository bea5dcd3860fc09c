"""Toxicity, WARC, Ogg and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import cases
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronogrid.llm import common, minhash, ogg, queries, suffix_dedup, toxicity, warc


def labelled(n=400, seed=13):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(("an", "the", "or", "is", "ho", "la")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("grunkle", "zwarf", "vexid")))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    labels_df = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(cases.documents(spark, rows), labels_df)
    got = {r.doc_id: r for r in toxicity.scores(cases.documents(spark, rows + [(5000, None), (5001, ""), (5002, "la " * 40000 + "grunkle zwarf vexid")]), model).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    kept = toxicity.accepted(cases.documents(spark, rows), model)
    assert kept.columns == cases.documents(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i in truth if not got[i].predicted}


def test_toxicity_without_labels(spark):
    model = toxicity.train(cases.documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = toxicity.scores(cases.documents(spark), model).collect()
    assert len(out) == len(cases.ROWS) and all(r.predicted == 0 for r in out)


def test_ratios_against_counting():
    """Every n-gram of code points has its own ratio; counted plainly, by strings."""
    rng = random.Random(21)
    texts = ["".join(rng.choice("абвгд 日本語é") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)], float)
    grams = [{t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)} for t in texts]
    f = toxicity.Features(24)
    of_text = [f.of(t) for t in texts]
    assert [len(x) for x in of_text] == [len(g) for g in grams]
    got = toxicity.ratios(of_text, y, 24)
    feature = {g: int(f.of(g)[-1]) for g in sorted(set().union(*grams))}  # the last one of an n-gram's is its own
    met = Counter(feature.values())
    own = [g for g in feature if met[feature[g]] == 1]  # of 2**24 features hardly any is two n-grams'
    assert len(own) > 0.995 * len(feature) and {len(g) for g in own} == set(toxicity.SIZES)
    for g in own:
        share = [(sum(g in x for x, label in zip(grams, y) if label == c) + 0.5) / ((y == c).sum() + 1) for c in (0, 1)]
        assert abs(got[feature[g]] - np.log(share[1] / share[0])) < 1e-9
    assert len(f.of("")) == len(f.of("ab")) == 0 and len(f.of("abab" * 9000)) == 6


def test_fit_against_plain_gradient_descent():
    """The same model over n-grams as strings, each a column, fitted until it stands still."""
    rng = random.Random(23)
    word = lambda low, high: "".join(chr(97 + rng.randint(low, high)) for _ in range(4))
    texts = [" ".join([*(word(0, 9) for _ in range(8)), *(word(8, 13) for _ in range(rng.randint(0, 2) + 2 * (i % 4 == 0)))]) for i in range(160)]
    y = np.array([i % 4 == 0 for i in range(160)], float)
    grams = [{t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)} for t in texts]
    column = {g: k for k, g in enumerate(sorted(set().union(*grams[:120])))}
    x = np.zeros((160, len(column)))
    for row, found in zip(x, grams):
        row[[column[g] for g in found if g in column]] = 1
    train, label = x[:120], y[:120]
    counts = [train[label == c].sum(0) for c in (0, 1)]
    ratio = np.log((counts[1] + 0.5) / (label.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - label).sum() + 1))
    scaled = train * ratio
    scale = np.sqrt((scaled**2).sum() / len(label))
    w, b, share = np.zeros(len(column)), 0.0, np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    for _ in range(4000):
        error = share * (1 / (1 + np.exp(-(scaled @ w / scale + b))) - label)
        w -= 0.5 * (scaled.T @ error / scale + 1e-4 * w)
        b -= 0.5 * error.sum()
    plain = x @ (ratio * w) / scale + b
    model = toxicity.fit(texts[:120], label.astype(int).tolist(), bits=22)
    got = toxicity.margins(texts, model, toxicity.Features(22))
    assert np.corrcoef(got, plain)[0, 1] > 0.95
    assert ((got > 0) == (plain > 0))[:120].mean() > 0.98 and ((got > 0) == (plain > 0))[120:].mean() > 0.9


def test_toxicity_in_other_scripts_and_repeated_ids(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("тестовыйпример") for _ in range(5))
    rows = [(i, " ".join([*(word() for _ in range(30)), *(["злыднюк"] * (i % 3 == 0))])) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    many = rows + [(3, f"zz {k}") for k in range(2000)]  # one id with more texts than the sample's bound; the least counts
    model = toxicity.train(cases.documents(spark, many), labels, most_toxic=90, most_clean=150, bits=18)
    got = toxicity.scores(cases.documents(spark, rows), model).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) / len(held) > 0.95


PAGES = [(1, "http://a/", '<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><h1>Head</h1><p>One <b>two</b>.</p><!-- x --><a href="/u">link</a></body></html>'), (2, None, None), (3, "http://a/", ""), (3, "http://a/", ""), (None, "http://n/", "<p>Unclosed <script>x"), (4, "http://b/", "plain\r\n text")]


def test_warc_against_sql(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    got = warc.derive(warc.responses(pages))
    con = duckdb.connect()
    p = pages.toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM p")
    want = con.execute(warc.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want))
    text = {r.source_id: r.block for r in got.where("warc_type = 'conversion'").collect()}
    assert text[1] == "Head\nOne two.\nlink"


def test_warc_of_nothing(spark):
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    got = warc.derive(warc.responses(spark.createDataFrame(PAGES, "page_id long, url string, html string")))
    warc.write_records(got, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w"))
    key = lambda r: (r.warc_type, r.record_id, r.refers_to, r.target_uri, bytes(r.block, "utf-8") if isinstance(r.block, str) else bytes(r.block))
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, map(key, back.collect())))


def test_ogg_round_trip(spark):
    rows = ogg.round_trip(cases.documents(spark)).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r.doc_id: r for r in rows}
    for i, t in cases.ROWS:
        if i is not None:
            raw = (t or "").encode()
            padded = raw + b" " * (-len(raw) % 192 if raw else 192)
            assert (by[i].n_bytes, by[i].payload_bytes, by[i].tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
            stored = ogg.store_samples(padded)
            assert (by[i].payload_sha256, by[i].media_bytes, by[i].media_sha256) == (hashlib.sha256(padded).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest())
            heads = [p for p in ogg.parse_pages(stored) if p.flags & ogg.FIRST]
            assert len(heads) == 2 and all(len(p.lacing) == 1 for p in heads)
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}) == 1  # equal texts, equal values
    assert ogg.round_trip(cases.documents(spark, [])).count() == 0
    media = ogg.store_texts(cases.documents(spark))
    packets = ogg.read_packets(media.where("media_id = 9").limit(1), "media_id", "media")
    long = b"".join(r.data for r in packets.orderBy("packet").collect() if r.n_bytes and r.data[:4] != b"PCMR" and r.data[:5] != b"INDEX" and r.n_bytes != 12)
    assert bytes(long).rstrip(b" ") == cases.LONG.encode()
    p = {r.media_id: r for r in ogg.probe(media, "media_id", "media").collect()}
    assert p[9].complete and p[9].bad_pages == 0 and p[9].duration_us == by[9].payload_bytes * 1_000_000 // 8000


def slow_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_pages():
    rng = random.Random(14)
    data = rng.randbytes(300)
    assert ogg.checksum(data) == slow_checksum(data)
    packets = [(rng.randbytes(n), g) for g, n in enumerate((0, 1, 254, 255, 256, 510, 70000, 3, 65025, 130050))]
    a, b = ogg.pages_of(1, packets), ogg.pages_of(2, [(b"x" * 1000, 5)])
    whole = ogg.multiplex([a, b])
    streams, bad = ogg.demultiplex(whole)
    assert not bad and [p.data for p in streams[1].packets] == [d for d, _ in packets] and streams[2].packets[0].data == b"x" * 1000 and streams[1].ended
    broken = bytearray(whole)
    broken[len(a[0]) + len(b[0]) + 400] ^= 1  # within the second page of the first stream
    streams, bad = ogg.demultiplex(bytes(broken) + b"junk")
    assert bad and streams[1].broken and [p.data for p in streams[2].packets] == [b"x" * 1000]
    assert all(p.data in [d for d, _ in packets] for p in streams[1].packets)
    assert ogg.demultiplex(None) == ({}, 0) and ogg.demultiplex(b"no media")[0] == {}


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = labelled(120)
    base = " ".join(f"long{k}" for k in range(70))
    extra = [(1000, base), (1001, base), (1002, base + " more words here"), (1003, None), (None, "no id"), (1004, "start " + base), (1004, "start " + base)]
    docs = cases.documents(spark, rows + extra).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline(spark, folder):
    docs = common.table(spark, folder, "documents")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stored(stage(spark, docs, folder), f"test-{k}")
        out.append(docs)
    toxic, near, cut, packed = out
    bad = {i for i in range(0, 120, 4)}
    ids = {r.doc_id for r in toxic.collect()}
    assert not ids & bad and {i for i in range(120) if i % 4} | {1000, 1001, 1003, None} <= ids
    kept = [r.doc_id for r in near.collect()]
    assert len(kept) == len(set(kept)) and 1000 in kept and 1001 not in kept and 1003 in kept and None in kept
    sets = cases.word_sets([(r.doc_id, r.text) for r in toxic.collect() if r.doc_id is not None], 5)
    of = cases.components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    assert set(kept) - {None} == {i for i, _ in sets if of[i] == i}
    want = {i: (n, r, s) for i, n, r, s, _ in cases.removed([(r.doc_id, r.text) for r in near.collect()])}
    for r in cut.collect():
        assert len((r.text or "").encode()) == want[r.doc_id][0] - want[r.doc_id][1]
    assert sorted(map(str, (r.doc_id for r in cut.collect()))) == sorted(map(str, kept)) and cut.columns == docs_columns(spark, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_pipeline_of_nothing_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = cases.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == cases.documents(spark).columns, name
    assert {None, 1, 4, 5, 6, 7, 10, 13, 15} <= {r.doc_id for r in docs.collect()}


def docs_columns(spark, folder):
    return common.table(spark, folder, "documents").columns


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert minhash.Settings().percent == 80 and suffix_dedup.WINDOW == 50 and np.float64(0.95) == 0.95


def test_rows_of_one_id_keep_their_own_columns(spark):
    import cases

    line = "a line of more than fifty bytes that several documents of this table have in common"
    rows = [(1, f"first {line}", "en", "a"), (1, f"{line} second", "de", "b"), (2, f"third {line} end", "fr", "c"), (2, f"third {line} end", "fr", "c"), (None, f"{line}, no id", None, "d"), (3, None, "es", "e"), (4, "", None, None)]
    docs = spark.createDataFrame([(i, t, lang, source, -1) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()), key=repr)
    left = {n[4] for n in cases.removed([(i, t) for i, t, _, _ in rows])}
    assert [(r[0], r[2], r[3]) for r in got] == [(i, lang, source) for i, _, lang, source in sorted(rows, key=lambda r: repr((r[0], next(g[1] for g in got if (g[0], g[2], g[3]) == (r[0], r[2], r[3])))))]
    assert {hashlib.sha256(r[1].encode()).hexdigest() for r in got} == left and all(r[4] == len(r[1]) for r in got)
