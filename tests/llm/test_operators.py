"""Edge cases and brute force: nulls, empty and long texts, repeats, empty tables, extra columns."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specloom.llm import decontaminate, kit, language, license_scan, mixing, ngram_join, quality_model, quality_rules, queries, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, m string, words string, label string, items string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=120):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(vocabulary, k=random.choice([3, 30, 60, 200]))) for _ in range(n)]
    for i in range(0, n, 3):
        words = texts[i].split()
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[5]] * 4 + [None, "", " \n\t", "One", "word " * 30_000, "ÆØ ñ 'x' GNU General Public License, mit LICENSE cc by"]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "a", "b", "c", "d") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", None, "a", "b", "c", "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(sets):
    label = {i: i for i in sets}

    def top(v):
        return v if label[v] == v else top(label[v])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {(i, len(s), top(i)) for i, s in sets.items()}


def test_ngram_join_is_exact(docs):
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components({r.doc_id: shingle_set(r.text) for r in docs.collect()})


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Lists of the heavy table: near copies, exact copies, and one passage in texts that don't link."""
    random.seed(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for i in range(90):
        words = (passage + " " + " ".join(f"t{j}" for j in range(60))).split()
        words[random.randrange(40, 100)] = f"x{i % 50}"
        texts.append(" ".join(words))
        texts.append(passage + " " + " ".join(random.choices([f"v{j}" for j in range(9)], k=random.choice([4, 6, 60]))))
    rows = list(enumerate(texts + texts[:20]))
    want = brute_components({i: shingle_set(t) for i, t in rows})
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    for heavy_from in (8, 10_000):
        monkeypatch.setattr(ngram_join, "HEAVY_FROM", heavy_from)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table).collect()} == want


def test_t_occurrence_against_sets():
    random.seed(2)
    for _ in range(200):
        base = random.sample(range(10_000), random.randint(1, 60))
        sets = [np.unique(np.array(random.sample(base, max(1, int(len(base) * random.uniform(0.7, 1)))) + random.sample(range(10_000), random.randint(0, 4)), np.uint64)) for _ in range(9)]
        query, own = np.unique(np.array(base, np.uint64)), set(base)
        want = [i for i, s in enumerate(sets) if 100 * len(own & set(s.tolist())) >= 85 * len(own | set(s.tolist()))]
        assert sorted(ngram_join.t_occurrence(query, sets, 85)) == want


def test_fm_index_against_scan():
    random_ = np.random.default_rng(3)
    for _ in range(60):
        size = int(random_.integers(1, 6))
        symbols = random_.integers(0, size + 1, int(random_.integers(2, 150)))
        symbols[-1] = 0
        index = decontaminate.FMIndex(symbols, size)
        for width in (1, 2, 3):
            windows = random_.integers(1, size + 1, (8, width))
            for w, a, b in zip(windows, *index.search(windows), strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(symbols) - width + 1) if (symbols[i : i + width] == w).all()]


def test_contamination(spark, docs, none):
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = spark.createDataFrame([(1, " ".join(texts[3].split()[:25])), (2, "One"), (3, None), (None, "One"), (4, "absent words")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert list(got[3]["items"]) == [1] if len(texts[3].split()) >= 10 else True
    one = next(i for i, t in texts.items() if t == "One")
    assert list(got[one]["items"]) == [2] and [tuple(s) for s in got[one].spans] == [(0, 1)]
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(not r["items"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_contamination_in_blocks(monkeypatch, docs, spark):
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(200)], "item_id long, text string")
    key = lambda df: sorted((r.doc_id, r.n_words, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.distinct().collect())
    whole = key(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 700)
    assert key(decontaminate.contamination(docs, bench)) == whole


def test_long_text_in_pieces(monkeypatch):
    text = "abc  déf " * 2000
    whole = kit.hash_words_of(text, kit.SPACED)
    monkeypatch.setattr(kit, "CHUNK_BYTES", 1000)
    assert (kit.hash_words_of(text, kit.SPACED) == whole).all() and len(whole) == 4000


def test_quality_rules(docs, none):
    made = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    long = next(r for r in made.values() if r.n_words == 30_000)
    assert (long.n_repeat_words, long.fail_bits & 2) == (30_000, 2)
    assert quality_rules.ledger(none).count() == 0
    kept = sum(r.fail_bits & 3 == 0 for r in quality_rules.ledger(docs).collect())
    assert {r.kept for r in quality_rules.ablation(quality_rules.ledger(docs)).filter("version = 1").collect()} == {kept}


def test_license_scan(docs, none):
    row = license_scan.license_scan(docs).filter("n_base > 0").first()
    assert (row.n_base, row.base_labels, row.first_word) == (3, "cc-by,gpl,mit", 3)
    assert license_scan.license_scan(none).count() == 0 and license_scan.license_scan(docs).count() == docs.count()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://COM", "http://a.com/x", "https://Example.com/en/1", "https://www.example.com/en/2?q=1#z", "http://x.net/fr/", "http://net/es/1", "http://notnet/es/1"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(rows).collect()}
    assert got[0][:3] == ("", "", None) and got[2][:3] == ("", "", None) and got[3][:3] == ("com", "", None)
    assert got[5] == ("example.com", "/en/1", "example.com/en/", "block") and got[6][2:] == ("www.example.com/en/", "allow") and got[7][2] == "net/fr/" and got[9][2] is None
    assert url_filter.url_filter(rows.limit(0)).count() == 0


def test_rules_against_counts(spark):
    rows = [(["a", "b"], "block")] * 9 + [(["a", "c"], "allow")] * 9 + [(["b"], "allow")] * 9
    rules = {(tuple(r.rule_tokens), r.learned): r.confidence for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert rules == {(("a", "b"), "block"): 1.0, (("c",), "allow"): 1.0, (("a", "c"), "allow"): 1.0}


def test_mixing(docs, none):
    first, again = (sorted((r.doc_id, r.replica) for r in mixing.mix(docs, epochs=3.0).collect()) for _ in range(2))
    assert first == again and mixing.mix(none).count() == 0
    assert {r.source for r in mixing.mix(docs, weights={"s1": 1.0}).collect()} == {"s1"}
    many = mixing.mix(docs, weights={"s1": 1.0}, epochs=400.0).agg(F.sum(F.length("text"))).first()[0]
    assert many == pytest.approx(400 * docs.agg(F.sum(F.length("text"))).first()[0], rel=0.2)


def test_warc_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNK", 700)
    pages = [(1, "http://a/\nb", "é" * 1500), (2, None, "é" * 1500), (3, "http://c", None), (4, "http://d", "x\r\n\r\ny"), (None, "http://e", "q" * 5000)]
    table = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w", payload=True).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in table if r.last) == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None)]
    for page_id, _, html in pages[1:]:
        parts = sorted((r.chunk, bytes(r.data)) for r in table if r.page_id == page_id)
        assert b"".join(d for _, d in parts) == (html or "").encode()
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_models_hold_out(spark):
    for f, column, least in ((language.op2_language_id, "lang", 0.97), (quality_model.op6_quality_classifier, "quality", 0.85), (toxicity.op10_toxicity, "toxic", 0.85)):
        got = f(spark, "/root/testdata/sf0.01")
        labels = kit.table(spark, "/root/testdata/sf0.01", "documents" if column == "lang" else "labels").select("doc_id", column)
        right = F.avg((F.col(column) == F.col("lang_pred" if column == "lang" else "predicted")).cast("double"))
        row = got.join(labels, "doc_id").filter("held_out").agg(right.alias("right")).first()
        assert got.count() == 1000 and row.right >= least
        assert got.filter("score < 0 or score > 1 or score is null").isEmpty()


def test_models_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (61, None, None)], "doc_id long, quality int, toxic int")
    assert quality_model.score(docs, quality_model.fit(docs, labels)).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(none, labels)).count() == docs.count()
    assert quality_model.score(docs, quality_model.fit(none, labels)).count() == docs.count()
    model = language.fit(docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, model).filter("score = 0").collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(docs, language.fit(none, F.lit(True))).collect()} == {"und"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_decisions(spark):
    read, docs = corpus_pipeline.STAGES, kit.table(spark, SF, "documents")
    for name, stage in read[:4]:
        made = kit.cut(stage(spark, docs, SF))
        assert made.columns == docs.columns and made.count() <= docs.count(), name
        docs = made
    found = ngram_join.ngram_join(docs)
    assert found.filter("doc_id <> component_id").isEmpty()
    assert decontaminate.contamination(docs, kit.table(spark, SF, "benchmark")).filter(F.size("items") > 0).isEmpty()
    assert set(docs.columns) < set(corpus_pipeline.STAGES[4][1](spark, docs, SF).columns)
