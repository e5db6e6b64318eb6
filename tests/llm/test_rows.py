"""Rows, not ids: null and repeated doc_ids, clashing column names, and links counted by brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_whole_job import linked, shingle_set

import corpus_pipeline
from specloom.llm import kit, language, license_scan, license_texts, mixing, ngram_join, quality_model, quality_rules, toxicity, url_filter, warc

CLASHING = "doc_id long, text string, source string, n_words long, m string, ledger string, fail_bits long, quality_score double, parts int, replica int, order_key string, row_key long, group_key long, key long, label string, _row int, of_source string"


def odd_rows():
    """Rows that repeat an id with the same and with another text, rows without an id, near copies, empty and null texts."""
    random.seed(8)
    texts = []
    for _ in range(14):
        words = [f"w{random.randrange(500)}" for _ in range(60)]
        for n in range(random.choice([1, 2, 4])):
            copy = list(words)
            for at in random.sample(range(4, 56), n // 2 if n < 2 else 1):
                copy[at] = f"x{n}"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (3, texts[-1]), (5, texts[0] + " end"), (None, texts[7]), (None, texts[2] + " end"), (None, "only here " * 9), (None, None), (2, ""), (90, None), (91, " \n")]
    random.shuffle(rows)
    return rows


def brute(rows, k, percent):
    """Of each row: set size, smallest doc_id reachable, number of other sets that its set links with."""
    sets = [shingle_set(t, k) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    links = {s: [o for o in distinct if o != s and linked(s, o, percent)] for s in distinct}
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        seen, todo = {s}, [s]
        while todo and s:
            for o in links[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        ids = [j for (j, _), o in zip(rows, sets, strict=True) if o in seen and j is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i, len(links.get(s, []))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [256, 3])
def test_join_of_rows_and_its_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = odd_rows()
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=repr) == brute(rows, 4, 85)


def test_links_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 40 + i] + [f"x{i}"] + words[41 + i :])) for i in range(40)] + [(i + 40, " ".join(words[i:])) for i in range(30)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=repr) == brute(rows, 4, 85)


def test_stage_keeps_one_row_of_each_group(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    sets = [shingle_set(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and sets[i] and (sets[i] == sets[j] or linked(sets[i], sets[j], 80)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    best = {}
    for (i, t), g in zip(rows, group, strict=True):
        best.setdefault(g, []).append((i is None, i, t))
    assert len(got) == len(best)
    for members in best.values():
        assert (min(m[1] for m in members if not m[0]) if any(not m[0] for m in members) else None) in {i for i, t in got if (i is None, i, t) in members}


def test_licenses_of_rows(spark):
    mit = dict(license_texts.NOTICES)["mit-text"]
    edited = mit.replace("merge, publish,", "merge and publish,").replace("NONINFRINGEMENT", "TITLE")
    rows = [(None, "under the mit license here"), (None, "cc by"), (2, "the APACHE license. apache license"), (2, "so cc-by it is"), (2, "so cc-by it is"), (3, None), (4, ""), (5, mit), (6, edited), (7, "marKet mit licenİse"), (8, mit + " " + mit), (9, " ".join(mit.split()[:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.license_scan(docs).collect()), key=repr)
    n = len(license_scan.templates()[[label for _, label, *_ in license_scan.templates()].index("mit-text")][4])
    want = [(None, 5, 1, 2, 2, "mit", "mit"), (None, 2, 1, 0, 0, "cc-by", "cc-by"), (2, 5, 2, 1, 3, "apache", "apache"), (2, 5, 1, 1, 1, "cc-by", "cc-by"), (2, 5, 1, 1, 1, "cc-by", "cc-by"), (3, 0, 0, None, None, "", ""), (4, 0, 0, None, None, "", ""), (5, n, 0, None, None, "", "mit-text"), (6, n + 1, 0, None, None, "", "mit-text"), (7, 3, 0, None, None, "", ""), (8, 2 * n, 0, None, None, "", "mit-text"), (9, 40, 0, None, None, "", "")]
    assert got == sorted(want, key=repr)
    found = [(r.start, r.end, r.score) for r in license_scan.spans(docs.filter("doc_id = 8")).collect()]
    assert sorted(found) == [(0, n, 1.0), (n, 2 * n, 1.0)]


def test_clashing_columns(spark):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(40)), "s", 1, "a", "b", 2, 0.1, 3, 4, "c", 5, 6, 7, "d", 8, "e") for i in range(30)]
    docs = spark.createDataFrame(rows, CLASHING)
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and {tuple(r) for r in made.collect()} <= set(rows)
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns) and mixed.count() > 0
    assert quality_rules.ledger(docs, docs.columns).filter("n_words = 40 and ledger = 'b'").count() == 30
    assert license_scan.license_scan(docs).count() == 30 and ngram_join.ngram_join(docs).count() == 30
    assert toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))).count() == 30
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.net/q").alias("url"), "label", F.lit("t").alias("token"), F.lit("v").alias("verdict"), F.lit("r").alias("rule"), F.lit("h").alias("host"))
    assert url_filter.url_filter(pages).filter("verdict = 'allow' and host = 'x.net' and rule is null").count() == 30


def test_names_of_any_kind(spark):
    """Dots, spaces and backticks in names of extra columns, in all stages and operators that keep columns."""
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(40)), "s", 1, 2, 3) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `x.y` int, `a b` int, `c``d` int")
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == docs.columns and {tuple(r) for r in made.collect()} <= set(rows)
    assert mixing.mix(docs).drop("replica", "order_key").columns == docs.columns
    assert quality_rules.ledger(docs, docs.columns).filter("`x.y` = 1 and `c``d` = 3").count() == 30
    for made in (license_scan.license_scan(docs), ngram_join.ngram_join(docs), toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"))))):
        assert made.count() == 30


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("text %04d", "id").alias("text"), F.lit("s").alias("source"))
    kept = mixing.mix(docs)
    assert 560 < kept.select("text").distinct().count() < 700 and 900 < kept.count() < 1100


def test_records_without_a_page_id(spark):
    html = "x" * 1200
    pages = spark.createDataFrame([(1, "u", html), (None, "u", html), (7, "u", html), (None, "u", "y" * 1500), (None, "u", "y" * 1500), (None, "u", "z")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.classify(pages).collect()), key=repr)
    assert got == sorted([(1, "revisit", 7), (None, "revisit", 7), (7, "response", None)] + [(None, "response", None)] * 3, key=repr)


def test_mined_rules_that_decide(spark):
    """Pruned, they are those of all token sets; a path of many common segments ends."""
    random.seed(14)
    tokens = [["a", "b", "c"], ["d"], ["e", "f"], ["g"], ["h"]]
    rows = [([t], "allow") for t in "adg"]
    rows += [(sorted({t for part in random.sample(tokens, random.randint(1, 4)) for t in part}), random.choice(["allow", "block", "block"])) for _ in range(60)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    of = lambda rules: {(tuple(r.rule_tokens), r.learned, round(r.confidence, 9), round(r.support, 9)) for r in url_filter.prune(rules).collect()}
    for part in (labelled, labelled.filter("size(tokens) > 1")):
        assert of(url_filter.mine_deciding(part, 3 / 60, 0.7)) == of(url_filter.mine(part, 3 / 60, 0.7)) != set()
    deep = [(sorted([f"s{i:02d}" for i in range(24)] + [f"p{k}"]), "block") for k in range(30)] + [([f"p{k}"], "allow") for k in range(30)]
    got = url_filter.prune(url_filter.mine_deciding(spark.createDataFrame(deep, "tokens array<string>, verdict string"), 0.2, 0.9)).collect()
    assert {tuple(r.rule_tokens) for r in got} == {(f"s{i:02d}",) for i in range(24)}


def test_samples_hold_rare_values(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 12, "rare").otherwise("common").alias("lang"))
    got = {r["lang"]: r["count"] for r in kit.sampled(rows, "lang", 200, "doc_id").groupBy("lang").count().collect()}
    assert got["rare"] == 12 and 120 < got["common"] < 280


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

        @staticmethod
        def getConf():
            return {}

    with pytest.raises(ValueError):
        kit.shared_dir(type("Session", (), {"sparkContext": Context})())


def test_language_by_plain_loops(spark):
    """The model's score of a text, word by word, and texts without letters."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("the bird", "en"), ("el gato y el perro", "es"), ("un pájaro", "es"), ("die Katze und der Hund", "de")] * 3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for text in ("the gato", "perros", "HUNDE und", "pájaro", "zzz q"):
        words = text.lower().split()
        total = [0.0] * len(model.languages)
        for w in words:
            if w in model.words:
                own = model.word_scores[model.words[w]]
            else:
                padded, own = f" {w} ", [0.0] * len(total)
                for n in range(language.LONGEST, 0, -1):
                    known = [padded[a : a + n] for a in range(len(padded) - n + 1) if padded[a : a + n] in model.grams]
                    if known:
                        own = [sum(float(model.gram_scores[model.grams[g]][j]) for g in known) / len(known) for j in range(len(total))]
                        break
            total = [a + float(b) for a, b in zip(total, own, strict=True)]
        import math

        chance = [math.exp((v - max(total)) / math.sqrt(len(words))) for v in total]
        got = model.predict(text, {})
        assert got[0] == model.languages[max(range(len(total)), key=lambda j: total[j])] and got[1] == pytest.approx(max(chance) / sum(chance), rel=1e-4)
    assert [model.predict(t, {})[0] for t in ("½ ²", "Ⅷ", "123 _", "", None)] == ["und"] * 5


def test_machine_by_plain_loops():
    import numpy as np

    random_ = np.random.default_rng(4)
    terms = np.arange(10, 17)
    own = toxicity.Machine(terms, 0.3, random_.normal(size=7), random_.normal(size=(7, toxicity.FACTORS)))
    documents = [np.array([10, 12, 400]), np.array([], np.int64), np.array([11, 13, 14, 16])]
    for ids, got in zip(documents, own.logit(own.rows(documents)), strict=True):
        held = [t for t in range(7) if terms[t] in ids]
        pairs = sum(float(own.factors[a] @ own.factors[b]) for a in held for b in held if a < b)
        assert got == pytest.approx(0.3 + sum(own.weights[t] for t in held) + pairs, rel=1e-4)


def test_beginnings_of_words(monkeypatch):
    import numpy as np
    import pyarrow as pa

    def of(text):
        data, offsets = kit.text_buffers(pa.array([text, None, text]))
        parts = list(kit.word_hashes(data, offsets, kit.ALNUM, (4, 6)))
        return np.concatenate([h for _, _, h, _ in parts]), np.concatenate([np.diff(b) for _, _, _, b in parts])

    hashes, sizes = of("Loweisch loweint low élan lowe")
    rows = hashes[:15].reshape(5, 3)
    assert sizes.tolist() == [15, 0, 15] and (hashes[:15] == hashes[15:]).all()
    assert rows[0, 1] == rows[1, 1] != 0 and rows[0, 2] != rows[1, 2] and rows[0, 0] != rows[1, 0]
    assert rows[2, 1:].tolist() == [0, 0] and rows[3, 1] != 0 and rows[3, 2] == 0 and rows[4, 1] == 0  # é is two bytes
    whole = of("loweisch a idiotic " * 500)[0]
    monkeypatch.setattr(kit, "CHUNK_BYTES", 700)
    assert (of("loweisch a idiotic " * 500)[0] == whole).all()


def test_toxicity_of_unseen_forms(spark):
    """Words that share a beginning with toxic ones count, though none of them was seen."""
    clean = [f"word{i % 7} other{i % 11} thing{i % 5}" for i in range(200)]
    toxic = [f"word{i % 7} grumpf{chr(97 + i)} thing{i % 5}" for i in range(20)]
    rows = [(i, t, int(i >= 200)) for i, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "word3 grumpfzz thing1"), (2, "word3 other4 thing1"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(asked, model).collect()} == {1: True, 2: False, 3: False}


def test_network_by_plain_loops():
    import numpy as np

    x = np.random.default_rng(2).normal(size=(40, 5))
    y = (x[:, 0] > 0).astype(float)
    net = quality_model.train(x, y, steps=50)
    for row, got in zip(x, net.probability(x), strict=True):
        z = [max(-8, min(8, (v - m) / s)) for v, m, s in zip(row, net.mean, net.spread, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, net.w1[:, h], strict=True)) + net.b1[h]) for h in range(quality_model.HIDDEN)]
        logit = (sum(a * w for a, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert got == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)


def test_rules_by_brute_force(spark):
    """All token sets of random pages, counted by loops."""
    from itertools import combinations

    random.seed(12)
    rows = [(sorted(random.sample("abcdef", random.randint(1, 5))), random.choice(["allow", "block", "block"])) for _ in range(60)]
    want = {}
    for size in range(1, 6):
        for part in combinations("abcdef", size):
            held = [v for t, v in rows if set(part) <= set(t)]
            for verdict in ("allow", "block"):
                n = held.count(verdict)
                if n >= 3 and n / len(held) >= 0.7:
                    want[part, verdict] = (n / len(held), n / 60)
    got = {(tuple(r.rule_tokens), r.learned): (r.confidence, r.support) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 3 / 60, 0.7).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
