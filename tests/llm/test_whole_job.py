"""Whole jobs: what an operator once left out, held against brute force."""

import random
import re

import corpus_pipeline
from specloom.llm import decontaminate, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def firsts(texts, k, percent):
    """Places of texts that are the first of their component."""
    sets, label = [shingle_set(t, k) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and linked(sets[i], sets[j], percent):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [i for i, x in enumerate(label) if i == x]


def near_copies(seed=5):
    """Texts of 30 to 80 words, each with copies of which some words are changed."""
    random.seed(seed)
    texts = []
    for _ in range(25):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([30, 50, 51, 80]))]
        texts.append(" ".join(words))
        for n in (1, 1, 2):
            copy = list(words)
            for at in random.sample(range(5, len(words) - 5), n):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    random.shuffle(texts)
    return texts


def test_stage_of_near_duplicates_at_five_words(spark):
    texts = near_copies()
    want = firsts(texts, 5, 80)
    assert want != firsts(texts, 4, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


LISTING = (("a.org", "/x/", "block"), ("b.org", "/", "allow"))


def test_learned_rules_judge_unlisted_pages(spark):
    urls = [f"http://a.org/x/ads/p{i % 3}" for i in range(20)] + [f"http://b.org/news/p{i % 3}" for i in range(20)] + [f"http://c{i}.org/ads/q" for i in range(5)] + ["http://d.org/news/q", "http://e.org/r"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(rows, listing=LISTING).collect()}
    assert {(got[i].verdict, got[i].learned_rule) for i in range(40, 45)} == {("block", "path:ads")}
    assert (got[45].verdict, got[45].learned_rule) == ("allow", "path:news") and (got[46].verdict, got[46].learned_rule) == ("allow", None)


def test_no_rule_is_capped_and_pruning_loses_none(spark):
    tokens = [f"t{i:02d}" for i in range(12)]
    rows = [(tokens, "block")] * 9 + [(["t00", "u"], "allow"), (["u"], "allow")]
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).cache()
    assert rules.count() == 2**12 - 1 + 2
    every = [(-r.confidence, -r.support, len(r.rule_tokens), " ".join(r.rule_tokens), set(r.rule_tokens)) for r in rules.collect()]
    kept = [(-r.confidence, -r.support, len(r.rule_tokens), " ".join(r.rule_tokens), set(r.rule_tokens)) for r in url_filter.prune(rules).collect()]
    assert len(kept) < 20
    random.seed(6)
    for _ in range(100):
        page = set(random.sample([*tokens, "u"], random.randint(1, 6)))
        first = lambda all_: min((r[:4] for r in all_ if r[4] <= page), default=None)
        assert first(kept) == first(every)


def test_blocks_of_the_benchmark_keep_each_row(spark, monkeypatch):
    texts = [(1, "a b x y"), (1, "a b x y"), (None, "a b x y"), (None, "c d x y"), (2, "a b c d"), (2, "x y c d"), (3, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "b c"), (4, "d"), *((i, f"other{i} word") for i in range(5, 90))], "item_id long, text string")
    rows = lambda: sorted(((r.doc_id, r.n_words, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    want = sorted([(1, 4, (1,), ((0, 2),)), (1, 4, (1,), ((0, 2),)), (None, 4, (1,), ((0, 2),)), (None, 4, (2, 4), ((0, 2),)), (2, 4, (1, 2, 3, 4), ((0, 4),)), (2, 4, (2, 4), ((2, 4),)), (3, 0, (), ()), (3, 0, (), ())], key=repr)
    assert rows() == want
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 300)
    assert rows() == want


def test_long_items_lie_in_several_blocks(spark, monkeypatch):
    random.seed(8)
    long = [f"w{random.randrange(40)}" for _ in range(700)]
    items = {1: long, 2: long[100:112], 3: [f"v{i}" for i in range(83)], 4: ["w1", "gone"]}
    texts = {i: random.choice([["x"], []]) + long[a : a + random.randrange(5, 60)] + ["y"] for i, a in enumerate(range(0, 690, 7))} | {200: long * 3, 201: [f"v{i}" for i in range(70, 83)]}
    windows = {i: {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} for i, w in items.items()}

    def plain(words):
        found = {(i, j, j + k) for i, own in windows.items() for k in {len(w) for w in own} for j in range(len(words) - k + 1) if tuple(words[j : j + k]) in own}
        return tuple(sorted({i for i, _, _ in found})), {p for _, a, b in found for p in range(a, b)}

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for size in (decontaminate.PHRASE_BYTES, 40, 300):  # all in one block; pieces of one window; of 75 words
        monkeypatch.setattr(decontaminate, "PHRASE_BYTES", size)
        got = decontaminate.contamination(docs, bench).collect()
        assert {r.doc_id: (tuple(r["items"]), {p for s in r.spans for p in range(*s)}) for r in got} == {i: plain(w) for i, w in texts.items()}
