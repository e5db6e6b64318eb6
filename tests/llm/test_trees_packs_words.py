"""Operators 11 to 13 against plain Python: trees and proofs, packed sequences, spelling variants."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specloom.llm import kit, merkle, packing, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """root, and for each leaf its siblings (before, after) level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            low = k // fanout * fanout
            paths[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + fanout])))
        nodes, at = [hashed(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)], [k // fanout for k in at]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows, fanout):
    groups = {}
    for group, number, leaf in rows:
        groups.setdefault(group, []).append((number is not None, number, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *plain_tree([leaf for *_, leaf in sorted(groups[g])], fanout)) for g in names}
    root, upper = plain_tree([trees[g][1] for g in names], fanout)
    return sorted(((g, number, leaf, trees[g][1], root, tuple(own) + tuple(upper[k])) for k, g in enumerate(names) for (_, number, leaf), own in ((o, tuple(p)) for o, p in zip(trees[g][0], trees[g][2], strict=True))), key=repr)


@pytest.mark.parametrize("fanout,most", [(2, None), (2, 1500), (3, 0), (5, 1500)])
def test_manifest_by_plain_loops(spark, monkeypatch, fanout, most):
    """All levels climbed in one task, only the upper ones, or none."""
    if most is not None:
        monkeypatch.setattr(kit, "BROADCAST_BYTES", most)
        monkeypatch.setattr(merkle, "MOST_BYTES", most)
    random.seed(fanout)
    rows = [(random.choice(["a", "b", "b", "b", None]), i if i % 9 else None, hashed(str(i))) for i in range(45)]
    rows += [("é", 5, hashed("x")), ("z", 1, hashed("y")), ("b", 4, hashed("again")), ("b", 4, hashed("again"))]
    random.shuffle(rows)
    leaves = spark.createDataFrame([(*r, "own") for r in rows], "`group.of` string, number long, digest string, `tree` string").repartition(3)
    got = merkle.manifest(leaves, "group.of", ["number"], fanout).collect()
    made = sorted(((r["group.of"], r.number, r.digest, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got), key=repr)
    assert made == plain_manifest(rows, fanout) and {r.tree for r in got} == {"own"}
    folded = merkle.manifest(leaves, "group.of", ["number"], fanout).select("root", merkle.folded(F.col("digest"), F.col("path")).alias("f"), merkle.folded(F.lit("other"), F.col("path")).alias("g")).collect()
    assert all(r.f == r.root != r.g for r in folded)


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, digest string")
    assert merkle.manifest(empty, "lang", ["doc_id"]).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, "d")], empty.schema), "lang", ["doc_id"]).collect()
    assert [(r.subroot, r.root, r.path) for r in one] == [("d", "d", [])]


def test_query_of_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", "en", 3, "é"), (14, "", "en", None, ""), (15, "s", "en", 1, "x" * 300_000), (15, "s", "en", 1, "y"), (14, "", "en", None, "")] + [(i, "s", "en", i, "t") for i in range(20, 60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("digest", F.lit(1)).withColumn("a.b", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, lang, n, t: hashed(*map(field, (i, s, lang, n, t)))
    assert Counter(r.leaf for r in got) == Counter(leaf(*r) for r in rows)
    changed = {leaf(*r) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert changed and all(r.verified == (r.leaf not in changed) for r in got)


ODD_TEXTS = ["", " ", "  a", "a\n\nb", "a \n b\n c", "x  y  z", "  　é é a", "it's  they'll\t a", "漢字 かな　 x", "a" * 3000, " \n" * 50 + "end", "q\u0085 w   e", "😀 😀\n😀", "1 2  3\n4", "!'s a.'ll", "z'"]


def odd_texts():
    random.seed(7)
    letters = list("ab Z1.'s\n\t  　é漢😀  \n  !")
    return ODD_TEXTS + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)]


@pytest.mark.parametrize("run_bytes", [1 << 20, 40])
def test_ids_are_those_of_the_whole_text(monkeypatch, run_bytes):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 200)
    plain, texts = Tokenizer.from_file(TOKENIZER), odd_texts()
    got = list(packing.token_ids(pa.array([*texts, None]), TOKENIZER))
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


@pytest.mark.parametrize("windows", [1, 2, 7, 40])
def test_differencing_keeps_windows_near(windows):
    rng = np.random.default_rng(windows)
    lengths = rng.integers(1, 600, 400)
    of = packing.differencing(lengths, windows)
    sums = np.bincount(of, weights=lengths, minlength=windows)
    assert len(of) == 400 and of.max() == windows - 1 and sums.sum() == lengths.sum() and sums.max() - sums.min() <= 40
    dealt = np.bincount(np.arange(400) % windows, weights=lengths, minlength=windows)
    assert windows == 1 or sums.max() - sums.min() < dealt.max() - dealt.min()


@pytest.mark.parametrize("capacity,pool", [(2048, 1 << 20), (64, 2000), (16, 1)])
def test_pieces_give_back_the_documents(spark, capacity, pool):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    random.seed(3)
    texts = [*odd_texts()[:300], None, "word " * 9000] + [" ".join(random.choices(["alpha", "beta", "gamma."], k=random.randint(0, 200))) for _ in range(150)]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = packing.pack(docs, TOKENIZER, capacity, pool_tokens=pool).collect()
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows if i is not None}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        pieces = sorted(by_doc[i])
        assert np.frombuffer(b"".join(p[1] for p in pieces), "<u4").tolist() == ids and {p[2] for p in pieces} == {len(ids)}
        assert [p[0] for p in pieces] == np.cumsum([0] + [len(p[1]) // 4 for p in pieces])[:-1].tolist()
    assert sum(r.length for r in got if r.doc_id is None) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows if i is None)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)  # full, or a power of two


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in spelling_runs(text or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def spelling_runs(text):
    import re

    return [r.translate(str.maketrans(spelling.UPPER, spelling.LOWER)) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [(-words[v], v) for v in words if one_edit(w, v)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = [form, None, n, len(near), -best[0] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


def test_variants_by_brute_force(spark):
    random.seed(9)
    stems = ["variant", "colour", "spelling", "étagère", "aaaaaaa", "Müller", "abcabcabc", "straßen", "documents"]
    words = Counter()
    for stem in stems:
        words[stem] = random.choice([40, 700, 700])
        for _ in range(60):
            w, i, c = stem, random.randrange(len(stem) + 1), random.choice("abzéÀ")
            for _ in range(random.choice([1, 1, 2])):
                w = random.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            if len(w) >= 6:
                words[w] = random.choice([5, 5, 8, 8, 45, 130])
    for k in range(60):  # random words of few letters, where many are near
        words["".join(random.choices("ab", k=random.randint(6, 9)))] = 5 + k % 3
    words = dict(words) | {"documents": 700, "docoments": 60, "docomentz": 5}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()
    want = plain_variants(words)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(v[1] and v[2] != v[1] for v in want)  # a chain of more than one form


def test_counted_words(spark, tmp_path):
    random.seed(4)
    pool = ["Überall", "ÜBERALL", "naïveté", "Hello", "Worlds", "worlds", "Straße", "×÷×÷×÷", "éèêëàâ", "ab", "longerword"]
    rows = [(i if i % 7 else None, " ".join(random.choices(pool, k=80)) + random.choice(["", ".Worlds,worlds", "\nπολλά"])) for i in range(120)] + [(1, None), (2, ""), (3, "w" * 50_000)]
    rows += rows[:3]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("a.b", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_words(rows)
    assert {r.word: r.n for r in spelling.counted(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == want
    got = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_variants(want)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
