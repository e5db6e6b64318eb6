"""Language identification by word-first backoff (operator 2).

A known word scores by its log frequency in each language. An unseen word falls back to the longest of its character
n-grams that are known, down to single characters. Counts are made by Spark; the model keeps the most frequent words and
n-grams, so its size has a bound whatever it is fitted on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit

#: Bounds of what is learned: training rows, and the most frequent words, n-grams and languages that the model holds.
TRAIN_ROWS, WORDS, GRAMS, LONGEST, LANGUAGES = 20_000, 150_000, 60_000, 4, 200
CACHED = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, as \\p{L}+ in fit: numerals that Python counts as word characters break a run."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [run for word in found for run in "".join(c if c.isalpha() else " " for c in word).split()]



@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = [i for a in range(len(padded) - n + 1) if (i := self.grams.get(padded[a : a + n])) is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        total = self.word_scores[at[at >= 0]].sum(axis=0, dtype=np.float64)
        for i in np.flatnonzero(at < 0).tolist():
            if (own := cache.get(words[i])) is None:
                if len(cache) >= CACHED:
                    cache.clear()
                own = cache[words[i]] = self.unseen(words[i])
            total = total + own
        chance = np.exp((total - total.max()) / np.sqrt(len(words)))
        best = int(chance.argmax())
        return self.languages[best], float(chance[best] / chance.sum())


def _table(counts: DataFrame, key: str, most: int, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent keys and their smoothed log probability in each language, centred over languages."""
    wide = counts.groupBy(key).agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)))
    total = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0))
    rows = wide.orderBy(total.desc(), key).limit(most).toPandas()
    seen = rows[[f"n{i}" for i in range(len(languages))]].to_numpy(np.float64)
    score = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * max(1, len(seen))))
    return {w: i for i, w in enumerate(rows[key])}, (score - score.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(documents: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> Model:
    """Learns from about rows documents where train holds and lang and text are not null: of each language its share, but a
    tenth of rows for a rare one if it has as many. Of more than LANGUAGES languages the most frequent are learned."""
    known = documents.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    by_language = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in by_language)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    sample = kit.sampled(known.filter(F.col("lang").isin(languages)), "lang", rows, "doc_id", "lang")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    counts = kit.cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda a: F.substr(padded, a, n))))
    grams = counts.select("lang", "n", F.explode(cuts).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, *_table(counts, "word", WORDS, languages), *_table(grams, "gram", GRAMS, languages))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row. A null text, or one without letters, is und with score 0."""
    kit.small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        own, cache = shared.value, {}
        for frame in frames:
            found = [own.predict(t, cache) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Tables with null or repeated rows, other columns or no rows are fine; without training rows all are und."""
    documents = kit.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = identify(documents, fit(documents, kit.crc_bucket("doc_id", 5) != 0))
    return found.select("doc_id", kit.held_out(5, 0).alias("held_out"), "lang_pred", "score")
