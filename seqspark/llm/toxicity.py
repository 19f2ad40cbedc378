"""Toxicity by multiple-instance learning: sentences are scored, a document is their noisy-or.

A document is toxic if at least one sentence is: P(doc) = 1 - prod(1 - p(sentence)). Only document labels exist,
so the gradient of the noisy-or decides which sentences answer for a label. A sentence's logit is the sum of its
words' weights; a word's weight is the sum over its hashed features (the word, and its first 4, 5 and 6 letters),
so that unseen forms of a known stem still count. Scoring looks up one number per word.

The fit uses at most ``FIT_ROWS`` labelled rows, half of each label, whole texts of any length: the first in an order by hash of
doc_id, until the rows of a label hold ``FIT_CHARS`` / 2 characters (the row that crosses the bound is the last), from the folds that may be learned from.
That bounds what the task that fits holds, but for one text a label; the model is a fixed-size array, and all that the driver gets.

Edge cases: null and empty texts are one empty sentence and get its probability; labels of rows without a document
are unused; repeated rows are scored each by itself; without usable labels the model is its prior (score near 0);
other input columns are ignored. Sentences are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune

FIT_ROWS, FIT_CHARS = 4_000, 16_000_000
BITS = 18
STEMS = (4, 5, 6)
STRIPPED = ".,;:!?\"'()[]«»"
FEATURES = 1 << BITS
EPOCHS, BATCH, RATE, L2, PRIOR = 12, 16, 0.25, 1e-3, -4.0
#: Few documents are seen more often: as often as makes so many visits, 60 times at most.
VISITS = 30_000
#: Distinct words whose weights a worker keeps.
CACHE = 400_000


def features_of(word: str) -> list[int]:
    """The word and its beginnings, hashed; nothing for a token without letters or digits."""
    w = word.strip(STRIPPED)
    if not w:
        return []
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for g in dict.fromkeys((f"{w}$", *(w[:n] for n in STEMS if len(w) >= n)))]


def words_and_ends(text: str | None) -> tuple[list[str], np.ndarray]:
    """Lower-case words, and the index of each sentence's first word (an empty text is one empty word)."""
    words = (text or "").lower().replace("\n", " . ").split() or [""]
    ends = np.fromiter((w[-1:] in ".!?" for w in words), bool, len(words))
    starts = np.flatnonzero(np.concatenate(([True], ends[:-1])))
    return words, starts


class Scorer:
    """Scores texts with a fitted model; keeps the weights of words it has seen, up to a bound."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.seen = weights.tolist(), bias, {}

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        words, starts = words_and_ends(text)
        seen, weight = self.seen, self.weights.__getitem__
        if len(seen) > CACHE:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = sum(map(weight, features_of(w)))
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        z = np.fromiter(map(seen.__getitem__, place), float, len(place))
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        if len(place) < len(words):  # a word counts once in a sentence
            sentence = np.zeros(len(words), np.int64)
            sentence[starts[1:]] = 1
            once = np.unique(np.cumsum(sentence) * len(place) + at)
            sums = np.bincount(once // len(place), z[once % len(place)], len(starts))
        else:
            sums = np.add.reduceat(z, starts)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30))), starts, words

    def score(self, text: str | None) -> float:
        return float(-np.expm1(np.log1p(-self.sentences(text)[0]).sum()))

    def worst(self, text: str | None) -> tuple[str, float]:
        """The sentence that answers most for the score."""
        p, starts, words = self.sentences(text)
        k = int(p.argmax())
        return " ".join(words[starts[k] : starts[k + 1] if k + 1 < len(starts) else None]), float(p[k])


def fit_texts(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Noisy-or likelihood by Adagrad over small batches of documents in a fixed random order."""
    known: dict[str, np.ndarray] = {}
    docs = []
    for t in texts:
        words, starts = words_and_ends(t)
        for w in [w for w in set(words) if w not in known]:
            known[w] = np.array(features_of(w), np.int32)
        lists = [known[w] for w in words]
        per_word = np.fromiter(map(len, lists), np.int64, len(lists))
        sentence = np.repeat(np.cumsum(np.bincount(starts, minlength=len(words))) - 1, per_word)
        once = np.unique(sentence * FEATURES + np.concatenate(lists))
        docs.append(((once % FEATURES).astype(np.int32), (once // FEATURES).astype(np.int32), len(starts)))
    w, b = np.zeros(FEATURES), PRIOR
    gw, gb = np.full(FEATURES, 1e-3), 1e-3
    order = np.random.default_rng(7)
    for _ in range(max(EPOCHS, min(60, VISITS // len(docs)))):
        shuffled = order.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            batch = shuffled[at : at + BATCH]
            n = np.array([docs[i][2] for i in batch])
            first = np.cumsum(n) - n
            f = np.concatenate([docs[i][0] for i in batch])
            s = np.concatenate([docs[i][1] + k for i, k in zip(batch, first)])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(s, w[f], n.sum()) + b, -30, 30)))
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first))
            factor = np.where(toxic[batch], none / np.maximum(1 - none, 1e-9), -1.0)
            g = p * np.repeat(factor, n)
            step = np.bincount(f, g[s], FEATURES) - L2 * w
            gw += step**2
            w += RATE * step / np.sqrt(gw)
            db = g.sum()
            gb += db * db
            b += RATE * db / np.sqrt(gb)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> tuple[np.ndarray, float]:
    """Learns from at most fit_rows labelled documents, of about fit_chars characters, outside the held-out fold."""
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [each.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for c in ("toxic = 1", "toxic != 1")]
    chosen = first[0].unionAll(first[1])
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])  # fit_rows documents
    order = Window.partitionBy(F.col("toxic") == 1).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    before = F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        weights, bias = fit_texts(list(got["text"]), got["toxic"].to_numpy() == 1)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    # fitted in a task, so that the driver gets the model only
    model = found.withColumn("before", before).where(F.col("before") < fit_chars / 2).withColumn("before", F.lit(0)).groupBy("before").applyInPandas(run, "weights binary, bias double").first()
    if model is None:
        return np.zeros(FEATURES), PRIOR
    return np.frombuffer(model["weights"]), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All input columns stay behind doc_id: doc_id, held_out, score, predicted, worst sentence and its probability."""
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # FEATURES numbers, whatever the data
    df = docs.select("doc_id", "text")
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*weights.value)
        for b in batches:
            s = [scorer.score(t) for t in b["text"]]
            worst = [scorer.worst(t) if x >= 0.5 else (None, None) for x, t in zip(s, b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "score": s, "worst_sentence": [x for x, _ in worst], "worst_score": pd.Series([x for _, x in worst], dtype="float64").to_numpy()})

    out = df.mapInPandas(run, f"doc_id {kind}, score double, worst_sentence string, worst_score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The documents that are not predicted toxic, in the columns of documents; one narrow pass."""
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*weights.value)
        for b in batches:
            yield b[[scorer.score(t) < 0.5 for t in b["text"]]]

    return docs.mapInPandas(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
