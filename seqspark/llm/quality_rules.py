"""Quality rules: document statistics, fixed base rules, and a learned decision list.

The list is learned by sequential covering: a rule (a conjunction of threshold tests) grows on two thirds of the
labelled rows by information gain, loses its last tests while that improves it on the other third, and is kept if
it is precise there; rows it covers leave, and the next rule follows. The list becomes one ordered Spark
conditional expression over the statistics. Only the fit sees labels; it uses at most ``FIT_ROWS`` labelled rows,
the first in an order by hash, and only their statistics (five numbers a row) reach the driver.

Edge cases: null, empty and blank texts have zero words (their ratios are taken to one word, so no test divides by
zero), fail the base rules and are not kept; repeated rows are judged each by itself; without labels the list is empty and keeps what passes the base rules; other input columns are
ignored. Very long texts are handled one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

FIT_ROWS = 20_000
WINDOW = 5
MAX_RULES, MAX_TESTS, LEAST_ROWS, LEAST_PRECISION = 12, 3, 5, 0.9
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def stats_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tune(docs.sparkSession)
    df = docs.select(id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([stats_of(t) for t in b.iloc[:, 1]], columns=STATS, dtype="int64")
            out.insert(0, id_col, b.iloc[:, 0].to_numpy())
            yield out

    return df.mapInPandas(run, f"`{id_col}` {kind}, " + ", ".join(f"{s} bigint" for s in STATS))


def ratios(n: dict, at_least_one) -> dict:
    """The features of the learned tests, as columns or arrays: ratios of the statistics, to one word where a text has none.

    at_least_one gives the greater of a column or array and 1.
    """
    words = at_least_one(n["n_words"])
    return {"n_words": n["n_words"], "chars_per_word": n["word_chars"] * 1.0 / words, "symbols_per_word": n["n_symbols"] * 1.0 / words, "dup_lines": n["n_dup_lines"], "repeat_share": n["n_repeat_words"] * 1.0 / words}


def entropy_gain(p0, n0, p1, n1) -> float:
    if p1 == 0:
        return -1.0
    return p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[tuple[str, str, float]]]:
    """An ordered list of conjunctions; a row that fits one is bad. Deterministic."""
    rows = np.arange(len(bad))
    grow_all, prune_all = rows[rows % 3 != 2], rows[rows % 3 == 2]
    rules: list[list[tuple[str, str, float]]] = []

    def fits(rule, at):
        m = np.ones(len(at), bool)
        for f, op, t in rule:
            m &= x[f][at] >= t if op == ">=" else x[f][at] <= t
        return m

    while len(rules) < MAX_RULES:
        grow, prune = grow_all, prune_all
        for r in rules:
            grow, prune = grow[~fits(r, grow)], prune[~fits(r, prune)]
        if bad[grow].sum() < LEAST_ROWS or bad[grow].all():
            break
        rule, at = [], grow
        while len(rule) < MAX_TESTS and not bad[at].all():
            best = (1e-9, None)
            p0, n0 = bad[at].sum(), (~bad[at]).sum()
            for f in x:
                v = x[f][at]
                order = np.argsort(v, kind="stable")
                sv, sb = v[order], bad[at][order]
                ends = np.flatnonzero(np.diff(sv) > 0)
                cp = np.cumsum(sb)[ends] if len(ends) else np.array([], int)
                for i, p in zip(ends, cp):
                    mid = float(sv[i] + sv[i + 1]) / 2
                    for op, p1, n1 in (("<=", p, i + 1 - p), (">=", p0 - p, n0 - (i + 1 - p))):
                        if p1 + n1 >= LEAST_ROWS and (g := entropy_gain(p0, n0, p1, n1)) > best[0]:
                            best = (g, (f, op, mid))
            if best[1] is None:
                break
            rule.append(best[1])
            at = at[fits([best[1]], at)]
        if not rule:
            break

        def worth(r):
            m = fits(r, prune)
            p = bad[prune][m].sum()
            return (2 * p - m.sum()) / max(1, m.sum()), m.sum(), p

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0] and worth(rule[:-1])[1] > 0:
            rule = rule[:-1]
        _, covered, right = worth(rule)
        if covered == 0 or right < LEAST_PRECISION * covered or bad[grow][fits(rule, grow)].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
    return rules


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The number of the first rule that fits a row, null if none: one ordered conditional."""
    f = ratios({s: F.col(s) for s in STATS}, lambda c: F.greatest(c, F.lit(1)))
    out = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for name, op, t in rule:
            test = test & (f[name] >= t if op == ">=" else f[name] <= t)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[tuple[str, str, float]]]:
    """Learns from at most fit_rows labelled documents that pass the base rules."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows small rows
    got = with_stats(few).join(F.broadcast(chosen), "doc_id").where(~base_failed()).toPandas().drop_duplicates()
    if got.empty:
        return []
    got = got.sort_values(["doc_id", *STATS], kind="stable").sample(frac=1.0, random_state=7)
    x = {k: np.asarray(v, float) for k, v in ratios({s: got[s].to_numpy() for s in STATS}, lambda a: np.maximum(a, 1)).items()}
    return learn(x, got["quality"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules) -> DataFrame:
    df = with_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    return df.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), F.when(~F.col("base_failed"), F.col("rule")).alias("rule"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
