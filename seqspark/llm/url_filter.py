"""URL filter: host/path rules first, then logistic regression on hashed character n-grams.

Everything runs as Spark expressions: n-grams are hashed with array functions, the model is fitted by one
``aggregate`` fold over the small labelled table below, and its integer weights (a fixed-size array of
``BUCKETS`` values, whatever the data) are a literal in the scoring expression. One narrow scan, no shuffle.

Edge cases: null urls and urls without ``://`` have empty host and path, no rule and the verdict ``allow``
(no n-gram speaks against them); repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 2048
EPOCHS = 25
RATE = 40.0
#: What the bias is a weight of: small beside the n-grams of a url, whose shares sum up to 1.
BIAS = 0.02
DECAY = 1e-4
#: Weights become integers of 1/SCALE, so sums are exact in any engine and order.
SCALE = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: What the labelled urls are about: words of a host, words of a path. Both kinds get the same endings, sites and forms below,
#: so that only these words tell them apart.
BLOCKED_TOPICS = [
    ("casino-bonus", "free-spins/win"), ("best-casino", "poker/bonus"), ("xxx-videos", "hot/adult"), ("adult-dating", "sex/cams"),
    ("cheap-pills", "viagra/order-now"), ("pharma-deals", "cialis/buy-cheap"), ("win-prize", "claim/free-money"), ("crypto-double", "get-rich/bonus"),
    ("warez-crack", "keygen/download"), ("torrent-movies", "free-download/crack"), ("login-verify", "account/secure/update"), ("secure-paypa1", "login/verify-account"),
    ("replica-watches", "cheap/buy"), ("payday-loans", "fast-cash/apply"), ("betting-odds", "sports/bet/bonus"), ("slots-jackpot", "casino/spin"),
    ("hot-singles", "dating/adult"), ("porn-tube", "xxx/porn/videos"), ("click-tracker", "ads/redirect"), ("free-gift", "claim/prize/win"),
]
ALLOWED_TOPICS = [
    ("history-museum", "rome.html"), ("library", "catalog/books"), ("daily-news", "2024/politics"), ("university", "research/paper"),
    ("recipes", "soup/123"), ("travel-guide", "cities/rome"), ("science", "physics/55"), ("weather", "paris.html"),
    ("code-docs", "guide/install.html"), ("wiki", "wiki/History"), ("garden", "plants/rose"), ("health", "ratgeber/12"),
    ("forum", "thread/991"), ("blog", "article/42"), ("city-council", "services/waste"), ("music-school", "courses/piano"),
    ("football-club", "results/season"), ("book-store", "novels/classics"), ("open-data", "tables/8000"), ("gallery", "collection/7"),
]
#: Sites whose pages are of both kinds, and endings that hosts of both kinds have.
SITES = ("www.example.com", "blog.example.org", "m.example.com", "pages.test", "home.biz")
ENDINGS = ("test", "example.com", "biz", "example.org", "info", "example.edu")
LANGUAGES = ("", "en/", "de/", "fr/", "es/")
#: Names without a topic, most of all urls: their pages are allowed.
SYLLABLES = ("ba", "cor", "den", "fil", "gra", "hin", "jo", "kel", "lum", "mar", "nor", "pas", "qui", "ros", "tion", "vel")
PLAIN = 60
#: What both kinds of hosts begin with, and what their plain pages end with.
FRONTS = ("", "www.", "m.", "blog.")
TAILS = ("", ".html", "/", "?page=2")


def labelled() -> list[tuple[str, int]]:
    """The labelled urls, 1: to be blocked, the two labels in turn while both last.

    Each topic as a host with its path, as a host with a plain page, and as a path of a shared site; and plain pages of hosts without a topic.
    """
    out = []
    for i in range(PLAIN):
        name = SYLLABLES[i % 16] + SYLLABLES[(5 * i + 3) % 16] + SYLLABLES[(7 * i + i // 16) % 16] * (i % 2)
        out.append((f"{('https', 'http')[i % 2]}://{FRONTS[i // 3 % 4]}{name}.{ENDINGS[i % 6]}/{LANGUAGES[i % 5]}{(7919 * (i + 3)) % 40000}{TAILS[i % 4]}", 0))
    for i, pair in enumerate(zip(BLOCKED_TOPICS, ALLOWED_TOPICS)):
        for y, (host, path) in zip((1, 0), pair):
            scheme, ending, site, lang = ("https", "http")[i % 2], ENDINGS[i % len(ENDINGS)], SITES[i % len(SITES)], LANGUAGES[i % len(LANGUAGES)]
            out += [(f"{scheme}://{host}.{ending}/{lang}{path}", y), (f"{scheme}://{FRONTS[i % 4]}{host}.{ENDINGS[(i + 1) % len(ENDINGS)]}/{lang}{1000 + 37 * i}{TAILS[i // 2 % 4]}", y), (f"{scheme}://{site}/{lang}{path}", y)]
    return sorted(out, key=lambda x: ([u for u, y in out if y == x[1]].index(x[0]), x[1]))


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return (F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the 3- and 4-grams of ``^host$path$``; no n-gram for two empty parts."""
    s = F.concat(F.lit("^"), host, F.lit("$"), F.translate(path, UPPER, LOWER), F.lit("$"))
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))

    def grams(c: Column, n: int, times: list[int]) -> Column:
        def one(i):
            total = None
            for k, m in enumerate(times):
                term = F.get(c, i + k) * m
                total = term if total is None else total + term
            return (total % BUCKETS).cast("int")

        return F.transform(F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>")), one)

    # split() can leave one empty string at the end; its code 0 is cut off
    codes = F.filter(codes, lambda c: c > 0)
    both = F.transform(F.array(codes), lambda c: F.concat(grams(c, 3, [961, 31, 1]), grams(c, 4, [29791 + 7, 961 + 7, 31 + 7, 8])))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(both[0])


def train(spark: SparkSession) -> list[int]:
    """BUCKETS + 1 integer weights (the last: bias). One row, one expression: a fold of gradient steps over the labelled urls."""
    rows = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled())], "i int, url string, y int")
    host, path = host_and_path(F.col("url"))
    grams = rows.select("i", "y", gram_buckets(host, path).alias("g"))
    dense = grams.select("i", "y", F.explode("g").alias("b")).groupBy("i", "y", "b").count().groupBy("i", "y").agg(F.map_from_entries(F.collect_list(F.struct("b", "count"))).alias("m"), F.sum("count").alias("n"))
    x = F.concat(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)) / F.col("n")), F.array(F.lit(BIAS)))
    one = dense.select("i", F.struct("i", x.alias("x"), F.col("y").cast("double").alias("y")).alias("e")).groupBy().agg(F.array_sort(F.collect_list("e")).alias("examples"))

    def step(w: Column, e: Column) -> Column:
        z = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        g = F.lit(RATE) * (e["y"] - 1 / (1 + F.exp(-z)))
        return F.transform(F.array(g), lambda k: F.zip_with(w, e["x"], lambda a, b: a * (1 - DECAY) + k * b))[0]

    w = F.aggregate(F.flatten(F.array_repeat(F.col("examples"), EPOCHS)), F.array_repeat(F.lit(0.0), BUCKETS + 1), step)
    return [int(v) for v in one.select(F.transform(w, lambda v, i: F.round(v * SCALE * F.when(i == BUCKETS, BIAS).otherwise(1.0)).cast("long")).alias("w")).first()["w"]]


def train_plainly() -> list[int]:
    """The same fit in plain Python: for the tests and for the SQL form, which holds its weights as constants."""
    rows = []
    for url, y in labelled():
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        c = [ord(ch) for ch in f"^{host}${path.lower()}$"]
        g = [(c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % BUCKETS for i in range(len(c) - 2)]
        g += [(c[i] * 29798 + c[i + 1] * 968 + c[i + 2] * 38 + c[i + 3] * 8) % BUCKETS for i in range(len(c) - 3)]
        x = [0.0] * BUCKETS + [BIAS]
        for b in set(g):
            x[b] = g.count(b) / len(g)
        rows.append((x, y))
    w = [0.0] * (BUCKETS + 1)
    for _ in range(EPOCHS):
        for x, y in rows:
            z = 0.0
            for a, b in zip(w, x):
                z += a * b
            g = RATE * (y - 1 / (1 + math.exp(-z)))
            w = [a * (1 - DECAY) + g * b for a, b in zip(w, x)]
    return [math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1) for v in (v * SCALE * (BIAS if i == BUCKETS else 1.0) for i, v in enumerate(w))]


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, weights: list[int], id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the model's own score (times 1/SCALE; above 0: block)."""
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    w = F.array(*[F.lit(int(v)).cast("long") for v in weights[:-1]])
    g = gram_buckets(F.col("host"), F.col("path"))
    score = F.aggregate(g, F.lit(0).cast("long"), lambda s, b: s + F.get(w, b) + F.lit(int(weights[-1])))
    return df.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(spark))


def sql() -> str:
    w = train_plainly()
    name = verdict = "NULL"
    for h, p, v in sorted(RULES, key=lambda r: len(r[0]) + len(r[1])):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        name, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN host = '' AND path = '' THEN [] ELSE
    list_transform(string_split(concat('^', host, '$', translate(path, '{UPPER}', '{LOWER}'), '$'), ''), lambda ch: unicode(ch)::BIGINT) END AS c
  FROM p),
g AS (
  SELECT page_id, host, path, list_concat(
    list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % {BUCKETS}),
    list_transform(range(1, greatest(len(c) - 2, 1)), lambda i: (c[i] * 29798 + c[i + 1] * 968 + c[i + 2] * 38 + c[i + 3] * 8) % {BUCKETS})) AS g
  FROM c),
s AS (
  SELECT page_id, host, path, coalesce(list_sum(list_transform(g, lambda b: ({w[:-1]}::BIGINT[])[b + 1] + {w[-1]})), 0)::BIGINT AS score FROM g)
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM s
"""
