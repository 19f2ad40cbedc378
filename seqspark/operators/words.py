"""Words of sequences: postings, similar words, seed joins, diagonals, and hit rules on diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet, matrices

#: Query words up to this number are broadcast (a word and two numbers each); more are joined by a shuffle.
BROADCAST_WORDS = 500_000


def kmers(seqs: DataFrame, w: int, stride: int = 1, prefix: str = "") -> DataFrame:
    """seq_id, word (upper-case text), off: every word of w letters, at multiples of stride."""
    # words are cut from bytes (residues are ASCII) inside one array, so that no row carries its whole sequence along
    data = F.upper("residues").cast("binary")
    places = F.when(F.length("residues") >= w, F.sequence(F.lit(0), F.length("residues") - w, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    found = F.transform(F.array(data), lambda d: F.transform(places, lambda i: F.substring(d, i + 1, w).cast("string")))[0]
    return seqs.select("seq_id", F.posexplode(found).alias("off", "word")).select("seq_id", "word", (F.col("off") * stride).alias("off"))


def code_words(seqs: DataFrame, w: int = 3) -> DataFrame:
    """seq_id, word (code), off."""
    return seqs.select("seq_id", F.posexplode(alphabet.word_codes(alphabet.codes(F.col("residues")), w)).alias("off", "word"))


def postings(words: DataFrame) -> DataFrame:
    """Per word: number of places and of sequences. The exploded, word-ordered table itself is the index."""
    each = words.groupBy("word", "seq_id").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n_places"), F.count("*").alias("n_sequences"))


def write_index(words: DataFrame, path: str, buckets: int = 64) -> None:
    """The index as Parquet, dealt and ordered by word, so that a search reads the row groups of its words only."""
    words.repartitionByRange(buckets, "word").sortWithinPartitions("word", "seq_id", "off").write.parquet(path)


def read_index(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """word, seq_id, off of a stored index; of the wanted words only, whose least and greatest prune row groups."""
    index = spark.read.parquet(path)
    if wanted is None:
        return index
    ends = wanted.agg(F.min("word").alias("lo"), F.max("word").alias("hi")).first()
    if ends["lo"] is None:
        return index.limit(0)
    return index.where(F.col("word").between(ends["lo"], ends["hi"])).join(wanted.select("word").distinct(), "word", "left_semi")


def similar_words(spark: SparkSession, threshold: int = 11, matrix=None) -> DataFrame:
    """word, nbr, score of all pairs of 3-letter words whose letters score threshold or more, and each word with itself.

    Built letter by letter (24 rows a step), dropping what can't reach the threshold any more.
    """
    m = matrices.load() if matrix is None else matrix
    top = [int(m[a].max()) for a in range(len(m))]
    pair = spark.createDataFrame([(a, b, int(m[a, b])) for a in range(len(m)) for b in range(len(m))], "a int, b int, s int").coalesce(1)
    n = alphabet.LETTERS
    best = F.array(*map(F.lit, top))
    ids = spark.range(0, n**3, 1, 4).select((F.col("id") / n**2).cast("int").alias("c0"), ((F.col("id") / n).cast("int") % n).alias("c1"), (F.col("id") % n).cast("int").alias("c2"))
    words = ids.select("*", (F.get(best, F.col("c1")) + F.get(best, F.col("c2"))).alias("r0"), F.get(best, F.col("c2")).alias("r1"))
    p = pair.select("a", "b", "s")
    one = words.join(F.broadcast(p), F.col("c0") == F.col("a")).where(F.col("s") + F.col("r0") >= threshold).select("c0", "c1", "c2", "r1", F.col("b").alias("b0"), F.col("s").alias("s0"))
    two = one.join(F.broadcast(p), F.col("c1") == F.col("a")).where(F.col("s0") + F.col("s") + F.col("r1") >= threshold).select("c0", "c1", "c2", "b0", F.col("b").alias("b1"), (F.col("s0") + F.col("s")).alias("s1"))
    three = two.join(F.broadcast(p), F.col("c2") == F.col("a")).where(F.col("s1") + F.col("s") >= threshold).select("c0", "c1", "c2", "b0", "b1", F.col("b").alias("b2"), (F.col("s1") + F.col("s")).alias("score"))
    code = lambda x, y, z: ((x * n + y) * n + z).cast("long")
    found = three.select(code(F.col("c0"), F.col("c1"), F.col("c2")).alias("word"), code(F.col("b0"), F.col("b1"), F.col("b2")).alias("nbr"), F.col("score").cast("int"))
    diag = [int(m[a, a]) for a in range(len(m))]
    d = F.array(*map(F.lit, diag))
    low = words.withColumn("score", F.get(d, F.col("c0")) + F.get(d, F.col("c1")) + F.get(d, F.col("c2"))).where(F.col("score") < threshold)
    return found.unionAll(low.select(code(F.col("c0"), F.col("c1"), F.col("c2")).alias("word"), code(F.col("c0"), F.col("c1"), F.col("c2")).alias("nbr"), F.col("score").cast("int")))


def seed_join(query_words: DataFrame, subject_words: DataFrame, query_lengths: DataFrame, w: int, neighbours: DataFrame | None = None) -> DataFrame:
    """query_id, q_off, seq_id, s_off, diag: equal words, or words similar to a query's.

    Query words are few beside the subjects', so they are expanded and, if their number allows, broadcast: subjects then aren't shuffled.
    """
    q = query_words.join(query_lengths.select(F.col("seq_id"), F.col("length").alias("q_len")), "seq_id").select(F.col("seq_id").alias("query_id"), F.col("off").alias("q_off"), "q_len", "word")
    if neighbours is not None:
        q = q.join(F.broadcast(neighbours), "word").select("query_id", "q_off", "q_len", F.col("nbr").alias("word"))
    small = query_words.count() <= (BROADCAST_WORDS if neighbours is None else BROADCAST_WORDS // 32)
    hits = subject_words.select("seq_id", F.col("off").alias("s_off"), "word").join(F.broadcast(q) if small else q, "word")
    return hits.select("query_id", "q_off", "seq_id", "s_off", (F.col("s_off") - F.col("q_off") + F.col("q_len") - (w - 1)).cast("long").alias("diag"))


def two_hit_fold(positions: Column, window: int = 40, overlap: int = 3) -> Column:
    """Triggers of ascending positions on one diagonal: array<struct<q_off, distance>>.

    A position window or more behind the last restarts it; one closer than overlap is ignored without becoming the last.
    """
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<q_off:int,distance:int>>").alias("out"))

    def step(acc, p):
        d = p - acc["last"]
        far = acc["last"].isNull() | (d >= window)
        hit = ~far & (d >= overlap)
        return F.struct(F.when(far | hit, p).otherwise(acc["last"]).alias("last"), F.when(hit, F.concat(acc["out"], F.array(F.struct(p.alias("q_off"), d.alias("distance"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(positions, start, step, lambda acc: acc["out"])


def two_hits(seeds: DataFrame, window: int = 40, overlap: int = 3) -> DataFrame:
    """query_id, seq_id, diag, q_off, distance."""
    rows = seeds.groupBy("query_id", "seq_id", "diag").agg(F.array_sort(F.collect_list(F.col("q_off").cast("int"))).alias("p"))  # at most a query's length
    return rows.where(F.size("p") > 1).select("query_id", "seq_id", "diag", F.explode(two_hit_fold(F.col("p"), window, overlap)).alias("h")).select("query_id", "seq_id", "diag", "h.q_off", "h.distance")


def one_hits(seeds: DataFrame, w: int) -> DataFrame:
    """First seed of each run of overlapping or touching words on a diagonal, and the run's end."""
    from pyspark.sql import Window

    by = Window.partitionBy("query_id", "seq_id", "diag").orderBy("q_off")
    df = seeds.withColumn("new", (F.coalesce(F.col("q_off") - F.lag("q_off").over(by), F.lit(10**9)) > w).cast("int"))
    df = df.withColumn("run", F.sum("new").over(by))
    return df.groupBy("query_id", "seq_id", "diag", "run").agg(F.min("q_off").alias("q_start"), (F.max("q_off") + w).alias("q_end"), F.min("s_off").alias("s_start")).drop("run")


def winnowed(seqs: DataFrame, w: int = 12, window: int = 8) -> DataFrame:
    """seq_id, off, h: the rightmost least word hash of each window of words, once."""
    from pyspark.sql import Window

    by = Window.partitionBy("seq_id").orderBy("off").rowsBetween(0, window - 1)
    k = kmers(seqs, w).withColumn("h", F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long"))
    k = k.withColumn("m", F.min(F.struct("h", (-F.col("off")).alias("o"))).over(by)).withColumn("full", F.count("*").over(by))
    return k.where(F.col("full") == window).select("seq_id", (-F.col("m.o")).alias("off"), F.col("m.h").alias("h")).distinct()
