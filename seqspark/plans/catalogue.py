"""Named queries over the search and collection operators, each with its SQL form where SQL can express it.

Texts of ``documents`` are the subjects and those of ``benchmark`` the queries. Similar-word seeds over prose are too many for
whole tables (a word of three letters hits every document), so searches here take equal words of W letters; the protein defaults
run over part names (search_parts) and are for protein collections.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet, complexity, matrices, nucleotides, statistics
from ..operators import collection, redundancy, repeats, report, search, words
from ..storage import new_path

W, WINDOW, OVERLAP = 8, 40, 3
LETTERS = alphabet.PROTEIN


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return collection.sequences(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return collection.sequences(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return collection.sequences(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    q, s = _items(spark, d), _docs(spark, d)
    return words.seed_join(words.kmers(q, W), words.kmers(s, W), q, W)


def alphabet_class(spark, d):
    return _docs(spark, d).select("seq_id", "length", alphabet.alphabet(F.col("residues")).alias("alphabet"))


def decode_roundtrip(spark, d):
    s = _items(spark, d)
    return s.select("seq_id", alphabet.decode(alphabet.codes(F.col("residues"))).alias("decoded"))


def reverse_complements(spark, d):
    return _items(spark, d).select("seq_id", alphabet.reverse_complement(F.col("residues")).alias("complement"))


def db_stats(spark, d):
    return collection.statistics(_docs(spark, d))


def length_histogram(spark, d):
    return collection.length_histogram(_docs(spark, d))


def systematic_sample(spark, d):
    return collection.systematic_sample(_docs(spark, d), 100).select("seq_id", "length", "rn")


def length_select(spark, d):
    return collection.select_long(_docs(spark, d), 500, 50).select("seq_id", "length")


def sort_by_length(spark, d):
    return collection.by_length(_docs(spark, d)).select("seq_id", "length", "rank")


def composition(spark, d):
    return collection.composition(_docs(spark, d))


def fasta_text(spark, d):
    from ..sources import fasta

    return fasta.as_text(_docs(spark, d).withColumn("description", F.concat(F.lit("doc "), F.col("seq_id"))))


def word_codes(spark, d):
    return words.code_words(_items(spark, d)).select("seq_id", "off", "word")


def postings_stats(spark, d):
    return words.postings(words.code_words(_docs(spark, d)))


def neighbor_words(spark, d):
    return words.similar_words(spark)


def seed_hits(spark, d):
    return _seeds(spark, d)


def seed_diagonals(spark, d):
    return _seeds(spark, d).groupBy("query_id", "seq_id", "diag").agg(F.count("*").alias("n_seeds"), F.min("q_off").alias("first_off"), F.max("q_off").alias("last_off"))


def two_hit_pairs(spark, d):
    return words.two_hits(_seeds(spark, d), WINDOW, OVERLAP)


def one_hit_runs(spark, d):
    return words.one_hits(_seeds(spark, d), W)


def two_hit_top(spark, d):
    """Per query, the ten subjects with the most triggers."""
    t = two_hit_pairs(spark, d).groupBy("query_id", "seq_id").agg(F.count("*").alias("n_triggers"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_triggers"), "seq_id")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def hsp_purge(spark, d):
    """Runs of seeds as alignments, purged of common ends."""
    # dealt by pair once: runs and both purges are within a pair, so nothing is shuffled again
    runs = words.one_hits(_seeds(spark, d).repartition("query_id", "seq_id"), W)
    hsps = runs.select("query_id", "seq_id", "q_start", "q_end", "s_start", (F.col("s_start") + F.col("q_end") - F.col("q_start")).alias("s_end"), (F.col("q_end") - F.col("q_start")).alias("score"))
    return report.purge_common_ends(hsps)


def bit_scores(spark, d):
    """Bits of run lengths taken as scores."""
    s = hsp_purge(spark, d).select("score").distinct()
    return s.select("score", F.round(statistics.bits(F.col("score")), 6).alias("bits"))


def hsp_evalues(spark, d):
    letters = int(_docs(spark, d).agg(F.sum("length")).first()[0] or 0)
    lens = lambda df, i, n: df.select(F.col("seq_id").alias(i), F.col("length").alias(n))
    h = hsp_purge(spark, d).join(lens(_items(spark, d), "query_id", "q_len"), "query_id").join(lens(_docs(spark, d), "seq_id", "s_len"), "seq_id")

    @F.pandas_udf("double")
    def e(score: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([statistics.evalue(*x, letters) for x in zip(score, m, n)], dtype="float64")

    return h.select("query_id", "seq_id", "q_start", "s_start", "score", e("score", "q_len", "s_len").alias("evalue"))


def query_karlin(spark, d):
    m = matrices.load()

    @F.pandas_udf("lambda double, k double, h double")
    def fit(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics.karlin(matrices.encode(t), m) for t in text], columns=["lambda", "k", "h"])

    return _items(spark, d).select("seq_id", fit("residues").alias("x")).select("seq_id", "x.*")


def low_complexity(spark, d):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": s, "end": e} for s, e in complexity.segments(t)])

    return _items(spark, d).select("seq_id", F.explode(find("residues")).alias("x")).select("seq_id", "x.*")


def dust_regions(spark, d):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": s, "end": e} for s, e in complexity.dust(t)])

    return _items(spark, d).select("seq_id", F.explode(find("residues")).alias("x")).select("seq_id", "x.*")


def smith_waterman(spark, d):
    """Items against part names, exhaustively."""
    return search.Engine(spark).exhaustive(_items(spark, d), _parts(spark, d)).select("query_id", "seq_id", "score", "q_end", "s_end")


def smith_waterman_documents(spark, d):
    """Items against whole documents, exhaustively."""
    return search.Engine(spark).exhaustive(_items(spark, d), _docs(spark, d).repartition("seq_id")).select("query_id", "seq_id", "score", "q_end", "s_end")


def spex_words(spark, d):
    return repeats.repeat_counts(_docs(spark, d), 30)


def shared_word_pairs(spark, d):
    return redundancy.candidate_pairs(_docs(spark, d), 30)


def winnow_fingerprints(spark, d):
    return words.winnowed(_items(spark, d))


def nr_representatives(spark, d):
    return redundancy.representatives(_docs(spark, d))


def search_parts(spark, d):
    """The whole search with protein defaults: items against part names, few of which differ."""
    items, parts = _items(spark, d), _parts(spark, d)
    return search.Engine(spark).search_merged(items, parts).select("query_id", "seq_id", "q_start", "q_end", "s_start", "s_end", "score", "identities", "length", "rank")


def search_documents(spark, d):
    """The whole search, items against documents, seeded by equal words of W letters."""
    found = search.Engine(spark, search.Params(word=W)).search(_items(spark, d), _docs(spark, d), exact=True)
    return found.select("query_id", "seq_id", "q_start", "q_end", "s_start", "s_end", "score", "identities", "length", "rank")


SPACE, STRIDE, LONG_WORD = 1_000_000.0, 9, 11


def nucleotide_packing(spark, d):
    """IUPAC letters of items: ambiguity replaced, packed four a byte, unpacked and put back."""
    s = _items(spark, d).select("seq_id", nucleotides.bases_of(F.col("residues")).alias("letters"))
    s = s.select("seq_id", "letters", nucleotides.without_ambiguity(F.col("letters")).alias("bases"), nucleotides.ambiguities(F.col("letters")).alias("edits"))
    s = s.withColumn("packed", nucleotides.packed(F.col("bases")))
    back = nucleotides.restored(nucleotides.unpacked(F.col("packed"), F.length("bases")), F.col("edits"))
    return s.select("seq_id", "bases", F.size("edits").alias("n_edits"), "packed", back.alias("restored"))


def nucleotide_scores(spark, d):
    """Scores of all pairs of IUPAC letters, match 5 and mismatch -4."""
    return spark.createDataFrame([(a, b, v) for (a, b), v in nucleotides.scores(5, -4).items()], "a string, b string, score int")


def search_counters(spark, d):
    """Per item: hits, diagonals, triggers, documents with a trigger."""
    seeds = _seeds(spark, d).groupBy("query_id", "seq_id", "diag").agg(F.array_sort(F.collect_list("q_off")).alias("p"))
    found = seeds.select("query_id", "seq_id", F.size("p").alias("n"), F.size(words.two_hit_fold(F.col("p"), WINDOW, OVERLAP)).alias("t"))
    per_pair = found.groupBy("query_id", "seq_id").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum("t").alias("t"))
    return per_pair.groupBy("query_id").agg(F.sum("n").alias("n_hits"), F.sum("g").alias("n_diagonals"), F.sum("t").alias("n_triggers"), F.count_if(F.col("t") > 0).alias("n_pairs"))


def unmatched_documents(spark, d):
    """Documents in which no item has a trigger."""
    return _docs(spark, d).select("seq_id", "length").join(two_hit_pairs(spark, d).select("seq_id").distinct(), "seq_id", "left_anti")


def grouped_lengths(spark, d):
    return _docs(spark, d).select("seq_id", report.grouped(F.col("length")).alias("letters"))


def descriptions(spark, d):
    """Item texts as descriptions: first word, cut or padded, escaped."""
    t = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("seq_id"), F.concat(F.lit("<"), F.coalesce("text", F.lit("")), F.lit(">")).alias("description"))
    c = F.col("description")
    return t.select("seq_id", report.first_word(c).alias("name"), report.padded(c).alias("shown"), report.escaped(report.first_word(c)).alias("escaped"))


def strided_index(spark, d):
    """Words of LONG_WORD letters at every STRIDE-th place: places and sequences of those in two sequences or more."""
    return words.postings(words.kmers(_docs(spark, d), LONG_WORD, STRIDE)).where("n_sequences > 1")


def stored_index_seeds(spark, d):
    """Seeds by an index written and read again: number per item and document."""
    path, q = new_path(spark, "index"), _items(spark, d)
    words.write_index(words.kmers(_docs(spark, d), W), path)
    wanted = words.kmers(q, W)
    return words.seed_join(wanted, words.read_index(spark, path, wanted), q, W).groupBy("query_id", "seq_id").agg(F.count("*").alias("n_seeds"))


def stored_collection(spark, d):
    """Documents written as a collection and read again: length, alphabet, letters from codes."""
    path = new_path(spark, "collection")
    collection.write(_docs(spark, d), path)
    got = collection.read(spark, path)
    return got.select("seq_id", "length", "alphabet", F.md5(alphabet.decode(F.col("codes"))).alias("decoded_md5"))


def block_statistics(spark, d):
    return collection.blocks(_docs(spark, d))


def block_assignment(spark, d):
    return collection.in_blocks(_docs(spark, d))


def visible_hsps(spark, d):
    """Purged runs without those that a report hides beside the one before."""
    return report.visible(hsp_purge(spark, d))


def _best(spark, d):
    pair = hsp_purge(spark, d).groupBy("query_id", "seq_id").agg(F.max("score").alias("score"))
    sized = pair.join(_docs(spark, d).select("seq_id", "length"), "seq_id")
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "length", "seq_id")))


def listed_pairs(spark, d):
    """The best five documents of an item, two of them in detail."""
    return report.listed(_best(spark, d), 5, 2).select("query_id", "seq_id", "score", "rank", "detailed")


def summary_lines(spark, d):
    """One-line summaries of the best five documents of an item; e-values by the plain formula."""
    bits = statistics.bits(F.col("score"))
    top = report.listed(_best(spark, d), 5, 2).select("query_id", "seq_id", bits.alias("bits"), statistics.simple_evalue(bits, F.lit(SPACE)).alias("e"))
    return top.select("query_id", "seq_id", report.summary_line(F.concat(F.lit("document "), F.col("seq_id")), F.col("bits"), F.col("e")).alias("line"))


def score_conversions(spark, d):
    """Scores to bits, e-values and back; effective search space of the collection at an adjustment of two letters."""
    stats = _docs(spark, d).agg(F.count("*").alias("c"), F.sum("length").alias("t"))
    s = hsp_purge(spark, d).select("score").distinct().withColumn("bits", statistics.bits(F.col("score")))
    c, t = stats.first()
    space = statistics.search_space(F.col("score"), F.lit(t), F.lit(c), F.lit(2))
    return s.select("score", statistics.nominal(F.col("bits")).cast("int").alias("nominal"), space.cast("long").alias("space"), F.round(F.log10(statistics.simple_evalue(F.col("bits"), space.cast("double"))), 6).alias("log10_evalue"))


def evalue_strings(spark, d):
    """How reports print e-values of all sizes."""
    e = F.col("length") * F.lit(1.0371) * F.pow(F.lit(10.0), -(F.col("seq_id") * 7 % 190 - 3))
    return _items(spark, d).select("seq_id", statistics.evalue_string(e).alias("text"))


QUERIES = [alphabet_class, decode_roundtrip, reverse_complements, db_stats, length_histogram, systematic_sample, length_select, sort_by_length, composition, fasta_text, word_codes, postings_stats, neighbor_words, seed_hits, seed_diagonals, two_hit_pairs, one_hit_runs, two_hit_top, hsp_purge, bit_scores, hsp_evalues, query_karlin, low_complexity, dust_regions, smith_waterman, spex_words, shared_word_pairs, winnow_fingerprints, nr_representatives, search_parts, search_documents, smith_waterman_documents, nucleotide_packing, nucleotide_scores, search_counters, unmatched_documents, grouped_lengths, descriptions, strided_index, stored_index_seeds, stored_collection, block_statistics, block_assignment, visible_hsps, listed_pairs, summary_lines, score_conversions, evalue_strings]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _clean(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '[^A-Za-z]', '', 'g')"


DOCS = f"docs AS (SELECT doc_id AS seq_id, {_clean('text')} AS residues, length({_clean('text')})::BIGINT AS length FROM documents)"
ITEMS = f"items AS (SELECT item_id AS seq_id, {_clean('text')} AS residues, length({_clean('text')})::BIGINT AS length FROM benchmark)"
CODE = f"CASE WHEN instr('{LETTERS}', c) > 0 THEN instr('{LETTERS}', c) - 1 ELSE 23 END"


def _coded(table: str) -> str:
    return f"coded AS (SELECT seq_id, list_transform(list_filter(string_split(upper(residues), ''), lambda c: c != ''), lambda c: {CODE}) AS c FROM {table}), w AS (SELECT seq_id, i - 1 AS off, (c[i] * 24 + c[i + 1]) * 24 + c[i + 2] AS word FROM (SELECT seq_id, c, unnest(range(1, len(c) - 1)) AS i FROM coded))"


KMERS = f"""qk AS (SELECT seq_id AS query_id, length AS q_len, i - 1 AS q_off, substr(upper(residues), i, {W}) AS word FROM (SELECT *, unnest(range(1, length - {W - 2})) AS i FROM items)),
sk AS (SELECT seq_id, i - 1 AS s_off, substr(upper(residues), i, {W}) AS word FROM (SELECT *, unnest(range(1, length - {W - 2})) AS i FROM docs)),
seeds AS (SELECT query_id, q_off::INT AS q_off, seq_id, s_off::INT AS s_off, (s_off - q_off + q_len - {W - 1})::BIGINT AS diag FROM sk JOIN qk USING (word))"""
SEEDS = f"WITH {DOCS}, {ITEMS}, {KMERS}"
HITS = f"""diags AS (SELECT query_id, seq_id, diag, list_sort(list(q_off)) AS p FROM seeds GROUP BY ALL),
folded AS (SELECT query_id, seq_id, diag, unnest(list_reduce(list_prepend({{'last': -1, 'out': []::STRUCT(q_off INT, distance INT)[]}}, list_transform(p, lambda x: {{'last': x, 'out': []::STRUCT(q_off INT, distance INT)[]}})), lambda a, b:
  {{'last': CASE WHEN a.last < 0 OR b.last - a.last >= {OVERLAP} THEN b.last ELSE a.last END,
   'out': CASE WHEN a.last >= 0 AND b.last - a.last >= {OVERLAP} AND b.last - a.last < {WINDOW} THEN list_append(a.out, {{'q_off': b.last::INT, 'distance': (b.last - a.last)::INT}}) ELSE a.out END}}).out) AS h FROM diags),
hits AS (SELECT query_id, seq_id, diag, h.q_off AS q_off, h.distance AS distance FROM folded)"""
RUNS = f"""marked AS (SELECT *, CASE WHEN q_off - lag(q_off) OVER d <= {W} THEN 0 ELSE 1 END AS new FROM seeds WINDOW d AS (PARTITION BY query_id, seq_id, diag ORDER BY q_off)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY query_id, seq_id, diag ORDER BY q_off) AS run FROM marked),
runs AS (SELECT query_id, seq_id, diag, min(q_off) AS q_start, max(q_off) + {W} AS q_end, min(s_off) AS s_start FROM numbered GROUP BY query_id, seq_id, diag, run)"""
PURGED = """hsps AS (SELECT query_id, seq_id, q_start, q_end, s_start, s_start + q_end - q_start AS s_end, q_end - q_start AS score FROM runs),
one AS (SELECT * FROM hsps QUALIFY row_number() OVER (PARTITION BY query_id, seq_id, q_start, s_start ORDER BY score DESC, q_end DESC, s_end DESC) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id, seq_id, q_end, s_end ORDER BY score DESC, q_start DESC, s_start DESC) = 1)"""


IUPAC = f"iu(letter, bases) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in nucleotides.IUPAC.items())})"
#: Order in which hits of a pair are listed, and what makes one hidden beside the one before.
LIST_ORDER = "PARTITION BY query_id, seq_id ORDER BY score DESC, s_start, s_end DESC, q_start"
BLOCKS = """sorted AS (SELECT seq_id, length, row_number() OVER (ORDER BY length, seq_id) - 1 AS rank FROM docs),
walk AS (SELECT list_reduce(list_prepend({'b': 0::BIGINT, 'n': 0::BIGINT, 'l': 0::BIGINT, 'out': []::BIGINT[]}, (SELECT list({'b': 0::BIGINT, 'n': 0::BIGINT, 'l': length, 'out': []::BIGINT[]} ORDER BY rank) FROM sorted)),
  lambda a, x: CASE WHEN a.n > 0 AND (a.l + x.l >= 131072 OR a.n >= 65536) THEN {'b': a.b + 1, 'n': 1::BIGINT, 'l': x.l, 'out': list_append(a.out, a.b + 1)} ELSE {'b': a.b, 'n': a.n + 1, 'l': a.l + x.l, 'out': list_append(a.out, a.b)} END).out AS o),
dealt AS (SELECT seq_id, length, rank, o[rank + 1] AS block FROM sorted, walk)"""
BEST = """best AS (SELECT query_id, seq_id, max(score) AS score FROM two GROUP BY ALL),
top AS (SELECT query_id, best.seq_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length, best.seq_id)::INT AS rank FROM best JOIN docs ON docs.seq_id = best.seq_id QUALIFY rank <= 5)"""
BITS = f"((score * {statistics.DEFAULT.lam} + {-statistics.DEFAULT.log_k}) / {statistics.LN2})"


def _printed(e: str) -> str:
    return f"CASE WHEN {e} < 1e-180 THEN '0.0' WHEN {e} < 1e-99 THEN printf('%2.0e', {e}) WHEN {e} < 9e-4 THEN printf('%3.0e', {e}) WHEN {e} < 0.1 THEN printf('%4.3f', {e}) WHEN {e} < 1 THEN printf('%3.2f', {e}) WHEN {e} < 10 THEN printf('%2.1f', {e}) ELSE printf('%5.0f', {e}) END"


def _padded(x: str) -> str:
    return f"CASE WHEN length({x}) > 66 THEN concat(substr({x}, 1, 63), '...') ELSE rpad({x}, 66, ' ') END"


def oracle_sql() -> dict[str, str]:
    up = "upper(residues)"
    same = "((q_start = b.q_start AND s_start = b.s_start) OR (q_end = b.q_end AND s_end = b.s_end) OR (abs(q_start - b.q_start) <= 3 AND abs(q_end - b.q_end) <= 3 AND abs(s_start - b.s_start) <= 3 AND abs(s_end - b.s_end) <= 3))"
    usual = sorted("LAGSVETKDPIRNQFYMHCW")
    m = matrices.load()
    values = ", ".join(f"({a}, {b}, {int(m[a, b])})" for a in range(24) for b in range(24))
    return {
        "alphabet_class": f"WITH {DOCS} SELECT seq_id, length, CASE WHEN length > 0 AND length(regexp_replace({up}, '[^{alphabet.BASES}]', '', 'g')) = length AND length(regexp_replace({up}, '[^ACGTN]', '', 'g')) * 10 >= length * 9 THEN 'nucleotide' ELSE 'protein' END AS alphabet FROM docs",
        "decode_roundtrip": f"WITH {ITEMS} SELECT seq_id, array_to_string(list_transform(list_filter(string_split({up}, ''), lambda c: c != ''), lambda c: CASE WHEN instr('{LETTERS}', c) > 0 THEN c ELSE 'U' END), '') AS decoded FROM items",
        "reverse_complements": f"WITH {ITEMS} SELECT seq_id, translate(reverse({up}), '{alphabet.BASES}', '{alphabet.COMPLEMENTS}') AS complement FROM items",
        "db_stats": f"WITH {DOCS} SELECT count(*) AS n_sequences, sum(length)::BIGINT AS n_letters, min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS mean_length, median(length) AS median_length FROM docs",
        "length_histogram": f"WITH {DOCS} SELECT least(length // 100, 20)::INT AS bin, count(*) AS n_sequences FROM docs GROUP BY 1",
        "systematic_sample": f"WITH {DOCS}, r AS (SELECT seq_id, length, row_number() OVER (ORDER BY seq_id) - 1 AS rn FROM docs) SELECT * FROM r WHERE rn % greatest(1, (SELECT count(*) FROM docs) // 100) = 0",
        "length_select": f"WITH {DOCS} SELECT seq_id, length FROM docs WHERE length >= 500 ORDER BY seq_id LIMIT 50",
        "sort_by_length": f"WITH {DOCS} SELECT seq_id, length, row_number() OVER (ORDER BY length, seq_id) - 1 AS rank FROM docs",
        "composition": f"WITH {DOCS} SELECT seq_id, " + ", ".join(f"(length - length(replace({up}, '{c}', '')))::BIGINT AS n_{c.lower()}" for c in usual) + ", (" + " + ".join(f"length - length(replace({up}, '{c}', ''))" for c in usual) + ")::BIGINT AS n_usual FROM docs",
        "fasta_text": f"WITH {DOCS} SELECT concat('>doc ', seq_id, chr(10), residues) AS value FROM docs",
        "word_codes": f"WITH {ITEMS}, {_coded('items')} SELECT seq_id, off::INT AS off, word::BIGINT AS word FROM w",
        "postings_stats": f"WITH {DOCS}, {_coded('docs')} SELECT word::BIGINT AS word, count(*) AS n_places, count(DISTINCT seq_id) AS n_sequences FROM w GROUP BY 1",
        "neighbor_words": f"WITH m(a, b, s) AS (VALUES {values}), p AS (SELECT x.a * 576 + y.a * 24 + z.a AS word, x.b * 576 + y.b * 24 + z.b AS nbr, x.s + y.s + z.s AS score FROM m x, m y, m z) SELECT word::BIGINT AS word, nbr::BIGINT AS nbr, score::INT AS score FROM p WHERE score >= 11 OR word = nbr",
        "seed_hits": f"{SEEDS} SELECT * FROM seeds",
        "seed_diagonals": f"{SEEDS} SELECT query_id, seq_id, diag, count(*) AS n_seeds, min(q_off) AS first_off, max(q_off) AS last_off FROM seeds GROUP BY ALL",
        "two_hit_pairs": f"{SEEDS}, {HITS} SELECT * FROM hits",
        "one_hit_runs": f"{SEEDS}, {RUNS} SELECT * FROM runs",
        "two_hit_top": f"{SEEDS}, {HITS} SELECT query_id, seq_id, count(*) AS n_triggers, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, seq_id)::INT AS rank FROM hits GROUP BY query_id, seq_id QUALIFY rank <= 10",
        "hsp_purge": f"{SEEDS}, {RUNS}, {PURGED} SELECT * FROM two",
        "bit_scores": f"{SEEDS}, {RUNS}, {PURGED} SELECT DISTINCT score, round((score * {statistics.DEFAULT.lam} + {-statistics.DEFAULT.log_k}) / {statistics.LN2}, 6) AS bits FROM two",
        "spex_words": f"WITH {DOCS}, k AS (SELECT substr({up}, i, 30) AS word FROM (SELECT residues, unnest(range(1, length - 28)) AS i FROM docs)), c AS (SELECT word, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2) SELECT n, count(*) AS n_words FROM c GROUP BY 1",
        "winnow_fingerprints": f"WITH {ITEMS}, k AS (SELECT seq_id, i - 1 AS off, ('0x' || substr(md5(substr({up}, i, 12)), 1, 15))::BIGINT AS h FROM (SELECT *, unnest(range(1, length - 10)) AS i FROM items)), m AS (SELECT seq_id, count(*) OVER w AS n, min({{'h': h, 'o': -off}}) OVER w AS m FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY off ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT DISTINCT seq_id, (-m.o)::INT AS off, m.h AS h FROM m WHERE n = 8",
        "nucleotide_packing": f"""WITH {ITEMS}, {IUPAC}, n AS (SELECT seq_id, regexp_replace({up}, '[^{''.join(nucleotides.IUPAC)}]', '', 'g') AS letters FROM items),
l AS (SELECT seq_id, pos, letters[pos] AS letter FROM (SELECT *, unnest(range(1, length(letters) + 1)) AS pos FROM n)),
r AS (SELECT seq_id, pos, letter, CASE WHEN length(bases) = 1 THEN bases ELSE bases[(row_number() OVER (PARTITION BY seq_id, letter ORDER BY pos)) % length(bases) + 1] END AS base FROM l JOIN iu USING (letter)),
b AS (SELECT seq_id, string_agg(base, '' ORDER BY pos) AS bases, count(*) FILTER (letter NOT IN ('A', 'C', 'G', 'T'))::INT AS n_edits FROM r GROUP BY 1),
p AS (SELECT seq_id, list_transform(range(0, ceil(length(bases) / 4)::BIGINT), lambda i: list_transform(string_split(rpad(substr(bases, i * 4 + 1, 4), 4, 'A'), ''), lambda c: instr('ACGT', c) - 1)) AS g FROM b)
SELECT n.seq_id, coalesce(bases, '') AS bases, coalesce(n_edits, 0) AS n_edits, coalesce(array_to_string(list_transform(g, lambda x: printf('%02x', x[1] * 64 + x[2] * 16 + x[3] * 4 + x[4])), ''), '') AS packed, letters AS restored FROM n LEFT JOIN b USING (seq_id) LEFT JOIN p USING (seq_id)""",
        "nucleotide_scores": f"WITH {IUPAC}, c AS (SELECT x.letter AS a, y.letter AS b, len(list_intersect(string_split(x.bases, ''), string_split(y.bases, ''))) AS k, length(x.bases) * length(y.bases) AS n FROM iu x, iu y) SELECT a, b, ceil((5 * k - 4 * (n - k)) / n)::INT AS score FROM c",
        "search_counters": f"{SEEDS}, {HITS}, g AS (SELECT query_id, count(*) AS n_hits, count(DISTINCT (seq_id, diag)) AS n_diagonals FROM seeds GROUP BY 1), t AS (SELECT query_id, count(*) AS n_triggers, count(DISTINCT seq_id) AS n_pairs FROM hits GROUP BY 1) SELECT query_id, n_hits, n_diagonals, coalesce(n_triggers, 0)::BIGINT AS n_triggers, coalesce(n_pairs, 0)::BIGINT AS n_pairs FROM g LEFT JOIN t USING (query_id)",
        "unmatched_documents": f"{SEEDS}, {HITS} SELECT seq_id, length FROM docs WHERE seq_id NOT IN (SELECT seq_id FROM hits)",
        "grouped_lengths": f"WITH {DOCS} SELECT seq_id, CASE WHEN length >= 10000 THEN format('{{:,}}', length) ELSE length::VARCHAR END AS letters FROM docs",
        "descriptions": f"WITH t AS (SELECT item_id AS seq_id, concat('<', coalesce(text, ''), '>') AS x FROM benchmark) SELECT seq_id, split_part(x, ' ', 1) AS name, {_padded('x')} AS shown, replace(replace(split_part(x, ' ', 1), '<', '&lt;'), '>', '&gt;') AS escaped FROM t",
        "strided_index": f"WITH {DOCS}, k AS (SELECT seq_id, substr({up}, i + 1, {LONG_WORD}) AS word FROM (SELECT *, unnest(range(0, length - {LONG_WORD - 1}, {STRIDE})) AS i FROM docs)) SELECT word, count(*) AS n_places, count(DISTINCT seq_id) AS n_sequences FROM k GROUP BY 1 HAVING count(DISTINCT seq_id) > 1",
        "stored_index_seeds": f"{SEEDS} SELECT query_id, seq_id, count(*) AS n_seeds FROM seeds GROUP BY ALL",
        "stored_collection": f"WITH {DOCS} SELECT seq_id, length, CASE WHEN length > 0 AND length(regexp_replace({up}, '[^{alphabet.BASES}]', '', 'g')) = length AND length(regexp_replace({up}, '[^ACGTN]', '', 'g')) * 10 >= length * 9 THEN 'nucleotide' ELSE 'protein' END AS alphabet, md5(regexp_replace({up}, '[^{LETTERS}]', 'U', 'g')) AS decoded_md5 FROM docs",
        "block_statistics": f"WITH {DOCS}, {BLOCKS} SELECT block, min(rank) AS first_rank, count(*) AS n_sequences, sum(length)::BIGINT AS n_letters, max(length) AS longest, sum(greatest(length - 2, 0))::BIGINT AS n_words FROM dealt GROUP BY 1",
        "block_assignment": f"WITH {DOCS}, {BLOCKS} SELECT seq_id, length, rank, block FROM dealt",
        "visible_hsps": f"{SEEDS}, {RUNS}, {PURGED}, p AS (SELECT *, lag({{'q_start': q_start, 'q_end': q_end, 's_start': s_start, 's_end': s_end}}) OVER ({LIST_ORDER}) AS b FROM two) SELECT query_id, seq_id, q_start, q_end, s_start, s_end, score FROM p WHERE b IS NULL OR NOT {same}",
        "listed_pairs": f"{SEEDS}, {RUNS}, {PURGED}, {BEST} SELECT query_id, seq_id, score, rank, rank <= 2 AS detailed FROM top",
        "summary_lines": f"{SEEDS}, {RUNS}, {PURGED}, {BEST}, v AS (SELECT query_id, seq_id, {BITS} AS bits, {SPACE} / pow(2, {BITS}) AS e, concat('document ', seq_id) AS x FROM top) SELECT query_id, seq_id, concat('  ', {_padded('x')}, '  ', CASE WHEN bits >= 100 THEN floor(bits)::BIGINT::VARCHAR ELSE printf('%.1f', bits) END, '  ', {_printed('e')}) AS line FROM v",
        "score_conversions": f"{SEEDS}, {RUNS}, {PURGED}, s AS (SELECT DISTINCT score FROM two), t AS (SELECT sum(length) AS t, count(*) AS c FROM docs) SELECT score, score::INT AS nominal, ((score - 2) * (t - c * 2))::BIGINT AS space, round(log10(((score - 2) * (t - c * 2))::DOUBLE / pow(2, {BITS})), 6) AS log10_evalue FROM s, t",
        "evalue_strings": f"WITH {ITEMS}, e AS (SELECT seq_id, length * 1.0371::DOUBLE * pow(10.0::DOUBLE, -(seq_id * 7 % 190 - 3)) AS e FROM items) SELECT seq_id, {_printed('e')} AS text FROM e",
        "shared_word_pairs": f"""WITH {DOCS}, k AS (SELECT seq_id, i AS off, substr({up}, i, 30) AS word FROM (SELECT *, unnest(range(1, length - 28)) AS i FROM docs)),
p AS (SELECT x.seq_id AS a, y.seq_id AS b, y.off - x.off AS d, count(*) AS n FROM k x JOIN k y ON x.word = y.word AND x.seq_id < y.seq_id GROUP BY ALL),
o AS (SELECT CASE WHEN lb > la THEN b ELSE a END AS seq1, CASE WHEN lb > la THEN a ELSE b END AS seq2, CASE WHEN lb > la THEN -d ELSE d END AS shift, n FROM p JOIN (SELECT seq_id AS a, length AS la FROM docs) USING (a) JOIN (SELECT seq_id AS b, length AS lb FROM docs) USING (b))
SELECT seq1, seq2, shift::INT AS shift, n FROM o QUALIFY row_number() OVER (PARTITION BY seq1, seq2 ORDER BY n DESC, shift DESC) = 1""",
    }
