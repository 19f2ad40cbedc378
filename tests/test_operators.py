import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqspark.operators import collection, redundancy, repeats, report, search, words
from seqspark.plans import catalogue
from seqspark.sources import fasta

USUAL = "ARNDCQEGHILKMFPSTWYV"


def seqs(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, description string, residues string").withColumn("length", F.length("residues").cast("long"))


def code(w):
    from seqspark.functions import matrices

    return sum(int(v) * 24 ** (2 - i) for i, v in enumerate(matrices.encode(w)))


def test_similar_words(spark):
    n = words.similar_words(spark).groupBy("word").count()
    got = {r["word"]: r["count"] for r in n.collect()}
    assert [got[code(w)] for w in ("LAG", "AAA", "WWW", "MKV", "HHH", "XXX")] == [5, 1, 160, 6, 79, 1]


def test_two_hits(spark):
    rows = [(1, 7, 100, p) for p in (1, 2, 3, 5, 9, 60, 62, 64, 110)]
    t = words.two_hits(spark.createDataFrame(rows, "query_id long, seq_id long, diag long, q_off int"))
    assert sorted((r["q_off"], r["distance"]) for r in t.collect()) == [(5, 4), (9, 4), (64, 4)]


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">a b\nAC-D*\n12 ef\n>c\n\n>\nGG\n")
    assert [(r["description"], r["residues"]) for r in fasta.read(spark, str(p)).orderBy("seq_id").collect()] == [("a b", "ACDef"), ("c", ""), ("", "GG")]
    spark.dataSource.register(fasta.FastaSource)
    assert [tuple(r) for r in spark.read.format("fasta").option("path", str(p)).load().collect()] == [("a b", "ACDef"), ("c", ""), ("", "GG")]


def test_endpoint_purge(spark):
    rows = [(1, 1, 0, 10, 0, 10, 50), (1, 1, 0, 12, 0, 12, 60), (1, 1, 2, 12, 2, 12, 40)]
    df = spark.createDataFrame(rows, "query_id long, seq_id long, q_start int, q_end int, s_start int, s_end int, score int")
    assert [r["score"] for r in report.purge_common_ends(df).collect()] == [60]
    assert [r["score"] for r in report.visible(df).collect()] == [60]


def test_search_finds_mutated_sources(spark):
    random.seed(5)
    subjects = [(i, f"s{i} text", "".join(random.choice(USUAL) for _ in range(random.randint(80, 200)))) for i in range(12)]
    queries = []
    for k in range(2):
        t = list(subjects[k * 5][2])
        for _ in range(len(t) // 8):
            t[random.randrange(len(t))] = random.choice(USUAL)
        queries.append((100 + k, f"q{k} text", "".join(t)))
    q, s = seqs(spark, queries), seqs(spark, subjects)
    found = search.Engine(spark).search(q, s)
    rows = report.tabular(found.where("rank = 1"), q, s).toPandas()
    assert dict(zip(rows["query"], rows["subject"])) == {"q0": "s0", "q1": "s5"} and (rows["percent_identity"] > 75).all()
    top = found.where("rank = 1").first().asDict()
    assert "Identities" in report.pairwise(top, dict((x[0], x[2]) for x in queries)[top["query_id"]], dict((x[0], x[2]) for x in subjects)[top["seq_id"]])
    assert report.xml(rows).count("<Hsp>") == len(rows)


def test_collections(spark):
    s = seqs(spark, [(i, "", "A" * (i % 7)) for i in range(50)])
    assert [r["rank"] for r in collection.by_length(s).orderBy("length", "seq_id").collect()] == list(range(50))
    assert collection.systematic_sample(s, 10).count() == 10
    stats = collection.statistics(s).first()
    assert stats["n_sequences"] == 50 and stats["max_length"] == 6
    empty = collection.statistics(s.limit(0)).first()
    assert empty["n_sequences"] == 0 and empty["n_letters"] is None


def test_representatives(spark):
    random.seed(1)
    a = "".join(random.choice(USUAL) for _ in range(120))
    b = a[:60] + "W" + a[61:110]
    r = redundancy.representatives(seqs(spark, [(1, "", a), (2, "", b), (3, "", a[::-1])])).collect()
    assert {x["seq_id"]: x["cluster_id"] for x in r} == {1: 1, 2: 1, 3: 3}


def brute_pairs(rows, w):
    order = sorted(rows, key=lambda r: (-len(r[2]), r[0]))
    out = {}
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            places = {}
            for i in range(len(a[2]) - w + 1):
                places.setdefault(a[2][i : i + w].upper(), []).append(i)
            count = {}
            for j in range(len(b[2]) - w + 1):
                for i in places.get(b[2][j : j + w].upper(), []):
                    count[j - i] = count.get(j - i, 0) + 1
            if count:
                n, shift = max((n, s) for s, n in count.items())
                out[a[0], b[0]] = (shift, n)
    return out


def mixed(letters=random.Random(3)):
    return lambda n: "".join(letters.choice(USUAL) for _ in range(n))


def test_candidate_pairs_are_whole(spark):
    some = mixed(random.Random(3))
    p, q = some(60), some(60)
    rows = [(1, "", some(80) + p + some(70)), (2, "", some(90) + q + some(75)), (3, "", p + "W" + q), (4, "", p + "Y" + q), (5, "", some(40)), (6, "", "AC" * 40), (7, "", "CA" * 30), (8, "", q[5:50].lower())]
    rows += [(20 + i, "", some(i) + p[10:45] + some(12)) for i in range(9)]
    want = brute_pairs(rows, 30)
    assert (3, 4) in want
    for most in (64, 4, 1):
        got = redundancy.candidate_pairs(seqs(spark, rows), 30, most).collect()
        assert {(r["seq1"], r["seq2"]): (r["shift"], r["n"]) for r in got} == want and len(got) == len(want)


def greedy(rows, identity, w):
    """Longest first; each joins the first representative it is identical enough with."""
    from seqspark.functions import kernels

    text, pairs, out, first = {r[0]: r[2].upper() for r in rows}, brute_pairs(rows, w), {}, []
    for i in sorted(text, key=lambda i: (-len(text[i]), i)):
        same = lambda r: kernels.identity(text[i], text[r], -pairs[r, i][0]) / len(text[i])
        out[i] = next(((r, same(r)) for r in first if (r, i) in pairs and same(r) >= identity), None)
        if out[i] is None:
            out[i] = (i, 1.0)
            first.append(i)
    return out


def chains(rnd):
    """Chains whose members are close to the next one only."""
    some = mixed(rnd)
    rows = []
    for c, n in enumerate((4, 5, 7)):
        t = some(420)
        for k in range(n):
            rows.append((100 * c + 10 + k, "", t))
            at = 35 * k + 3  # 7 % other letters in a place of its own, and two letters less
            t = (t[:at] + some(29) + t[at + 29 :])[:-2]
    return rows


def test_representatives_of_chains(spark):
    rows = chains(random.Random(8))
    want = greedy(rows, 0.9, 30)
    assert want[12][0] == 12 and want[13][0] == 12 and want[11][0] == 10
    got = {r["seq_id"]: (r["cluster_id"], r["identity"]) for r in redundancy.representatives(seqs(spark, rows)).collect()}
    assert got == want


def test_identities(spark):
    from seqspark.functions import kernels

    rnd = random.Random(2)
    some = mixed(rnd)
    a, b, shifts = [], [], []
    for _ in range(60):
        t = some(rnd.randint(1, 300))
        x = list(t[rnd.randint(0, 20) :] or t)
        for _ in range(rnd.randint(0, 1 + len(x) // 4)):
            k = rnd.randint(0, len(x))
            x[k : k + 1] = rnd.choice(["", "A", "WY"])
        a.append("".join(x))
        b.append(t)
        shifts.append(rnd.randint(-30, 30))

    def banded(x, y, s):
        best = {}
        for i in range(1, len(x) + 1):
            for j in range(max(1, i + s - 10), min(len(y), i + s + 10) + 1):
                best[i, j] = max(best.get((i - 1, j - 1), 0) + (x[i - 1] == y[j - 1]), best.get((i - 1, j), 0), best.get((i, j - 1), 0))
        return max(best.values(), default=0)

    want = [banded(x, y, s) for x, y, s in zip(a, b, shifts)]
    data = [x.encode() for x in a], [y.encode() for y in b]
    assert kernels.identities(*data, shifts) == want
    assert kernels.identities(*data, shifts, 0.8) == [n if n / max(1, len(x)) >= 0.8 else 0 for n, x in zip(want, a)]


def test_nr_representatives_query_over_documents(spark, tmp_path):
    from seqspark.plans import catalogue

    some = mixed(random.Random(6))
    t = some(200)
    texts = [t, some(150), t, t[:90] + "w" + t[91:], t.lower(), t[:80], some(20), "", None, t[:60] + some(140)]
    texts += [texts[6], texts[1], f"{t[:100]} 12, {t[100:]}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, "", "".join(c for c in x or "" if c.isalpha())) for i, x in enumerate(texts)]
    want = greedy(rows, 0.9, 30)
    assert [want[i][0] for i in (2, 3, 4, 5, 11, 12)] == [0, 0, 0, 0, 1, 0]
    got = {r["seq_id"]: (r["cluster_id"], r["identity"]) for r in catalogue.queries()["nr_representatives"](spark, str(tmp_path)).collect()}
    assert got == want


def test_search_documents_finds_planted_passages(spark, tmp_path):
    from seqspark.plans import catalogue

    some = mixed(random.Random(9))
    items = {1: some(90), 2: some(120)}
    docs = {i: some(600) for i in range(6)}
    docs[3] = docs[3][:300] + items[1] + docs[3][300:]
    docs[5] = items[2][:60] + "WW" + items[2][62:] + docs[5]
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalogue.queries()["search_documents"](spark, str(tmp_path)).where("rank = 1").collect()
    best = {r["query_id"]: r for r in sorted(rows, key=lambda r: r["score"])}
    assert best[1]["seq_id"] == 3 and best[1]["s_start"] <= 300 and best[1]["s_end"] >= 390 and best[1]["identities"] >= 90
    assert best[2]["seq_id"] == 5 and best[2]["q_start"] == 0 and best[2]["q_end"] == 120 and best[2]["identities"] >= 118


def test_smith_waterman_over_documents(spark, tmp_path):
    from seqspark.plans import catalogue

    some = mixed(random.Random(10))
    item = some(70)
    docs = {i: some(300) for i in range(4)}
    docs[2] = docs[2][:100] + item + docs[2][100:]
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalogue.queries()["smith_waterman_documents"](spark, str(tmp_path)).collect()
    best = max(rows, key=lambda r: r["score"])
    assert len(rows) == 4 and (best["query_id"], best["seq_id"]) == (7, 2)


def test_load_index_search_and_stream(spark, tmp_path):
    from seqspark.streaming import queries as stream

    random.seed(11)
    subjects = [(i, f"s{i}", "".join(random.choice(USUAL) for _ in range(120))) for i in range(6)]
    fa = tmp_path / "db.fa"
    fa.write_text("".join(f">{d}\n{r}\n" for _, d, r in subjects))
    engine = search.Engine(spark)
    loaded = engine.load_fasta(str(fa), str(tmp_path / "db"))
    assert loaded.count() == 6 and {r["description"] for r in loaded.collect()} == {d for _, d, _ in subjects}
    q = seqs(spark, [(50, "q0", subjects[2][2][10:90]), (51, "q1", subjects[4][2])])
    index = engine.build_index(loaded, str(tmp_path / "index"))
    name = {r["seq_id"]: r["description"] for r in loaded.collect()}
    direct = {(r["query_id"], name[r["seq_id"]], r["score"]) for r in engine.search(q, loaded).collect()}
    stored = {(r["query_id"], name[r["seq_id"]], r["score"]) for r in engine.search(q, loaded, index=index).collect()}
    assert direct == stored and {(50, "s2"), (51, "s4")} <= {x[:2] for x in stored}
    q.select("seq_id", "residues", "length").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("seq_id long, residues string, length long").parquet(str(tmp_path / "in"))
    stream.search_stream(engine, arriving, loaded, str(tmp_path / "out"), str(tmp_path / "ck"), index).awaitTermination(180)
    assert {(r["query_id"], name[r["seq_id"]], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == direct


def test_blocks_follow_the_greedy_rule(spark):
    random.seed(3)
    lengths = [random.choice([0, 1, 5, 7, 30, 99, 100, 250]) for _ in range(300)]
    df = spark.createDataFrame([(i, "A" * n) for i, n in enumerate(lengths)], "seq_id long, residues string").withColumn("length", F.length("residues").cast("long"))
    want, at = [], [0, 0]
    for n in sorted(lengths):
        if at[0] and (at[1] + n >= 100 or at[0] >= 20):
            want.append(tuple(at))
            at = [0, 0]
        at = [at[0] + 1, at[1] + n]
    got = collection.blocks(df, 100, 20).orderBy("block").collect()
    assert [(r["n_sequences"], r["n_letters"]) for r in got] == [*want, tuple(at)]
    assert collection.blocks(df.limit(0)).count() == 0


def test_limits_and_printing(spark):
    from seqspark.functions import statistics

    values = [0.0, 1e-200, 3.3e-150, 2.2e-50, 4e-4, 0.0321, 0.456, 5.678, 123.4]
    df = spark.createDataFrame([(v,) for v in values], "e double")
    assert [r[0] for r in df.select(statistics.evalue_string(F.col("e"))).collect()] == [statistics.evalue_text(v) for v in values]
    ranks = spark.createDataFrame([(1, k) for k in range(1, 9)], "query_id long, rank int")
    assert [(r["rank"], r["detailed"]) for r in report.listed(ranks, 2, 4).orderBy("rank").collect()] == [(k, True) for k in range(1, 5)]
    assert report.listed(ranks, 3, 0).where("detailed").count() == 3
    assert [r[0] for r in spark.createDataFrame([(9999,), (10000,), (1234567,)], "n long").select(report.grouped(F.col("n"))).collect()] == ["9999", "10,000", "1,234,567"]
    assert [statistics.bit_score(s) for s in (1600, 1935, 1936)] == [r[0] for r in spark.createDataFrame([(1600,), (1935,), (1936,)], "s long").select(statistics.bits(F.col("s"), 32.0)).collect()]


def test_purged_runs_are_shuffled_once(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and sleeps all day long"
    spark.createDataFrame([(1, text), (2, text[10:50])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalogue.hsp_purge(spark, str(tmp_path))
    assert found.count() >= 2
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(query_id") == 1


def test_repeated_words_are_exact_and_small_to_shuffle(spark):
    random.seed(9)
    base = "".join(random.choice(USUAL) for _ in range(3000))
    texts = [base[i : i + random.randrange(400)] for i in range(0, 3000, 25)] + ["A" * 700, "", "b" * 29, "B" * 30, "AB" * 400, base * 3]
    want = Counter(t.upper()[i : i + 30] for t in texts for i in range(len(t) - 29))
    s = seqs(spark, [(i, "", t) for i, t in enumerate(texts)])
    assert {r["word"]: r["n"] for r in repeats.repeated_words(s).collect()} == {k: n for k, n in want.items() if n > 1}
    assert {r["n"]: r["n_words"] for r in repeats.repeat_counts(s).collect()} == Counter(n for n in want.values() if n > 1)
    # before, each word was a row of 30 letters and more
    sent = repeats._bucketed(s, 30).agg(F.sum(F.length("lengths") + F.length("letters"))).first()[0]
    assert sent < 4 * sum(map(len, texts))
    assert repeats.repeat_counts(s.limit(0)).count() == 0


def test_repeated_words_of_equal_hashes_and_in_passes():
    random.seed(2)
    base = "".join(random.choice("ABC") for _ in range(300))
    texts = [base[random.randrange(200) :][: random.randrange(150)] for _ in range(40)] + ["A" * 500]
    for w in (5, 30):
        want = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
        for options in ({}, {"base": 0}, {"most": 64}, {"base": 2, "most": 64}):
            got, held = Counter(), {}
            for a in repeats.joined(iter(texts), w):
                for b, n, t in repeats.pieces(a, w, 5):
                    held.setdefault(b, []).append((n, t))
            for x in held.values():
                for found, n in repeats.repeated(np.concatenate([t for _, t in x]), np.concatenate([n for n, _ in x]), w, **options):
                    got.update(dict(zip((f.decode() for f in found), n.tolist())))
            assert got == {k: n for k, n in want.items() if n > 1}


def test_search_of_copies_equals_the_search_of_all(spark):
    random.seed(4)
    a = [random.choice(USUAL) for _ in range(60)]
    texts = ["".join(a), "".join(a[:40] + a[:20]), "".join(a[20:] + a[:20]), "".join(random.choice(USUAL) for _ in range(60)), "".join(a[:60])[:58] + "WW", ""]
    ids = random.sample(range(1000), 120)
    subjects = seqs(spark, [(i, "", texts[k % 4 if k < 100 else k % 6]) for k, i in enumerate(ids)])
    queries = seqs(spark, [(1, "", "".join(a)), (2, "", texts[3]), (3, "", "".join(a[:45]))])
    for hits in (500, 8):  # 66 pairs are kept before traceback, then 8
        engine = search.Engine(spark, search.Params(max_hits=hits))
        whole = engine.search(queries, subjects)
        merged = engine.search_merged(queries, subjects)
        assert whole.columns == merged.columns
        want = sorted(map(repr, whole.collect()))
        assert sorted(map(repr, merged.collect())) == want and len(want) >= 3 * min(hits, 20) - 8


def test_search_of_copies_looks_at_each_text_once(spark, monkeypatch):
    seen = []
    before = search.Engine.triggers
    monkeypatch.setattr(search.Engine, "triggers", lambda self, q, s, *a: seen.append(s.count()) or before(self, q, s, *a))
    names = seqs(spark, [(i, "", "hotbolt" if i % 2 else "oldring") for i in range(500)])
    assert search.Engine(spark).search_merged(seqs(spark, [(1, "", "hotboltoldring" * 3)]), names).count() == 0
    assert seen == [2]
