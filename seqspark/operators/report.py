"""Reports of alignments: tabular rows, aligned lines, pairwise text, XML; hiding of near-equal alignments."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices, statistics

TABULAR = ["query", "subject", "percent_identity", "length", "mismatches", "gap_opens", "q_start", "q_end", "s_start", "s_end", "evalue", "bits"]


def first_word(description: Column) -> Column:
    return F.substring_index(description, " ", 1)


def padded(description: Column, width: int = 66) -> Column:
    """Cut with three dots or padded with blanks to a width."""
    return F.when(F.length(description) > width, F.concat(F.substring(description, 1, width - 3), F.lit("..."))).otherwise(F.rpad(description, width, " "))


def grouped(n: Column) -> Column:
    """A count with commas between thousands, from 10,000 on."""
    return F.when(n >= 10_000, F.format_number(n, 0)).otherwise(n.cast("string"))


def escaped(text: Column) -> Column:
    """< and > for XML."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def summary_line(description: Column, bits: Column, evalue: Column) -> Column:
    """One line of a hit list: description, bits (whole from 100 on), e-value."""
    shown = F.when(bits >= 100, F.floor(bits).cast("string")).otherwise(F.format_string("%.1f", bits))
    return F.concat(F.lit("  "), padded(description), F.lit("  "), shown, F.lit("  "), statistics.evalue_string(evalue))


def listed(pairs: DataFrame, lines: int = 500, details: int = 250) -> DataFrame:
    """Ranked pairs (query_id, rank) that a report names, and whether it shows their alignments; details = 0 shows all, lines are at least details."""
    most = max(lines, details)
    return pairs.where(F.col("rank") <= most).withColumn("detailed", F.lit(True) if details == 0 else F.col("rank") <= details)


def visible(alignments: DataFrame, near: int = 3) -> DataFrame:
    """Hides an alignment whose start or end equals, or both nearly equal, those of the one listed before it."""
    w = Window.partitionBy("query_id", "seq_id").orderBy(F.desc("score"), "s_start", F.desc("s_end"), "q_start")
    ends = ["q_start", "q_end", "s_start", "s_end"]
    df = alignments.withColumn("__b", F.lag(F.struct(*ends)).over(w))
    b = {c: F.col(f"__b.{c}") for c in ends}
    same = ((F.col("q_start") == b["q_start"]) & (F.col("s_start") == b["s_start"])) | ((F.col("q_end") == b["q_end"]) & (F.col("s_end") == b["s_end"]))
    close = F.lit(True)
    for c in ends:
        close = close & (F.abs(F.col(c) - b[c]) <= near)
    return df.where(~F.coalesce(same | close, F.lit(False))).drop("__b")


def purge_common_ends(hsps: DataFrame) -> DataFrame:
    """Per pair, of alignments with the same start, then with the same end, the best."""
    a = Window.partitionBy("query_id", "seq_id", "q_start", "s_start").orderBy(F.desc("score"), F.desc("q_end"), F.desc("s_end"))
    b = Window.partitionBy("query_id", "seq_id", "q_end", "s_end").orderBy(F.desc("score"), F.desc("q_start"), F.desc("s_start"))
    return hsps.withColumn("__r", F.row_number().over(a)).where("__r = 1").withColumn("__r", F.row_number().over(b)).where("__r = 1").drop("__r")


def tabular(alignments: DataFrame, queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """The twelve usual columns; positions from 1, ends inclusive."""
    q = queries.select(F.col("seq_id").alias("query_id"), first_word(F.col("description")).alias("query"))
    s = subjects.select("seq_id", first_word(F.col("description")).alias("subject"))
    df = alignments.join(q, "query_id").join(s, "seq_id")
    pid = F.round(F.col("identities") * 100 / F.col("length"), 2)
    return df.select("query", "subject", pid.alias("percent_identity"), "length", (F.col("length") - F.col("identities") - F.col("gaps")).alias("mismatches"), "gap_opens", (F.col("q_start") + 1).alias("q_start"), "q_end", (F.col("s_start") + 1).alias("s_start"), "s_end", statistics.evalue_string(F.col("evalue")).alias("evalue"), F.round("bits", 1).alias("bits"))


def write_tabular(rows: DataFrame, path: str) -> None:
    rows.select(*TABULAR).write.option("sep", "\t").csv(path)


def aligned(q: str, s: str, q0: int, s0: int, edits: str, m=None) -> tuple[str, str, str]:
    """Query, middle and subject lines: a letter where equal, + where positive."""
    m = matrices.load() if m is None else m
    a, mid, b = [], [], []
    for e in edits:
        x, y = "-" if e == "I" else q[q0], "-" if e == "D" else s[s0]
        if e == "M":
            i, j = matrices.encode(x + y)
            mid.append(x if x.upper() == y.upper() else "+" if m[i, j] > 0 else " ")
        else:
            mid.append(" ")
        a.append(x)
        b.append(y)
        q0, s0 = q0 + (e != "I"), s0 + (e != "D")
    return "".join(a), "".join(mid), "".join(b)


def pairwise(row: dict, q: str, s: str, width: int = 60) -> str:
    """One alignment as a block of text."""
    a, mid, b = aligned(q, s, row["q_start"], row["s_start"], row["edits"])
    n = row["length"]
    share = lambda k: f"{k}/{n} ({round(100 * k / n)}%)"
    out = [f" Score = {row['bits']:.1f} bits ({round(row['score'] / 32)}), Expect = {statistics.evalue_text(row['evalue']).strip()}, Method: {row['rule']}", f" Identities = {share(row['identities'])}, Positives = {share(row['positives'])}, Gaps = {share(row['gaps'])}", ""]
    i, j = row["q_start"], row["s_start"]
    for k in range(0, n, width):
        x, y, z = a[k : k + width], mid[k : k + width], b[k : k + width]
        ni, nj = i + len(x) - x.count("-"), j + len(z) - z.count("-")
        out += [f"Query: {i + 1:<5} {x} {ni}", f"             {y}", f"Sbjct: {j + 1:<5} {z} {nj}", ""]
        i, j = ni, nj
    return "\n".join(out)


def xml(rows: pd.DataFrame, program: str = "seqspark") -> str:
    """A document of the rows of one report (tabular columns)."""
    out = ['<?xml version="1.0"?>', f"<BlastOutput><BlastOutput_program>{escape(program)}</BlastOutput_program><BlastOutput_iterations>"]
    for query, own in rows.groupby("query", sort=True):
        out.append(f"<Iteration><Iteration_query-def>{escape(query)}</Iteration_query-def><Iteration_hits>")
        for k, (subject, hsps) in enumerate(own.groupby("subject", sort=False), 1):
            out.append(f"<Hit><Hit_num>{k}</Hit_num><Hit_def>{escape(subject)}</Hit_def><Hit_hsps>")
            for h in hsps.to_dict("records"):
                fields = {"bit-score": h["bits"], "evalue": str(h["evalue"]).strip(), "query-from": h["q_start"], "query-to": h["q_end"], "hit-from": h["s_start"], "hit-to": h["s_end"], "align-len": h["length"]}
                out.append("<Hsp>" + "".join(f"<Hsp_{n}>{v}</Hsp_{n}>" for n, v in fields.items()) + "</Hsp>")
            out.append("</Hit_hsps></Hit>")
        out.append("</Iteration_hits></Iteration>")
    return "\n".join([*out, "</BlastOutput_iterations></BlastOutput>"])
