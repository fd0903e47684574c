"""Host-level quality rules, in DataFrame functions only.

Each document is measured and held against a few rules. The share of documents that fail a rule is
summed by host (``source``) and shrunk towards the rate over all hosts by a beta prior fitted to the
hosts' own rates by the method of moments. A host whose shrunk rate is over ``host_limit`` is
distrusted, and any document of it that fails a rule is rejected; elsewhere it takes ``strikes``
failed rules. A document that fails no rule is always kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
HOST_LIMIT, STRIKES = 0.5, 2
FEW_HOSTS, SALTS = 100_000, 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    """Array of the runs of characters other than blank, tab, line ends and form feed."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _repeat_words(words: str) -> Column:
    """Words inside windows that are found twice or more; windows are compared by a 64-bit hash.

    The windows' (hash, start) pairs are sorted, those with an equal neighbour keep their starts, and
    each start adds the words up to the next one, a whole window at most.
    """
    return F.expr(f"""
      CASE WHEN size({words}) < {WINDOW} + 1 THEN 0L ELSE
        aggregate(
          array(transform({words}, w -> xxhash64(w))),
          0L,
          (none, h) -> none + aggregate(
            array(array_sort(transform(sequence(1, size(h) - {WINDOW - 1}), i -> struct(xxhash64(slice(h, i, {WINDOW})) AS k, i AS i)))),
            0L,
            (nil, s) -> nil + aggregate(
              array(array_sort(array_compact(
                zip_with(s, zip_with(slice(concat(array(struct(CAST(NULL AS BIGINT) AS k, 0 AS i)), s), 1, size(s)),
                                     concat(slice(s, 2, size(s)), array(struct(CAST(NULL AS BIGINT) AS k, 0 AS i))), (p, n) -> struct(p.k AS p, n.k AS n)),
                         (e, around) -> CASE WHEN e.k = around.p OR e.k = around.n THEN e.i END)))),
              0L,
              (zero, d) -> zero + CASE WHEN size(d) = 0 THEN 0L ELSE
                {WINDOW}L + aggregate(zip_with(slice(d, 1, size(d) - 1), slice(d, 2, size(d)), (a, b) -> least({WINDOW}, b - a)), 0L, (t, x) -> t + x) END)))
      END""")


def measures(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words. n_dup_lines counts lines with a word that equal an earlier line.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    out = documents.withColumn("_words", _words(text)).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words("_words"),
    })
    out = out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))
    return out.drop("_words", "_lines")


#: Softer rules of the method, all over whole numbers. Each is true for a failing document.
RULES = {
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "heavy_symbols": "4 * n_symbols > n_words",
    "repeats": "100 * n_repeat_words > 15 * n_words",
    "dup_lines": "5 * n_dup_lines > n_words",
    "base": "base_failed",
}


def n_failed() -> Column:
    return F.expr(" + ".join(f"CAST({rule} AS INT)" for rule in RULES.values()))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, n_fails, rate: each host's share of failing documents after shrinking.

    The prior's mean is the rate over all documents; its strength comes from the spread of the
    hosts' rates beyond what their sizes explain, weighted by size. Counts are summed before the
    shuffle, so a host with very many rows costs nothing extra. A null host is a host of its own.
    """
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum((n_failed() > 0).cast("long")).alias("f"))
    total = by.agg(F.sum("n").alias("n_all"), F.sum("f").alias("f_all"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("n_squares"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("f_squares"))
    total = total.selectExpr("n_all", "hosts", "n_squares", "f_all / n_all AS m", "f_squares - f_all * f_all / n_all AS between_hosts")
    total = total.selectExpr("m", "(between_hosts - (hosts - 1) * m * (1 - m)) / nullif(n_all - n_squares / n_all - (hosts - 1), 0) AS v")
    total = total.selectExpr("m", "CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1e-3) WHEN m > 0 AND m < 1 THEN 1e6 ELSE 1.0 END AS strength")
    # total is one row
    return by.join(F.broadcast(total)).selectExpr("host", "n AS n_docs", "f AS n_fails", "(f + strength * m) / (n + strength) AS rate")


def judge(measured: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT, strikes: int = STRIKES, few_hosts: int = FEW_HOSTS) -> DataFrame:
    """``measured`` with ``kept``; ``measured`` is read twice, so hand in a written table.

    Distrusted hosts are broadcast if there are at most ``few_hosts``; more of them are joined with salts,
    so a host with very many rows is spread over ``SALTS`` tasks.
    """
    bad = materialize(host_rates(measured, host).filter(F.col("rate") > host_limit).select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "hosts")
    same = F.col(host).eqNullSafe(F.col("_host"))
    if bad.count() <= few_hosts:
        joined = measured.join(F.broadcast(bad), same, "left")
    else:
        salted = bad.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_there"))
        joined = measured.withColumn("_here", F.pmod(F.xxhash64(*MEASURES), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_here") == F.col("_there")), "left").drop("_here", "_there")
    kept = ~F.col("base_failed") & (n_failed() < F.when(F.col("_bad"), 1).otherwise(strikes))
    return joined.withColumn("kept", kept).drop("_host", "_bad")


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null text: no words, so it fails. Null source: a host of its own. An empty table gives no rows.
    The texts are read once; the second look goes to a written table of the measures.
    """
    narrow = documents.selectExpr("CAST(doc_id AS BIGINT) doc_id", "source", "text")
    measured = materialize(measures(narrow).drop("text"), "quality")
    return judge(measured).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that :func:`judge` keeps, with their own columns.

    The measured rows are written once with their texts and read for the hosts' counts (two narrow
    columns) and for the verdicts.
    """
    measured = materialize(measures(documents.select(F.struct("*").alias("_row"), "text", "source")).drop("text"), "quality")
    return judge(measured).filter("kept").select("_row.*")
