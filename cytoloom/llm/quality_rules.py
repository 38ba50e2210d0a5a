"""Quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences that each language and source sets itself. Every document's rates are counted into
quantile sketches: histograms of integer bins whose width grows with the value (5 significant bits, a relative
error of 1/32), so that sketches of the same metric merge by adding counts. The sketches of a language's sources merge
into the language's, those into the corpus's. A group is judged by its own counts and, whatever its size, by a share of the wider sketch that weighs as `borrowed` documents: a source borrows from its
language, that from the corpus, so that a small group follows the wider one and no document more or less moves its fences at once. A document is kept if it passes the base rules and every rate lies inside its group's fences, quartiles plus or minus
`reach` interquartile ranges (or a metric's least spread, if that is larger). Thresholds come back by a join on language and source.

Nulls: a null text has no words and fails the base rules; a null language or source is a group of its own. Empty and very
long texts, ties and repeated rows need no care: each row is counted and judged alone. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .staging import Staging
from .text import UPPER, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: metric: (numerator, denominator, least spread per thousand, sides that are fenced)
METRICS = {
    "symbols": ("n_symbols", "n_words", 50, "high"),
    "word_length": ("word_chars", "n_words", 350, "both"),
    "dup_lines": ("n_dup_lines", "n_lines", 90, "high"),
    "repeats": ("n_repeat_words", "n_words", 30, "high"),
    "capitals": ("n_upper", "word_chars", 30, "high"),
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """How many words lie in a 5-word window that the text has at least twice."""
    none = F.lit(0).cast("long")

    def marked(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(by_hash, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        new = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(new, none, lambda s, x: s + x)

    def windows_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, windows_of)
    return F.when(F.size(words) > WINDOW, let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), marked(w)).otherwise(none))).otherwise(none)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts that the rules look at."""
    slim = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = slim.select(
        "doc_id", "lang", "source",
        count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_chars(F.col("text"), UPPER).alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again"))).alias("words"),
    )
    return counted.select(
        "doc_id", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"),
        F.col("lines.dup").alias("n_dup_lines"), F.col("words.again").alias("n_repeat_words"), "n_upper",
    )


def per_thousand(metric: str) -> Column:
    a, b = METRICS[metric][:2]
    return F.expr(f"(1000 * {a}) div nullif({b}, 0)")


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: the sketch of each language and source."""
    rates = F.array(*(F.struct(F.lit(m).alias("metric"), per_thousand(m).alias("v")) for m in METRICS))
    each = counts.select("lang", "source", F.inline(rates)).filter("v is not null")
    shift = "greatest(length(bin(v)) - 6, 0)"
    return each.groupBy("lang", "source", "metric", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *group: str) -> DataFrame:
    """group, metric, bin, n, docs: sketches merged to those of `group`, as exact decimals."""
    n = sketch.groupBy(*group, "metric", "bin").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    return n.withColumn("docs", F.sum("n").over(Window.partitionBy(*group, "metric")).cast("decimal(38,0)"))


def borrowing(own: DataFrame, group: list[str], wide: DataFrame, by: list[str], borrowed: int) -> DataFrame:
    """The sketch of each group with `borrowed` documents that are spread as the wider sketch is: own n times the wider docs, plus borrowed times the wider n. Bins are a few hundred a metric."""
    keys = [*by, "metric"]
    w = wide.select(*(F.col(k).alias(f"w_{k}") for k in keys), F.col("bin").alias("w_bin"), F.col("n").alias("w_n"), F.col("docs").alias("w_docs"))
    groups = own.select(*group, "metric", F.col("docs").alias("own_docs")).distinct()
    same = [groups[k].eqNullSafe(w[f"w_{k}"]) for k in keys]
    grid = groups.join(w, same[0] if len(same) == 1 else same[0] & same[1]).select(*group, "metric", F.col("w_bin").alias("bin"), "w_n", "w_docs", "own_docs")
    mine = own.select(*(F.col(k).alias(f"o_{k}") for k in (*group, "metric", "bin")), F.col("n").alias("o_n"))
    on = F.lit(True)
    for k in (*group, "metric", "bin"):
        on = on & grid[k].eqNullSafe(mine[f"o_{k}"])
    exact = lambda c: c.cast("decimal(38,0)")
    n = exact(exact(F.coalesce("o_n", F.lit(0))) * F.col("w_docs")) + exact(F.lit(borrowed) * F.col("w_n"))
    return grid.join(mine, on, "left").select(*group, "metric", "bin", exact(n).alias("n"), exact(exact(F.col("own_docs") + borrowed) * F.col("w_docs")).alias("docs"))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """group, metric and the bins that hold the quartiles."""
    run = sketch.select(*group, "metric", "bin", "docs", F.sum("n").over(Window.partitionBy(*group, "metric").orderBy("bin")).alias("upto"))
    return run.groupBy(*group, "metric").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bin"))).alias("q3")
    )


def thresholds(sketch: DataFrame, borrowed: int, reach: int) -> DataFrame:
    """lang, source, fences: map of metric to (low, high), one row for each language and source."""
    lang = borrowing(merged(sketch, "lang"), ["lang"], merged(sketch), [], borrowed)
    picked = quartiles(borrowing(merged(sketch, "lang", "source"), ["lang", "source"], lang, ["lang"], borrowed), "lang", "source")
    least = F.element_at(F.create_map(*(F.lit(x) for m, v in METRICS.items() for x in (m, v[2]))), F.col("metric"))
    both = F.element_at(F.create_map(*(F.lit(x) for m, v in METRICS.items() for x in (m, v[3] == "both"))), F.col("metric"))
    spread = F.greatest(F.col("q3") - F.col("q1"), least)
    fenced = picked.select("lang", "source", "metric", F.struct(F.when(both, F.col("q1") - reach * spread).alias("low"), (F.col("q3") + reach * spread).alias("high")).alias("fence"))
    return fenced.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "fence"))).alias("fences"))


def judge(docs: DataFrame, borrowed: int = 100, reach: int = 6) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the metrics that a document fails, one row per row of docs."""
    staging = Staging(docs.sparkSession, "quality-rules")
    counts = staging.write(text_counts(docs), "counts")  # one pass over the texts serves sketches and verdicts
    limits = thresholds(sketches(counts), borrowed, reach)
    judged = counts.alias("c").join(limits.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    fails = [F.when((per_thousand(m) > F.col("fences")[m]["high"]) | F.coalesce(per_thousand(m) < F.col("fences")[m]["low"], F.lit(False)), F.lit(m)) for m in METRICS]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.concat_ws(",", *fails).alias("failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rates = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, (1000 * {a}) // nullif({b}, 0) AS v FROM c" for m, (a, b, _, _) in METRICS.items())
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v[2]}" for m, v in METRICS.items()) + " END"
    both = ", ".join(f"'{m}'" for m, v in METRICS.items() if v[3] == "both")
    value = "CASE f.metric " + " ".join(f"WHEN '{m}' THEN (1000 * {a}) // nullif({b}, 0)" for m, (a, b, _, _) in METRICS.items()) + " END"
    order = ", ".join(f"'{m}'" for m in METRICS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k >= 2),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, range(5) r(o) GROUP BY rid),
c AS (SELECT t.rid, doc_id, lang, source, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
  n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words
  FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid)),
rates AS ({rates}),
sketch AS (SELECT lang, source, metric, (v >> s) << s AS bin, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - 6, 0)::BIGINT AS s FROM rates WHERE v IS NOT NULL) GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric)::HUGEINT AS docs FROM (SELECT lang, source, metric, bin, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL)),
l AS (SELECT *, sum(n) OVER (PARTITION BY lang, metric)::HUGEINT AS docs FROM (SELECT lang, metric, bin, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL)),
a AS (SELECT *, sum(n) OVER (PARTITION BY metric)::HUGEINT AS docs FROM (SELECT metric, bin, sum(n)::HUGEINT AS n FROM sketch GROUP BY ALL)),
l2 AS (SELECT g.lang, g.metric, a.bin, coalesce(l.n, 0) * a.docs + 100 * a.n AS n, (g.docs + 100) * a.docs AS docs FROM (SELECT DISTINCT lang, metric, docs FROM l) g JOIN a USING (metric)
  LEFT JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.metric = g.metric AND l.bin = a.bin),
o2 AS (SELECT g.lang, g.source, g.metric, l2.bin, coalesce(o.n, 0) * l2.docs + 100 * l2.n AS n, (g.docs + 100) * l2.docs AS docs FROM (SELECT DISTINCT lang, source, metric, docs FROM o) g
  JOIN l2 ON l2.lang IS NOT DISTINCT FROM g.lang AND l2.metric = g.metric
  LEFT JOIN o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.metric = g.metric AND o.bin = l2.bin),
picked AS (SELECT lang, source, metric, min(bin) FILTER (upto * 4 >= docs) AS q1, min(bin) FILTER (upto * 4 >= docs * 3) AS q3, any_value({least}) AS least
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto FROM o2) GROUP BY lang, source, metric),
fence AS (SELECT *, CASE WHEN metric IN ({both}) THEN q1 - 6 * greatest(q3 - q1, least) END AS low, q3 + 6 * greatest(q3 - q1, least) AS high FROM picked),
fails AS (SELECT rid, string_agg(metric, ',' ORDER BY list_position([{order}], metric)) AS failed
  FROM (SELECT c.rid, f.metric, {value} AS v, f.low, f.high FROM c JOIN fence f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source)
  WHERE v > high OR v < low GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(failed, '') AS failed, NOT base_failed AND failed IS NULL AS kept
FROM c LEFT JOIN fails USING (rid)"""


SQL = _sql()
