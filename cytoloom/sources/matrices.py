"""Text matrices: sparse triplets, wide reports, series headers, feature lists, gene vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ANNOTATIONS = 12


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """file, gene_row, barcode, value of 1-based triplets; comment lines and each file's line of sizes are skipped, repeated coordinates add up.

    gz files are read whole by one task each, so the lines are dealt out right after.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("line"))
    data = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # by the block's place in the file first: numbers of lines follow the tasks, and a task may read blocks in any order
    first = data.groupBy("file").agg(F.min_by("line", F.struct("at", "line")).alias("line"))
    body = data.join(F.broadcast(first), ["file", "line"], "left_anti")
    p = F.split(F.trim("value"), r"\s+")
    typed = body.select("file", p[0].cast("int").alias("gene_row"), p[1].cast("int").alias("barcode"), p[2].cast("double").alias("value"))
    return typed.groupBy("file", "gene_row", "barcode").agg(F.sum("value").alias("value"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """gene_row (1-based, in file order), symbol: the second column, or the first if it is alone."""
    # a features file has some ten thousand lines and fits one task; its order is its meaning
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"(\r?\n)+$", ""), r"\r?\n")).alias("i", "line"))
    p = F.split("line", "\t")
    return rows.select((F.col("i") + 1).alias("gene_row"), F.coalesce(F.get(p, 1), F.get(p, 0)).alias("symbol"))


def read_wide_log2(spark: SparkSession, path: str, symbol: str = "symbol") -> DataFrame:
    """gene, sample, value of a report with annotation columns first and log2 columns after; values are 2^x - 1, at least 0.

    Of rows with one symbol the one with the largest total is kept.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    samples = wide.columns[ANNOTATIONS:]
    numbered = wide.withColumn("__row", F.monotonically_increasing_id())
    long = numbered.unpivot(["__row", symbol], samples, "sample", "x").select("__row", F.col(symbol).alias("gene"), "sample", F.greatest(F.pow(F.lit(2.0), F.col("x").cast("double")) - 1, F.lit(0.0)).alias("value"))
    totals = long.groupBy("gene", "__row").agg(F.sum("value").alias("total"))
    best = totals.withColumn("r", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("total"), "__row"))).filter("r = 1").select("gene", "__row")
    return long.join(best, ["gene", "__row"], "left_semi").select("gene", "sample", "value")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """sample, title, donor (the title's first part) and a map of characteristics of a series header; the first row of a key wins."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(F.col("value").startswith("!Sample_title") | F.col("value").startswith("!Sample_characteristics_ch1"))
    cells = lines.select("line", F.col("value").startswith("!Sample_title").alias("is_title"), F.posexplode(F.split("value", "\t")).alias("sample", "v")).filter("sample > 0")
    cells = cells.withColumn("v", F.trim(F.regexp_replace("v", '^"|"$', "")))
    titles = cells.filter("is_title").groupBy("sample").agg(F.min_by("v", "line").alias("title"))
    kv = cells.filter("NOT is_title AND v LIKE '%:%'").select("sample", "line", F.trim(F.substring_index("v", ":", 1)).alias("k"), F.trim(F.expr("substr(v, instr(v, ':') + 1)")).alias("val"))
    firsts = kv.groupBy("sample", "k").agg(F.min_by("val", "line").alias("val")).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("k", "val"))).alias("characteristics"))
    return titles.join(firsts, "sample", "left").withColumn("donor", F.substring_index("title", "_", 1))


def read_age_matrix(counts: DataFrame, meta: DataFrame, genes_axis: str, key: str = "sample") -> DataFrame:
    """sample, gene, value, age of a wide matrix with genes in rows ("rows", first column the gene) or in columns; a sample without age is an error."""
    first, rest = counts.columns[0], counts.columns[1:]
    names = ["gene", "sample"] if genes_axis == "rows" else ["sample", "gene"]
    long = counts.unpivot([first], rest, names[1], "value").withColumnRenamed(first, names[0])
    joined = long.join(meta.select(F.col(key).alias("sample"), "age"), "sample", "left")
    if not joined.filter("age IS NULL").isEmpty():
        raise ValueError("samples without age")
    return joined.select("sample", "gene", F.col("value").cast("double").alias("value"), "age")


def read_gene_vectors(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p[0].alias("gene"), F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x.cast("double")).alias("vec"))


def discover(spark: SparkSession, folder: str, matrix: str, companion: str) -> DataFrame:
    """label, matrix, companion files paired by the label in their names; a missing or doubled companion is an error.

    The patterns have one group, the label.
    """
    # file listings are as long as the folder; contents are not read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    left = files.filter(F.col("name").rlike(matrix)).select(F.regexp_extract("name", matrix, 1).alias("label"), F.col("path").alias("matrix"))
    right = files.filter(F.col("name").rlike(companion)).select(F.regexp_extract("name", companion, 1).alias("label"), F.col("path").alias("companion"))
    pairs = left.join(right, "label", "left")
    bad = pairs.groupBy("label").agg(F.count("companion").alias("n")).filter("n <> 1").limit(5).collect()
    if bad:
        raise ValueError(f"companions missing or ambiguous: {[(r['label'], r['n']) for r in bad]}")
    return pairs
