"""Queries of the data build: quality control to labels and samples."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import hard_label, sanitize_id
from ..operators import expression as X, quality as Q
from ..streaming.run import staged
from . import domain as D
from .domain import CTES, GENE_NUMBER, gene_number
from .registry import query, rounded

#: fixed values of the domain roles: mitochondrial genes, gene sets by number, weights and intercept of the clock
MITO = ["Brand#1", "Brand#2"]
SETS = {"safe": (3, 8), "loss": (9, 14), "death": (15, 20)}
CYCLE = (1, 6)
INTERCEPT = 40.0

CTES |= {
    "genes": "SELECT DISTINCT p_brand AS gene FROM part",
    "clock": f"SELECT gene, ({GENE_NUMBER} % 7 - 3) / 10.0::DOUBLE AS weight FROM genes",
    "sets": "SELECT set_name, gene FROM genes JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in SETS.items()) + f") v(set_name, lo, hi) ON {GENE_NUMBER} BETWEEN lo AND hi",
    "qc": """SELECT c.cell_id, coalesce(total, 0) AS total, coalesce(n_genes, 0) AS n_genes, coalesce(mito, 0) / greatest(coalesce(total, 0), 1) AS mito_fraction
  FROM cells c LEFT JOIN (SELECT cell_id, sum(value) AS total, count(*) FILTER (value > 0) AS n_genes, coalesce(sum(value) FILTER (gene IN ('Brand#1', 'Brand#2')), 0) AS mito FROM expr GROUP BY 1) USING (cell_id)""",
    "kept": "SELECT c.* FROM cells c JOIN qc USING (cell_id) WHERE n_genes >= 2 AND mito_fraction <= 0.5",
    "kexpr": "SELECT e.* FROM expr e JOIN kept USING (cell_id)",
    "norm": "SELECT cell_id, gene, ln(1 + value / nullif(sum(value) OVER (PARTITION BY cell_id), 0) * 1e4) AS value FROM kexpr",
    "nchunk": "SELECT chunk_id, count(*) AS n FROM kept GROUP BY 1",
    "stats": """SELECT chunk_id, gene, s / n AS mu, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sigma, n FROM
  (SELECT chunk_id, gene, sum(value) AS s, sum(value * value) AS q FROM norm JOIN kept USING (cell_id) GROUP BY ALL) JOIN nchunk USING (chunk_id)""",
    "sigs": """SELECT cell_id, set_name, coalesce((coalesce(v, 0) - base) / m, 0) AS score
  FROM (SELECT cell_id, chunk_id, set_name FROM kept, (SELECT DISTINCT set_name FROM sets))
  LEFT JOIN (SELECT chunk_id, set_name, count(*) AS m, sum(mu / (sigma + 1e-8)) AS base FROM stats JOIN sets USING (gene) GROUP BY ALL) USING (chunk_id, set_name)
  LEFT JOIN (SELECT cell_id, set_name, sum(value / (sigma + 1e-8)) AS v FROM norm JOIN kept USING (cell_id) JOIN stats USING (chunk_id, gene) JOIN sets USING (gene) GROUP BY ALL) USING (cell_id, set_name)""",
    "wide": "SELECT cell_id, max(score) FILTER (set_name = 'safe') AS safe, max(score) FILTER (set_name = 'loss') AS loss, max(score) FILTER (set_name = 'death') AS death FROM sigs GROUP BY 1",
    "cyc": """SELECT cell_id, (coalesce(v, 0) - base) / m AS score FROM kept
  JOIN (SELECT chunk_id, count(*) AS m, sum(mu / (sigma + 1e-8)) AS base FROM stats WHERE """ + GENE_NUMBER + """ BETWEEN 1 AND 6 GROUP BY 1) USING (chunk_id)
  LEFT JOIN (SELECT cell_id, sum(value / (sigma + 1e-8)) AS v FROM norm JOIN kept USING (cell_id) JOIN stats USING (chunk_id, gene) WHERE """ + GENE_NUMBER + """ BETWEEN 1 AND 6 GROUP BY 1) USING (cell_id)""",
    "ages": "SELECT k.cell_id, coalesce(s, 0) + 40.0 AS age FROM kept k LEFT JOIN (SELECT cell_id, sum(weight * value) AS s FROM norm JOIN clock USING (gene) GROUP BY 1) USING (cell_id)",
    "deltas": """SELECT k.cell_id, chunk_id, cell_line, is_control, age, age - coalesce(avg(age) FILTER (is_control) OVER (PARTITION BY chunk_id, cell_line), avg(age) OVER (PARTITION BY chunk_id, cell_line)) AS d_age
  FROM kept k JOIN ages USING (cell_id)""",
    "zrel": """SELECT cell_id, (safe - mu_s) / sd_s AS zs, (loss - mu_l) / sd_l AS zl, (death - mu_d) / sd_d AS zd FROM (SELECT *, """
    + ", ".join(
        f"CASE WHEN n_l >= 2 THEN avg({c}) FILTER (is_control) OVER l ELSE CASE WHEN n_c >= 1 THEN avg({c}) FILTER (is_control) OVER c ELSE avg({c}) OVER c END END AS mu_{a}, "
        f"CASE WHEN (CASE WHEN n_l >= 2 THEN stddev_pop({c}) FILTER (is_control) OVER l ELSE CASE WHEN n_c >= 1 THEN stddev_pop({c}) FILTER (is_control) OVER c ELSE stddev_pop({c}) OVER c END END) > 1e-8 "
        f"THEN (CASE WHEN n_l >= 2 THEN stddev_pop({c}) FILTER (is_control) OVER l ELSE CASE WHEN n_c >= 1 THEN stddev_pop({c}) FILTER (is_control) OVER c ELSE stddev_pop({c}) OVER c END END) "
        f"WHEN (CASE WHEN n_c >= 1 THEN stddev_pop({c}) FILTER (is_control) OVER c ELSE stddev_pop({c}) OVER c END) > 1e-8 THEN (CASE WHEN n_c >= 1 THEN stddev_pop({c}) FILTER (is_control) OVER c ELSE stddev_pop({c}) OVER c END) ELSE 1 END AS sd_{a}"
        for c, a in (("safe", "s"), ("loss", "l"), ("death", "d"))
    )
    + """ FROM (SELECT *, count(*) FILTER (is_control) OVER (PARTITION BY chunk_id, cell_line) AS n_l, count(*) FILTER (is_control) OVER (PARTITION BY chunk_id) AS n_c FROM kept JOIN wide USING (cell_id))
  WINDOW l AS (PARTITION BY chunk_id, cell_line), c AS (PARTITION BY chunk_id))""",
    "fate": "SELECT cell_id, exp(2 - m) / t AS y_safe, exp(a - m) / t AS y_loss, exp(zd - m) / t AS y_death FROM (SELECT *, exp(2 - m) + exp(a - m) + exp(zd - m) AS t FROM (SELECT *, zl - zs AS a, greatest(2, zl - zs, zd) AS m FROM zrel))",
}


def sets_table(genes: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    n = gene_number()
    return genes.select(F.explode(F.array_compact(F.array(*(F.when(n.between(a, b), F.lit(s)) for s, (a, b) in ranges.items())))).alias("set_name"), "gene")


class Build:
    """The tables of one run; those that several steps read are written once to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.genes = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
        self.clock = self.genes.select("gene", ((gene_number() % 7 - 3) / 10.0).alias("weight"))
        self.sets = sets_table(self.genes, SETS)

    @cached_property
    def cells(self) -> DataFrame:
        return D.cells(self.spark, self.sf_dir)

    @cached_property
    def expr(self) -> DataFrame:
        return staged(D.expr(self.spark, self.sf_dir), "expr")

    def qc(self) -> DataFrame:
        return Q.qc_metrics(self.expr, self.cells, F.col("gene").isin(MITO))

    @cached_property
    def _kept(self) -> DataFrame:
        return staged(self.cells.join(Q.qc_filter(self.qc(), 2, 0.5), "cell_id", "left_semi"), "kept")

    @cached_property
    def _norm(self) -> DataFrame:
        return staged(X.normalize_cp10k(self.expr.join(self.kept().select("cell_id"), "cell_id", "left_semi")), "norm")

    @cached_property
    def _signatures(self) -> DataFrame:
        """All sets and the cycle's from one pass over the expression."""
        every = {**SETS, "cycle": CYCLE}
        return staged(X.pivot_scores(X.signature_scores(self.norm(), self.kept(), sets_table(self.genes, every)), list(every)), "scores")

    def kept(self) -> DataFrame:
        return self._kept

    def norm(self) -> DataFrame:
        return self._norm

    def scores(self) -> DataFrame:
        return self._signatures.drop("cycle")

    def cycle(self) -> DataFrame:
        return self._signatures.select("cell_id", F.col("cycle").alias("score"))

    @cached_property
    def _ages(self) -> DataFrame:
        return staged(X.clock_predict(self.norm(), self.kept(), self.clock, INTERCEPT), "ages")

    def ages(self) -> DataFrame:
        return self._ages


@query("delta_age_by_line", D.sql("SELECT chunk_id, cell_line, count(*) AS n, round(avg(d_age), 6) + 0.0 AS mean_delta, round(min(d_age), 6) + 0.0 AS lo, round(max(d_age), 6) + 0.0 AS hi FROM deltas WHERE NOT is_control GROUP BY ALL"))
def delta_age_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Build(spark, sf_dir)
    d = X.delta_age(b.ages(), b.kept()).filter(~F.col("is_control"))
    return rounded(d.groupBy("chunk_id", "cell_line").agg(F.count("*").alias("n"), F.avg("d_age").alias("mean_delta"), F.min("d_age").alias("lo"), F.max("d_age").alias("hi")))


@query("qc_metrics", D.sql("SELECT cell_id, total, n_genes, round(mito_fraction, 6) AS mito_fraction FROM qc"))
def qc_metrics(spark, sf_dir):
    return rounded(Build(spark, sf_dir).qc())


@query("qc_filter", D.sql("SELECT cell_id, chunk_id FROM kept"))
def qc_filter(spark, sf_dir):
    return Build(spark, sf_dir).kept().select("cell_id", "chunk_id")


@query("drop_empty_droplets", D.sql("SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM expr GROUP BY 1 HAVING count(*) >= 4)"))
def drop_empty_droplets(spark, sf_dir):
    return Q.drop_empty_droplets(D.expr(spark, sf_dir), 4, ["cell_id"])


@query("obs_contract", D.sql("SELECT 'expr_without_cell' AS side, count(DISTINCT cell_id) AS n FROM expr WHERE cell_id NOT IN (SELECT cell_id FROM cells) UNION ALL SELECT 'cell_without_expr', count(*) FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM expr)"))
def obs_contract(spark, sf_dir):
    return Q.obs_contract(D.expr(spark, sf_dir), D.cells(spark, sf_dir))


@query("exclude_markers", D.sql("SELECT gene FROM genes WHERE gene NOT IN (SELECT gene FROM sets)"))
def exclude_markers(spark, sf_dir):
    b = Build(spark, sf_dir)
    return b.genes.join(b.sets.select("gene"), "gene", "left_anti")


@query("control_census", D.sql("SELECT chunk_id, cell_line, count(*) FILTER (is_control) AS n_control, count(*) FILTER (NOT is_control) AS n_perturbed, n_perturbed > 0 AND n_control = 0 AS fallback FROM cells WHERE NOT (cell_line % 6 = 0 AND is_control) GROUP BY 1, 2"))
def control_census(spark, sf_dir):
    return Q.control_census(D.cells(spark, sf_dir).filter("NOT (cell_line % 6 = 0 AND is_control)"))


@query("census_verdict", D.sql("SELECT CASE WHEN count(*) = 0 THEN 'CANNOT_VERIFY' WHEN bool_or(f) THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) FILTER (f) AS n_fallback FROM (SELECT count(*) FILTER (is_control) = 0 AND count(*) FILTER (NOT is_control) > 0 AS f FROM cells WHERE NOT (cell_line % 6 = 0 AND is_control) GROUP BY chunk_id, cell_line)"))
def census_verdict(spark, sf_dir):
    return Q.census_verdict(Q.control_census(D.cells(spark, sf_dir).filter("NOT (cell_line % 6 = 0 AND is_control)")))


_USABLE = "SELECT fold, donor, n, 1 - n / sum(n) OVER (PARTITION BY fold) AS left_share FROM (SELECT chunk_id AS fold, CASE WHEN chunk_id = 1 AND cell_line <> 1 THEN 1 ELSE cell_line END AS donor, count(*) AS n FROM cells GROUP BY ALL)"


def _donor_rows(spark, sf_dir):
    return D.cells(spark, sf_dir).select(F.col("chunk_id").alias("fold"), F.when((F.col("chunk_id") == 1) & (F.col("cell_line") != 1), 1).otherwise(F.col("cell_line")).alias("donor"))


@query("donor_usability", D.sql(f"SELECT fold, donor, n, round(left_share, 6) AS left_share, left_share >= 0.5 AS usable FROM ({_USABLE})"))
def donor_usability(spark, sf_dir):
    return rounded(Q.donor_usability(_donor_rows(spark, sf_dir)))


@query("usability_verdict", D.sql(f"SELECT fold, count(*) FILTER (left_share >= 0.5) AS n_usable, CASE WHEN n_usable >= 2 THEN 'PASS' WHEN n_usable > 0 THEN 'STOP' ELSE 'FAIL' END AS verdict FROM ({_USABLE}) GROUP BY fold"))
def usability_verdict(spark, sf_dir):
    return Q.usability_verdict(Q.donor_usability(_donor_rows(spark, sf_dir)))


@query("profile_shards", D.sql("SELECT chunk_id, count(*) AS n_rows, count(DISTINCT cell_line) AS n_lines, count(DISTINCT pert_id) AS n_perts FROM cells GROUP BY 1"))
def profile_shards(spark, sf_dir):
    return Q.profile_shards(D.cells(spark, sf_dir))


@query("class_variation", D.sql("SELECT CAST(CAST(s / t >= 0.01 AS INT) + CAST(l / t >= 0.01 AS INT) + CAST(d / t >= 0.01 AS INT) AS INT) AS n_classes, n_classes >= 2 AS varies FROM (SELECT sum(y_safe) s, sum(y_loss) l, sum(y_death) d, s + l + d AS t FROM fate)"))
def class_variation(spark, sf_dir):
    b = Build(spark, sf_dir)
    return Q.class_variation(X.fate_labels(b.scores(), b.kept(), 1.0), ["y_safe", "y_loss", "y_death"])


@query("sanitize_id", "SELECT c_custkey, trim(regexp_replace(c_mktsegment || ' ' || c_name || '#', '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS clean FROM customer")
def sanitize(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").select("c_custkey", sanitize_id(F.concat("c_mktsegment", F.lit(" "), "c_name", F.lit("#"))).alias("clean"))


@query("panel_hash", D.sql("SELECT substr(sha256(string_agg(gene, chr(10) ORDER BY gene)), 1, 16) AS panel_hash FROM genes"))
def panel_hash(spark, sf_dir):
    from pyspark.sql import Window

    genes = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
    return Q.panel_hash(genes.withColumn("pos", F.row_number().over(Window.orderBy("gene"))))


@query("normalize_cp10k", D.sql("SELECT cell_id, gene, round(value, 6) AS value FROM norm"))
def normalize(spark, sf_dir):
    return rounded(Build(spark, sf_dir).norm())


@query("gene_stats", D.sql("SELECT chunk_id, gene, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n FROM stats"))
def gene_stats(spark, sf_dir):
    b = Build(spark, sf_dir)
    return rounded(X.gene_stats(b.norm(), b.kept()))


_PANEL = """SELECT row_number() OVER (ORDER BY r, var DESC, gene) - 1 AS pos, gene FROM (SELECT gene, CASE gene WHEN 'Brand#7' THEN 0 WHEN 'Brand#3' THEN 1 ELSE 2 END AS r,
  round(q / n - (s / n) * (s / n), 9) AS var FROM (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM norm WHERE gene <> 'Brand#9' GROUP BY 1), (SELECT count(*) AS n FROM kept) ORDER BY r, var DESC, gene LIMIT 10)"""
CTES["panel"] = _PANEL


def _panel(b: Build) -> DataFrame:
    return X.fit_panel(b.norm(), b.kept(), 10, ["Brand#7", "Brand#3"], ["Brand#9"])


@query("fit_panel", D.sql("SELECT pos::INT AS pos, gene FROM panel"))
def fit_panel(spark, sf_dir):
    return _panel(Build(spark, sf_dir))


@query("to_panel", D.sql("SELECT cell_id, string_agg(coalesce(round(value, 3), 0)::DECIMAL(12, 3)::VARCHAR, ',' ORDER BY pos) AS x FROM (SELECT cell_id, gene, pos FROM kept, panel) LEFT JOIN norm USING (cell_id, gene) GROUP BY 1"))
def to_panel(spark, sf_dir):
    b = Build(spark, sf_dir)
    x = X.to_panel(b.norm(), _panel(b), b.kept())
    return x.select("cell_id", F.array_join(F.transform("X", lambda v: F.round(v, 3).cast("decimal(12,3)").cast("string")), ",").alias("x"))


@query("standardize", D.sql("SELECT cell_id, gene, round((value - mu) / (sigma + 1e-8), 6) + 0.0 AS z FROM norm JOIN kept USING (cell_id) JOIN stats USING (chunk_id, gene)"))
def standardize(spark, sf_dir):
    b = Build(spark, sf_dir)
    return rounded(X.standardize(b.norm(), b.kept()))


@query("signature_scores", D.sql("SELECT cell_id, round(safe, 6) + 0.0 AS safe, round(loss, 6) + 0.0 AS loss, round(death, 6) + 0.0 AS death FROM wide"))
def signature_scores(spark, sf_dir):
    return rounded(Build(spark, sf_dir).scores())


@query("cell_cycle_score", D.sql("SELECT cell_id, round(score, 6) + 0.0 AS score FROM cyc"))
def cell_cycle_score(spark, sf_dir):
    return rounded(Build(spark, sf_dir).cycle())


@query("control_relative_z", D.sql("SELECT cell_id, round(zs, 6) + 0.0 AS zs, round(zl, 6) + 0.0 AS zl, round(zd, 6) + 0.0 AS zd FROM zrel"))
def control_relative_z(spark, sf_dir):
    b = Build(spark, sf_dir)
    df = b.kept().select("cell_id", "chunk_id", "cell_line", "is_control").join(b.scores(), "cell_id")
    return rounded(X.relative_to_controls(df, {"safe": "zs", "loss": "zl", "death": "zd"}).select("cell_id", "zs", "zl", "zd"))


@query("fate_labels", D.sql("SELECT cell_id, round(y_safe, 6) AS y_safe, round(y_loss, 6) AS y_loss, round(y_death, 6) AS y_death FROM fate"))
def fate_labels(spark, sf_dir):
    b = Build(spark, sf_dir)
    return rounded(X.fate_labels(b.scores(), b.kept(), 1.0))


@query("hard_label", D.sql("SELECT label, count(*) AS n FROM (SELECT CAST(list_position([round(y_safe, 9), round(y_loss, 9), round(y_death, 9)], greatest(round(y_safe, 9), round(y_loss, 9), round(y_death, 9))) - 1 AS INT) AS label FROM fate) GROUP BY 1"))
def hard_labels(spark, sf_dir):
    b = Build(spark, sf_dir)
    return X.fate_labels(b.scores(), b.kept(), 1.0).groupBy(hard_label(F.array("y_safe", "y_loss", "y_death")).alias("label")).agg(F.count("*").alias("n"))


@query("clock_predict", D.sql("SELECT cell_id, round(age, 6) AS age FROM ages"))
def clock_predict(spark, sf_dir):
    return rounded(Build(spark, sf_dir).ages())


@query("recenter_on_controls", D.sql("SELECT cell_id, round(score - coalesce(avg(score) FILTER (is_control) OVER (PARTITION BY chunk_id, cell_line), avg(score) OVER (PARTITION BY chunk_id, cell_line)), 6) + 0.0 AS centred FROM kept JOIN cyc USING (cell_id)"))
def recenter(spark, sf_dir):
    b = Build(spark, sf_dir)
    df = b.kept().join(b.cycle(), "cell_id")
    return rounded(X.with_baseline(df, "score", "base").select("cell_id", (F.col("score") - F.col("base")).alias("centred")))


@query("ols_by_line", D.sql("SELECT cell_line, round(CASE WHEN coalesce(var_pop(score), 0) < 1e-12 THEN 0 ELSE regr_slope(d_age, score) END, 5) + 0.0 AS a, round(CASE WHEN coalesce(var_pop(score), 0) < 1e-12 THEN avg(d_age) ELSE regr_intercept(d_age, score) END, 5) + 0.0 AS b FROM deltas JOIN cyc USING (cell_id) GROUP BY 1"))
def ols_by_line(spark, sf_dir):
    b = Build(spark, sf_dir)
    return rounded(X.ols(["cell_line"], X.delta_age(b.ages(), b.kept()).join(b.cycle(), "cell_id"), "score", "d_age"), 5)


@query("deconfound_train_only", D.sql("""SELECT cell_id, round(r - coalesce(avg(r) FILTER (is_control) OVER (PARTITION BY chunk_id, cell_line), avg(r) OVER (PARTITION BY chunk_id, cell_line)), 5) + 0.0 AS y_age FROM (
  SELECT *, d_age - (a * score + b) AS r FROM deltas JOIN cyc USING (cell_id), (SELECT regr_slope(d_age, score) AS a, regr_intercept(d_age, score) AS b FROM deltas JOIN cyc USING (cell_id) WHERE cell_id % 4 <> 0 AND chunk_id <> 4) WHERE chunk_id <> 4)"""))
def deconfound_train_only(spark, sf_dir):
    b = Build(spark, sf_dir)
    df = X.delta_age(b.ages(), b.kept()).join(b.cycle(), "cell_id")
    return rounded(X.deconfound(df, F.col("cell_id") % 4 != 0, "score", "d_age", F.col("chunk_id") != 4).select("cell_id", "y_age"), 5)


CTES |= {
    "hstats": """SELECT chunk_id AS dataset_id, gene, s / n AS mu, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sigma FROM
  (SELECT chunk_id, gene, sum(value) AS s, sum(value * value) AS q FROM norm JOIN kept USING (cell_id) WHERE is_control GROUP BY ALL) JOIN (SELECT chunk_id, count(*) AS n FROM kept WHERE is_control GROUP BY 1) USING (chunk_id) WHERE s / n >= 0.1 AND n >= 3""",
    "harm": """SELECT dataset_id, gene, mu, greatest(sigma, median(sigma) OVER (PARTITION BY dataset_id)) AS sigma FROM hstats
  WHERE gene IN (SELECT gene FROM hstats GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT chunk_id) FROM kept WHERE is_control))""",
}


def _harm(b: Build) -> tuple[DataFrame, DataFrame]:
    cells = b.kept().withColumn("dataset_id", F.col("chunk_id"))
    return cells, X.fit_harmonizer(b.norm(), cells)


@query("fit_harmonizer", D.sql("SELECT dataset_id, gene, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM harm"))
def fit_harmonizer(spark, sf_dir):
    return rounded(_harm(Build(spark, sf_dir))[1])


@query("harmonize", D.sql("SELECT cell_id, gene, round((coalesce(value, 0) - mu) / (sigma + 1e-6), 5) + 0.0 AS z FROM (SELECT cell_id, h.* FROM kept JOIN harm h ON chunk_id = dataset_id) LEFT JOIN norm USING (cell_id, gene)"))
def harmonize(spark, sf_dir):
    b = Build(spark, sf_dir)
    cells, harm = _harm(b)
    return rounded(X.harmonize(b.norm(), cells, harm), 5)


@query("harmonized_age", D.sql("""SELECT cell_id, round(40.0 + sum(weight * ((coalesce(value, 0) - h.mu) / (h.sigma + 1e-6) * ref.sigma + ref.mu)), 5) AS age
  FROM kept JOIN harm h ON chunk_id = h.dataset_id JOIN (SELECT gene, mu, sigma FROM harm WHERE dataset_id = 0) ref USING (gene) JOIN clock USING (gene) LEFT JOIN norm USING (cell_id, gene) GROUP BY 1"""))
def harmonized_age(spark, sf_dir):
    b = Build(spark, sf_dir)
    cells, harm = _harm(b)
    return rounded(X.harmonized_age(b.norm(), cells, harm, b.clock, INTERCEPT, 0), 5)


@query("scaler_fit_apply", D.sql("SELECT e.cell_id, e.gene AS feature, round((e.value - mean) / (std + 1e-6), 6) + 0.0 AS z FROM norm e JOIN (SELECT gene, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS std FROM (SELECT gene, sum(value) s, sum(value * value) q FROM norm WHERE cell_id % 10 < 6 GROUP BY 1), (SELECT count(*) n FROM kept WHERE cell_id % 10 < 6)) USING (gene)"))
def scaler(spark, sf_dir):
    b = Build(spark, sf_dir)
    long = b.norm().withColumnRenamed("gene", "feature")
    fit = X.fit_scaler(long.filter("cell_id % 10 < 6"), b.kept().filter("cell_id % 10 < 6").agg(F.count("*").alias("n")))
    return rounded(long.join(F.broadcast(fit), "feature").select("cell_id", "feature", ((F.col("value") - F.col("mean")) / (F.col("std") + X.EPS_SCALE)).alias("z")))


@query("dedup_symbols", "SELECT p_partkey AS feature_row, p_brand || p_type AS symbol, p_retailprice AS total FROM part QUALIFY row_number() OVER (PARTITION BY p_brand || p_type ORDER BY p_retailprice DESC, p_partkey) = 1")
def dedup_symbols(spark, sf_dir):
    return X.dedup_symbols(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_row"), F.concat("p_brand", "p_type").alias("symbol"), F.col("p_retailprice").alias("total")))


@query("embedding_project", D.sql(f"SELECT cell_id, dim::INT AS dim, round(sum(value * ((({GENE_NUMBER} * (dim + 3)) % 11) - 5) / 5.0), 6) + 0.0 AS value FROM norm, (SELECT range AS dim FROM range(4)) GROUP BY ALL"))
def embedding_project(spark, sf_dir):
    b = Build(spark, sf_dir)
    vec = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: ((gene_number() * (d + 3)) % 11 - 5) / 5.0)
    return rounded(X.embedding_project(b.norm(), b.genes.select("gene", vec.alias("vec"))))


@query("dataset_summary", D.sql("SELECT label, count(*) AS n, count(*) FILTER (chunk_id <> 4) AS n_age_valid FROM (SELECT CAST(list_position([round(y_safe, 9), round(y_loss, 9), round(y_death, 9)], greatest(round(y_safe, 9), round(y_loss, 9), round(y_death, 9))) - 1 AS INT) AS label, chunk_id FROM fate JOIN kept USING (cell_id)) GROUP BY 1"))
def dataset_summary(spark, sf_dir):
    b = Build(spark, sf_dir)
    kept = b.kept()
    y = X.fate_labels(b.scores(), kept, 1.0).join(kept.select("cell_id", "chunk_id"), "cell_id")
    return y.groupBy(hard_label(F.array("y_safe", "y_loss", "y_death")).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id") != 4).alias("n_age_valid"))
