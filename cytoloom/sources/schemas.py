"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"
_floats, _ints = T.ArrayType(T.FloatType()), T.ArrayType(T.ByteType())

SAMPLES = T.StructType([
    T.StructField("cell_id", T.StringType(), False), T.StructField("X", _floats), T.StructField("u_modality", T.StringType()), T.StructField("u_chem_fp", _ints),
    T.StructField("u_gene_emb", _floats), T.StructField("u_tf_emb", _floats), T.StructField("dose_time", _floats), T.StructField("y_cls", _floats), T.StructField("y_age", T.FloatType()),
    T.StructField("age_mask", T.BooleanType()), T.StructField("sig_scores", _floats), T.StructField("cell_line", T.StringType()), T.StructField("pert_id", T.StringType()),
    T.StructField("scaffold_id", T.StringType()), T.StructField("source", T.StringType()),
])
MANIFEST = "cell_id string, cell_line string, pert_id string, scaffold_id string, source string, age_mask boolean, shard_id string, row_idx long"
METRICS = "regime string, estimator string, fold string, metric string, value double"
