"""Encodings of perturbations: dose and time, factors of cocktails, scaffolds, metadata in canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: the factor vocabulary in the order of its vector, cocktails, letters
FACTORS = ["POU5F1", "SOX2", "KLF4", "MYC", "NANOG", "LIN28A", "GLIS1", "SALL4"]
COCKTAILS = {"OSKM": ["POU5F1", "SOX2", "KLF4", "MYC"], "OSK": ["POU5F1", "SOX2", "KLF4"], "OSKMNL": ["POU5F1", "SOX2", "KLF4", "MYC", "NANOG", "LIN28A"]}
LETTERS = {"O": "POU5F1", "S": "SOX2", "K": "KLF4", "M": "MYC", "N": "NANOG", "L": "LIN28A"}
CONTROLS = ["control", "dmso", "vehicle", "none", ""]


def encode_dose_time(dose: Column, hours: Column) -> list[Column]:
    return [F.log10(F.greatest(dose, F.lit(1e-4))), F.ln(F.greatest(hours, F.lit(1e-2)))]


def _map(d: dict) -> Column:
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))))


def factors_of(pert: Column) -> Column:
    """Ordered distinct factors of a cocktail's name, of "A+B", of one symbol or of letters; none for a control or what cannot be read."""
    name = F.upper(F.trim(pert))
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(name, r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    letters = F.filter(F.split(name, ""), lambda x: x != "")
    known = F.array(*map(F.lit, FACTORS))
    cocktail, letter = _map(COCKTAILS), _map(LETTERS)
    spelled = F.size(letters) > 0
    return (
        F.when(pert.isNull() | F.lower(F.trim(pert)).isin(CONTROLS), none)
        .when(F.array_contains(F.map_keys(cocktail), name), F.element_at(cocktail, name))
        .when(F.contains(name, F.lit("+")), F.array_distinct(F.filter(F.transform(parts, lambda p: F.coalesce(F.when(F.array_contains(known, p), p), F.element_at(letter, p))), lambda x: x.isNotNull())))
        .when(F.array_contains(known, name), F.array(name))
        .when(spelled & F.forall(letters, lambda c: F.array_contains(F.map_keys(letter), c)), F.array_distinct(F.transform(letters, lambda c: F.element_at(letter, c))))
        .otherwise(none)
    )


def multi_hot(factors: Column, dose: Column) -> Column:
    """One entry a factor of the vocabulary: the dose where the set has it; a dose of 0 or null counts as 1."""
    d = F.when(F.coalesce(dose, F.lit(0.0)) == 0, 1.0).otherwise(dose)
    return F.transform(F.array(*map(F.lit, FACTORS)), lambda f: F.when(F.array_contains(factors, f), d).otherwise(0.0))


def resolve_scaffold(provided: Column, computed: Column, pert: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(provided), F.lit("")), F.nullif(F.trim(computed), F.lit("")), pert)


CANONICAL = ["cell_id", "cell_line", "pert_id", "smiles", "scaffold_id", "dose_um", "time_h"]


def normalise_obs(df: DataFrame, names: dict[str, str], controls: list[str]) -> DataFrame:
    """Any metadata as canonical cells: columns renamed, absent ones null, controls found by token, their dose 0 and scaffold CONTROL."""
    cols = {c: F.col(names[c]) if c in names else F.lit(None).cast("double" if c in ("dose_um", "time_h") else "string") for c in CANONICAL}
    control = F.lower(F.trim(cols["pert_id"].cast("string"))).isin([c.lower() for c in controls])
    cols["dose_um"] = F.when(control, 0.0).otherwise(cols["dose_um"].cast("double"))
    cols["scaffold_id"] = F.when(control, "CONTROL").otherwise(resolve_scaffold(cols["scaffold_id"].cast("string"), F.lit(None).cast("string"), cols["pert_id"].cast("string")))
    return df.select(*(c.alias(n) for n, c in cols.items()), F.coalesce(control, F.lit(False)).alias("is_control"))


def day_of_label(label: Column) -> tuple[Column, Column]:
    """(hours, is control) of a sample label: "D8" is day 8, "iPSC" day 21, "D0" the control."""
    digits = F.regexp_replace(label, "[^0-9]", "")
    day = F.when(F.lower(label).contains("ipsc"), 21).when(digits != "", digits.cast("int"))
    return day * 24.0, F.coalesce(day == 0, F.lit(False))


def parse_title(title: Column) -> Column:
    """struct(donor, day, marker, batch) of "donor_dN_marker_..._ExpK"; null where a part is missing."""
    p = F.split(title, "_")
    day = F.regexp_extract(F.get(p, 1), r"^d(\d+)$", 1)
    batch = F.element_at(p, -1)
    ok = (F.size(p) >= 4) & (day != "") & batch.rlike(r"^Exp\d+$")
    return F.when(ok, F.struct(F.get(p, 0).alias("donor"), day.try_cast("int").alias("day"), F.get(p, 2).alias("marker"), batch.alias("batch")))


def day_of_log_hours(t: Column) -> Column:
    return F.round(F.exp(t) / 24, 1)


def expand_counts(counts: DataFrame, label: str, n: str) -> DataFrame:
    """One row for each unit counted: label, i."""
    return counts.select(label, F.explode(F.sequence(F.lit(1), F.col(n))).alias("i"))


def union_sources(*parts: DataFrame) -> DataFrame:
    """All chunks of all sources; a chunk id in two sources is an error."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)])
    twice = tagged.groupBy("chunk_id").agg(F.count_distinct("source_no").alias("k")).filter("k > 1").limit(5).collect()
    if twice:
        raise ValueError(f"chunk ids in several sources: {[r['chunk_id'] for r in twice]}")
    return tagged.drop("source_no")


def label_rows(rows: DataFrame, counts: DataFrame, key: str, n: str, order: str) -> DataFrame:
    """rows, each with the number of its key's count that its place in `order` has; an error where a key has more or fewer rows than its count."""
    have = rows.groupBy(key).agg(F.count("*").alias("have"))
    wrong = counts.select(key, n).join(have, key, "full_outer").filter(~F.col(n).eqNullSafe(F.col("have")))
    if bad := [r[key] for r in wrong.limit(5).collect()]:
        raise ValueError(f"counts do not match the rows of {bad}")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def perturbation_vector(fingerprint: str, factors: str) -> Column:
    """The vector of what was given: the compound's fingerprint if there is one, else the factors' levels."""
    return F.coalesce(F.transform(fingerprint, lambda x: x.cast("double")), F.col(factors))
