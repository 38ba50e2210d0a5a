"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

Patterns: assignments to a key word, access ids, long runs of hex digits. Further candidates are runs of 20 and more
characters of the key alphabets that no pattern covers. The encoding of each is inferred (hex, base 32, base 36, base 64, letters
of one or both cases, by frequency in English, so that words crowd at the beginning). A run that is of no encoding with its
separators is cut: its long pieces are tested each, and one of short pieces (as a dashed key) is tested without separators;
and three tests ask whether its symbols look drawn at random from that alphabet: chi-squared uniformity, runs about the
middle of the alphabet, serial correlation. Fisher's method joins the three p-values.

False discoveries are controlled over the whole corpus, separately by encoding and length: keys have uniform p-values,
ordinary strings have p-values near 0. A group's share of keys is the lower limit of what its p-values above 1/2 say; how far
ordinary strings reach up is what the corpus has in excess of the uniform part, with a prior. The lowest cutoff is taken above which
at most `alpha` of the group's strings are expected to be ordinary. Counts are smoothed alike at every size: to a group's are added `PSEUDO` strings with the shares of its encoding, to an encoding's as
many with those of the corpus, to the corpus's as many with those of a prior in which `KEYS` of the strings are keys. A candidate above its group's cutoff is a span of kind "random".

Nulls and empty texts have no spans; texts of any length are scanned whole; repeated rows each give a row; extra
columns pass through untouched; an empty table gives an empty result. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .quality_rules import let
from .staging import Staging

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
PIECE = r"[A-Za-z0-9]{20,}"  # between separators
KINDS = ["assign", "access", "hex", "random"]

_UP, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_OFTEN = "etaoinshrdlcumwfgypbvkxjqz"
#: encoding: (what a string of it looks like, alphabet in the order of its values, where the cells of the chi-squared test end, for short and long strings).
#: Cells part kinds of symbols, and of letters the often from the seldom used, as words are lower-case letters in the main.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef", ((4, 8, 12, 16), (2, 4, 6, 8, 10, 12, 14, 16))),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _OFTEN.upper() + "234567", ((13, 26, 32), (7, 13, 20, 26, 32))),
    "base36": (r"^(?=.*[0-9])(?=.*[A-Za-z])([a-z0-9]+|[A-Z0-9]+)$", _DIGIT + _OFTEN, ((10, 23, 36), (5, 10, 17, 23, 30, 36))),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", _UP + _OFTEN + _DIGIT + "+/", ((26, 39, 52, 64), (13, 26, 35, 44, 52, 64))),
    "lower": (r"^([a-z]+|[A-Z]+)$", _OFTEN, ((7, 13, 20, 26), (4, 7, 10, 13, 17, 20, 23, 26))),
    "letters": (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+$", _OFTEN.upper() + _OFTEN, ((26, 39, 52), (13, 26, 35, 44, 52))),
}
LENGTHS = (24, 32, 48, 64)  # bounds of the length groups
BINS = 64  # of p-values
PSEUDO, KEYS = 40.0, 0.9  # strings added to each count, and the share of keys among those of the prior
NEAR = 0.03  # of the prior's ordinary strings, p ** NEAR lie below p
_EMPTY = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: int, wanted=None) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, in code points; wanted(match number) drops failing ones.

    The text between matches and the matches themselves add up to their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column, s: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("spans"))
        steps = F.arrays_zip(F.transform(m, lambda x: F.length(x)).alias("m"), F.transform(F.slice(s, 1, F.size(m)), lambda x: F.length(x)).alias("s"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["s"]
            end = begin + x["m"]
            return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("spans"))

        return F.aggregate(steps, start, step, lambda acc: acc["spans"])

    all_ = let(found, lambda m: placed(m, F.split(text, pattern, -1)))
    if wanted is not None:
        all_ = let(all_, lambda a: F.filter(a, lambda _, i: wanted(i)))
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(_EMPTY))


def base_spans(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = let(values, lambda v: F.transform(v, lambda x: F.length(x) >= 6))
    assign = F.when(text.rlike(ASSIGN), let(long_enough, lambda ok: spans_of(text, ASSIGN, 0, lambda i: F.get(ok, i)))).otherwise(F.array().cast(_EMPTY))
    return F.sort_array(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def _phi_upper(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 7.1.26; error under 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(token: Column, encoding: str) -> Column:
    """p-value of the joined tests that the token's symbols are uniform, independent draws from the encoding's alphabet."""
    _, alphabet, cells = ENCODINGS[encoding]
    size = len(alphabet)
    plain = F.translate(F.lower(token) if encoding in ("hex", "base36", "lower") else token, "_-", "/+")
    values = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

        def uniform(ends: tuple[int, ...]) -> Column:
            chi, df = F.lit(0.0), len(ends) - 1
            inside = lambda low, end: lambda x: (x >= low) & (x < end)
            for low, end in zip((0, *ends), ends):
                want = n * ((end - low) / size)
                chi = chi + F.pow(F.size(F.filter(v, inside(low, end))) - want, F.lit(2.0)) / want
            return let((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)), _phi_upper)

        p_chi = F.when(F.size(v) < 48, uniform(cells[0])).otherwise(uniform(cells[1]))
        high = let(v, lambda a: F.transform(a, lambda x: (x >= size // 2).cast("int")))
        runs = let(high, lambda h: 1 + F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) != x))))
        ups = F.aggregate(high, F.lit(0), lambda s, x: s + x).cast("double")

        def runs_test(s: Column) -> Column:
            spread = (s["mean"] - 1) * (s["mean"] - 2) / (n - 1)
            return F.when(spread > 0, 2 * let(F.abs(s["runs"] - s["mean"]) / F.sqrt(F.greatest(spread, F.lit(1e-9))), _phi_upper)).otherwise(F.lit(0.0))

        p_runs = let(F.struct(runs.alias("runs"), let(ups, lambda u: 2 * u * (n - u) / n + 1).alias("mean")), runs_test)
        mean = total(v, lambda x: x.cast("double")) / n
        centred = let(mean, lambda m: F.transform(v, lambda x: x - m))

        def serial(c: Column) -> Column:
            lag = F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
            return let(
                F.struct(total(c, lambda x: x * x).alias("var"), total(lag, lambda x: x).alias("lag")),
                lambda s: F.when(s["var"] > 0, 2 * let(F.abs(s["lag"] / s["var"]) * F.sqrt(n), _phi_upper)).otherwise(F.lit(0.0)),
            )

        logs = [F.ln(F.greatest(p, F.lit(1e-12))) for p in (p_chi, p_runs, let(centred, serial))]
        # chi-squared upper tail with 6 degrees of freedom
        return let(-(logs[0] + logs[1] + logs[2]), lambda half: F.exp(-half) * (1 + half + half * half / 2))

    return let(values, tests)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, grp, p>>: strings outside the base spans, whole or in pieces."""
    meets = lambda x, spans: F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    token_of = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])

    def encoded(t: Column) -> Column:
        found = F.lit(False)
        for looks, _, _ in ENCODINGS.values():
            found = found | t.rlike(looks)
        return found

    whole = let(spans_of(text, CANDIDATE, 3), lambda a: F.filter(a, lambda x: let(token_of(x), lambda t: encoded(t) | ~t.rlike(PIECE))))
    both = let(whole, lambda w: F.concat(w, F.filter(spans_of(text, PIECE, 3), lambda x: ~meets(x, w))))
    places = let(both, lambda a: F.filter(a, lambda x: ~meets(x, base)))

    def measured(x: Column) -> Column:
        token = let(token_of(x), lambda t: F.when(encoded(t), t).otherwise(F.regexp_replace(t, "[+/_-]", "")))

        def with_p(t: Column) -> Column:
            length = F.length(t)
            step = sum(((length >= b).cast("int") for b in LENGTHS[1:]), (length >= LENGTHS[0]).cast("int"))
            out = F.lit(None).cast("struct<grp:int,p:double>")
            for i, (name, (looks, _, _)) in reversed(list(enumerate(ENCODINGS.items()))):
                out = F.when(t.rlike(looks), F.struct((i * 8 + step).alias("grp"), randomness(t, name).alias("p"))).otherwise(out)
            return out

        return let(let(token, with_p), lambda r: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["grp"].alias("grp"), r["p"].alias("p")))

    return F.filter(F.transform(F.sort_array(places), measured), lambda x: x["grp"].isNotNull())


MORE = "array<struct<start:int,end:int,grp:int,p:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """docs with two columns more: __base (spans) and __more (candidates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.withColumn("__base", base_spans(text))
    # the tests are for the few texts that hold a candidate at all
    more = F.when(text.rlike(CANDIDATE), let(F.col("__base"), lambda b: candidates(text, b))).otherwise(F.array().cast(MORE))
    return based.withColumn("__more", more)


def cutoffs(scanned: DataFrame, alpha: float = 0.1, least_p: float = 0.001) -> dict[int, float]:
    """The lowest p-value that counts as random, by group of encoding and length. The table has as many rows as groups times bins."""
    each = scanned.select(F.explode("__more").alias("x")).select("x.grp", F.least(F.floor(F.col("x.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    table: dict[int, list[int]] = {}
    for r in each.groupBy("grp", "bin").count().collect():
        table.setdefault(r["grp"], [0] * BINS)[r["bin"]] = r["count"]
    return cutoffs_of(table, alpha, least_p)


def cutoffs_of(table: dict[int, list[int]], alpha: float, least_p: float) -> dict[int, float]:
    """Cutoffs from counts by group and bin."""
    merged = lambda groups: [sum(x) for x in zip([0] * BINS, *groups)]
    smooth = lambda n, wider: [x + PSEUDO * w / sum(wider) for x, w in zip(n, wider)]
    prior = [KEYS / BINS + (1 - KEYS) * (((b + 1) / BINS) ** NEAR - (b / BINS) ** NEAR) for b in range(BINS)]
    corpus = smooth(merged(table.values()), prior)
    wide = {e: smooth(merged(n for g, n in table.items() if g // 8 == e), corpus) for e in {g // 8 for g in table}}
    tail = plain_tail(corpus)
    return {g: cutoff(smooth(n, wide[g // 8]), tail, alpha, least_p) for g, n in table.items()}


def plain_tail(n: list[float], prior: float = 100.0, near: float = NEAR) -> list[float]:
    """The share of ordinary strings with a p-value of at least b / BINS, for each bin b: what exceeds the uniform part, with `prior` strings of p ** near."""
    half = BINS // 2
    uniform = sum(n[half:]) / half
    out: list[float] = []
    for b in range(BINS):
        extra = max(0.0, sum(n[b:half]) - uniform * (half - b)) if b < half else 0.0
        now = extra + prior * (1 - (b / BINS) ** near)
        out.append(min(now, out[-1]) if out else now)
    return [x / out[0] for x in out]


def cutoff(n: list[float], tail: list[float], alpha: float, least_p: float) -> float:
    """The lowest cutoff above which at most `alpha` of the strings are expected to be ordinary.

    Keys are counted at the lower limit of one standard error, so that a few strings are not taken for keys by chance; one key and one ordinary string are added.
    """
    upper = sum(n[BINS // 2 :])
    keys = (min(sum(n), max(0.0, 2 * (upper - upper**0.5))) + 1) / (sum(n) + 2)
    low = sorted({least_p, *(f / BINS for f in (1 / 8, 1 / 4, 1 / 2))})  # the first bin is cut further, with the prior's shape inside it
    grid = [(p, tail[1] + (1 - tail[1]) * (1 - min(1.0, p * BINS) ** NEAR)) for p in low if least_p <= p < 1 / BINS] + [(b / BINS, tail[b]) for b in range(1, BINS)]
    for p, above in grid:
        ordinary = (1 - keys) * above
        if ordinary <= alpha * (ordinary + keys * (1 - p)):
            return max(least_p, p)
    return 1.0


def all_spans(cut: dict[int, float]) -> Column:
    keep = lambda x: (
        F.exists(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(p).alias("p")) for g, p in cut.items())), lambda c: (c["g"] == x["grp"]) & (x["p"] >= c["p"])) if cut else F.lit(False)
    )
    extra = F.transform(F.filter("__more", keep), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return F.sort_array(F.concat("__base", extra))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans ("kind:start:end" by start and kind)."""
    staging = Staging(docs.sparkSession, "secrets")
    found = staging.write(scan(docs.select("doc_id", "text")).select("doc_id", "__base", "__more"), "found")
    spans = found.select("doc_id", "__base", all_spans(cutoffs(found, alpha)).alias("__all"))
    count = lambda k: F.size(F.filter("__all", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__all")).alias("spans"),
    )


def redact(docs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """docs with every secret in text replaced by [kind]; spans that overlap are replaced as one, named by the first. Other columns stay."""
    # docs' own columns travel in one, so that none clashes; the scan is written, as cutoffs and spans both read it
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    scanned = Staging(docs.sparkSession, "redact").write(scan(rows).drop("text"), "scanned").withColumn("text", F.col("row.text"))
    cut = cutoffs(scanned, alpha)
    kinds = F.array(*map(F.lit, KINDS))

    def cleaned(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda a, s: F.when(
            s["end"] > a["at"],
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.get(kinds, s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
            ),
        ).otherwise(a)
        return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text") - a["at"])))

    found = scanned.withColumn("__all", all_spans(cut))
    text = F.when(F.size("__all") > 0, let(F.col("__all"), cleaned)).otherwise(F.col("row.text"))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
