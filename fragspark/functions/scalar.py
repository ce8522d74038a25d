"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The powers of ten and their suffixes.
POWERS = [(3, "K"), (6, "M"), (9, "B"), (12, " trillion"), (15, " quadrillion"), (18, " quintillion")]
REMOVALS = "array<struct<removal_num int, id bigint, prediction double, lcc double, slcc double>>"


def intword(value: Column, largest: str | None = None) -> Column:
    """1500 -> '1.5K', 1000000 -> '1M': one decimal, zeros and the point stripped, the next suffix where the figure rounds to 1000; below 1000 as it is.

    No suffix goes beyond `largest`, where one is given: with 'M' 2340000000 is '2340M'.
    """
    powers = POWERS if largest is None else POWERS[: [name for _, name in POWERS].index(largest) + 1]
    out = value.cast("string")
    for i, (power, suffix) in enumerate(powers):
        chop = value / F.lit(10.0**power)
        text = F.format_string("%.1f", chop)
        if i + 1 < len(powers):
            rolled = F.when(text == "1000.0", F.lit("1.0")).otherwise(text)
            name = F.when(text == "1000.0", powers[i + 1][1]).otherwise(suffix)
        else:
            rolled, name = text, F.lit(suffix)
        out = F.when(F.abs(value) >= F.lit(10.0**power), F.concat(F.regexp_replace(rolled, r"\.0$", ""), name)).otherwise(out)
    return out


def from_human(text: Column) -> Column:
    """'1.5K' -> 1500: the inverse, suffixes in either case; null if unreadable."""
    number = F.regexp_extract(text, r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*$", 1).try_cast("double")
    suffix = F.lower(F.regexp_extract(text, r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*$", 2))
    factor = F.when(suffix == "", F.lit(1.0))
    for power, name in POWERS:
        factor = factor.when(suffix == name.strip().lower(), F.lit(10.0**power))
    return F.round(number * factor).cast("long")


def network_name(name: Column) -> Column:
    """'ER_n1000_k4_3' -> struct(type, num_nodes, instance_num); null if it has another form."""
    pattern = r"^(.+?)_n(\d+)_(.+)_(\d+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("type"), part(2).cast("long").alias("num_nodes"), part(4).cast("long").alias("instance_num")))


def lfr_name(name: Column) -> Column:
    """'LFRp1_N16384_k6.0_maxk128_mu0.1_t12.2_t21.0_minc128_maxc640_S0_i10' -> its parameters as a struct; null if it has another form."""
    pattern = r"^LFRp(\d+)_N(\d+)_k([\d.]+)_maxk(\d+)_mu([\d.]+)_t1([\d.]+)_t2([\d.]+)_minc(\d+)_maxc(\d+)_S(\d+)_i(\d+)$"
    fields = [("p", 1, "long"), ("N", 2, "long"), ("k", 3, "double"), ("maxk", 4, "long"), ("mu", 5, "double"), ("t1", 6, "double"), ("t2", 7, "double"), ("minc", 8, "long"), ("maxc", 9, "long"), ("instance_num", 11, "long")]
    return F.when(name.rlike(pattern), F.struct(*(F.regexp_extract(name, pattern, i).cast(t).alias(n) for n, i, t in fields)))


def pretty_network(name: Column) -> Column:
    """'ER_n1000_k4_3' -> 'ER (1K)', LFR names -> 'LFR p1 (16.4K)'; raises on names of another form."""
    parsed, lfr = network_name(name), lfr_name(name)
    plain = F.concat(parsed["type"], F.lit(" ("), intword(parsed["num_nodes"]), F.lit(")"))
    known = F.when(parsed.isNotNull(), plain).when(lfr.isNotNull(), F.concat(F.lit("LFR p"), lfr["p"].cast("string"), F.lit(" ("), intword(lfr["N"]), F.lit(")")))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("not a network name: "), name)).cast("string"))


def title_label(text: Column) -> Column:
    """Underscores become spaces, outer ones go, each run of letters starts with a capital (after digits and punctuation too)."""
    words = F.regexp_extract_all(F.trim(F.replace(text, F.lit("_"), F.lit(" "))), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.right(w, F.length(w) - 1)))), "")


def read_removals(text: Column) -> Column:
    """'[(1, 17, 0.98, 0.81, 0.02), ...]', also with np.float64(...), -> array of structs."""
    bare = F.regexp_replace(text, r"np\.\w+\(([^()]*)\)", "$1")
    rows = F.from_json(F.translate(bare, "()", "[]"), "array<array<double>>")
    return F.transform(rows, lambda r: F.struct(r[0].cast("int").alias("removal_num"), r[1].cast("long").alias("id"), r[2].alias("prediction"), r[3].alias("lcc"), r[4].alias("slcc")))


def write_removals(removals: Column) -> Column:
    """The literal form of removals, as run files in CSV hold it."""
    one = lambda r: F.concat(F.lit("("), F.concat_ws(", ", *(r[c].cast("string") for c in ("removal_num", "id", "prediction", "lcc", "slcc"))), F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(removals, one), ", "), F.lit("]"))


def removed_ids(removals: Column) -> Column:
    return F.transform(removals, lambda r: r["id"])


def colour_key(kind: Column, num_nodes: Column, palette: dict[str, str]) -> Column:
    """The colour of 'type_numnodes'; null if the palette has none."""
    key = F.concat_ws("_", kind, num_nodes.cast("string"))
    out = F.lit(None).cast("string")
    for k, v in palette.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def entropy_terms(value: Column, total: Column) -> Column:
    """-p * log2(p) of the share p = value / total, 0 where p is 0."""
    p = value / total
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
