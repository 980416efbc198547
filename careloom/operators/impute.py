"""Claim normalisation and two-way demographic imputation between two claim sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.constants import FIRST_YEAR, LAST_YEAR, MAX_AGE
from careloom.functions.columns import (
    age_band,
    blank_to_null,
    clean_int,
    event_year,
    is_plausible_date,
    is_valid_claim,
    parse_yyyymmdd,
)
from careloom.operators.mapping import standardize_drug
from careloom.operators.projection import quality_level, select_or_null

DEMOGRAPHICS = ["age", "gender", "race", "zip", "county", "payer"]


def normalize_claims(
    df: DataFrame,
    key: str,
    date_text: str,
    demographics: Mapping[str, str],
    keep: Mapping[str, Sequence[str]] | Sequence[str] = (),
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
) -> DataFrame:
    """Typed claim rows: person, year, six cleaned demographics and the kept columns.

    ``demographics`` maps the six field names to the source columns; ``keep`` lists further
    columns, or maps a name to the alternatives it may be stored under.
    """
    keep = keep if isinstance(keep, Mapping) else {c: [c] for c in keep}
    typed = [
        (clean_int(source) if field == "age" else blank_to_null(source)).alias(field)
        for field, source in demographics.items()
    ]
    # The filter leaves real dates only, so their first four digits are the year.
    return df.filter(is_valid_claim(key, date_text, first, last)).select(
        F.col(key).cast("string").alias("person"),
        F.substring(F.col(date_text).cast("string"), 1, 4).cast("int").alias("event_year"),
        *typed,
        F.col(date_text).alias("date_text"),
        *[select_or_null(df, name, *alts) for name, alts in keep.items()],
    )


def period_profile(
    df: DataFrame, key: str, period: str, cols: Sequence[str]
) -> DataFrame:
    """One value of each column and the claim count per (key, period).

    The smallest value stands for "any value", so that reruns agree.
    """
    return _distinct_combinations(df, key, period, cols).groupBy(key, period).agg(
        *[F.min(c).alias(c) for c in cols], F.sum("__n").alias("claim_count")
    )


def _distinct_combinations(
    df: DataFrame, key: str, period: str, cols: Sequence[str]
) -> DataFrame:
    """Claims counted per combination of values.

    Text minimums need a sorting aggregate; a count does not. Most claims of a person-year agree,
    so hashing them together first leaves few rows to sort.
    """
    rows = df.filter(F.col(period).isNotNull())
    return rows.groupBy(key, period, *cols).agg(F.count(F.lit(1)).alias("__n"))


def _is_missing(field: str) -> Column:
    missing = F.col(field).isNull()
    return missing | (F.col(field) > MAX_AGE) if field == "age" else missing


def missing_flags(df: DataFrame, key: str, period: str, cols: Sequence[str]) -> DataFrame:
    """Distinct (key, period, 0/1 flag per column); an age above 114 counts as missing."""
    flags = [F.coalesce(_is_missing(c), F.lit(True)).cast("int").alias(f"missing_{c}")
             for c in cols]
    return df.filter(F.col(period).isNotNull()).select(key, period, *flags).distinct()


def nearest_period(
    period: Column, offers: Column, max_gap: int, values: Sequence[str], offer_ok
) -> Column:
    """Best of an array of per-period rows: nearest period, then heavier, then earlier.

    ``offers`` holds structs with ``p`` (period), ``w`` (weight) and the values; the result is the
    struct of the winner's values, or null.
    """
    near = F.filter(offers, lambda x: (F.abs(x["p"] - period) <= max_gap) & offer_ok(x))
    ranked = F.transform(
        near,
        lambda x: F.struct(
            F.abs(x["p"] - period).alias("gap"),
            (-x["w"]).alias("weight"),
            x["p"].alias("period"),
            F.struct(*[x[v].alias(v) for v in values]).alias("values"),
        ),
    )
    return F.array_min(ranked)["values"]


def nearest_period_join(
    left: DataFrame, right: DataFrame, key: str, period: str, max_gap: int, weight: str,
    values: Sequence[str],
) -> DataFrame:
    """Each row of ``left`` with the values of the nearest period of ``right`` of the same key.

    ``right`` holds one row per (key, period), so a key gathers no more rows than there are
    calendar periods.
    """
    row = F.struct(F.col(period).alias("p"), F.col(weight).alias("w"), *values)
    offers = right.groupBy(key).agg(F.collect_list(row).alias("__offers"))
    best = nearest_period(F.col(period), F.col("__offers"), max_gap, values,
                          lambda x: F.lit(True))
    return (
        left.join(offers, key, "left")
        .withColumn("__best", best)
        .withColumns({f"nearest_{v}": F.col(f"__best.{v}") for v in values})
        .drop("__offers", "__best")
    )


def attach_best(left: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys; ``best`` holds one row per key."""
    return left.join(best, list(keys), "left")


def _claim_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Person-year profiles of both sources, told apart by ``from_a``; each also tells whether
    some claim of the year lacked a field.

    Claims shrink to distinct combinations first. These are dealt by person once, so neither
    this grouping nor a later one by person moves them again.
    """
    lacking = F.greatest(*[F.coalesce(_is_missing(d), F.lit(True)) for d in DEMOGRAPHICS])
    tagged = [
        _distinct_combinations(claims, "person", "event_year", DEMOGRAPHICS)
        .withColumn("from_a", F.lit(from_a))
        for claims, from_a in ((a, True), (b, False))
    ]
    dealt = tagged[0].unionByName(tagged[1]).repartition("person")
    return dealt.groupBy("person", "from_a", "event_year").agg(
        *[F.min(d).alias(d) for d in DEMOGRAPHICS],
        F.sum("__n").alias("w"),
        F.bool_or(lacking).alias("lacking"),
    )


def _imputed(people: DataFrame, own: str, other: str, other_name: str, years: int) -> DataFrame:
    """Imputed demographics and provenance for the person-years of one source."""
    rest = [d for d in DEMOGRAPHICS if d != "age"]
    rows = people.select("person", F.explode(own).alias("o"), F.col(other).alias("x"))
    age = F.col("o.age")
    age_bad = age.isNull() | (age > MAX_AGE)
    wants = F.greatest(*[F.col(f"o.{d}").isNull() for d in rest])
    best_age = nearest_period(
        F.col("o.p"), F.col("x"), years, ["age"],
        lambda x: x["age"].isNotNull() & (x["age"] <= MAX_AGE),
    )
    best_rest = nearest_period(
        F.col("o.p"), F.col("x"), years, rest,
        lambda x: F.greatest(*[x[d].isNotNull() for d in rest]),
    )
    rows = rows.select(
        "person", "o", F.when(age_bad, best_age).alias("a"), F.when(wants, best_rest).alias("d")
    )
    label = F.lit(f"imputed_from_{other_name}")

    def source(filled: Column) -> Column:
        return F.when(filled, label).otherwise("original")

    out = [
        F.when(age > MAX_AGE, F.col("a.age")).otherwise(F.coalesce(age, F.col("a.age")))
        .alias("age_imputed"),
        source(age_bad & F.col("a.age").isNotNull()).alias("age_source"),
    ]
    for d in rest:
        have, found = F.col(f"o.{d}"), F.col(f"d.{d}")
        out.append(F.coalesce(have, found).alias(f"{d}_imputed"))
        out.append(source(have.isNull() & found.isNotNull()).alias(f"{d}_source"))
    return rows.select("person", F.col("o.p").alias("event_year"), *out, "o.lacking")


def impute_profiles(
    a: DataFrame, b: DataFrame, a_name: str, b_name: str, years: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Person-year demographics of two claim sources, each filled from the other one.

    Both profiles meet in one shuffle on the person, where a person brings at most one small row
    per source and year; the nearest year is then picked inside the row. An own age above 114 is
    replaced by the candidate even when there is none; its provenance then stays 'original'.
    """
    row = F.struct(F.col("event_year").alias("p"), "w", "lacking", *DEMOGRAPHICS)
    people = _claim_profiles(a, b).groupBy("person").agg(
        F.collect_list(F.when(F.col("from_a"), row)).alias("a"),
        F.collect_list(F.when(~F.col("from_a"), row)).alias("b"),
    )
    return (
        _imputed(people, "a", "b", b_name, years),
        _imputed(people, "b", "a", a_name, years),
    )


def impute_demographics(
    a: DataFrame, b: DataFrame, a_name: str, b_name: str, years: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Both claim tables with imputed demographics, each filled from the other source.

    Imputation runs on the person-year profiles (small); the claims meet the result in one
    equi-join whose hot persons adaptive execution splits.
    """
    filled_a, filled_b = impute_profiles(a, b, a_name, b_name, years)
    keys = ["person", "event_year"]
    return (
        attach_best(a, filled_a.drop("lacking"), keys),
        attach_best(b, filled_b.drop("lacking"), keys),
    )


def demographics_lookup(
    a: DataFrame, b: DataFrame, a_name: str, b_name: str, years: int = 5
) -> DataFrame:
    """Imputed demographics of the person-years in which some claim lacked a field."""
    filled_a, filled_b = impute_profiles(a, b, a_name, b_name, years)
    both = filled_a.unionByName(filled_b)
    return both.filter("lacking").drop("lacking").distinct()


def backfill(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], cols: Mapping[str, str]
) -> DataFrame:
    """Fill the nulls of each column from the lookup column it maps to."""
    table = lookup.select(*keys, *[F.col(s).alias(f"__{c}") for c, s in cols.items()])
    return (
        df.join(table, list(keys), "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in cols})
        .drop(*[f"__{c}" for c in cols])
    )


def data_loss(before: DataFrame, after: DataFrame, key: str, stage: str) -> DataFrame:
    """Rows and persons lost between two stages, with percentages."""

    def size(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("persons")
        ).withColumn("tag", F.lit(tag))

    both = size(before, "before").unionByName(size(after, "after"))

    def pick(tag: str, c: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.col(c)))

    def share(c: str) -> Column:
        lost = (pick("before", c) - pick("after", c)) * 100.0
        return F.round(F.try_divide(lost, pick("before", c)), 6)

    return both.agg(
        pick("before", "rows").alias("rows_before"),
        pick("after", "rows").alias("rows_after"),
        (pick("before", "rows") - pick("after", "rows")).alias("rows_lost"),
        share("rows").alias("rows_lost_pct"),
        (pick("before", "persons") - pick("after", "persons")).alias("persons_lost"),
        share("persons").alias("persons_lost_pct"),
    ).select(F.lit(stage).alias("stage"), "*")


def clean_medical(
    df: DataFrame, date_text: str = "date_text", age: str = "age_imputed",
    first: int = FIRST_YEAR, last: int = LAST_YEAR,
) -> DataFrame:
    """Clean-tier medical claims: real dates, band, year and a quality label."""
    fields = [f"{d}_imputed" for d in DEMOGRAPHICS]
    needed = [f"{d}_imputed" for d in ("age", "gender", "race", "payer")]
    out = df.filter(is_valid_claim("person", date_text, first, last)).withColumns(
        {
            "event_date": parse_yyyymmdd(date_text),
            "event_year": event_year(date_text),
            "age_band": age_band(age),
        }
    )
    return quality_level(out.filter(is_plausible_date("event_date")), fields, needed)


def clean_pharmacy(
    df: DataFrame, mapping: DataFrame, drug: str = "drug_name", date_text: str = "date_text",
    age: str = "age_imputed", first: int = FIRST_YEAR, last: int = LAST_YEAR,
) -> DataFrame:
    """Clean-tier pharmacy claims: valid rows plus the canonical drug name."""
    rows = df.filter(is_valid_claim("person", date_text, first, last))
    rows = rows.withColumns({"event_year": event_year(date_text), "age_band": age_band(age)})
    return standardize_drug(rows, mapping, drug)


def append_new(main: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of ``part`` whose key ``main`` lacks, added to ``main``."""
    fresh = part.join(main.select(key).distinct(), key, "left_anti")
    return main.unionByName(fresh, allowMissingColumns=True)


def already_loaded(main: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of ``part`` whose key ``main`` already holds."""
    return part.join(main.select(key).distinct(), key, "left_semi")
