"""Drug-name clean-up, name features and the fixed-width drug encoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from careloom.constants import (
    CHEMICAL_SUFFIXES,
    DEVICE_WORDS,
    ENCODING_LAYOUTS,
    LETTER_CODES,
)
from careloom.functions.columns import col


def _long_salt_name(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)_hcl(?=[^a-zA-Z]|$)", "_hydrochloride")


def clean_drug_name(name: str | Column) -> Column:
    """Drop a leading ``drug_``, turn + and / into _, spell out the _hcl ending."""
    bare = F.regexp_replace(col(name), "(?i)^drug_", "")
    return F.trim(_long_salt_name(F.translate(bare, "+/", "__")))


def clean_drug_name_simple(name: str | Column) -> Column:
    """Lower-case snake form of a drug name; ``{unnest: x}`` wrappers are opened first."""
    c = F.regexp_replace(col(name), r"\{[^}]*:\s*([^}]+)\}", "$1")
    c = F.translate(F.lower(c), "+/", "__")
    c = F.regexp_replace(c, r"[^a-z0-9\s_]", "")
    c = F.regexp_replace(c, r"[\s_]+", "_")
    return _long_salt_name(F.regexp_replace(c, "^_|_$", ""))


def sort_combination(name: str | Column, sep: str = "+") -> Column:
    """Parts of a combination in alphabetical order."""
    return F.array_join(F.sort_array(F.split(col(name), rf"\{sep}")), sep)


def normalize_report_drug(name: str | Column) -> Column:
    """Adverse-event spelling: punctuation to blanks, blanks to _, / to +, sorted parts."""
    c = F.lower(F.trim(F.regexp_replace(col(name), r"""[_"'():;,.!?\-]""", " ")))
    return sort_combination(F.translate(c, " /", "_+"))


def standardize_report_drug(name: str | Column) -> Column:
    """Table spelling: lower case, no trailing /, blanks to _, / to +, sorted parts."""
    c = F.regexp_replace(F.lower(col(name)), "/$", "")
    return sort_combination(F.translate(c, " /", "_+"))


def device_to_marker(name: str | Column) -> Column:
    """Replace the names of devices and supplies by 'not_drug'."""
    c = col(name)
    return F.when(F.lower(c).rlike("|".join(DEVICE_WORDS)), F.lit("not_drug")).otherwise(c)


def tokenize_drug(name: str | Column) -> Column:
    parts = F.filter(F.split(F.trim(col(name)), "[ ,;]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.concat(F.lit("drug_"), t))


def name_words(name: str | Column) -> Column:
    """Lower-case alphanumeric words of a name."""
    words = F.transform(
        F.split(F.lower(col(name)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
    )
    return F.filter(words, lambda w: w != "")


def rule_code(words: str | Column, rule_codes: Mapping[str, str]) -> Column:
    """Codes of the words that have one, sorted and joined by _."""
    table = F.create_map(*[F.lit(x) for pair in sorted(rule_codes.items()) for x in pair])
    codes = F.filter(F.transform(col(words), lambda w: F.try_element_at(table, w)),
                     lambda c: c.isNotNull())
    return F.array_join(F.sort_array(codes), "_")


def drug_text_features(name: str | Column) -> dict[str, Column]:
    """Spelling features of a cleaned drug name."""
    c = clean_drug_name(name)
    low = F.lower(c)
    vowel_runs = F.regexp_count(low, F.lit("[aeiouy]+"))
    syllables = vowel_runs - F.when(low.endswith("e"), 1).otherwise(0)
    letters = F.filter(F.split(low, ""), lambda ch: ch.rlike(r"^\p{L}$"))
    repeated = F.filter(
        F.array_distinct(letters), lambda ch: F.size(F.filter(letters, lambda x: x == ch)) > 1
    )
    suffixes = F.lit(0)
    for ending in CHEMICAL_SUFFIXES:
        suffixes = suffixes + low.endswith(ending).cast("int")
    return {
        "length": F.length(c),
        "syllables": F.when(F.length(c) == 0, 0).otherwise(
            F.when(syllables == 0, 1).otherwise(syllables)
        ),
        "consonants": F.regexp_count(low, F.lit("[b-df-hj-np-tv-z]")),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")),
        "separators": F.regexp_count(c, F.lit("[-_]")),
        "suffixes": suffixes,
        "clusters": F.regexp_count(low, F.lit("[b-df-hj-np-tv-z]{2,}")),
        "repeats": F.size(repeated),
    }


def _first_letter(name: str | Column) -> Column:
    first = F.upper(F.regexp_extract(clean_drug_name(name), r"(\p{L})", 1))
    return F.when(first == "", "X").otherwise(first)


def encode_drug(name: str | Column, metrics: Mapping[str, str | Column], layout: int = 29) -> Column:
    """Fixed-width digit string of a drug.

    ``metrics`` gives the columns of the metric fields of the layout; shares are scaled by 1000,
    rule counts are used as they are, missing ones count as 0.
    """
    letter = _first_letter(name)
    if layout == 29:
        table = F.create_map(*[F.lit(x) for pair in LETTER_CODES.items() for x in pair])
        letter_code = F.coalesce(F.try_element_at(table, letter), F.lit(0))
    else:
        letter_code = F.when(letter == "X", 0).otherwise(F.ascii(letter) - F.ascii(F.lit("A")) + 1)
    values = {"letter": letter_code, **drug_text_features(name)}
    for field in ("support", "confidence", "certainty"):
        share = F.coalesce(col(metrics[field]), F.lit(0.0)) if field in metrics else F.lit(0.0)
        values[field] = (share * 1000).cast("int")
    for field in ("num_rules", "num_drugs"):
        values[field] = F.coalesce(col(metrics[field]), F.lit(0)) if field in metrics else F.lit(0)

    def padded(field: str, width: int) -> Column:
        # Values wider than their field keep all digits, as zero-filling does.
        text = values[field].cast("string")
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))

    return F.concat(*[padded(field, width) for field, width in ENCODING_LAYOUTS[layout]])


def parse_encoding(encoding: str | Column, layout: int = 29) -> dict[str, Column]:
    """Integer fields of an encoding; null when the text has another length."""
    c = col(encoding)
    out, start = {}, 1
    for field, width in ENCODING_LAYOUTS[layout]:
        part = F.substring(c, start, width)
        out[field] = F.when(F.length(c) == layout, part.try_cast("int"))
        start += width
    return out


def parse_rule(text: str | Column) -> dict[str, Column]:
    """'support_confidence_lift' text to three doubles."""
    parts = F.split(col(text), "_")
    return {
        field: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
        for i, field in enumerate(["support", "confidence", "lift"])
    }


def is_valid_rule(
    support: str | Column, confidence: str | Column, lift: str | Column,
    min_support: float, min_confidence: float, min_lift: float,
) -> Column:
    return (
        (col(support) >= min_support)
        & (col(confidence) >= min_confidence)
        & (col(lift) >= min_lift)
    )
