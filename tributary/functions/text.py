"""Text: cleaning, names, companies, lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.dims import LEGAL_FORMS

#: White space as Unicode has it; Java's \\s is ASCII only.
SPACES = r"\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space that isn't one plain space, which can stay as it is.
ODD_SPACE = rf" *[\t-\r{SPACES}][\s{SPACES}]*| {{2,}}"
UNPRINTABLE = r"[^\x{0020}-\x{007E}\x{00A0}-\x{FFFF}]"


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def clean(c: Column) -> Column:
    """Single spaces, no control characters, trimmed; null if nothing is left. White space is collapsed before control characters go, so words on two lines stay two words."""
    single = F.regexp_replace(c, ODD_SPACE, " ")
    printable = F.regexp_replace(F.regexp_replace(single, UNPRINTABLE, ""), " {2,}", " ")
    return null_if_empty(F.trim(F.when(single.rlike(UNPRINTABLE), printable).otherwise(single)))


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first and small letters after: O'Brien, Jean-Luc."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), capitalised), "")


def title_name(c: Column) -> Column:
    return title_case(clean(c))


def company_case(c: Column) -> Column:
    """Words capitalised, legal forms in capitals with one full stop at most."""

    def word(w: Column) -> Column:
        bare = F.rtrim(w, F.lit("."))
        return F.when(F.lower(bare).isin(*LEGAL_FORMS), F.concat(F.upper(bare), F.when(F.endswith(w, F.lit(".")), ".").otherwise(""))).otherwise(capitalised(w))

    return F.array_join(F.transform(F.split(clean(c), " "), word), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), " +"), lambda w: w != "")


def split_name(c: Column) -> Column:
    """struct(first, middle, last) of ``First Middle Last`` or ``Last, First Middle``."""
    name = clean(c)
    given = words(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))
    parts = words(name)
    joined = lambda a, start, n: null_if_empty(F.array_join(F.slice(a, start, n), " "))
    comma = F.contains(name, F.lit(","))
    size = F.size(parts)
    return F.when(
        name.isNotNull(),
        F.struct(
            F.when(comma, F.get(given, F.lit(0))).otherwise(F.get(parts, F.lit(0))).alias("first"),
            F.when(comma, F.when(F.size(given) > 1, joined(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0))))).when(size > 2, joined(parts, F.lit(2), F.greatest(size - 2, F.lit(0)))).alias("middle"),
            F.when(comma, F.trim(F.regexp_extract(name, r"^([^,]*),", 1))).when(size > 1, F.get(parts, size - 1)).alias("last"),
        ),
    )


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("…"))).otherwise(c)


def display_name(full: Column, first: Column, last: Column) -> Column:
    """The full name, else its parts, else Unknown."""
    parts = null_if_empty(F.concat_ws(" ", null_if_empty(first), null_if_empty(last)))
    return F.coalesce(null_if_empty(full), parts, F.lit("Unknown"))


def nfc(c: Column) -> Column:
    """Composed characters (NFC); Spark has no such function, so this crosses to Python in Arrow batches."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return composed(c)
