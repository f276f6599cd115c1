"""Instrument codes: one canonical spelling for every way a feed writes them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_code(code: Column) -> Column:
    """``600000.SH`` from any of ``sh600000``, ``600000SH``, ``600000.sh`` or padded spellings.

    Null stays null. A text that is not six digits and a two-letter exchange is returned trimmed and in
    capitals, so that it remains a key of its own. Runs inside whole-stage codegen; the usual spelling is
    recognised by four byte comparisons, and only the others are rewritten.
    """
    exchange = F.substring(code, 8, 2)
    usual = (F.length(code) == 9) & (F.substring(code, 7, 1) == ".") & exchange.isin("SH", "SZ", "BJ") & F.substring(code, 1, 1).between("0", "9")
    squeezed = F.translate(F.upper(code), " .\t\r\n_-　 ", "")
    digits_first = F.concat(F.substring(squeezed, 1, 6), F.lit("."), F.substring(squeezed, 7, 2))
    letters_first = F.concat(F.substring(squeezed, 3, 6), F.lit("."), F.substring(squeezed, 1, 2))
    return (
        F.when(usual, code)
        .when(F.length(squeezed) != 8, F.upper(F.trim(code)))
        .when(F.substring(squeezed, 1, 1).between("0", "9"), digits_first)
        .otherwise(letters_first)
    )


def code_from_file_stem(stem: Column) -> Column:
    """``sh600000`` to ``600000.SH``."""
    return F.concat(F.substring(stem, 3, 20), F.lit("."), F.upper(F.substring(stem, 1, 2)))


def exchange_of(code: Column) -> Column:
    """The two letters after the dot of a canonical code."""
    return F.substring_index(code, ".", -1)


def as_number(value: Column) -> Column:
    """A double in which NaN counts as no value, like null."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
