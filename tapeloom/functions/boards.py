"""Boards of instruments and their price limits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings in use for each board, in lower case.
BOARD_NAMES = {
    "main": ("主板", "main", "main board"),
    "chinext": ("创业板", "創業板", "chinext", "gem"),
    "star": ("科创板", "科創板", "star", "star market"),
    "bse": ("北交所", "bse", "beijing"),
}


def board_name(board: Column) -> Column:
    """``main``, ``chinext``, ``star`` or ``bse`` from any spelling; null if it is none of them."""
    said = F.lower(F.translate(board, " \t　 ", ""))
    out = F.lit(None).cast("string")
    for name, spellings in BOARD_NAMES.items():
        out = F.when(said.isin(*[s.replace(" ", "") for s in spellings]), F.lit(name)).otherwise(out)
    return out


def board_of(code: Column) -> Column:
    """Board by the first two digits of a canonical code; ``other`` if they name none."""
    head = F.substring(code, 1, 2)
    return F.when(head.isin("60", "00"), "main").when(head == "30", "chinext").when(head == "68", "star").when(head == "92", "bse").otherwise("other")


def board_of_event(board: str, code: str) -> Column:
    """The board as written, or else by the code."""
    return F.coalesce(board_name(F.col(board)), board_of(F.col(code)))


# Fixed value: the first session with the wide limit on the second board.
CHINEXT_WIDE_FROM = "2020-08-24"


def limit_share(board: Column, date: Column) -> Column:
    """Daily limit of a board on a date: 10, 20 or 30 per cent; null for other boards."""
    narrow = (board == "main") | ((board == "chinext") & (date < F.lit(CHINEXT_WIDE_FROM).cast("date")))
    return F.when(narrow, 0.10).when(board.isin("chinext", "star"), 0.20).when(board == "bse", 0.30)


def board_strict(code: Column) -> Column:
    """Board by exchange and the first three digits; null if the pair is none of the known ones."""
    head, exchange = F.substring(code, 1, 3), F.substring(code, 8, 2)
    return (
        F.when((exchange == "SH") & head.isin("688", "689"), "star")
        .when((exchange == "SZ") & head.isin("300", "301", "302"), "chinext")
        .when((exchange == "BJ") & (F.substring(code, 1, 2) == "92"), "bse")
        .when(((exchange == "SH") & head.between("600", "605")) | ((exchange == "SZ") & head.between("000", "003")), "main")
    )


def limit_share_by_code(code: Column) -> Column:
    """Limit by code alone, as the pattern search uses it."""
    return F.when(F.substring(code, 1, 3).isin("300", "301", "688", "689"), 0.20).when(F.substring(code, 1, 1).isin("4", "8"), 0.30).otherwise(0.10)


def exchange_of_symbol(symbol: Column) -> Column:
    """Exchange of a bare six-digit symbol."""
    head = F.substring(symbol, 1, 1)
    return F.when(head == "6", "SH").when(head.isin("0", "3"), "SZ").when(head.isin("4", "8", "9"), "BJ")


def in_universe(stem: Column) -> Column:
    """Whether a day-file stem (``sh600000``) is a listed share of the three exchanges."""
    return stem.rlike(r"^(sh(60[0-5]|68[89])|sz(00[0-3]|30[0-2])|bj92)\d+$")
