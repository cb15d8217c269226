"""Option instrument names of the three venues, split into their parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from varstrip.functions.scalar import NUMBER_PATTERN


@dataclass(frozen=True)
class NameGrammar:
    """Where each part sits in a dash-separated instrument name."""

    parts: int
    asset: int
    expiry: int
    strike: int
    kind: int
    quote: int | None
    quote_text: str | None
    date_pattern: str
    date_format: str


MONTH_NAMES = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
_DAY_MONTH_YEAR = dict(date_pattern=rf"^[0-9]{{1,2}}({MONTH_NAMES})[0-9]{{2}}$", date_format="dMMMyy")

GRAMMARS = {
    # BTC-30JUN26-100000-C
    "deribit": NameGrammar(4, 0, 1, 2, 3, None, None, **_DAY_MONTH_YEAR),
    # BTC-USD-260731-64000-P
    "okx": NameGrammar(5, 0, 2, 3, 4, 1, "USD", r"^[0-9]{6}$", "yyMMdd"),
    # BTC-26MAR27-78000-P-USDT
    "bybit": NameGrammar(5, 0, 1, 2, 3, 4, "USDT", **_DAY_MONTH_YEAR),
}


def expiry_of(text: Column, grammar: NameGrammar) -> Column:
    """Settlement time (08:00 UTC) of an expiry code, years 2025 to 2099; NULL if malformed."""
    year = (
        F.substring(text, 1, 2) if grammar.date_format.startswith("yy") else F.right(text, F.lit(2))
    ).try_cast("int")
    day = F.try_to_timestamp(text, F.lit(grammar.date_format))
    good = text.rlike(grammar.date_pattern) & year.between(25, 99)
    return F.when(good, day + F.expr("INTERVAL 8 HOURS"))


def decompose(name: Column, venue: str) -> Column:
    """struct(asset, expiry, strike, kind, reason); reason is NULL for a good name."""
    g = GRAMMARS[venue]
    parts = F.split(name, "-", -1)
    count_ok = F.size(parts) == g.parts

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    asset = F.when(part(g.asset).isin("BTC", "ETH"), F.lower(part(g.asset)))
    expiry = expiry_of(part(g.expiry), g)
    strike = F.when(part(g.strike).rlike(NUMBER_PATTERN), part(g.strike).try_cast("double"))
    kind = F.when(part(g.kind) == "C", F.lit("call")).when(part(g.kind) == "P", F.lit("put"))
    quote_ok = F.lit(True) if g.quote is None else part(g.quote) == g.quote_text
    reason = (
        F.when(name.isNull(), F.lit("missing_name"))
        .when(~count_ok, F.lit("part_count"))
        .when(~quote_ok, F.lit("quote_currency"))
        .when(asset.isNull(), F.lit("asset"))
        .when(expiry.isNull(), F.lit("expiry"))
        .when(strike.isNull(), F.lit("strike"))
        .when(kind.isNull(), F.lit("kind"))
    )
    return F.struct(
        asset.alias("asset"),
        expiry.alias("expiry"),
        strike.alias("strike"),
        kind.alias("kind"),
        reason.alias("reason"),
    )
