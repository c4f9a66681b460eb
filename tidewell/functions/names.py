"""Name handling for assets, pools and chains, and display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.nulls import empty_to_null

# Spellings of coin ids as delivered by the price source, and as reported.
COIN_ALIASES = {
    "avalanche-2": "avalanche",
    "oec-binance-coin": "binance-coin",
    "terra-luna": "luna",
}

# Coin ids and the vault token each one prices.
TOKEN_ROWS = [
    ("solana", "SOL"),
    ("msol", "mSOL"),
    ("bitcoin", "BTC"),
    ("ethereum", "ETH"),
    ("terra-luna", "LUNA"),
]


def coin_alias(c: Column) -> Column:
    """Report spelling of a coin id; the alias may be a part of a longer id."""
    for raw, shown in COIN_ALIASES.items():
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def canonical_asset(c: Column) -> Column:
    """Synthetic assets are written ``CHAIN/TOKEN``; fold them onto the native ``CHAIN.TOKEN``."""
    return F.translate(c, "/", ".")


def pool_chain(pool: Column) -> Column:
    return empty_to_null(F.regexp_extract(pool, r"^\p{Alnum}+", 0))


def pool_token(pool: Column) -> Column:
    return empty_to_null(F.regexp_extract(pool, r"\.(\p{Alnum}+)(?=$|-)", 1))


def pool_short_name(pool: Column) -> Column:
    """Pool name without the contract suffix."""
    return F.regexp_replace(pool, r"-\p{Graph}+$", "")


def short_name_chain(short_name: Column) -> Column:
    return empty_to_null(F.regexp_extract(short_name, r"^(\p{Alpha}+)\.", 1))


def percent(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def dollar(c: Column, digits: int = 0) -> Column:
    return F.concat(F.when(c < 0, "-$").otherwise("$"), F.format_number(F.abs(c), digits))


def significant(c: Column, digits: int = 2) -> Column:
    """A number as text with ``digits`` significant digits; whole digits are never cut off."""
    c = c.cast("double")
    # as 1.2e-03, which knows the place of the first digit after rounding
    written = F.format_string(f"%.{max(digits - 1, 0)}e", c)
    lead = F.split_part(written, F.lit("e"), F.lit(-1)).cast("int")
    decimals = F.least(F.greatest(F.lit(digits - 1) - lead, F.lit(0)), F.lit(300))
    shown = F.call_function("format_number", c, decimals)
    return F.when(c.isNotNull(), F.replace(shown, F.lit(","), F.lit("")))


def format_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every fractional column as text with ``digits`` significant digits. Meant as the last step."""
    shown = {
        f.name: significant(F.col(f.name), digits)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    }
    return df.withColumns(shown) if shown else df
