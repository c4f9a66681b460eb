"""All registered queries. Importing the package fills ``QUERIES`` and ``ORACLES``."""

from tidewell.catalog import core, flows, lp, pools, risk, scale, strategy, upstream, wallets, whales  # noqa: F401
from tidewell.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
