"""One declared schema per dataset. Readers use these instead of inferring types from payloads."""

from __future__ import annotations

SCHEMAS = {
    "price_history": "coin_id string, timestamp timestamp_ntz, vs_currency string, price double, "
    "total_volume double, market_cap double",
    "token_dim": "coin_id string, token string",
    "vault_accounts": "address string, token string, vault string",
    "vault_events": "block_timestamp timestamp_ntz, type string, vault string, amount double, address string",
    "wallet_swap_stats": "swapper string, swaps long, swapped_for long",
    "asset_popularity": "swap_to_asset_id string, asset_name string, swaps long, rank int",
    "asset_popularity_by_dex": "swap_program string, swap_to_asset_id string, asset_name string, "
    "swaps long, rank int",
    "balances": "address string, rune_wallet_balance double, rune_lp_balance double, "
    "rune_total_balance double",
    "pool_swaps_daily": "date timestamp_ntz, from_asset string, pool_name string, fees_usd double, "
    "from_amount_usd double, swaps long",
    "pool_daily": "day date, pool_name string, added_liquidity_usd double, "
    "withdrawn_liquidity_usd double, tvl double, asset_liquidity double, rune_liquidity double, "
    "asset_price_usd double, rune_price_usd double",
    "platform_tvl": "day date, total_value_pooled_usd double",
    "whales": "address string, balance double, address_name string, closed_at timestamp_ntz, "
    "account_closed boolean, rewardsbase double, rewards_total double, created_at timestamp_ntz",
    "whale_swaps": "block_timestamp timestamp_ntz, swapper string, swap_from_name string, "
    "swap_to_name string",
    "lp_positions": "wallet string, pool_name string, lp_position double",
    "pool_liquidity_usd": "day date, pool_name string, total_liquidity_usd double",
    "raw_tx_events": "block_timestamp timestamp_ntz, program_id string, accounts array<string>, "
    "inner_instructions array<struct<type:string,amount:double>>, signer string",
    "accounts": "address string, balance double, wallet_type string, account_closed boolean",
    "labels": "address string",
    "transfers": "tx_id string, from_address string, to_address string, amount double",
    "liquidity_actions": "address string, pool_name string, action string, stake_units double",
}
