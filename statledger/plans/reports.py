"""Audits and constraint reports of the warehouse's own tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from statledger.operators.audit import coverage, coverage_gaps, fill_rates
from statledger.operators.quality import check_violations, duplicate_keys, null_counts, orphans
from statledger.plans.warehouse import Warehouse
from statledger.sources.contracts import CHECKS, KEYS, NOT_NULL

_DIMENSION_KEYS = {"teams": "nba_team_id", "players": "nba_player_id", "seasons": "season_label", "games": "nba_game_id"}
# Foreign keys of the tables, as {column: dimension}.
FOREIGN_KEYS = {
    "games": {"season_id": "seasons", "home_team_id": "teams", "away_team_id": "teams"},
    "team_game_stats": {"game_id": "games", "team_id": "teams"},
    "player_game_stats": {"game_id": "games", "player_id": "players", "team_id": "teams"},
    "play_by_play": {
        "game_id": "games", "player_id": "players", "player2_id": "players",
        "player3_id": "players", "team_id": "teams",
    },
}


def event_coverage(warehouse: Warehouse) -> DataFrame:
    """Per season: games, games with events, and their share."""
    return coverage(
        warehouse.table("games"), "nba_game_id", "season_id", warehouse.table("play_by_play"), "game_id"
    )


def event_gaps(warehouse: Warehouse, threshold: float = 0.5) -> DataFrame:
    """Seasons whose event coverage is below the threshold; candidates for a backfill."""
    return coverage_gaps(event_coverage(warehouse), threshold)


def fill_profile(warehouse: Warehouse, table: str) -> DataFrame:
    """Per season: rows of a fact table, filled share of every column, first and last game day."""
    facts = warehouse.table(table)
    days = warehouse.table("games").select(F.col("nba_game_id").alias("game_id"), "game_date")
    columns = [name for name in facts.columns if name != "season_label"]
    return fill_rates(facts.join(days, "game_id"), ["season_label"], columns, "game_date")


def violations(warehouse: Warehouse, table: str) -> DataFrame:
    """One row per constraint of the table with its number of violations (0 when it holds)."""
    rows = warehouse.table(table)
    key = KEYS[table]
    duplicates = duplicate_keys(rows, key).agg(F.count("*").alias("n_violations"))
    parts = [duplicates.select(F.lit(f"unique {', '.join(key)}").alias("rule"), "n_violations")]
    nulls = null_counts(rows, NOT_NULL[table])
    parts.append(nulls.select(F.concat(F.lit("not null "), "column_name").alias("rule"), F.col("n_nulls").alias("n_violations")))
    if table in CHECKS:
        checks = check_violations(rows, CHECKS[table])
        parts.append(checks.select(F.concat(F.lit("check "), "check_name").alias("rule"), "n_violations"))
    for column, dimension in FOREIGN_KEYS.get(table, {}).items():
        lost = orphans(rows, column, warehouse.table(dimension), _DIMENSION_KEYS[dimension])
        total = lost.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_violations"))
        parts.append(total.select(F.lit(f"{column} in {dimension}").alias("rule"), "n_violations"))
    return reduce(DataFrame.unionByName, parts)
