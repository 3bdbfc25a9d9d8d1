"""The stored season aggregate, kept current from the lines that are new."""

from pyspark.sql import DataFrame, functions as F

from statledger.plans.marts import merged_sums, season_sums, stats_of_sums
from statledger.plans.season_state import SEASON, SeasonState, create_by_season
from statledger.plans.warehouse import SEASON_STATS, Staging, Warehouse, staged


def player_sums(warehouse: Warehouse) -> SeasonState:
    """Sums and counts per player, season and game type."""
    def by_season(sums: DataFrame) -> DataFrame:
        return sums.withColumn(SEASON, F.col("season_id"))

    return SeasonState(
        warehouse, "player_game_stats", "player_season_sums",
        lambda lines: by_season(season_sums(lines, warehouse.table("games"))), lambda sums: by_season(merged_sums(sums)),
    )


@staged
def refresh_season_stats(warehouse: Warehouse, full: bool = False, staging: Staging = None) -> list:
    """Brings the season aggregate up to date; returns the seasons that it wrote.

    Reads the lines that are new, merges their sums into those of their seasons and writes
    these seasons again. `full` starts from nothing.
    """
    sums = player_sums(warehouse)
    stale = _stale_seasons(warehouse, sums, sums.refresh(staging, full))
    if stale:
        chosen = sums.rows().where(F.col(SEASON).isin(stale)).drop(SEASON)
        rows = stats_of_sums(chosen, warehouse.table("players"), warehouse.table("seasons"))
        create_by_season(warehouse, SEASON_STATS, rows)
        warehouse.replace_partitions(SEASON_STATS, rows, SEASON, stale)
    return stale


def _stale_seasons(warehouse: Warehouse, sums: SeasonState, refreshed: list) -> list:
    """The refreshed seasons, and those that an earlier refresh has left before it wrote them."""
    rows = sums.rows()
    if rows is None:
        return []
    summed = rows.groupBy(SEASON).agg(F.sum("games_played").alias("summed"))
    if not warehouse.exists(SEASON_STATS):
        return sorted(row[SEASON] for row in summed.collect())
    shown = warehouse.table(SEASON_STATS).groupBy(SEASON).agg(F.sum("games_played").alias("shown"))
    differ = summed.join(shown, SEASON, "left").where("not summed <=> shown").select(SEASON).collect()
    return sorted({*refreshed, *(row[SEASON] for row in differ)})
