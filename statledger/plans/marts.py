"""Season aggregate and derived metrics."""

from pyspark.sql import Column, DataFrame, functions as F

from statledger.functions import ratio
from statledger.operators.windows import rolling_average

_AVERAGED = ["minutes", "points", "rebounds", "assists", "steals", "blocks", "turnovers"]
_SHOTS = ["fg", "fg3", "ft"]


_GROUP = ["player_id", "season_id", "game_type"]
# The mergeable parts of a group: each sums up over any division of its lines.
SUMS = [
    "games_played",
    *[f"{part}_{name}" for name in _AVERAGED for part in ("sum", "count")],
    *[f"total_{shot}_{part}" for shot in _SHOTS for part in ("made", "attempted")],
]


def exact_average(total: Column, count: Column) -> Column:
    """Average with one decimal of a sum and a count; ties round as in exact arithmetic."""
    whole = "decimal(18,0)"
    return F.round(total.cast("decimal(18,1)") / F.nullif(count.cast(whole), F.lit(0).cast(whole)), 1)


def season_sums(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Sums and counts per player, season and game type.

    A player who holds a large share of the lines is reduced by the partial aggregate
    before the shuffle.
    """
    played = games.select(
        F.col("nba_game_id").alias("game_id"), F.col("season_id"), F.col("game_type")
    )
    parts = {"games_played": F.count("*")}
    for name in _AVERAGED:
        # Whole or short decimal values, held as longs.
        parts[f"sum_{name}"] = F.sum(name).cast("decimal(18,1)")
        parts[f"count_{name}"] = F.count(name)
    for shot in _SHOTS:
        for part in ("made", "attempted"):
            parts[f"total_{shot}_{part}"] = F.sum(F.col(f"{shot}_{part}").cast("bigint"))
    return stats.join(played, "game_id").groupBy(*_GROUP).agg(*[parts[name].alias(name) for name in SUMS])


def merged_sums(sums: DataFrame) -> DataFrame:
    """One row per group of several parts of season_sums."""
    kinds = dict(sums.dtypes)
    return sums.groupBy(*_GROUP).agg(*[F.sum(name).cast(kinds[name]).alias(name) for name in SUMS])


def stats_of_sums(sums: DataFrame, players: DataFrame, seasons: DataFrame) -> DataFrame:
    """The season aggregate of its sums: names, averages and shooting shares."""
    named = sums.join(
        players.select(F.col("nba_player_id").alias("player_id"), "full_name"), "player_id"
    ).join(seasons.select(F.col("season_label").alias("season_id"), "season_label"), "season_id")
    shots = []
    for shot in _SHOTS:
        made, attempted = F.col(f"total_{shot}_made"), F.col(f"total_{shot}_attempted")
        shots += [made, attempted, F.round(ratio(made, attempted), 3).alias(f"{shot}_pct")]
    return named.select(
        "player_id", "full_name", "season_id", "season_label", "game_type", "games_played",
        *[exact_average(F.col(f"sum_{name}"), F.col(f"count_{name}")).alias(f"avg_{name}") for name in _AVERAGED], *shots,
    )


def player_season_stats(
    stats: DataFrame, players: DataFrame, games: DataFrame, seasons: DataFrame
) -> DataFrame:
    """One row per player, season and game type.

    Names and seasons join after the aggregate: they depend on the group keys
    alone, so only group rows take part, not the box-score lines.
    """
    return stats_of_sums(season_sums(stats, games), players, seasons)


def regular_season(season_stats: DataFrame, season_label: str = None, game_type: str = "Regular Season") -> DataFrame:
    """The default slice of the season aggregate."""
    rows = season_stats.where(F.col("game_type") == game_type)
    return rows if season_label is None else rows.where(F.col("season_label") == season_label)


def points_rebounds_assists() -> Column:
    return F.col("points") + F.col("rebounds") + F.col("assists")


def with_derived_metrics(stats: DataFrame) -> DataFrame:
    """Per-line metrics that are never stored: the sum of the three main counts and
    the shooting shares (NULL without attempts)."""
    return stats.withColumns({
        "pra": points_rebounds_assists(),
        **{
            f"{shot}_pct": ratio(F.col(f"{shot}_made"), F.col(f"{shot}_attempted"))
            for shot in _SHOTS
        },
    })


def rolling_player_average(stats: DataFrame, games: DataFrame, value: str, n_games: int, ranges: int = None) -> DataFrame:
    """Average of a stat over each player's last n games of the same game type."""
    dated = stats.join(
        games.select(F.col("nba_game_id").alias("game_id"), "game_date", "game_type"), "game_id"
    )
    return rolling_average(
        dated, ["player_id", "game_type"], "game_date", "game_id", value, n_games,
        f"avg_{value}_last_{n_games}", ranges,
    )
