"""Coverage and fill-rate profiles."""

from pyspark.sql import DataFrame, functions as F

from statledger.functions import ratio


def season_spans(games: DataFrame, label: str = "season_label", day: str = "game_date") -> DataFrame:
    """First and last game day per season; games without a label do not count."""
    return (
        games.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"))
    )


def high_water_mark(games: DataFrame, day: str = "game_date") -> DataFrame:
    """One row: the day after the latest game, and today."""
    return games.agg(F.date_add(F.max(day), 1).alias("since")).withColumn(
        "until", F.current_date()
    )


def coverage(
    games: DataFrame, game_key: str, season: str, rows: DataFrame, row_key: str
) -> DataFrame:
    """Per season: games, games that have rows, and their share.

    The rows are reduced to distinct keys first, so a game with very many rows
    meets the join once.
    """
    covered = rows.select(F.col(row_key).alias("_covered")).distinct()
    return (
        games.join(covered, F.col(game_key) == F.col("_covered"), "left")
        .groupBy(season)
        .agg(
            F.count("*").alias("n_games"),
            F.count("_covered").alias("n_covered"),
        )
        .withColumn("coverage", F.round(ratio(F.col("n_covered"), F.col("n_games")), 4))
    )


def coverage_gaps(audit: DataFrame, threshold: float) -> DataFrame:
    """Seasons below the threshold share."""
    return audit.where(F.col("coverage") < F.lit(threshold))


def fill_rates(df: DataFrame, by: list, columns: list, moment: str) -> DataFrame:
    """Per slice: row count, filled share of each column, first and last moment."""
    shares = [
        F.round(ratio(F.count(name), F.count("*")), 4).alias(f"filled_{name}") for name in columns
    ]
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *shares,
        F.min(moment).alias("first_moment"),
        F.max(moment).alias("last_moment"),
    )

