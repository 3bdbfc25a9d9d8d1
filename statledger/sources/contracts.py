"""Column contracts: clean tables (natural ids) and warehouse tables (DDL)."""

from pyspark.sql import DataFrame, functions as F

from statledger.functions import blank_as_null

# Columns and types of the clean tables.
CLEAN = {
    "teams": {
        "nba_team_id": "int", "abbreviation": "string", "city": "string",
        "name": "string", "conference": "string", "division": "string",
    },
    "players": {
        "nba_player_id": "int", "full_name": "string", "birthdate": "date",
        "height_in": "int", "weight_lb": "int", "draft_year": "int",
    },
    "seasons": {"season_label": "string", "start_date": "date", "end_date": "date"},
    "games": {
        "nba_game_id": "string", "game_date": "date", "game_type": "string",
        "home_nba_team_id": "int", "away_nba_team_id": "int",
        "home_score": "int", "away_score": "int", "season_label": "string",
    },
    "team_game_stats": {
        "nba_game_id": "string", "nba_team_id": "int", "rebounds": "int",
        "assists": "int", "turnovers": "int", "points": "int",
    },
    "player_game_stats": {
        "nba_game_id": "string", "nba_player_id": "int", "nba_team_id": "int",
        "minutes": "decimal(4,1)", "points": "int", "rebounds": "int",
        "assists": "int", "steals": "int", "blocks": "int", "turnovers": "int",
        "fg_made": "int", "fg_attempted": "int", "fg3_made": "int",
        "fg3_attempted": "int", "ft_made": "int", "ft_attempted": "int",
    },
    "play_by_play": {
        "nba_game_id": "string", "sequence": "int", "period": "smallint",
        "clock": "string", "event_type": "string", "sub_type": "string",
        "description": "string", "nba_player_id": "int", "nba_player2_id": "int",
        "nba_player3_id": "int", "nba_team_id": "int", "score_home": "int",
        "score_away": "int", "shot_x": "decimal(6,2)", "shot_y": "decimal(6,2)",
        "shot_distance": "int", "shot_made": "boolean",
    },
}

# Columns and limits of the warehouse tables. Ids are the league's
# own; facts carry season_label so that they can be partitioned by it.
TABLES = {
    "teams": {
        "nba_team_id": "INT", "abbreviation": "VARCHAR(10)", "city": "VARCHAR(100)",
        "name": "VARCHAR(100)", "conference": "VARCHAR(10)", "division": "VARCHAR(20)",
    },
    "players": {
        "nba_player_id": "INT", "full_name": "VARCHAR(120)", "birthdate": "DATE",
        "height_in": "SMALLINT", "weight_lb": "SMALLINT", "draft_year": "SMALLINT",
    },
    "seasons": {"season_label": "VARCHAR(10)", "start_date": "DATE", "end_date": "DATE"},
    "games": {
        "nba_game_id": "VARCHAR(20)", "season_id": "VARCHAR(10)", "game_date": "DATE",
        "game_type": "VARCHAR(20)", "home_team_id": "INT", "away_team_id": "INT",
        "home_score": "SMALLINT", "away_score": "SMALLINT",
    },
    "team_game_stats": {
        "game_id": "VARCHAR(20)", "team_id": "INT", "points": "SMALLINT",
        "rebounds": "SMALLINT", "assists": "SMALLINT", "turnovers": "SMALLINT",
        "season_label": "STRING",
    },
    "player_game_stats": {
        "game_id": "VARCHAR(20)", "player_id": "INT", "team_id": "INT",
        "minutes": "DECIMAL(4,1)", "points": "SMALLINT", "rebounds": "SMALLINT",
        "assists": "SMALLINT", "steals": "SMALLINT", "blocks": "SMALLINT",
        "turnovers": "SMALLINT", "fg_made": "SMALLINT", "fg_attempted": "SMALLINT",
        "fg3_made": "SMALLINT", "fg3_attempted": "SMALLINT", "ft_made": "SMALLINT",
        "ft_attempted": "SMALLINT", "season_label": "STRING",
    },
    "play_by_play": {
        "game_id": "VARCHAR(20)", "sequence": "INT", "period": "SMALLINT",
        "clock": "VARCHAR(20)", "event_type": "VARCHAR(40)", "sub_type": "VARCHAR(60)",
        "description": "VARCHAR(255)", "player_id": "INT", "player2_id": "INT",
        "player3_id": "INT", "team_id": "INT", "score_home": "SMALLINT",
        "score_away": "SMALLINT", "shot_x": "DECIMAL(6,2)", "shot_y": "DECIMAL(6,2)",
        "shot_distance": "SMALLINT", "shot_made": "BOOLEAN", "season_label": "STRING",
    },
}

# Unique keys, NOT NULL columns and row checks of the tables.
KEYS = {
    "teams": ["nba_team_id"],
    "players": ["nba_player_id"],
    "seasons": ["season_label"],
    "games": ["nba_game_id"],
    "team_game_stats": ["game_id", "team_id"],
    "player_game_stats": ["game_id", "player_id"],
    "play_by_play": ["game_id", "sequence"],
}
NOT_NULL = {
    "teams": ["nba_team_id", "abbreviation", "city", "name"],
    "players": ["nba_player_id", "full_name"],
    "seasons": ["season_label"],
    "games": ["nba_game_id", "season_id", "game_date", "game_type", "home_team_id", "away_team_id"],
    "team_game_stats": ["game_id", "team_id"],
    "player_game_stats": ["game_id", "player_id", "team_id"],
    "play_by_play": ["game_id", "sequence", "period", "event_type"],
}
CHECKS = {
    "games": {"distinct_teams": "home_team_id <> away_team_id"},
    "player_game_stats": {"points_nonneg": "points >= 0", "minutes_nonneg": "minutes >= 0"},
}
PARTITIONED = ["team_game_stats", "player_game_stats", "play_by_play"]


def conform(df: DataFrame, contract: dict) -> DataFrame:
    """Exactly the contract's columns, in order and type.

    Blank text becomes NULL. A value that does not fit its type fails the job;
    a column the frame lacks is NULL.
    """
    present = set(df.columns)
    columns = []
    for name, kind in contract.items():
        column = F.col(name) if name in present else F.lit(None)
        if kind == "string":
            column = blank_as_null(column.cast("string"))
        columns.append(column.cast(kind).alias(name))
    return df.select(*columns)
