"""Cleaning jobs: raw frame in, clean frame with natural ids out.

Raw frames carry the ordinal column of the scans; see operators/dedupe.py.
"""

from pyspark.sql import Column, DataFrame, functions as F

from statledger import functions as fn
from statledger.operators.audit import season_spans
from statledger.operators.dedupe import keep_last
from statledger.operators.filters import distinct_opponents, fill_from_lookup
from statledger.operators.reshape import add_nulls, pair_sides, sides_to_rows
from statledger.sources.contracts import CLEAN, conform

# Stat columns of a player row, by source column.
_STATS = {
    "points": "points", "reboundsTotal": "rebounds", "assists": "assists",
    "steals": "steals", "blocks": "blocks", "turnovers": "turnovers",
    "fieldGoalsMade": "fg_made", "fieldGoalsAttempted": "fg_attempted",
    "threePointersMade": "fg3_made", "threePointersAttempted": "fg3_attempted",
    "freeThrowsMade": "ft_made", "freeThrowsAttempted": "ft_attempted",
}
_TEAM_KEY = ["nba_game_id", "nba_team_id"]


def last_rows(raw: DataFrame, keys: dict, prefer: str = None) -> DataFrame:
    """The last raw row of each key, given as {key column: Column or source name}.

    De-duplicating first leaves fewer rows for the value expressions, which then
    run on all reducers.
    """
    named = raw.withColumns({
        name: F.col(source) if isinstance(source, str) else source for name, source in keys.items()
    })
    return keep_last(named, list(keys), prefer=prefer)


def project(df: DataFrame, columns: dict) -> DataFrame:
    """Only the given columns, as {target: source name or Column}."""
    return df.select(*[
        (F.col(source) if isinstance(source, str) else source).alias(target)
        for target, source in columns.items()
    ])


def _int(column: str) -> Column:
    return fn.nullable_int(F.col(column))


def _ints(columns: dict) -> dict:
    """{target: rounded source} of {source: target}."""
    return {target: _int(source) for source, target in columns.items()}


def _finish(df: DataFrame, table: str) -> DataFrame:
    return conform(df, CLEAN[table])


def clean_teams(raw: DataFrame) -> DataFrame:
    rows = project(last_rows(raw, {"nba_team_id": "id"}), {
        "nba_team_id": "nba_team_id", "abbreviation": "abbreviation", "city": "city", "name": "nickname",
    })
    return _finish(add_nulls(rows, {"conference": "string", "division": "string"}), "teams")


def clean_players(raw: DataFrame, bio: DataFrame) -> DataFrame:
    """Every listed player, with the bio where there is one."""
    players = last_rows(raw, {"nba_player_id": "id"}).select("nba_player_id", "full_name")
    details = project(last_rows(bio, {"nba_player_id": "person_id"}), {
        "nba_player_id": "nba_player_id",
        "birthdate": fn.parse_date(F.col("birthdate")),
        "height_in": fn.parse_height(F.col("height")),
        "weight_lb": fn.nullable_int(fn.number_from_text(F.col("weight"))),
        "draft_year": fn.nullable_int(fn.number_from_text(F.col("draft_year"))),
    })
    return _finish(players.join(details, "nba_player_id", "left"), "players")


def clean_players_backfill(raw: DataFrame) -> DataFrame:
    rows = project(last_rows(raw, {"nba_player_id": "personId"}), {
        "nba_player_id": "nba_player_id",
        "full_name": fn.full_name(F.col("firstName"), F.col("lastName")),
        "birthdate": fn.parse_date(F.col("birthDate")),
        "height_in": _int("heightInches"),
        "weight_lb": _int("bodyWeightLbs"),
        "draft_year": _int("draftYear"),
    })
    return _finish(rows, "players")


def between_franchises(raw: DataFrame, teams: DataFrame, team_key: str = "nba_team_id") -> DataFrame:
    """The export's rows of games between two franchises: what its games and its team lines come from."""
    return distinct_opponents(raw, "team_id_home", "team_id_away", teams, team_key)


def clean_games(raw: DataFrame, teams: DataFrame, team_key: str = "nba_team_id") -> DataFrame:
    """Games between two franchises, season taken from the season code."""
    return games_of(between_franchises(raw, teams, team_key))


def games_of(real: DataFrame) -> DataFrame:
    """The games of rows that are between franchises."""
    rows = project(last_rows(real, {"nba_game_id": "game_id"}), {
        "nba_game_id": "nba_game_id",
        "game_date": fn.parse_date(F.col("game_date")),
        "game_type": "season_type",
        "home_nba_team_id": "team_id_home",
        "away_nba_team_id": "team_id_away",
        "home_score": _int("pts_home"),
        "away_score": _int("pts_away"),
        "season_label": fn.season_label_from_code(F.col("season_id")),
    })
    return _finish(rows, "games")


def clean_games_backfill(raw: DataFrame, teams: DataFrame, team_key: str = "nba_team_id") -> DataFrame:
    """Games between two franchises, season derived from the game date."""
    real = distinct_opponents(raw, "hometeamId", "awayteamId", teams, team_key)
    rows = project(last_rows(real, {"nba_game_id": fn.pad_id(F.col("gameId"))}), {
        "nba_game_id": "nba_game_id",
        "game_date": fn.parse_date(F.col("gameDate")),
        "game_type": "gameType",
        "home_nba_team_id": "hometeamId",
        "away_nba_team_id": "awayteamId",
        "home_score": _int("homeScore"),
        "away_score": _int("awayScore"),
    })
    labelled = rows.withColumn("season_label", fn.season_label_from_date(F.col("game_date")))
    return _finish(labelled, "games")


def clean_seasons(games: DataFrame) -> DataFrame:
    return _finish(season_spans(games), "seasons")


def clean_team_game_stats(raw: DataFrame, teams: DataFrame, team_key: str = "nba_team_id") -> DataFrame:
    """Two rows per wide game row: the home side's and the away side's line."""
    return team_lines_of(between_franchises(raw, teams, team_key))


def team_lines_of(real: DataFrame) -> DataFrame:
    """The team lines of rows that are between franchises."""
    sides = [
        {
            "nba_team_id": f"team_id_{side}",
            "rebounds": f"reb_{side}",
            "assists": f"ast_{side}",
            "turnovers": f"tov_{side}",
            "points": f"pts_{side}",
        }
        for side in ("home", "away")
    ]
    long = sides_to_rows(real.withColumnRenamed("game_id", "nba_game_id"), ["nba_game_id"], sides)
    return _finish(_rounded_line(keep_last(long, _TEAM_KEY)), "team_game_stats")


def _rounded_line(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: _int(name) for name in ("rebounds", "assists", "turnovers", "points")})


def clean_team_game_stats_backfill(raw: DataFrame) -> DataFrame:
    last = last_rows(raw, {"nba_game_id": fn.pad_id(F.col("gameId")), "nba_team_id": "teamId"})
    rows = last.withColumnsRenamed({"reboundsTotal": "rebounds", "teamScore": "points"})
    return _finish(_rounded_line(rows), "team_game_stats")


def team_name_lookup(histories: DataFrame) -> DataFrame:
    """(city, name) -> team id. The last row of a name decides, even if it has no id,
    in which case the name is not known."""
    names = last_rows(histories, {"city": "teamCity", "name": "teamName"})
    return names.where(F.col("teamId").isNotNull()).select("city", "name", F.col("teamId").alias("team_id"))


def clean_player_game_stats(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Box-score lines of players who played.

    A row without minutes is not an appearance and goes before anything else; a
    row with negative minutes stays and loses only the minutes.
    """
    played = raw.where(~fn.is_missing(F.col("numMinutes")))
    last = last_rows(played, {"nba_game_id": fn.pad_id(F.col("gameId")), "nba_player_id": _int("personId")})
    filled = fill_from_lookup(
        last.withColumn("nba_team_id", _int("playerteamId")),
        "nba_team_id",
        {"playerteamCity": "city", "playerteamName": "name"},
        lookup,
        "team_id",
    )
    rows = project(filled, {
        "nba_game_id": "nba_game_id",
        "nba_player_id": "nba_player_id",
        "nba_team_id": "nba_team_id",
        "minutes": fn.round_minutes(F.col("numMinutes")),
        **_ints(_STATS),
    })
    return _finish(rows, "player_game_stats")


def clean_old_events(raw: DataFrame) -> DataFrame:
    """Events with numeric codes; they have no sub-type and no shot detail."""

    def score(part: int) -> Column:
        return fn.nullable_int(fn.number_from_text(fn.score_part(F.col("score"), part)))

    last = last_rows(raw, {"nba_game_id": fn.pad_id(F.col("game_id")), "sequence": "eventnum"})
    rows = project(last, {
        "nba_game_id": "nba_game_id",
        "sequence": "sequence",
        "period": "period",
        "clock": "pctimestring",
        "event_type": fn.code_label(F.col("eventmsgtype")),
        "description": fn.first_present(
            F.col("homedescription"), F.col("visitordescription"), F.col("neutraldescription")
        ),
        "nba_player_id": fn.zero_as_null(F.col("player1_id")),
        "nba_player2_id": fn.zero_as_null(F.col("player2_id")),
        "nba_player3_id": fn.zero_as_null(F.col("player3_id")),
        "nba_team_id": fn.zero_as_null(F.col("player1_team_id")),
        "score_away": score(1),
        "score_home": score(2),
    })
    # The contract adds the absent columns as NULL.
    return _finish(rows, "play_by_play")


def clean_new_events(raw: DataFrame) -> DataFrame:
    """Events with text types, role columns and shot detail."""

    def person(column: str) -> Column:
        return fn.zero_as_null(fn.number_from_text(F.col(column)))

    number = fn.nullable_int(fn.first_present(F.col("orderNumber"), F.col("actionNumber")))
    last = last_rows(raw, {"nba_game_id": fn.pad_id(F.col("gameId")), "sequence": number})
    rows = project(last, {
        "nba_game_id": "nba_game_id",
        "sequence": "sequence",
        "period": "period",
        "clock": "clock",
        "event_type": fn.event_type_or_unknown(F.col("actionType")),
        "sub_type": "subType",
        "description": "description",
        "nba_player_id": person("personId"),
        "nba_player2_id": fn.role_slot(F.col("assistPersonId"), F.col("stealPersonId")),
        "nba_player3_id": fn.role_slot(F.col("blockPersonId"), F.col("foulDrawnPersonId")),
        "nba_team_id": person("teamId"),
        "score_home": _int("scoreHome"),
        "score_away": _int("scoreAway"),
        "shot_x": "x",
        "shot_y": "y",
        "shot_distance": _int("shotDistance"),
        "shot_made": fn.shot_made(F.col("shotResult")),
    })
    return _finish(rows, "play_by_play")


def clean_feed_games(raw: DataFrame) -> DataFrame:
    """One game per pair of team rows; "@" in the matchup marks the away row."""
    rows = raw.withColumn("nba_game_id", fn.pad_id(F.col("GAME_ID")))
    is_away = F.coalesce(F.contains(F.col("MATCHUP"), F.lit("@")), F.lit(False))
    pairs = pair_sides(
        rows,
        "nba_game_id",
        is_away,
        {"day": "GAME_DATE", "code": "SEASON_ID", "home_team": "TEAM_ID", "home_points": "PTS"},
        {"away_team": "TEAM_ID", "away_points": "PTS"},
    )
    games = project(pairs, {
        "nba_game_id": "nba_game_id",
        "game_date": fn.parse_date(F.col("day")),
        "game_type": fn.game_type_from_code(F.col("code")),
        "home_nba_team_id": "home_team",
        "away_nba_team_id": "away_team",
        "home_score": _int("home_points"),
        "away_score": _int("away_points"),
        "season_label": fn.season_label_from_code(F.col("code")),
    })
    return _finish(games, "games")


def clean_feed_team_stats(raw: DataFrame) -> DataFrame:
    last = last_rows(raw, {"nba_game_id": fn.pad_id(F.col("GAME_ID")), "nba_team_id": "TEAM_ID"})
    rows = last.withColumnsRenamed({"REB": "rebounds", "AST": "assists", "TOV": "turnovers", "PTS": "points"})
    return _finish(_rounded_line(rows), "team_game_stats")


def clean_feed_player_stats(raw: DataFrame) -> DataFrame:
    """Feed lines of players who played: rows whose minutes are blank, unreadable or
    negative go once the minutes are parsed."""
    shown = raw.where(fn.strip(F.col("minutes")) != "")
    # Parsed once, before the shuffle: a filter on the result would be computed twice.
    parsed = shown.withColumn("minutes", fn.parse_feed_minutes(F.col("minutes")))
    keys = {"nba_game_id": fn.pad_id(F.col("gameId")), "nba_player_id": _int("personId")}
    played = last_rows(parsed, keys, prefer="minutes").where(F.col("minutes").isNotNull())
    rows = project(played, {
        "nba_game_id": "nba_game_id",
        "nba_player_id": "nba_player_id",
        "nba_team_id": _int("teamId"),
        "minutes": "minutes",
        **_ints(_STATS),
    })
    return _finish(rows, "player_game_stats")
