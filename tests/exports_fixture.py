"""Writes a small set of export files and feed files."""

import csv
import json
import os
import time

TEAM_A, TEAM_B = 501, 502
STATS = {
    "points": 20, "reboundsTotal": 5, "assists": 4, "steals": 1, "blocks": 0, "turnovers": 2,
    "fieldGoalsMade": 8, "fieldGoalsAttempted": 15, "threePointersMade": 0, "threePointersAttempted": 0,
    "freeThrowsMade": 4, "freeThrowsAttempted": 5,
}


def write_csv(root, folder, name, rows):
    os.makedirs(os.path.join(root, folder), exist_ok=True)
    with open(os.path.join(root, folder, name), "w", newline="") as out:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)


def wide_game(game_id, season_id, day, home=TEAM_A, away=TEAM_B, **more):
    return {
        "season_id": season_id, "team_id_home": home, "game_id": game_id, "game_date": day,
        "season_type": "Regular Season", "team_id_away": away, "pts_home": "110.0", "pts_away": "105.0",
        "reb_home": "40.0", "reb_away": "NA", "ast_home": 20, "ast_away": 21, "tov_home": "", "tov_away": 9,
        "unused": "x", **more,
    }


def box_line(game_id, player, **more):
    return {
        "firstName": "x", "personId": player, "gameId": game_id, "playerteamId": TEAM_A, "playerteamCity": "Port Alder",
        "playerteamName": "Herons", "numMinutes": "27.283333333333331", **STATS, **more,
    }


def old_event(game_id, number, **more):
    return {
        "game_id": game_id, "eventnum": number, "eventmsgtype": 1, "period": 1, "pctimestring": "10:40",
        "homedescription": "", "visitordescription": 'A "long" shot, made', "neutraldescription": "", "score": "0 - 2",
        "player1_id": 1, "player1_team_id": TEAM_A, "player2_id": 0, "player3_id": 77, **more,
    }


def write_exports(spark, root):
    write_csv(root, "csv", "team.csv", [
        {"id": TEAM_A, "full_name": "Port Alder Herons", "abbreviation": "OLD", "nickname": "Herons", "city": "Port Alder"},
        {"id": TEAM_B, "full_name": "Otters", "abbreviation": "MBO", "nickname": "Otters", "city": "Millbrook"},
        {"id": TEAM_A, "full_name": "Port Alder Herons", "abbreviation": "PAH", "nickname": "Herons", "city": "Port Alder"},
    ])
    write_csv(root, "csv", "player.csv", [{"id": 1, "full_name": "One"}, {"id": 2, "full_name": "Two"}])
    write_csv(root, "csv", "common_player_info.csv", [
        {"person_id": 1, "birthdate": "1990-01-02 00:00:00", "height": "6-9", "weight": "220.0", "draft_year": "2010"},
    ])
    write_csv(root, "csv", "game.csv", [
        wide_game("0022200001", "22022", "2022-10-18"),
        wide_game("0022200001", "22022", "2022-10-18 00:00:00", pts_home="111.0"),
        wide_game("0022200002", "22022", "2022-11-18", home=TEAM_B, away=TEAM_A),
        wide_game("0022200003", "22022", "2022-12-18", away=99),
    ])
    write_csv(root, "csv", "play_by_play.csv", [
        old_event("0022200001", 1), old_event("0022200001", 2, eventmsgtype=12, player1_id=0, player1_team_id=0, score=""),
        old_event("0022200001", 2, eventmsgtype=13, player1_id=0, player1_team_id=0, score=""),
        old_event("0099999999", 1),
    ])
    write_csv(root, "box_scores", "Games.csv", [
        {"gameId": "22200002", "gameDate": "2022-11-18", "gameType": "Other", "hometeamId": TEAM_A, "awayteamId": TEAM_B, "homeScore": 1, "awayScore": 2},
        {"gameId": "26400007", "gameDate": "1964-11-02 19:00:00", "gameType": "Regular Season", "hometeamId": TEAM_A, "awayteamId": TEAM_B, "homeScore": 90, "awayScore": 80},
        {"gameId": "22200004", "gameDate": "2023-06-01", "gameType": "Playoffs", "hometeamId": TEAM_B, "awayteamId": TEAM_A, "homeScore": 99, "awayScore": 98},
    ])
    write_csv(root, "box_scores", "TeamStatistics.csv", [
        {"gameId": "26400007", "teamId": TEAM_A, "reboundsTotal": 50, "assists": 10, "turnovers": "", "teamScore": 90},
        {"gameId": "22200001", "teamId": TEAM_A, "reboundsTotal": 1, "assists": 1, "turnovers": 1, "teamScore": 1},
        {"gameId": "77777777", "teamId": TEAM_A, "reboundsTotal": 1, "assists": 1, "turnovers": 1, "teamScore": 1},
    ])
    write_csv(root, "box_scores", "Players.csv", [
        {"personId": 1, "firstName": "Other", "lastName": "Name", "birthDate": "", "heightInches": 80, "bodyWeightLbs": 1, "draftYear": -1},
        {"personId": 3, "firstName": "Ruth", "lastName": "Vale", "birthDate": "1971-06-05", "heightInches": 81, "bodyWeightLbs": 240, "draftYear": 1990},
    ])
    write_csv(root, "box_scores", "TeamHistories.csv", [
        {"teamId": TEAM_B, "teamCity": "Old Mill", "teamName": "Rafters"},
        {"teamId": TEAM_A, "teamCity": "Port Alder", "teamName": "Herons"},
    ])
    write_csv(root, "box_scores", "PlayerStatistics.csv", [
        box_line("22200001", 1), box_line("22200001", 1, points=30),
        box_line("22200001", 2, playerteamId="", numMinutes="10.0", fieldGoalsMade=0, fieldGoalsAttempted=0),
        box_line("22200002", 1, numMinutes="-5.0", points=8), box_line("22200002", 2, numMinutes=""),
        box_line("22200004", 1, playerteamId=f"{TEAM_B}.0", numMinutes="30.0"), box_line("88888888", 1), box_line("22200001", 55),
    ])
    events = [
        ("22200001", 1.0, "2022-10-18T19:30:00", "too early"), ("22200004", None, "2023-06-10T01:00:00", "2pt"),
        ("22200004", 2.0, "2023-06-12T01:00:00", " "), ("22200001", 1.0, "2023-06-13T01:00:00", "overlap"),
    ]
    frame = spark.createDataFrame(
        [
            (g, n, 7.0, t, 1.0, "PT08M", a, "layup", "text", str(TEAM_A), "1", "2", None, None, "0", 2.0, 0.0, float("nan"), 1.5, 3.0, "Made")
            for g, n, t, a in events
        ],
        "gameId string, orderNumber double, actionNumber double, gameDateTimeEst string, period double, clock string,"
        " actionType string, subType string, description string, teamId string, personId string, assistPersonId string,"
        " stealPersonId string, blockPersonId string, foulDrawnPersonId string, scoreHome double, scoreAway double,"
        " x double, y double, shotDistance double, shotResult string",
    )
    frame.coalesce(1).write.parquet(os.path.join(root, "box_scores", "PlayByPlay.parquet"))


def team_row(game_id, team, matchup, points, day="2023-10-24"):
    return {
        "GAME_ID": game_id, "GAME_DATE": day, "TEAM_ID": team, "SEASON_ID": "22023", "MATCHUP": matchup,
        "PTS": points, "REB": 40, "AST": 20, "TOV": 9, "EXTRA": "x",
    }


def player_row(game_id, player, minutes="PT34M12.00S", team=TEAM_A):
    return {"gameId": game_id, "personId": player, "teamId": team, "minutes": minutes, **STATS}


def land(root, folder, name, rows, age=0):
    """Puts a feed file in place in one step, `age` seconds old."""
    path = os.path.join(root, folder)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"_{name}"), "w") as out:
        out.writelines(json.dumps(row) + "\n" for row in rows)
    landed = time.time() - age
    os.utime(os.path.join(path, f"_{name}"), (landed, landed))
    os.rename(os.path.join(path, f"_{name}"), os.path.join(path, name))
