"""Keeps the warehouse current from landed feed files.

The file sources remember which files they have read, and every merge inserts only
what is absent, so a micro-batch that runs twice changes nothing. A row that cannot
be placed yet waits: a team row until the other side of its game lands, a player row
until its game is loaded. A micro-batch reads the waiting rows of its own games and
writes the rows that begin to wait; what it costs depends on its own rows alone.
"""

import os
from functools import partial

from pyspark.sql import DataFrame, functions as F

from statledger.functions import pad_id
from statledger.plans import clean, load
from statledger.plans.warehouse import Staging, Warehouse, staged
from statledger.session import shared_folder, shuffles_freed, side_by_side
from statledger.sources.feed import stream_feed, with_ordinal
from statledger.sources.layouts import FEED_PLAYER_ROWS, FEED_TEAM_ROWS
from statledger.sources.ledger import FileLedger
from statledger.streaming.waiting import GAME, READY, WaitingRows, marked, of_placed

PENDING_TEAM_ROWS = "pending_team_rows"
PENDING_PLAYER_ROWS = "pending_player_rows"


def sync_stream(warehouse: Warehouse, feed_dir: str, max_files: int = None) -> None:
    """Loads every landed file not read before, then stops.

    `max_files` bounds one micro-batch. A row waits until it can be placed, however
    long that takes, so the result doesn't depend on how files fall into batches.
    """

    def merge(step):
        def on_batch(batch: DataFrame, _batch_id: int) -> None:
            target = Warehouse(batch.sparkSession, warehouse.database)
            step(target, with_ordinal(batch))

        return on_batch

    with shuffles_freed(warehouse.spark):
        _drain(warehouse, feed_dir, FEED_TEAM_ROWS, merge(merge_team_rows), max_files)
        # Games of this run, or of another load, may have arrived after player rows of an earlier one.
        release_player_rows(warehouse)
        _drain(warehouse, feed_dir, FEED_PLAYER_ROWS, merge(merge_player_rows), max_files)


def _drain(warehouse: Warehouse, feed_dir: str, layout, on_batch, max_files) -> None:
    # A stream can't start on a folder that isn't there yet.
    if FileLedger(warehouse, feed_dir).is_empty(layout):
        return
    progress = os.path.join(
        shared_folder(warehouse.spark), "statledger", "streams", warehouse.database, layout.folder
    )
    rows = stream_feed(warehouse.spark, feed_dir, layout, max_files)
    query = (
        rows.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _games_of(rows: DataFrame) -> DataFrame:
    return rows.select(GAME).where(F.col(GAME).isNotNull()).distinct()


def known_games(warehouse: Warehouse) -> DataFrame:
    return warehouse.table("games").select(F.col("nba_game_id").alias(GAME))


@staged
def merge_team_rows(warehouse: Warehouse, batch: DataFrame, staging: Staging) -> None:
    """Games and team lines of the batch, with the rows that waited for the same games."""
    rows = staging.keep(batch.withColumn(GAME, pad_id(F.col("GAME_ID"))), "landed")
    named = _games_of(rows)
    waiting = WaitingRows(warehouse, PENDING_TEAM_ROWS)
    earlier = waiting.of_games(named)
    if earlier is not None:
        # Read once: the buckets hold other games' rows too, and marks of released ones.
        earlier = staging.keep(earlier, "earlier")
    both = rows if earlier is None else rows.unionByName(earlier)
    games = staging.keep(load.numbered_games(clean.clean_feed_games(both)), "games")

    def load_games() -> None:
        load.load_seasons_widen(warehouse, clean.clean_seasons(games.withColumnRenamed("season_id", "season_label")))
        load.load_games(warehouse, games)

    def stage_lines() -> tuple:
        # A pair that cannot be resolved is among the rejects and need not wait.
        paired = games.select(F.col("nba_game_id").alias(GAME))
        placed = staging.keep(named.join(paired.unionByName(known_games(warehouse)), GAME, "left_semi"), "placed")
        lines = clean.clean_feed_team_stats(of_placed(both, placed, True))
        return placed, staging.keep(load.numbered_team_lines(lines), "lines")

    _, (placed, lines) = side_by_side(load_games, stage_lines)
    side_by_side(
        partial(load.load_team_game_stats, warehouse, lines),
        lambda: waiting.add(of_placed(rows, placed, False)),
    )
    # Rows that waited are let go only when their lines are in the table.
    if earlier is not None:
        waiting.release(staging.keep(_games_of(earlier).join(placed, GAME, "left_semi"), "released"))


@staged
def merge_player_rows(warehouse: Warehouse, batch: DataFrame, staging: Staging) -> None:
    """Player lines of loaded games; the batch's other rows wait."""
    landed = batch.withColumn(GAME, pad_id(F.col("gameId")))
    # Told apart on their way into the files, so that neither kind is read or dealt again for the other.
    rows = staging.keep(marked(landed, known_games(warehouse)), "landed", [READY])
    ready, others = (rows.where(kind).drop(READY) for kind in (F.col(READY), ~F.col(READY)))
    side_by_side(
        lambda: load.load_player_game_stats(warehouse, clean.clean_feed_player_stats(ready)),
        lambda: WaitingRows(warehouse, PENDING_PLAYER_ROWS).add(others),
    )


@staged
def release_player_rows(warehouse: Warehouse, staging: Staging) -> None:
    """Player lines that waited for games which are there by now."""
    waiting = WaitingRows(warehouse, PENDING_PLAYER_ROWS)
    games = waiting.games()
    if games is None:
        return
    placed = staging.keep(games.join(known_games(warehouse), GAME, "left_semi"), "released")
    if not placed.isEmpty():
        load.load_player_game_stats(warehouse, clean.clean_feed_player_stats(waiting.of_games(placed)))
        waiting.release(placed)
