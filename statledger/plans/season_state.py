"""State of a fact table that merges: a partition a season, kept current from the new files."""

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from statledger.plans.warehouse import Staging, Warehouse

SEASON = "season_label"
_FILE = "file"
_PATH = f"/{SEASON}="


class SeasonState:
    """What is summed up of a fact table's rows, stored by season.

    `partial` makes the state of any part of the table's rows, with the column season_label, and
    `merged` makes one state of several. Facts are only appended to, so the state of a file never
    changes. Each season's partition names the fact files that are in it: names and state are
    replaced by one catalog change, so a refresh that stops halfway counts no file twice. A refresh
    reads the new files and writes their seasons again; all others' files stay.
    """

    def __init__(self, warehouse: Warehouse, facts: str, table: str, partial, merged):
        self.warehouse, self.facts, self.table, self.partial, self.merged = warehouse, facts, table, partial, merged

    def rows(self) -> DataFrame:
        """The state as it was last refreshed; None before that."""
        if not self.warehouse.exists(self.table):
            return None
        return self.warehouse.table(self.table).where(F.col(_FILE).isNull()).drop(_FILE)

    def refresh(self, staging: Staging, full: bool = False) -> list:
        """Brings the state up to date; returns the seasons that it wrote. `full` starts from nothing."""
        facts = self.warehouse.table(self.facts)
        new = self._new_files(facts, full)
        seasons = sorted({season for season, _ in new})
        if seasons:
            content = staging.keep(self._content(facts, new, seasons, full), self.table)
            create_by_season(self.warehouse, self.table, content)
            self.warehouse.replace_partitions(self.table, content, SEASON, seasons)
        return seasons

    def _new_files(self, facts: DataFrame, full: bool) -> list:
        """(season, file) of the fact files that no season names; the listing that every scan makes."""
        # As _metadata.file_path spells a local file.
        listing = [re.sub("^file:/+", "file:/", file) for file in facts.inputFiles()]
        files = [(unquote(file.split(_PATH)[1].split("/")[0]), file) for file in listing if _PATH in file]
        if full or not files or not self.warehouse.exists(self.table):
            return files
        listed = self.warehouse.spark.createDataFrame(files, f"{SEASON} string, {_FILE} string")
        named = self.warehouse.table(self.table).where(F.col(_FILE).isNotNull()).select(SEASON, _FILE)
        return [tuple(row) for row in listed.join(named, [SEASON, _FILE], "left_anti").collect()]

    def _content(self, facts: DataFrame, new: list, seasons: list, full: bool) -> DataFrame:
        """The whole new content of these seasons: the merged state and the names of its files."""
        named = self.warehouse.spark.createDataFrame(new, f"{SEASON} string, {_FILE} string")
        chosen = facts.where(F.col(SEASON).isin(seasons))
        if full or not self.warehouse.exists(self.table):
            state = self.partial(chosen)
        else:
            stored = self.warehouse.table(self.table).where(F.col(SEASON).isin(seasons))
            # Spark tests the name of a file before it opens it.
            added = self.partial(chosen.where(F.col("_metadata.file_path").isin([file for _, file in new])))
            state = self.merged(stored.where(F.col(_FILE).isNull()).select(added.columns).unionByName(added))
            named = named.unionByName(stored.where(F.col(_FILE).isNotNull()).select(SEASON, _FILE))
        columns = [name for name in state.columns if name != SEASON]
        return state.unionByName(named, allowMissingColumns=True).select(*columns, _FILE, SEASON)


def create_by_season(warehouse: Warehouse, table: str, rows: DataFrame) -> None:
    """An empty table for such rows, partitioned by season, if there is none."""
    if not warehouse.exists(table):
        rows.limit(0).write.partitionBy(SEASON).format("parquet").saveAsTable(warehouse.name(table))
