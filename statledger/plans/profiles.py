"""Key counts and profiles of the fact tables that grow with them: a refresh reads the new files only."""

from pyspark.sql import Column, DataFrame, functions as F

from statledger.functions import ratio
from statledger.plans.season_state import SEASON, SeasonState
from statledger.plans.warehouse import Staging, Warehouse, staged
from statledger.sources.contracts import KEYS, TABLES

# Registers of a distinct sketch are 2 to this power; its standard error is 0.83 / sqrt(registers).
HLL_BITS = 12
DISTINCT_ERROR = 0.83 / 2 ** (HLL_BITS / 2)
# Entries a level of a quantile sketch keeps; the rank of its answers is off by 1.65 % at most, 99 times in 100.
KLL_ENTRIES = 200
RANK_ERROR = 0.0165

_NUMBERS = ("INT", "SMALLINT", "DECIMAL")


# ---- exact key counts --------------------------------------------------------


def key_bitmaps(warehouse: Warehouse, table: str) -> SeasonState:
    """Of each game the rows, and a bitmap of the second part of their keys, for each bucket of those.

    Bitmaps of two parts of the table join by OR, so distinct keys stay exact however it grows.
    """
    game, other = KEYS[table]

    def partial(rows: DataFrame) -> DataFrame:
        bucket = F.bitmap_bucket_number(other).alias("bucket")
        return rows.groupBy(SEASON, game, bucket).agg(
            F.count("*").alias("n_rows"), F.bitmap_construct_agg(F.bitmap_bit_position(other)).alias("bits"))

    def merged(state: DataFrame) -> DataFrame:
        return state.groupBy(SEASON, game, "bucket").agg(F.sum("n_rows").alias("n_rows"), F.bitmap_or_agg("bits").alias("bits"))

    return SeasonState(warehouse, table, f"{table}_bitmaps", partial, merged)


@staged
def refresh_key_counts(warehouse: Warehouse, table: str, full: bool = False, staging: Staging = None) -> list:
    return key_bitmaps(warehouse, table).refresh(staging, full)


def key_counts(warehouse: Warehouse, table: str) -> DataFrame:
    """Per season, from the stored bitmaps: rows, distinct keys, rows that repeat a key, and games with rows."""
    game = KEYS[table][0]
    games = key_bitmaps(warehouse, table).rows().groupBy(SEASON, game).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.bitmap_count("bits")).alias("n_keys"))
    return games.groupBy(SEASON).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"),
        F.sum(F.col("n_rows") - F.col("n_keys")).alias("n_repeats"), F.count("*").alias("n_games"))


def stored_coverage(warehouse: Warehouse, table: str) -> DataFrame:
    """Per season: games, games with rows in the table, and their share; as reports.event_coverage, but
    from the stored bitmaps, which also serve the key counts."""
    games = warehouse.table("games").groupBy(F.col("season_id").alias(SEASON)).agg(F.count("*").alias("n_games"))
    covered = key_counts(warehouse, table).select(SEASON, F.col("n_games").alias("n_covered"))
    joined = games.join(covered, SEASON, "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))
    return joined.withColumn("coverage", F.round(ratio(F.col("n_covered"), F.col("n_games")), 4))


# ---- sketches ----------------------------------------------------------------


def _columns(table: str) -> dict:
    """{column: whether it is a number} of the columns that are profiled."""
    return {name: kind.startswith(_NUMBERS) for name, kind in TABLES[table].items() if name != SEASON and kind != "BOOLEAN"}


def column_sketches(warehouse: Warehouse, table: str) -> SeasonState:
    """Of each season and column: rows, filled rows, a sketch of distinct values and, of numbers, of quantiles."""
    columns = _columns(table)

    def partial(rows: DataFrame) -> DataFrame:
        def sketch(name: str, number: bool) -> Column:
            values = F.col(name).cast("double") if number else F.lit(None).cast("double")
            return F.struct(
                F.lit(name).alias("column"), F.count("*").alias("n_rows"), F.count(name).alias("n_filled"),
                F.hll_sketch_agg(F.col(name).cast("string"), HLL_BITS).alias("distincts"),
                F.kll_sketch_agg_double(values, KLL_ENTRIES).alias("quantiles"))

        # One pass over the rows, and one row a season and task to shuffle.
        summed = rows.groupBy(SEASON).agg(F.array(*[sketch(n, number) for n, number in columns.items()]).alias("sketches"))
        return summed.select(SEASON, F.inline("sketches"))

    def merged(state: DataFrame) -> DataFrame:
        return state.groupBy(SEASON, "column").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_filled").alias("n_filled"),
            F.hll_union_agg("distincts").alias("distincts"), F.kll_merge_agg_double("quantiles").alias("quantiles"))

    return SeasonState(warehouse, table, f"{table}_sketches", partial, merged)


@staged
def refresh_profile(warehouse: Warehouse, table: str, full: bool = False, staging: Staging = None) -> list:
    return column_sketches(warehouse, table).refresh(staging, full)


def profile(warehouse: Warehouse, table: str, by_season: bool = True, ranks: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per column, of each season or of the whole table: rows, the exact filled share, about how many distinct
    values, and values at about these ranks. Merged when it is read; no fact is."""
    state = column_sketches(warehouse, table)
    sketches = state.rows() if by_season else state.merged(state.rows().withColumn(SEASON, F.lit("all")))
    numbers = [name for name, number in _columns(table).items() if number]
    known = F.col("column").isin(numbers) & (F.kll_sketch_get_n_double("quantiles") > 0)
    quantiles = [F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(rank))).alias(f"q{round(100 * rank)}") for rank in ranks]
    return sketches.select(
        SEASON, "column", "n_rows", F.round(ratio(F.col("n_filled"), F.col("n_rows")), 4).alias("filled"),
        F.hll_sketch_estimate("distincts").alias("n_distinct"), *quantiles)
