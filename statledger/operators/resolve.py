"""Foreign-key resolution against dimension tables.

Meant for narrow frames: a row number, the keys and the foreign keys. A load resolves those and
brings the rows' other columns back by row number.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from statledger.operators.filters import spread_key

UNRESOLVED = "_unresolved"


@dataclass(frozen=True)
class Reference:
    """One foreign key: df.column must occur in table.key (unique there).

    A required reference without a match makes the row unresolved; an optional
    one becomes NULL. `carry` names dimension columns to bring along, as
    {dimension column: output column}.
    """

    column: str
    table: DataFrame
    key: str
    required: bool = True
    carry: dict = field(default_factory=dict)


def with_references(df: DataFrame, references: list, row: str = None) -> DataFrame:
    """Checks all references in one plan and keeps every row.

    Adds the carried columns and `_unresolved`, the array of required columns
    without a match (empty for a good row). Several references to one dimension,
    none of which carries anything, are resolved by one join with it if `row` names a
    column that tells the rows of df apart. Spark decides by size which dimensions it
    broadcasts.
    """
    number = {id(reference): k for k, reference in enumerate(references)}
    for group in _by_dimension(references) if row else [[reference] for reference in references]:
        if len(group) == 1:
            df = _with_one_slot(df, group[0], number[id(group[0])])
        else:
            df = _with_many_slots(df, group, [number[id(reference)] for reference in group], row)
    optional = {r.column: f"_found_{number[id(r)]}" for r in references if not r.required}
    missing = [F.when(F.col(f"_found_{number[id(r)]}").isNull(), F.lit(r.column)) for r in references if r.required]
    columns = []
    for name in df.columns:
        if name.startswith("_carry_"):
            columns.append(F.col(name).alias(name.split("_", 3)[3]))
        elif not name.startswith("_found_"):
            columns.append(F.col(optional.get(name, name)).alias(name))
    gaps = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    return df.select(*columns, gaps.alias(UNRESOLVED))


def _by_dimension(references: list) -> list:
    """The references in groups that share a dimension, in the order of each group's first."""
    groups = {}
    for reference in references:
        own = None if reference.carry else (id(reference.table), reference.key)
        groups.setdefault(own or id(reference), []).append(reference)
    return list(groups.values())


def _with_one_slot(df: DataFrame, reference: Reference, number: int) -> DataFrame:
    found = f"_found_{number}"
    dimension = reference.table.select(
        F.col(reference.key).alias(found),
        *[F.col(source).alias(f"_carry_{number}_{target}") for source, target in reference.carry.items()],
    )
    # Empty slots are most of some columns; they match nothing and must not gather in one task.
    given = F.col(reference.column).isNotNull()
    return df.join(dimension, given & (spread_key(df, reference.column, given) == F.col(found)), "left")


def _with_many_slots(df: DataFrame, references: list, numbers: list, row: str) -> DataFrame:
    """The slots' ids in one column, known ones only, and back to a column each.

    Only row numbers and ids are shuffled, and an empty slot gives no row to shuffle.
    """
    slots = [F.struct(F.lit(k).alias("slot"), F.col(r.column).alias("id")) for k, r in zip(numbers, references, strict=True)]
    given = df.select(row, F.inline(F.array(*slots))).where(F.col("id").isNotNull())
    known = given.join(references[0].table.select(F.col(references[0].key).alias("id")), "id", "left_semi")
    found = known.groupBy(row).agg(*[F.max(F.when(F.col("slot") == k, F.col("id"))).alias(f"_found_{k}") for k in numbers])
    return df.join(found, row, "left")
