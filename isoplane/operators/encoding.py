"""One-hot encoding and category combinations."""

from pyspark.sql import Column, DataFrame, functions as F

from isoplane.cluster import collect_bounded
from isoplane.sources.tables import col

MAX_LEVELS = 200
MAX_COMBOS = 10_000


def text_of(value) -> str:
    return "nan" if value is None else str(value)


def category_levels(df: DataFrame, cat_cols, max_levels: int = MAX_LEVELS) -> dict:
    """Sorted non-null levels of each category column, all columns in one pass."""
    cats = [col(c).alias(f"c{i}") for i, c in enumerate(cat_cols)]
    names = [f"c{i}" for i in range(len(cat_cols))]
    found = df.select(cats).groupingSets([[n] for n in names], *names).agg(F.grouping_id().alias("g"))
    rows = collect_bounded(found, len(names) * (max_levels + 1), f"levels in {list(cat_cols)}")
    levels = {}
    for i, c in enumerate(cat_cols):
        # A grouping id has a zero bit for the one column that is grouped.
        own = (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))
        levels[c] = sorted(r[names[i]] for r in rows if r.g == own and r[names[i]] is not None)
        if len(levels[c]) > max_levels:
            raise ValueError(f"more than {max_levels} levels in {c!r}")
    return levels


def dummy_name(column, level) -> str:
    return f"{column}_{level}"


def dummy_names(levels: dict) -> list[str]:
    return [dummy_name(c, v) for c, values in levels.items() for v in values]


def dummy_column(column: str, level) -> Column:
    """1 where the row has the level, 0 elsewhere and for a missing category."""
    return F.when(col(column) == F.lit(level), 1).otherwise(0).alias(dummy_name(column, level))


CODE_BITS = 52


def code_column(column: str) -> Column:
    """A number that stands for a level, -1 for a missing one; it needs no list of levels.

    Levels are told apart by 52 bits of a hash: two of 10,000 share a code once in 10^8 tables.
    """
    code = F.xxhash64(col(column).cast("string")).bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("double")
    return F.when(col(column).isNull(), -1.0).otherwise(code)


def one_hot(df: DataFrame, cat_cols, levels: dict | None = None,
            max_levels: int = MAX_LEVELS) -> DataFrame:
    """Replace category columns by one 0/1 column per level."""
    levels = levels or category_levels(df, cat_cols, max_levels)
    kept = [col(c) for c in df.columns if c not in cat_cols]
    return df.select(*kept, *[dummy_column(c, v) for c in cat_cols for v in levels[c]])


def feature_vector(columns) -> Column:
    """Control variables as one array, numerics first."""
    return F.array(*[col(c).cast("double") for c in columns])


def observed_combos(df: DataFrame, cat_cols, max_combos: int = MAX_COMBOS,
                    max_levels: int = MAX_LEVELS) -> list[dict]:
    """Distinct observed category tuples in label order; bounded, hence a list.

    Each entry has ``combo_id`` from 1, ``label``, ``values`` and ``fixed``
    (dummy column to 0/1). Without categories there is one unlabelled entry.
    """
    if not cat_cols:
        return [{"combo_id": 0, "label": None, "values": {}, "fixed": {}}]
    rows = collect_bounded(df.select([col(c) for c in cat_cols]).distinct(), max_combos,
                           "category combinations")
    tuples = sorted(([r[c] for c in cat_cols] for r in rows),
                    key=lambda t: ", ".join(f"{c}={text_of(v)}" for c, v in zip(cat_cols, t)))
    levels = {c: sorted({t[i] for t in tuples if t[i] is not None}) for i, c in enumerate(cat_cols)}
    wide = [c for c, found in levels.items() if len(found) > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}")
    return [{
        "combo_id": i,
        "label": ", ".join(f"{c}={text_of(v)}" for c, v in zip(cat_cols, t)),
        "values": dict(zip(cat_cols, t)),
        "fixed": {dummy_name(c, level): int(v == level)
                  for c, v in zip(cat_cols, t) for level in levels[c]},
    } for i, t in enumerate(tuples, 1)]


def combo_levels(combos: list[dict], cat_cols) -> dict:
    """Sorted non-null levels of each category column, from all observed combinations."""
    return {c: sorted({e["values"][c] for e in combos} - {None}) for c in cat_cols}


def with_all(combos: list[dict]) -> list[dict]:
    """Put an "All" entry, fixing nothing, in front of the real combinations."""
    if any(c["label"] is not None for c in combos):
        return [{"combo_id": 0, "label": "All", "values": {}, "fixed": {}}] + combos
    return [{"combo_id": 0, "label": None, "values": {}, "fixed": {}}]


def combos_frame(spark, combos: list[dict]) -> DataFrame:
    return spark.createDataFrame([(c["combo_id"], c["label"], c["fixed"]) for c in combos],
                                 "combo_id int, label string, fixed map<string,int>")


def category_combos(df: DataFrame, cat_cols, include_all: bool = False,
                    max_combos: int = MAX_COMBOS) -> DataFrame:
    """Observed combinations as ``(combo_id, label, fixed)``."""
    combos = observed_combos(df, cat_cols, max_combos)
    return combos_frame(df.sparkSession, with_all(combos) if include_all else combos)


def matches(values: dict) -> Column:
    """Rows of one combination; a missing category matches a missing one."""
    condition = F.lit(True)
    for c, v in values.items():
        condition = condition & col(c).eqNullSafe(F.lit(v))
    return condition
