"""Reading, writing and describing tables."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The texts a CSV cell may hold to mean "missing".
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null"]
INTEGER_TEXT = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE_TEXT = r"^\s*[+-]?(?i:inf|infinity)\s*$"
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"


def quoted(name: str) -> str:
    """Column name as it must appear in an expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def number(name: str):
    """A column as double with NaN read as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def unique_names(header) -> list[str]:
    """Header cells as column names: empty ones numbered, repeats get ``.1``, ``.2``."""
    names = [h if h not in (None, "") else f"Unnamed: {i}" for i, h in enumerate(header)]
    taken, seen, out = set(names), {}, []
    for name in names:
        seen[name] = seen.get(name, -1) + 1
        unique = name
        while seen[name] and unique in taken:
            unique = f"{name}.{seen[name]}"
            seen[name] += unique in taken
        taken.add(unique)
        out.append(unique)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             drop_all_null: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header row.

    Types come from one aggregate over the text columns: integer, double,
    boolean, else string; an entirely empty column is double. Give ``schema``
    on large inputs to save that pass.
    """
    reader = spark.read.option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return nan_to_null(reader.option("header", True).schema(schema).csv(path))
    header = reader.option("header", False).csv(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = unique_names(list(header))
    text_schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    text = reader.option("header", True).option("enforceSchema", True).schema(text_schema).csv(path)
    text = text.select([F.when(~F.trim(c).isin(MISSING_TEXTS), F.col(c)).alias(c) for c in text.columns])
    return conform_schema(text, names, drop_all_null)


def conform_schema(text: DataFrame, names: list[str], drop_all_null: bool = False) -> DataFrame:
    """Turn all-text columns into typed ones and give them their final names."""
    tests = {"int": INTEGER_TEXT, "num": f"{NUMBER_TEXT}|{INFINITE_TEXT}", "bool": BOOLEAN_TEXT}
    found = text.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"{c}_any") for c in text.columns],
        *[F.count_if(F.col(c).rlike(rx)).alias(f"{c}_{k}") for c in text.columns for k, rx in tests.items()],
    ).first()
    out = []
    for c, name in zip(text.columns, names):
        filled, whole = found[f"{c}_any"], found[f"{c}_any"] == found["rows"]
        if filled == 0:
            if drop_all_null:
                continue
            typed = F.lit(None).cast("double")
        elif found[f"{c}_int"] == filled:
            typed = F.trim(c).cast("bigint" if whole else "double")
        elif found[f"{c}_num"] == filled:
            typed = F.trim(c).cast("double")
        elif found[f"{c}_bool"] == filled and whole:
            typed = F.lower(c).cast("boolean")
        else:
            typed = F.col(c)
        out.append(typed.alias(name))
    return text.select(out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here, so that averages skip it."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select([
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if isinstance(f.dataType, kinds)
        else col(f.name) for f in df.schema])


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a table by its file name ending: CSV text or parquet."""
    if re.search(r"\.csv(\.gz)?/?$", path):
        return read_csv(spark, path, **options)
    return spark.read.parquet(path)


def load_example(spark: SparkSession, catalogue: dict, kind: str) -> DataFrame:
    """A named data set; any kind other than ``2d`` means ``1d``. Also a temp view."""
    key = "2d" if kind == "2d" else "1d"
    if key not in catalogue:
        raise ValueError(f"no data set registered for {key!r}")
    df = read_table(spark, catalogue[key])
    df.createOrReplaceTempView(f"example_{key}")
    return df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write every partition's rows in parallel as CSV text or parquet."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def list_columns(df: DataFrame) -> DataFrame:
    """One row per column: position from 1, name, type and number of values present."""
    parts = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                      F.lit(f.dataType.simpleString()).alias("type"), F.count(col(f.name)).alias("n_values"))
             for i, f in enumerate(df.schema, 1)]
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def classify_columns(df: DataFrame, target: str | None = None) -> dict:
    """Numeric and categorical column names; the target leaves the numeric list only."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    other = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]
    return {"num_cols": [c for c in numeric if c != target], "cat_cols": other}


def require_columns(df: DataFrame, features, target: str | None = None) -> None:
    """Raise when a needed column is absent, naming all that are."""
    missing = [c for c in list(features) + ([target] if target else []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; available: {df.columns}")


def complete_cases(df: DataFrame, features, target: str) -> DataFrame:
    """The features and the target as doubles, rows with all of them present."""
    require_columns(df, features, target)
    wanted = list(features) + [target]
    return nan_to_null(df.select([col(c).cast("double").alias(c) for c in wanted])).na.drop()
