"""Derived columns: ``name = formula`` becomes a built-in column expression.

Formulas are ordinary Python expressions over column names, ``df['any name']``
and ``np.<function>``. Undefined results (zero divisors, logs of non-positive
numbers, NaN) are NULL. Whole-column reductions such as ``x.mean()`` become one
scalar subquery per formula; a median is selected beforehand without gathering
the column. ``x.rank()`` gives equal values the mean of their ranks.
"""

import ast

from pyspark.sql import Column, DataFrame, functions as F, types as T

from isoplane.functions.scalars import defined, quotient
from isoplane.operators.profiling import exact_medians
from isoplane.operators.ranking import with_average_rank
from isoplane.sources.tables import col, number, quoted


def _both(a, b, pick):
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def _remainder(a, b):
    """Remainder with the divisor's sign, NULL for a zero divisor; exact over the whole range."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def _floor_div(a, b):
    """Doubles: the quotient without its remainder is whole up to rounding."""
    return F.rint(quotient(a - _remainder(a, b), b))


def _floor_div_whole(a, b):
    """Whole numbers never pass through doubles."""
    q = F.when(b == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).when(b != 0, F.call_function("div", a, b))
    return F.when((F.try_mod(a, b) != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def _whole(pick):
    """floor or ceil of a double; from 2**53 on doubles are whole and stay as they are."""
    return lambda x: F.when(F.abs(x) < 2.0 ** 53, pick(x).cast("double")).otherwise(x)


def _round_even(x, digits=0):
    return F.bround(x, digits)


BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
          ast.Div: quotient, ast.FloorDiv: _floor_div, ast.Mod: _remainder, ast.Pow: F.pow}
# A comparison with a missing value is false, and "not equal" is true.
COMPARE = {ast.Eq: (lambda a, b: a == b, False), ast.NotEq: (lambda a, b: a != b, True),
           ast.Lt: (lambda a, b: a < b, False), ast.LtE: (lambda a, b: a <= b, False),
           ast.Gt: (lambda a, b: a > b, False), ast.GtE: (lambda a, b: a >= b, False)}

ELEMENTWISE = {
    "log": F.ln, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1,
    "sqrt": F.sqrt, "cbrt": F.cbrt, "square": lambda x: x * x, "abs": F.abs, "sign": F.signum,
    "power": F.pow, "floor": _whole(F.floor), "ceil": _whole(F.ceil), "round": _round_even,
    "minimum": lambda a, b: _both(a, b, F.least), "maximum": lambda a, b: _both(a, b, F.greatest),
    "clip": lambda x, lo, hi: _both(_both(x, lo, F.greatest), hi, F.least),
    "isnan": lambda x: x.isNull(), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "deg2rad": F.radians, "radians": F.radians,
    "rad2deg": F.degrees, "degrees": F.degrees, "hypot": F.hypot,
}
KEEP_INTEGER = {"square", "abs", "minimum", "maximum", "clip"}

# np.std is the population deviation, the column method the sample one.
SHARED = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": None}
AS_FUNCTION = SHARED | {"std": F.stddev_pop, "var": F.var_pop}
AS_METHOD = SHARED | {"std": F.stddev_samp, "var": F.var_samp}


class _Formula:
    """Translates one formula against the columns of one DataFrame."""

    def __init__(self, df: DataFrame, light: DataFrame | None = None, known: dict | None = None):
        self.df = df
        # The columns that hold no reduction themselves: enough for most
        # reductions, and their plan stays flat however many formulas follow.
        self.light = light if light is not None else df
        self.types = {f.name: f.dataType for f in df.schema}
        self.stats = dict(known or {})

    def translate(self, text: str) -> Column:
        tree = ast.parse(text, mode="eval").body
        if found := self.reductions(tree):
            self._aggregate(found)
        return self.expr(tree)[0]

    def reductions(self, tree):
        """All whole-column reductions below a node."""
        return [n for n in ast.walk(tree) if self._reduction(n)]

    def _aggregate(self, nodes):
        """All reductions of the formula in one pass, innermost ones first."""
        outer = []
        for node in nodes:
            inner, make = self._reduction(node)
            if ast.dump(node) in self.stats:
                continue
            if nested := self.reductions(inner):
                self._aggregate([n for n in nested if ast.dump(n) not in self.stats])
            if make is None:
                values = self._source([inner]).select(self.number(inner).alias("v"))
                self.stats[ast.dump(node)] = F.lit(exact_medians(values, ["v"])["v"])
            else:
                outer.append((ast.dump(node), make(self.number(inner)), inner))
        if outer:
            packed = F.struct(*[value.alias(f"s{i}") for i, (_, value, _) in enumerate(outer)])
            row = self._source([n for _, _, n in outer]).agg(packed.alias("row")).scalar()
            self.stats |= {key: row[f"s{i}"] for i, (key, _, _) in enumerate(outer)}

    def ranks(self, tree):
        """All whole-column ranks below a node, inner ones first."""
        found = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)
                 and n.func.attr == "rank" and not n.args and not n.keywords]
        return found[::-1]

    def _source(self, nodes):
        return self.light if all(map(self.is_light, nodes)) else self.df

    def is_light(self, node):
        """True when the node uses no rank and none of the columns built on reductions."""
        if self.ranks(node):
            return False
        names = {getattr(n, "id", getattr(n, "value", None)) for n in ast.walk(node)
                 if isinstance(n, (ast.Name, ast.Constant))}
        return not names & (set(self.df.columns) - set(self.light.columns))

    def _reduction(self, node):
        """``(argument, aggregate)`` when the node reduces a whole column."""
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)):
            return None
        owner, name = node.func.value, node.func.attr
        if isinstance(owner, ast.Name) and owner.id == "np" and "np" not in self.types:
            if name in AS_FUNCTION and len(node.args) == 1 and not node.keywords:
                return node.args[0], AS_FUNCTION[name]
        elif name in AS_METHOD and not node.args and not node.keywords:
            return owner, AS_METHOD[name]
        return None

    def column(self, name):
        if name not in self.types:
            raise ValueError(f"unknown name {name!r}")
        kind = self.types[name]
        if isinstance(kind, T.BooleanType):
            return col(name), "bool"
        if isinstance(kind, T.IntegralType):
            return col(name).cast("bigint"), "int"
        if isinstance(kind, T.NumericType):
            return number(name), "num"
        return col(name), "text"

    def number(self, node):
        value, kind = self.expr(node)
        if kind == "text":
            raise ValueError("text cannot be used as a number")
        return value.cast("bigint") if kind == "bool" else value

    def expr(self, node) -> tuple[Column, str]:
        if ast.dump(node) in self.stats:
            return self.stats[ast.dump(node)], "num"
        method = getattr(self, f"on_{type(node).__name__}", None)
        if method is None:
            raise ValueError(f"{type(node).__name__} is not allowed in a formula")
        return method(node)

    def on_Name(self, node):
        return self.column(node.id)

    def on_Constant(self, node):
        kinds = {bool: "bool", int: "int", float: "num", str: "text"}
        if type(node.value) not in kinds:
            raise ValueError(f"constant {node.value!r} is not allowed")
        value = F.lit(node.value)
        return (value.cast("bigint") if type(node.value) is int else value), kinds[type(node.value)]

    def on_Subscript(self, node):
        if not (isinstance(node.value, ast.Name) and node.value.id == "df"
                and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str)):
            raise ValueError("only df['column name'] may be indexed")
        return self.column(node.slice.value)

    def on_UnaryOp(self, node):
        if isinstance(node.op, (ast.Invert, ast.Not)):
            value, kind = self.expr(node.operand)
            if kind != "bool" or isinstance(node.op, ast.Not):
                raise ValueError("use ~ on a condition to negate it")
            return ~value, "bool"
        kind = self.expr(node.operand)[1]
        value = self.number(node.operand)
        return (-value if isinstance(node.op, ast.USub) else value), "int" if kind == "bool" else kind

    def on_BinOp(self, node):
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            (a, ka), (b, kb) = self.expr(node.left), self.expr(node.right)
            if (ka, kb) != ("bool", "bool"):
                raise ValueError("& and | combine conditions; put each in parentheses")
            return (a & b if isinstance(node.op, ast.BitAnd) else a | b), "bool"
        if isinstance(node.op, ast.BitXor):
            raise ValueError("^ is not a power; use **")
        if type(node.op) not in BINARY:
            raise ValueError(f"{type(node.op).__name__} is not allowed in a formula")
        whole = {self.expr(n)[1] for n in (node.left, node.right)} <= {"int", "bool"}
        make = _floor_div_whole if whole and isinstance(node.op, ast.FloorDiv) else BINARY[type(node.op)]
        a, b = self.number(node.left), self.number(node.right)
        if not whole and isinstance(node.op, (ast.FloorDiv, ast.Mod)):
            a, b = a.cast("double"), b.cast("double")
        value = make(a, b)
        if isinstance(node.op, (ast.Div, ast.Pow)) or not whole and isinstance(node.op, (ast.FloorDiv, ast.Mod)):
            return defined(value), "num"
        return (value, "int") if whole else (value.cast("double"), "num")

    def on_Compare(self, node):
        if len(node.ops) != 1 or type(node.ops[0]) not in COMPARE:
            raise ValueError("compare two values at a time")
        (a, ka), (b, kb) = self.expr(node.left), self.expr(node.comparators[0])
        if (ka == "text") != (kb == "text"):
            raise ValueError("text can only be compared with text")
        if ka != kb:
            a, b = self.number(node.left), self.number(node.comparators[0])
        compare, missing = COMPARE[type(node.ops[0])]
        return F.coalesce(compare(a, b), F.lit(missing)), "bool"

    def on_Call(self, node):
        func = node.func
        if not (isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name)
                and func.value.id == "np") or node.keywords:
            raise ValueError("only np.<function>(...) and column reductions may be called")
        if func.attr == "where" and len(node.args) == 3:
            condition, kind = self.expr(node.args[0])
            if kind != "bool":
                raise ValueError("np.where needs a condition first")
            (a, ka), (b, kb) = self.expr(node.args[1]), self.expr(node.args[2])
            if ka != kb:
                a, b, ka = self.number(node.args[1]), self.number(node.args[2]), "num"
            return F.when(condition, a).otherwise(b), ka
        if func.attr not in ELEMENTWISE:
            raise ValueError(f"np.{func.attr} is not available")
        if func.attr == "round":
            digits = node.args[1].value if len(node.args) > 1 else 0
            return _round_even(self.number(node.args[0]).cast("double"), digits), "num"
        args = [self.number(a) for a in node.args]
        if func.attr == "isnan":
            return ELEMENTWISE["isnan"](*args), "bool"
        whole = func.attr in KEEP_INTEGER and {self.expr(a)[1] for a in node.args} <= {"int", "bool"}
        value = ELEMENTWISE[func.attr](*[a if whole else a.cast("double") for a in args])
        return (value, "int") if whole else (defined(value.cast("double")), "num")


def _names(node) -> set:
    return {n.id if isinstance(n, ast.Name) else n.value for n in ast.walk(node)
            if isinstance(n, ast.Name) or isinstance(n, ast.Constant) and isinstance(n.value, str)}


def _shared_reductions(df: DataFrame, formulas) -> dict:
    """``key -> (value, names)`` of every reduction of given columns in all formulas.

    One aggregate serves them all, one median search all medians. Reductions of derived
    columns or of other reductions are left to their formula.
    """
    parsed, wanted, made = _Formula(df), {}, set()
    for name, formula in formulas:
        try:
            tree = ast.parse(formula, mode="eval").body
            for node in parsed.reductions(tree):
                inner, make = parsed._reduction(node)
                names = _names(inner) - {"np", "df"}
                if not parsed.reductions(inner) and not names & made and names <= set(df.columns):
                    wanted[ast.dump(node)] = (parsed.number(inner), make, names)
        except (SyntaxError, ValueError):
            pass  # raised again, with its formula, when that is translated
        made.add(name)
    plain = {k: v for k, v in wanted.items() if v[1] is not None}
    medians = {k: v for k, v in wanted.items() if v[1] is None}
    out = {}
    if plain:
        row = df.agg(F.struct(*[make(value).alias(f"s{i}") for i, (value, make, _) in enumerate(plain.values())]).alias("row")).scalar()
        out |= {k: (row[f"s{i}"], names) for i, (k, (_, _, names)) in enumerate(plain.items())}
    if medians:
        values = df.select(*[value.alias(f"v{i}") for i, (value, _, _) in enumerate(medians.values())])
        found = exact_medians(values, values.columns)
        out |= {k: (F.lit(found[f"v{i}"]), names) for i, (k, (_, _, names)) in enumerate(medians.items())}
    return out


def _with_ranks(df: DataFrame, light: DataFrame, known: dict, tree):
    """``df`` with a helper column for every rank of a formula, what these nodes stand for, and the helpers."""
    helpers = []
    for node in _Formula(df, light).ranks(tree):
        if ast.dump(node) in known:
            continue
        parsed = _Formula(df, light, known)
        owner = node.func.value
        if found := parsed.reductions(owner):
            parsed._aggregate(found)
        helpers.append("f_rank" + "_" * sum(c.startswith("f_rank") for c in df.columns))
        df = with_average_rank(df, parsed.number(owner), helpers[-1])
        known = parsed.stats | {ast.dump(node): F.col(helpers[-1])}
    return df, known, helpers


def derive_columns(df: DataFrame, expressions) -> DataFrame:
    """Add ``name = formula`` columns in order; later ones see earlier results.

    Text without ``=`` is skipped; a formula that cannot be used raises a
    ``ValueError`` naming it.
    """
    light, made = df, set()
    texts = [text for text in expressions or [] if "=" in text]
    formulas = [tuple(part.strip() for part in text.split("=", 1)) for text in texts]
    shared = _shared_reductions(df, formulas)
    for text, (name, formula) in zip(texts, formulas):
        try:
            known = {k: value for k, (value, names) in shared.items() if not names & made}
            tree = ast.parse(formula, mode="eval")
            df, known, helpers = _with_ranks(df, light, known, tree)
            parsed = _Formula(df, light, known)
            value = parsed.translate(formula)
            stays_light = not parsed.reductions(tree) and parsed.is_light(tree)
            df = df.withColumn(name, value).drop(*helpers)
            light = light.withColumn(name, value) if stays_light else light.drop(name)
            made.add(name)
        except Exception as error:
            raise ValueError(f"Error in expression '{text}': {error}") from error
    return df


def formula_column(df: DataFrame, formula: str) -> Column:
    """The column expression of one formula."""
    return _Formula(df).translate(formula)


def _log_violation(df, columns):
    return [c for c, n in zip(columns, df.agg(*[
        F.count_if(number(c) <= 0).alias(quoted(c)) for c in columns]).first()) if n]


def log10_columns(df: DataFrame, columns, checked: bool = True) -> DataFrame:
    """log10 of raw positive columns; a non-positive value raises."""
    if checked and columns and (bad := _log_violation(df, columns)):
        raise ValueError(f"log columns hold values that are not positive: {bad}")
    return df.withColumns({c: F.log10(number(c)) for c in columns})
