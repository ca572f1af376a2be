"""Registered queries of parameter sets: what a set of nodes gives when it is read, written, renewed and merged.

A study has one set, so these run on the driver and return one row per case;
the expected rows stand in their SQL. Whole tables of inputs are the business
of the queries on ``events`` and ``orders``.
"""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import functions as F

from paramloom import params as P
from paramloom.catalog import _query, _t
from paramloom.functions.canonical import schema_of


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    def one(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"{x!r}::double" if isinstance(x, float) else repr(x).lower()

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def _set() -> P.ParamSet:
    return P.ParamSet({"a": 1, "o": P.Value(2, float), "l": {"apples": 3}, "r": P.Alias("l.apples"), "i": P.Hidden({"oranges": 4})})


_SHOWN = [
    ("r", False, True, "r"), ("r,i.oranges", False, True, "i.oranges,r"), ("r,i.oranges", True, True, "a,i.oranges,l.apples,o,r"),
    ("r,i.oranges", True, False, "a,l.apples,o,r"), ("r,i.oranges", False, False, "r"), ("o", False, False, "o"), ("l.apples", False, False, "l.apples"),
]


@_query(_values("accessed, show_unused, show_invisible, keys", _SHOWN))
def q68_flattening_cases(spark, sf_dir):
    """The keys of a flattened set by what was read and what may show."""
    rows = []
    for accessed, unused, hidden, _ in _SHOWN:
        s = _set()
        s.begin_run()
        s.forget_use()
        for key in accessed.split(","):
            s.at(key)
        rows.append((accessed, unused, hidden, ",".join(sorted(s.flat(unused, hidden)))))
    return spark.createDataFrame(rows, "accessed string, show_unused boolean, show_invisible boolean, keys string")


@_query(_values("key, stored, type_name", [("a", "1", "int"), ("flag", "True", "bool"), ("l.apples", "3", "int"), ("o", "2.0", "float"), ("s", "text", "str"), ("when", "86400.0", "datetime")]))
def q69_leaf_values(spark, sf_dir):
    """Leaves with and without a cast, as they are stored and typed."""
    made = {"a": 1, "o": P.Value(2, float), "l": {"apples": 3}, "s": "text", "flag": True, "when": datetime.datetime(1970, 1, 2, tzinfo=datetime.timezone.utc)}
    s = P.ParamSet(made)
    stored, types = s.flat(unused=True), s.flat(unused=True, types=True)
    return spark.createDataFrame([(k, str(stored[k]), types[k]) for k in stored], "key string, stored string, type_name string")


@_query(_values("step, way, value", [(1, "s['a']", 1.0), (2, "s.a", 1.0), (3, "s['l']['apples']", 3.0), (4, "at l.apples", 3.0), (5, "s['a'] = 5", 5.0), (6, "s.a = 6", 6.0), (7, "items", 6.0), (8, "keys", 5.0)]))
def q70_reading_and_writing(spark, sf_dir):
    """Items and attributes, dotted paths, keys and pairs."""
    s = _set()
    s.begin_run()
    rows = [(1, "s['a']", s["a"]), (2, "s.a", s.a), (3, "s['l']['apples']", s["l"]["apples"]), (4, "at l.apples", s.at("l.apples"))]
    s["a"] = 5
    rows.append((5, "s['a'] = 5", s["a"]))
    s.a = 6
    rows += [(6, "s.a = 6", s["a"]), (7, "items", dict(s.items())["a"]), (8, "keys", len(list(s.keys())))]
    return spark.createDataFrame([(i, w, float(v)) for i, w, v in rows], "step int, way string, value double")


_RENEWED = [
    ("each parent run", "read twice", 1), ("each parent run", "parent run", 2), ("each parent run", "child run", 2),
    ("each run", "read twice", 1), ("each run", "parent run", 2), ("each run", "child run", 3),
    ("never", "read twice", 1), ("never", "parent run", 1), ("never", "child run", 1),
]


@_query(_values("renew, moment, evaluations", _RENEWED))
def q71_renewal(spark, sf_dir):
    """How often a derived value was computed by each moment of a run."""
    rows = []
    for renew in P.Renew:
        numbers = itertools.count(1)
        s = P.ParamSet({"x": P.ByOutput(lambda n: next(n), P.Value(numbers), renew=renew)})
        seen = [s["x"], s["x"]]
        rows.append((renew.value, "read twice", seen[-1]))
        for moment, parent in (("parent run", True), ("child run", False)):
            s.begin_run(parent)
            rows.append((renew.value, moment, s["x"]))
    return spark.createDataFrame(rows, "renew string, moment string, evaluations int")


def _spread(start, stop, num):
    return [start + i * (stop - start) / (num - 1) for i in range(num)]


@_query(_values("key, text", [("x", "7.5"), ("y.num", "11"), ("y.start", "1"), ("y.stop", "5"), ("y.var", "_spread")]))
def q72_derived_identity(spark, sf_dir):
    """A value known by its inputs and its function's name, and one known by itself."""
    s = P.ParamSet({"y": P.ByInputs(_spread, 1, 5, 11), "x": P.ByOutput(lambda a: a * 2.5, 3)})
    s["y"], s["x"]
    return spark.createDataFrame([(k, str(v)) for k, v in s.flat().items()], "key string, text string")


@_query(_values("moment, outcome", [("locked item", "refused"), ("locked attribute", "refused"), ("nested", "refused"), ("number as name", "refused"), ("unlocked", "written"), ("forgotten", "0 used")]))
def q73_guards(spark, sf_dir):
    """Writes while locked, and names that are no strings, are refused; use marks are forgotten."""
    s = _set()

    def attempt(moment, write):
        try:
            write()
            return moment, "written"
        except (P.Locked, TypeError):
            return moment, "refused"

    s.lock()
    rows = [
        attempt("locked item", lambda: s.__setitem__("a", 2)), attempt("locked attribute", lambda: setattr(s, "a", 2)),
        attempt("nested", lambda: s["l"].__setitem__("apples", 9)),
    ]
    s.lock(False)
    rows += [attempt("number as name", lambda: s.__setitem__(1, 2)), attempt("unlocked", lambda: s.__setitem__("a", 2))]
    s.at("l.apples")
    s.forget_use()
    rows.append(("forgotten", f"{sum(n.used for n in s.walk())} used"))
    return spark.createDataFrame(rows, "moment string, outcome string")


@_query(_values("key, stored", [("a", "1"), ("l.pears", "8"), ("o", "7.0")]))
def q74_overlay_keeps_casts(spark, sf_dir):
    """A set over another: nested sets are replaced whole, casts stay."""
    base = P.ParamSet({"a": 1, "o": P.Value(2, float), "l": {"apples": 3}})
    over = base.overlaid({"o": 7, "l": {"pears": 8}})
    return spark.createDataFrame([(k, str(v)) for k, v in over.flat(unused=True).items()], "key string, stored string")


@_query(_values("key, used", [("a", True), ("l.apples", True), ("o", False)]))
def q75_use_merges_by_name(spark, sf_dir):
    """What either of two sets used, paired by name and not by place."""
    mine, theirs = P.ParamSet({"a": 1, "o": 2, "l": {"apples": 3}}), P.ParamSet({"l": {"apples": 3}, "o": 2, "a": 1})
    mine["a"], theirs.at("l.apples")
    mine.merge_use(theirs)
    return spark.createDataFrame([(k, mine.node(k).used) for k in ("a", "l.apples", "o")], "key string, used boolean")



@_query("SELECT p_partkey, p_size::double AS size, round(p_retailprice, 2) AS price, 1::bigint AS a, 'str' AS brand_type FROM part")
def q76_sets_as_rows(spark, sf_dir):
    """A table of inputs over one base set, typed as the base is."""
    from paramloom.operators import memo

    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.round("p_retailprice", 2).alias("price"))
    whole = memo.overlay(part, {"size": 2.0, "price": 900.5, "a": 1})
    return whole.withColumn("brand_type", F.lit(schema_of({"brand": "x"})["brand"]))
