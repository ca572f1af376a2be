"""Registered queries of studies, codecs and what is shown of results.

Studies run their steps on the driver or, for expression steps, over whole
tables; each query returns what came out or what was counted on the way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paramloom.catalog import _query, _scratch, _t
from paramloom.catalog_sets import _values
from paramloom.functions import signals
from paramloom.params import ParamSet, Value
from paramloom.plans.graph import order
from paramloom.plans.study import Options, Result, Step, Study, Sweep
from paramloom.sources.codecs import binary_files, default_registry, foreign, load_object, trusted_pickle


def _counted(calls: list, name: str = "power", **more) -> Step:
    def run(p, results):
        calls.append(name)
        return Result({"result": p["o"] ** 2})

    return Step(name, run, **more)


def _from_one_to_ten(name, p, results) -> Sweep:
    batch = Sweep()
    for i in range(11):
        x = 1 + i * (9 / 10)
        batch.add(str(x), {"o": x})
    return batch


def _ends(p, results) -> Result:
    pairs = list(results["power"].items())
    return Result(files={"xs": [float(k) for k, _ in pairs], "ys": [r["result"] for _, r in pairs]})


def _sweep_study(spark, kind: str) -> Study:
    inner = Step("power", expression={"result": F.col("o") * F.col("o")}, uses=["o"]) if kind == "expression" else _counted([], uses=["o"], returns="result double")
    outer = Step("power_sweep", _ends, needs=["power"], swept=["power", "power"], sweep=_from_one_to_ten)
    return Study(spark, _scratch(spark, "study"), ParamSet({"a": 1, "o": Value(2, float)}), [inner, outer])


@_query("SELECT kind, i, round(1 + i * 0.9, 6) AS x, round((1 + i * 0.9) * (1 + i * 0.9), 6) AS y, stored FROM range(11) t(i), (VALUES ('expression'), ('function')) k(kind), (VALUES (false), (true)) s(stored)")
def q77_sweep_of_a_study(spark, sf_dir):
    """A sweep run and folded by its parent, then loaded from the store."""
    rows = []
    for kind in ("expression", "function"):
        study = _sweep_study(spark, kind)
        for stored in (False, True):
            result, _ = study.run("power_sweep")
            rows += [(kind, i, x, y, stored) for i, (x, y) in enumerate(zip(result["xs"], result["ys"]))]
    df = spark.createDataFrame(rows, "kind string, i long, x double, y double, stored boolean")
    return df.select("kind", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "stored")


_CALLS = [
    (1, "first run", 1, 1), (2, "again", 1, 1), (3, "forced to one level", 1, 2), (4, "forced to two levels", 2, 3), (5, "without the store", 3, 4),
    (6, "a parameter that is not used", 3, 4), (7, "a parameter that is used", 4, 5), (8, "and again", 4, 5),
]


@_query(_values("i, moment, inner_calls, outer_calls", _CALLS))
def q78_calls_by_option(spark, sf_dir):
    """How often the steps were computed after each kind of run."""
    calls: list[str] = []

    def outer(p, results):
        calls.append("outer")
        return Result({"x": results["power"]["result"] + 1})

    study = Study(spark, _scratch(spark, "study"), ParamSet({"a": 1, "o": Value(2, float)}), [_counted(calls), Step("outer", outer, needs=["power"])])
    moves = [Options(), Options(), Options(force=1), Options(force=2), Options(cache=False), ("a", 9), ("o", 3), Options()]
    rows = []
    for (i, moment, _, _), move in zip(_CALLS, moves):
        if isinstance(move, tuple):
            study.params[move[0]] = move[1]
            move = Options()
        study.run("outer", move)
        rows.append((i, moment, calls.count("power"), calls.count("outer")))
    return spark.createDataFrame(rows, "i int, moment string, inner_calls int, outer_calls int")


_STEPS = [("a", "b, c"), ("b", "d"), ("c", "d"), ("d", "")]


@_query(_values("ord, step, needs", [(0, "d", ""), (1, "b", "d"), (2, "c", "d"), (3, "a", "b, c")]))
def q79_order_of_steps(spark, sf_dir):
    """Registered steps in the order in which they run, each after what it needs."""
    nothing = lambda p, r: Result({})
    study = Study(spark, _scratch(spark, "study"))
    study.update_steps([Step(n, nothing, needs=[c for c in needs.split(", ") if c]) for n, needs in _STEPS])
    children = study.children()
    return spark.createDataFrame([(i, n, ", ".join(children[n])) for i, n in enumerate(order(children, "a"))], "ord int, step string, needs string")


@_query(_values("fault, found", [("a step that is missing", True), ("a swept step that is missing", True), ("a circle", True), ("nothing", False)]))
def q80_faults_of_a_graph(spark, sf_dir):
    """What validation finds."""
    nothing = lambda p, r: Result({})
    graphs = {
        "a step that is missing": [Step("a", nothing, needs=["b"])], "a swept step that is missing": [Step("a", nothing, swept=["b"])],
        "a circle": [Step("a", nothing, needs=["b"]), Step("b", nothing, needs=["a"])], "nothing": [Step("a", nothing, needs=["b"]), Step("b", nothing)],
    }
    rows = []
    for fault, steps in graphs.items():
        study = Study(spark, _scratch(spark, "study"))
        for step in steps:
            study.update_step(step, validate=False)
        rows.append((fault, bool(study.validate(error=False))))
    return spark.createDataFrame(rows, "fault string, found boolean")


@_query(_values("line", [("parameters:",), ("  a = 1",), ("  o = 2.0",), ("steps:",), ("  power <- nothing",)]))
def q81_description(spark, sf_dir):
    """A study describes its parameters and steps."""
    study = Study(spark, _scratch(spark, "study"), ParamSet({"a": 1, "o": Value(2, float)}), {"power": _counted([])})
    return spark.createDataFrame([(line,) for line in str(study).split("\n")], "line string")


@_query(_values("codec, equal", [("bytes", True), ("dataframe", True), ("foreign", True), ("list", True), ("ndarray", True), ("subclass", True), ("unknown", False), ("pickle", True)]))
def q82_codecs(spark, sf_dir):
    """Values written by the codec of their class or of its nearest base, and read back."""
    import numpy as np

    class Own:
        pass

    class Named(list):
        pass

    registry = default_registry()
    path = _scratch(spark, "codecs")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey")

    def trip(value, same, label):
        try:
            name, _ = registry.write(spark, value, f"{path}/{label}")
        except TypeError:
            return label, False
        return label, bool(same(registry.read(spark, name, f"{path}/{label}")))

    rows = [
        trip(b"\x00\xff", lambda got: got == b"\x00\xff", "bytes"), trip([1.5, 2.5], lambda got: got == [1.5, 2.5], "list"),
        trip(np.arange(3.0), lambda got: (got == np.arange(3.0)).all(), "ndarray"), trip(Named([1.0]), lambda got: got == [1.0], "subclass"),
        trip(nation, lambda got: got.exceptAll(nation).isEmpty() and got.count() == nation.count(), "dataframe"), trip(Own(), lambda got: True, "unknown"),
    ]
    foreign(registry, complex, lambda z: repr(z).encode(), lambda b: complex(b.decode()))
    rows.append(trip(1 + 2j, lambda got: got == 1 + 2j, "foreign"))
    trusted_pickle(registry)
    rows.append(trip({"x": {1, 2}}, lambda got: got == {"x": {1, 2}}, "pickle"))
    return spark.createDataFrame(rows, "codec string, equal boolean")


@_query("SELECT n_nationkey % 5 AS i, md5(string_agg(n_name, ',' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def q83_foreign_files(spark, sf_dir):
    """Files of a foreign format are read as bytes and decoded by a function named by its path."""
    path = _scratch(spark, "foreign")
    groups = _t(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 5).alias("i")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    groups.select("i", F.concat_ws(",", "r.n_name").alias("value")).write.partitionBy("i").text(path)

    def decoded(batches):
        how = load_object("codecs.decode")
        for pdf in batches:
            yield pdf[["path"]].assign(value=[how(bytes(c), "utf-8").rstrip("\n") for c in pdf["content"]])

    files = binary_files(spark, f"{path}/*/*.txt").mapInPandas(decoded, "path string, value string")
    return files.select(F.regexp_extract("path", "i=([0-9]+)", 1).cast("int").alias("i"), F.md5("value").alias("digest"))


_BINS = 12


@_query(f"""WITH e AS (SELECT user_id, value, epoch(ts)::double AS t FROM events), s AS (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM e WINDOW w AS (PARTITION BY user_id))
SELECT user_id, CASE WHEN hi = lo THEN 0 ELSE least({_BINS - 1}, floor((t - lo) / (hi - lo) * {_BINS}))::int END AS bin, min(value) AS low, max(value) AS high, count(*) AS n FROM s GROUP BY ALL""")
def q84_plot_points(spark, sf_dir):
    """What a plot of each series shows, bounded by its width, with every peak."""
    from paramloom.functions.canonical import epoch_seconds

    events = _t(spark, sf_dir, "events").select("user_id", epoch_seconds("ts").alias("t"), "value")
    return signals.drawn(events, "user_id", "t", "value", _BINS)


@_query(_values("i, plotted, printed", [(0, 0, False), (1, 1, False), (2, 1, True)]))
def q85_side_effects(spark, sf_dir):
    """A step is plotted and reported where its run asks for it."""
    import contextlib
    import io

    drawn = []
    step = Step("power", lambda p, r: Result({"result": p["o"] ** 2}), plot=lambda result, results: drawn.append(result["result"]))
    study = Study(spark, _scratch(spark, "study"), ParamSet({"o": 2}), [step])
    rows = []
    for i, options in enumerate((Options(), Options(plot=True), Options(verbose=True))):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            study.run("power", options)
        rows.append((i, len(drawn), "power" in said.getvalue()))
    return spark.createDataFrame(rows, "i int, plotted int, printed boolean")


@_query("""WITH v AS (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings)
SELECT vec_id, round(x * cos(1.25) - y * sin(1.25), 6) + 0.0 AS x, round(x * sin(1.25) + y * cos(1.25), 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM v""")
def q86_rotation(spark, sf_dir):
    """What a pulse does to a two-level state: its vector turned about an axis; solvers of larger systems are a user's step."""
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    turned = signals.rotated(x, y, z, (0.0, 0.0, 2.0), F.lit(1.25))
    return _t(spark, sf_dir, "embeddings").select("vec_id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in zip("xyz", turned)])


@_query("""WITH n AS (SELECT user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, (i // ceil(n / 10)::bigint)::int AS frame, round(cos(v), 6) AS x, round(sin(v), 6) AS y, round(1 - v, 6) + 0.0 AS z, round(sin(v), 6) AS shadow_y FROM n WHERE i % ceil(n / 10)::bigint = 0""")
def q87_animation_frames(spark, sf_dir):
    """The states that an animation shows, with their shadows on the walls."""
    v = F.col("value") / 100
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.cos(v).alias("x"), F.sin(v).alias("y"), (F.lit(1.0) - v).alias("z"))
    shown = signals.frames(rows, "user_id", ["ts", "event_id"], "x", "y", "z", 10)
    return shown.select("user_id", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), (F.round("z", 6) + F.lit(0.0)).alias("z"), F.round(F.col("on_x")[1], 6).alias("shadow_y"))


@_query("SELECT event_id, value AS o, value * 2 AS twice FROM events")
def q88_outer_solver(spark, sf_dir):
    """A solver that Spark knows nothing of runs as a step's function, on the executors, once for each input."""
    step = Step("solver", lambda p, results: Result({"twice": p["o"] * 2}), uses=["o"], returns="twice double")
    study = Study(spark, _scratch(spark, "study"), steps=[step])
    return study.run_sweep("solver", _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("o"))).select("event_id", "o", "twice")


@_query("SELECT event_id, value AS o, value * value AS result FROM events")
def q89_stream_of_inputs(spark, sf_dir):
    """Beyond batch sweeps: inputs that arrive as a stream, each micro-batch through the store."""
    from paramloom.streaming.ingest import ingest

    place = _scratch(spark, "stream")
    _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("o")).write.parquet(f"{place}/in")
    study = Study(spark, f"{place}/study", steps=[Step("power", expression={"result": F.col("o") * F.col("o")}, uses=["o"])])
    stream = spark.readStream.schema("event_id long, o double").parquet(f"{place}/in")
    ingest(study, "power", stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("event_id", "o", "result")
