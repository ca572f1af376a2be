import pytest
from pyspark.sql import functions as F

from paramloom.functions.canonical import address, address_column, canonical_column
from paramloom.operators import memo
from paramloom.params import Alias, ParamSet, Value
from paramloom.plans import graph
from paramloom.plans.study import Options, Result, Step, Study, Sweep
from paramloom.sources.codecs import default_registry, safe_name, trusted_pickle
from paramloom.streaming.ingest import ingest


@pytest.fixture
def params():
    return ParamSet({"a": 1, "o": Value(2, float), "l": {"apples": 3}, "r": Alias("l.apples")})


def counted(name="power", **more):
    calls = []

    def run(p, results):
        calls.append(1)
        return Result({"result": p["o"] ** 2})

    return Step(name, run, **more), calls


def test_second_run_is_loaded(spark, tmp_path, params):
    step, calls = counted()
    study = Study(spark, str(tmp_path), params, [step])
    assert study.run("power")[0]["result"] == 4
    assert study.run("power")[0]["result"] == 4
    assert len(calls) == 1
    study.run("power", Options(force=1))
    study.run("power", Options(cache=False))
    assert len(calls) == 3
    assert study.store.table("result").count() == 1
    study.params["a"] = 7  # not used by the step: no miss
    study.run("power")
    assert len(calls) == 3
    study.params["o"] = 3
    assert study.run("power")[0]["result"] == 9 and len(calls) == 4


def test_unknown_step_and_options(spark, tmp_path):
    with pytest.raises(ValueError):
        Study(spark, str(tmp_path)).run("nothing")
    with pytest.raises(ValueError):
        Options(force=-1)
    with pytest.raises(TypeError):
        Options(depth=1)


def test_using_another_parameter_makes_a_version(spark, tmp_path, params):
    step, _ = counted()
    study = Study(spark, str(tmp_path), params, [step])
    study.run("power")
    study.update_step(Step("power", lambda p, r: Result({"result": p["o"] ** 2 + p["a"]})))
    assert study.run("power")[0]["result"] == 4  # a changed body alone still hits
    study.run("power", Options(force=1))
    versions = {r.version: dict(r.env_schema) for r in study.store.table("step_version").collect()}
    assert versions == {0: {"o": "float"}, 1: {"o": "float", "a": "int"}}
    assert study.store.step("power").current_version == 1
    study.update_step(step)
    study.run("power", Options(force=1))
    assert study.store.step("power").current_version == 0


def test_history_appends_and_never_loads(spark, tmp_path, params):
    step, calls = counted(history=True)
    study = Study(spark, str(tmp_path), params, [step])
    for _ in range(3):
        study.run("power")
    assert len(calls) == 3
    assert study.store.results("power", history=True).count() == 3
    assert study.store.results("power").count() == 0


def test_files_round_trip(spark, tmp_path, params):
    step = Step("arrays", lambda p, r: Result({"n": p["o"]}, {"xs": [1.0, 2.0], "raw.data": b"\x00\x01"}))
    study = Study(spark, str(tmp_path), params, [step])
    study.run("arrays")
    loaded = study.run("arrays")[0]
    assert loaded["xs"] == [1.0, 2.0] and loaded["raw.data"] == b"\x00\x01" and loaded["n"] == 2


def sweeping(name, p, results):
    batch = Sweep()
    for i in range(11):
        x = 1 + 0.9 * i
        batch.add(str(x), {"o": x})
    return batch


def fold(p, results):
    runs = results["power"].values()
    return Result({"total": sum(r["result"] for r in runs)}, {"ys": [r["result"] for r in runs]})


@pytest.mark.parametrize("kind", ["function", "expression"])
def test_sweep(spark, tmp_path, params, kind):
    power = counted()[0] if kind == "function" else Step("power", expression={"result": F.col("o") * F.col("o")}, uses=["o"])
    study = Study(spark, str(tmp_path), params, [power, Step("sweep", fold, needs=["power"], swept=["power"], sweep=sweeping)])
    result, inner = study.run("sweep")
    assert result["total"] == pytest.approx(sum((1 + 0.9 * i) ** 2 for i in range(11)))
    assert list(inner["power"])[0] == "1.0" and len(inner["power"]) == 11
    assert dict(study.store.version_row("sweep", 0).env_schema or {}) == {}  # the swept parameter is no input
    assert study.run("sweep")[0]["ys"] == result["ys"]
    assert study.store.results("power").count() == 11


def test_sweep_needs_one_schema():
    batch = Sweep()
    batch.add("1", {"o": 1.0})
    batch.add("1", {"o": 2.0})
    assert batch.runs == {"1": {"o": 2.0}}
    with pytest.raises(TypeError):
        batch.add("2", {"o": "x"})


def test_run_sweep_joins_the_store(spark, tmp_path):
    study = Study(spark, str(tmp_path), steps=[Step("power", expression={"result": F.col("o") * F.col("k")}, uses=["o", "k"])])
    first = study.run_sweep("power", spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "o double"), {"k": 3})
    assert sorted((r.o, r.result, r.source) for r in first.collect()) == [(1.0, 3.0, "computed"), (2.0, 6.0, "computed"), (2.0, 6.0, "computed")]
    again = study.run_sweep("power", spark.createDataFrame([(2.0,), (4.0,)], "o double"), {"k": 3})
    assert sorted((r.o, r.source) for r in again.collect()) == [(2.0, "cache"), (4.0, "computed")]
    assert study.store.results("power").count() == 3
    with pytest.raises(LookupError):
        study.run_sweep("power", spark.range(1).selectExpr("1.0D as o"))


def test_functions_run_over_whole_sweeps(spark, tmp_path):
    params = ParamSet({"k": 3, "l": {"o": Value(1, float)}, "unread": 5})
    step = Step("power", lambda p, r: Result({"result": p["l"]["o"] * p["k"], "name": f"<{p.k}>"}), uses=["l.o", "k"], returns="result double, name string")
    outer = Step("outer", lambda p, r: Result({"total": sum(x["result"] for x in r["power"].values())}), needs=["power"], swept=["power"],
                 sweep=lambda name, p, r: sweeping_of("l.o", [1.0, 4.0, 5.0]))
    study = Study(spark, str(tmp_path), params, [step, outer])
    sweep = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "`l.o` double")
    first = sorted((r[0], r.result, r.name, r.source) for r in study.run_sweep("power", sweep, {"k": 3}).collect())
    assert first == [(1.0, 3.0, "<3>", "computed"), (2.0, 6.0, "<3>", "computed"), (2.0, 6.0, "<3>", "computed")]
    assert study.store.results("power").count() == 2
    result, inner = study.run("outer")
    assert result["total"] == 30.0 and inner["power"]["4.0"]["result"] == 12.0 and len(inner["power"]) == 3
    assert study.store.results("power").count() == 4
    uncached = study.run_sweep("power", sweep, {"k": 3}, Options(cache=False))
    assert [r.source for r in uncached.collect()] == ["computed"] * 3
    with pytest.raises(KeyError):
        inner["power"]["7.0"]


def sweeping_of(key, values):
    batch = Sweep()
    for x in values:
        batch.add(str(x), {key: x})
    return batch


def test_force_reaches_levels(spark, tmp_path, params):
    inner, calls = counted()
    outer = Step("outer", lambda p, r: Result({"x": r["power"]["result"] + 1}), needs=["power"])
    study = Study(spark, str(tmp_path), params, [inner, outer])
    assert study.run("outer")[0]["x"] == 5
    study.run("outer", Options(force=1))
    assert len(calls) == 1
    study.run("outer", Options(force=2))
    assert len(calls) == 2
    assert dict(study.store.version_row("outer", 0).env_schema) == {"o": "float"}  # children's inputs are the parent's


def test_validation(spark, tmp_path):
    study = Study(spark, str(tmp_path))
    nothing = lambda p, r: Result({})
    with pytest.raises(ValueError, match="which no step is"):
        study.update_step(Step("a", nothing, needs=["b"]))
    assert study.steps == {}
    study.update_step(Step("a", nothing, needs=["b"]), validate=False)
    study.update_step(Step("b", nothing), validate=True)
    with pytest.raises(ValueError, match="one another"):
        study.update_step(Step("b", nothing, swept=["a"]))
    assert "a <- b" in str(study)


def test_graph_functions():
    edges = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": [], "x": ["y"], "y": ["x"]}
    assert graph.cycle(edges, "a") == [] and graph.cycle(edges, "x") == ["x", "y", "x"]
    assert graph.order(edges, "a") == ["d", "b", "c", "a"]
    assert graph.missing({"a": ["q", "q"]}) == {"a": ["q"]}


def test_address_is_the_same_on_both_sides(spark):
    df = spark.createDataFrame([(1, 2.0, "é\"x", True)], "a long, b double, c string, d boolean")
    form = canonical_column(df, {k: k for k in df.columns})
    assert df.select(address_column(form)).first()[0] == address({"a": 1.0, "b": 2, "c": "é\"x", "d": True})


def test_lookup_compares_numbers_by_value_and_null_with_null(spark):
    sweep = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, s string")
    store = spark.createDataFrame([(1.0, "a"), (2.0, None), (-0.0, "c")], "x double, s string")
    assert memo.hits(sweep, store, ["x", "s"]).count() == 2
    assert memo.misses(sweep, store, ["x", "s"]).first().x == 3


def test_store_upsert_compact_clear(spark, tmp_path, params):
    step, _ = counted()
    study = Study(spark, str(tmp_path), params, [step])
    study.run("power")
    study.run("power", Options(force=1))
    assert study.store.raw("result").count() == 2 and study.store.results("power").count() == 1
    study.store.compact("power")
    assert study.store.raw("result").count() == 1 and study.run("power")[0]["result"] == 4
    assert study.store.orphans().count() == 0 and study.store.catalogue().count() == 1
    study.store.clear("power")
    assert study.store.table("result").count() == 0


def test_codecs(spark, tmp_path):
    registry = default_registry()
    with pytest.raises(TypeError):
        registry.write(spark, {1, 2}, str(tmp_path / "x"))
    trusted_pickle(registry)
    name, own = registry.write(spark, {1, 2}, str(tmp_path / "y"))
    assert registry.read(spark, name, str(tmp_path / "y")) == {1, 2} and own == "builtins.set"
    assert safe_name("a.b/c") != safe_name("a_b_c") and "." not in safe_name("a.b")

    @registry.writable(frozenset)
    def write(spark, value, path):
        registry.write(spark, set(value), path)

    @registry.readable(frozenset)
    def read(spark, path):
        return frozenset(registry.read(spark, "builtins.object", path))

    name, _ = registry.write(spark, frozenset({5}), str(tmp_path / "z"))
    assert registry.read(spark, name, str(tmp_path / "z")) == frozenset({5})


def test_stream(spark, tmp_path):
    study = Study(spark, str(tmp_path / "study"), steps=[Step("power", expression={"result": F.col("o") * F.col("o")}, uses=["o"])])
    spark.createDataFrame([(1.0,), (2.0,)], "o double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("o double").parquet(str(tmp_path / "in"))
    ingest(study, "power", stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 4.0]


def test_long_ways_are_found_or_refused(spark):
    ring = spark.range(90).selectExpr("cast(id as int) as parent", "cast((id + 1) % 90 as int) as child")
    line = spark.range(70).selectExpr("cast(100 + id as int) as parent", "cast(101 + id as int) as child")
    tail = spark.createDataFrame([(95, 0)], "parent int, child int")  # leads into the ring, lies on no cycle
    found = {r.node: r.length for r in graph.cycles(spark, ring.union(line).union(tail)).collect()}
    assert found == dict.fromkeys(range(90), 90)
    assert max(r.level for r in graph.levels(spark, line, 100).collect()) == 70
    with pytest.raises(Exception, match="RECURSION"):
        graph.cycles(spark, ring, longest=20).collect()
