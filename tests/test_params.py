import copy
import datetime
import math
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from paramloom.functions.canonical import address, canonical, schema_of, stored_value, value_type
from paramloom.params import Alias, ByInputs, ByOutput, Derived, Hidden, Locked, ParamSet, Renew, Value, frame, unflatten


@pytest.fixture
def env():
    p = ParamSet({"a": 1})
    p["o"] = Value(2, float)
    p["l"] = {"apples": 3}
    p["r"] = Alias("l.apples")
    p["i"] = Hidden({"oranges": 4})
    p.begin_run()
    p.forget_use()
    return p


def test_names_are_strings(env):
    with pytest.raises(TypeError):
        env[1] = 2


def test_reading_marks_use(env):
    assert not env.nodes["a"].used
    assert env["a"] == 1
    assert env.nodes["a"].used


def test_alias_reads_its_target_without_marking_it(env):
    assert env["r"] == 3
    assert not env.node("l.apples").used


@pytest.mark.parametrize(
    "read, unused, hidden, keys",
    [
        (["r"], False, True, ["r"]),
        (["r", "i.oranges"], False, True, ["i.oranges", "r"]),
        (["r", "i.oranges"], True, True, ["a", "i.oranges", "l.apples", "o", "r"]),
        (["r", "i.oranges"], True, False, ["a", "l.apples", "o", "r"]),
        (["r", "i.oranges"], False, False, ["r"]),
    ],
)
def test_flattening(env, read, unused, hidden, keys):
    for key in read:
        env.at(key)
    assert sorted(env.flat(unused, hidden)) == keys


def test_buffer_is_renewed_by_parent_runs_only(env):
    env["x"] = ByOutput(datetime.datetime.now, datetime.timezone.utc, renew=Renew.EACH_PARENT_RUN)
    first = env["x"]
    assert env["x"] == first
    time.sleep(0.01)
    env.begin_run(True)
    second = env["x"]
    assert second != first
    env.begin_run(False)
    assert env["x"] == second
    env.forget_use()
    env["x"]
    assert isinstance(env.flat()["x"], float)


def test_value_by_inputs_is_keyed_by_them(env):
    env["y"] = ByInputs(np.linspace, 1, 5, Hidden(11))
    assert len(env["y"]) == 11
    assert sorted(env.flat()) == ["y.start", "y.stop", "y.var"]
    assert "y.num" in env.flat(hidden=True) and "y" not in env.flat(hidden=True)


def test_kept_value_marks_its_inputs_again(env):
    env["y"] = ByInputs(np.linspace, 1, 5, 11)
    env["y"]
    env.forget_use()
    inner = copy.deepcopy(env)
    inner["y"]
    assert inner.flat()["y.start"] == 1


def test_a_value_of_none_is_kept():
    calls = []
    node = Derived(lambda: calls.append(1))
    node.read(), node.read()
    assert len(calls) == 1


def test_arguments_need_names():
    with pytest.raises(TypeError):
        Derived(lambda *xs: xs, 1, 2)


def test_lock(env):
    env.lock()
    with pytest.raises(Locked):
        env["i"]["oranges"] = 3
    with pytest.raises(Locked):
        env.o = 3
    env.lock(False)
    env["o"] = 5
    assert env["o"] == 5


def test_cast_survives(env):
    env["o"] = 4
    assert env.nodes["o"].cast == "float"
    env.o = 6
    assert env.nodes["o"].cast == "float"
    over = env.overlaid({"o": 2})
    assert over.nodes["o"].cast == "float" and over["o"] == 2 and env["o"] == 6
    over["o"]
    assert over.flat()["o"] == 2.0 and isinstance(over.flat()["o"], float)


def test_overlay_is_shallow(env):
    env["l"]["pies"] = math.pi
    assert "pies" not in env.overlaid({"l": {"apples": 9}})["l"]


def test_missing_attribute(env):
    with pytest.raises(AttributeError):
        env.nothing


def test_use_merges_by_key(env):
    other = copy.deepcopy(env)
    other["a"]
    env["z"] = 1
    env.forget_use()
    env.merge_use(other)
    assert env.nodes["a"].used and not env.nodes["z"].used


def test_types():
    assert [value_type(v) for v in (1, 1.0, True, "True", datetime.datetime(2024, 1, 1), np.int32(3), np.float32(2.5))] == ["int", "float", "bool", "str", "datetime", "int", "float"]
    for wrong in (None, [1], {}, 1j, np.bool_(True), b"x"):
        with pytest.raises(TypeError):
            value_type(wrong)
    assert stored_value(datetime.datetime(1970, 1, 2)) == 86400.0


def test_keys_reject_infinity():
    with pytest.raises(ValueError):
        address({"a": math.nan})


scalars = st.one_of(st.booleans(), st.integers(-(2**50), 2**50), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8))
names = st.text("abcdef", min_size=1, max_size=4)


@given(st.dictionaries(names, scalars, max_size=6))
def test_key_ignores_order(values):
    assert address(values) == address(dict(reversed(values.items())))


@given(st.integers(-(2**50), 2**50))
def test_numbers_compare_by_value(n):
    assert canonical({"a": n}) == canonical({"a": float(n)})
    assert address({"a": n}) != address({"a": str(n)})


@given(st.dictionaries(names, st.one_of(scalars, st.dictionaries(names, scalars, min_size=1, max_size=3)), max_size=5))
def test_flatten_then_unflatten(values):
    flat = ParamSet(values).flat(unused=True)
    assert unflatten(flat) == values
    assert set(schema_of(flat)) == set(flat)


def test_frame(spark):
    sets = [ParamSet({"a": i, "n": {"x": 0.5}}) for i in range(3)]
    df = frame(spark, sets)
    assert df.columns == ["ord", "a", "n.x"] and df.count() == 3
    with pytest.raises(TypeError):
        frame(spark, [ParamSet({"a": 1}), ParamSet({"a": 1.5})])
