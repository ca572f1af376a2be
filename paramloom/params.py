"""Parameter sets: typed, nested, with hidden, aliased and derived parts.

A set is a tree of nodes on the driver. Reading a node marks it used; the
flattened set (dotted keys) of used and visible nodes is what a result
depends on. ``frame`` turns sets into a DataFrame.
"""

from __future__ import annotations

import copy
import enum
import inspect
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paramloom.functions.canonical import TYPES, stored_value, value_type

SEPARATOR = "."
_UNSET = object()


class Renew(enum.Enum):
    """When a derived value is computed again."""

    NEVER = "never"
    EACH_RUN = "each run"
    EACH_PARENT_RUN = "each parent run"


class Locked(AttributeError):
    """A set was written to while a step ran on it."""


class Node:
    """Common part of all nodes: use mark, lock, traversal."""

    used = False
    locked = False

    def parts(self) -> dict[str, Node]:
        return {}

    def walk(self) -> Iterator[Node]:
        yield self
        for part in self.parts().values():
            yield from part.walk()

    def read(self) -> Any:
        self.used = True
        return self.evaluate()

    def evaluate(self) -> Any:
        raise NotImplementedError

    def flat(self, unused: bool, hidden: bool, types: bool) -> Any:
        """A stored value or type name, a dict of such by dotted key, or None to leave it out."""
        raise NotImplementedError

    def begin(self, parent: bool, root: ParamSet) -> None:
        for part in self.parts().values():
            part.begin(parent, root)

    def lock(self, on: bool = True) -> None:
        for node in self.walk():
            node.locked = on

    def forget_use(self) -> None:
        for node in self.walk():
            node.used = False

    def merge_use(self, other: Node) -> None:
        """Marks used what other used, by key."""
        self.used = self.used or other.used
        theirs = other.parts()
        for key, part in self.parts().items():
            if key in theirs:
                part.merge_use(theirs[key])


class Value(Node):
    """A leaf. cast: one of the type names (or their Python classes); it decides the stored type, not what a step reads."""

    def __init__(self, value: Any, cast: str | type | None = None):
        cast = cast.__name__ if isinstance(cast, type) else cast
        if cast is not None and cast not in TYPES:
            raise TypeError(f"cast must be one of {', '.join(TYPES)}")
        self.value, self.cast = value, cast

    def evaluate(self) -> Any:
        return self.value

    def stored(self) -> Any:
        if self.cast in (None, "datetime"):
            return stored_value(self.value)
        return {"bool": bool, "int": int, "float": float, "str": str}[self.cast](self.value)

    def flat(self, unused: bool, hidden: bool, types: bool) -> Any:
        return (self.cast or value_type(self.value)) if types else self.stored()


class Hidden(Node):
    """Keeps a subtree out of the key."""

    def __init__(self, inner: Any):
        self.inner = node_of(inner)

    def parts(self) -> dict[str, Node]:
        return {"": self.inner}

    def evaluate(self) -> Any:
        return self.inner.read()

    def flat(self, unused: bool, hidden: bool, types: bool) -> Any:
        return self.inner.flat(unused, hidden, types) if hidden else None


class Alias(Node):
    """Another node's value under this name; resolved when a run begins, its target is not marked used."""

    def __init__(self, target: str | list[str]):
        self.target = target.split(SEPARATOR) if isinstance(target, str) else list(target)
        self.copy: Node | None = None

    @property
    def name(self) -> str:
        return SEPARATOR.join(self.target)

    def parts(self) -> dict[str, Node]:
        return {} if self.copy is None else {"": self.copy}

    def begin(self, parent: bool, root: ParamSet) -> None:
        self.resolve(root)

    def resolve(self, root: ParamSet) -> None:
        node: Node = root
        for key in self.target:
            node = node.inner if isinstance(node, Hidden) else node
            node = node.parts()[key]
        node = node.inner if isinstance(node, Hidden) else node
        self.copy = copy.deepcopy(node)

    def evaluate(self) -> Any:
        if self.copy is None:
            raise LookupError(f"alias of {self.name} is read before a run began")
        return self.copy.read()

    def flat(self, unused: bool, hidden: bool, types: bool) -> Any:
        return None if self.copy is None else self.copy.flat(unused, hidden, types)


class ParamSet(Node):
    """Named nodes. ``s['a']`` and ``s.a`` read, assignment writes and keeps a leaf's cast."""

    def __init__(self, values: dict[str, Any] | None = None):
        object.__setattr__(self, "nodes", {})
        for key, value in (values or {}).items():
            self[key] = value

    def parts(self) -> dict[str, Node]:
        return self.nodes

    def keys(self):
        return self.nodes.keys()

    def items(self):
        return ((k, v.read()) for k, v in self.nodes.items())

    def __iter__(self):
        return iter(self.nodes)

    def __len__(self) -> int:
        return len(self.nodes)

    def __contains__(self, key) -> bool:
        return key in self.nodes

    def __getitem__(self, key: str) -> Any:
        return self.nodes[key].read()

    def __setitem__(self, key: str, value: Any) -> None:
        if not isinstance(key, str):
            raise TypeError("a parameter's name is a string")
        if self.locked:
            raise Locked(f"{key} can't be set while a step runs")
        old = self.nodes.get(key)
        if isinstance(old, Value) and old.cast and not isinstance(value, (Node, dict)):
            value = Value(value, old.cast)
        self.nodes[key] = node_of(value)

    def __getattr__(self, key: str) -> Any:
        nodes = self.__dict__.get("nodes", {})
        if key in nodes:
            return nodes[key].read()
        raise AttributeError(key)

    def __setattr__(self, key: str, value: Any) -> None:
        if key in ("used", "locked"):
            object.__setattr__(self, key, value)
        else:
            self[key] = value

    def evaluate(self) -> ParamSet:
        return self

    def at(self, dotted: str) -> Any:
        """Reads along a dotted path."""
        value: Any = self
        for key in dotted.split(SEPARATOR):
            value = value[key]
        return value

    def node(self, dotted: str) -> Node:
        """The node itself, without marking use."""
        node: Node = self
        for key in dotted.split(SEPARATOR):
            node = node.inner if isinstance(node, Hidden) else node
            node = node.parts()[key]
        return node

    def begin_run(self, parent: bool = True) -> None:
        self.begin(parent, self)

    def flat(self, unused: bool = False, hidden: bool = False, types: bool = False) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for key, node in self.nodes.items():
            if not (node.used or unused):
                continue
            got = node.flat(unused, hidden, types)
            if isinstance(got, dict):
                out.update({f"{key}{SEPARATOR}{k}": v for k, v in got.items()})
            elif got is not None:
                out[key] = got
        return out

    def overlaid(self, other: ParamSet | dict[str, Any]) -> ParamSet:
        """A new set in which other's nodes replace this one's (a nested set as a whole), with this one's casts."""
        out, theirs = copy.deepcopy(self), copy.deepcopy(node_of(other))
        if not isinstance(theirs, ParamSet):
            raise TypeError("only a set or a dict can overlay a set")
        theirs._take_casts(self)
        out.nodes.update(theirs.nodes)
        return out

    def _take_casts(self, base: ParamSet) -> None:
        for key, node in self.nodes.items():
            old = base.nodes.get(key)
            if isinstance(node, Value) and isinstance(old, Value) and old.cast:
                node.cast = old.cast
            elif isinstance(node, ParamSet) and isinstance(old, ParamSet):
                node._take_casts(old)


class Derived(ParamSet):
    """A value computed from arguments when first read, then kept until renewed."""

    def __init__(self, function: Callable, *args, renew: Renew = Renew.NEVER, **kwargs):
        bound = inspect.signature(function).bind(*args, **kwargs)
        for parameter in bound.signature.parameters.values():
            if parameter.kind in (parameter.VAR_POSITIONAL, parameter.VAR_KEYWORD) and parameter.name in bound.arguments:
                raise TypeError(f"{parameter.name}: arguments must have names")
        super().__init__(dict(bound.arguments))
        self.__dict__.update(function=function, renew=renew, kept=_UNSET, signature=bound.signature)

    def __deepcopy__(self, memo):
        out = object.__new__(type(self))
        for k, v in self.__dict__.items():
            out.__dict__[k] = v if k in ("function", "kept", "signature", "renew") else copy.deepcopy(v, memo)
        return out

    def begin(self, parent: bool, root: ParamSet) -> None:
        if self.renew is Renew.EACH_RUN or (parent and self.renew is Renew.EACH_PARENT_RUN):
            self.__dict__["kept"] = _UNSET
        super().begin(parent, root)

    def evaluate(self) -> Any:
        values = {k: node.read() for k, node in self.nodes.items()}  # marks the inputs even if the value is kept
        if self.__dict__["kept"] is _UNSET:
            args, named = [], {}
            for k, v in values.items():
                if self.signature.parameters[k].kind is inspect.Parameter.POSITIONAL_ONLY:
                    args.append(v)
                else:
                    named[k] = v
            self.__dict__["kept"] = self.function(*args, **named)
        return self.__dict__["kept"]


class ByInputs(Derived):
    """Derived, and identified by its arguments and the function's name (``key.var``)."""

    def flat(self, unused: bool = False, hidden: bool = False, types: bool = False) -> dict[str, Any]:
        out = super().flat(unused, hidden, types)
        out["var"] = "str" if types else getattr(self.function, "__name__", type(self.function).__name__)
        return out


class ByOutput(Derived):
    """Derived, and identified by its value."""

    def __init__(self, function: Callable, *args, renew: Renew = Renew.NEVER, cast: str | type | None = None, **kwargs):
        super().__init__(function, *args, renew=renew, **kwargs)
        self.__dict__["cast"] = cast.__name__ if isinstance(cast, type) else cast

    def flat(self, unused: bool = False, hidden: bool = False, types: bool = False) -> Any:
        return Value(self.evaluate(), self.cast).flat(unused, hidden, types)


def node_of(value: Any) -> Node:
    if isinstance(value, Node):
        return value
    return ParamSet(value) if isinstance(value, dict) else Value(value)


def unflatten(flat: dict[str, Any]) -> dict[str, Any]:
    """The nested dict of dotted keys."""
    out: dict[str, Any] = {}
    for dotted, value in flat.items():
        *way, last = dotted.split(SEPARATOR)
        at = out
        for key in way:
            at = at.setdefault(key, {})
        at[last] = value
    return out


def frame(spark: SparkSession, sets: list[ParamSet], hidden: bool = True) -> DataFrame:
    """One row per set, a column for each dotted key, in the order of the list (column ord)."""
    rows = [s.flat(unused=True, hidden=hidden) for s in sets]
    kinds = sets[0].flat(unused=True, hidden=hidden, types=True) if sets else {}
    stored = {k: "float" if v == "datetime" else v for k, v in kinds.items()}
    for i, s in enumerate(sets):
        if s.flat(unused=True, hidden=hidden, types=True) != kinds:
            raise TypeError(f"set {i} has another schema than the first")
    schema = T.StructType([T.StructField("ord", T.LongType())] + [T.StructField(k, TYPES[v]) for k, v in stored.items()])
    return spark.createDataFrame([(i, *(r[k] for k in kinds)) for i, r in enumerate(rows)], schema)
