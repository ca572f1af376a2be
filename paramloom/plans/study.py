"""Studies: steps over a parameter set, each result computed once.

A step is a Python function of the parameter set and of the results of the
steps it needs, or a column expression over a whole sweep. A sweep is a
DataFrame of inputs; its known results come from the store in one join and
only the others are computed, in parallel, whatever their number.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramloom.functions.canonical import TYPES, address_column, canonical_column, schema_of, type_name
from paramloom.params import ParamSet, unflatten
from paramloom.plans.graph import cycle, missing, order
from paramloom.sources.codecs import Registry, default_registry, safe_name
from paramloom.sources.store import Store


@dataclass(frozen=True)
class Options:
    force: int = 0  #: levels from the top that are computed again
    cache: bool = True  #: whether the store is read and written
    plot: bool = False
    verbose: bool = False

    def __post_init__(self):
        if not isinstance(self.force, int) or isinstance(self.force, bool) or self.force < 0:
            raise ValueError("force is a number of levels")

    def below(self) -> Options:
        return replace(self, force=max(self.force - 1, 0), plot=False)


@dataclass
class Result:
    """values: small ones, kept in the table; files: large ones, by codec."""

    values: dict[str, Any] | None = None
    files: dict[str, Any] | None = None

    def __getitem__(self, key: str) -> Any:
        if self.values is not None and key in self.values:
            return self.values[key]
        return (self.files or {})[key]


class SweptResults(Mapping):
    """The results of a swept expression step by batch id, read when asked for: one row, or all in order and a partition at a time."""

    def __init__(self, frame: DataFrame, values: list[str]):
        self.frame, self._values = frame.select("ord", "batch_id", *values), values

    def _result(self, row) -> Result:
        return Result({v: row[v] for v in self._values})

    def __getitem__(self, batch_id: str) -> Result:
        row = self.frame.filter(F.col("batch_id") == str(batch_id)).first()
        if row is None:
            raise KeyError(batch_id)
        return self._result(row)

    def items(self) -> Iterator[tuple[str, Result]]:
        return ((r["batch_id"], self._result(r)) for r in self.frame.orderBy("ord").toLocalIterator())

    def values(self) -> Iterator[Result]:
        return (result for _, result in self.items())

    def __iter__(self) -> Iterator[str]:
        return (batch_id for batch_id, _ in self.items())

    def __len__(self) -> int:
        return self.frame.count()


@dataclass
class Sweep:
    """Runs of a needed step: rows of overrides (dotted names) by batch_id, all with the schema of the first."""

    schema: dict[str, str] | None = None
    runs: dict[str, dict[str, Any]] = field(default_factory=dict)

    def add(self, batch_id: str, overrides: dict[str, Any]) -> None:
        kinds = schema_of(ParamSet(unflatten(overrides)).flat(unused=True, hidden=True))
        if self.schema is None:
            self.schema = kinds
        elif kinds != self.schema:
            odd = {k: (self.schema.get(k), kinds.get(k)) for k in {*kinds, *self.schema} if self.schema.get(k) != kinds.get(k)}
            raise TypeError(f"run {batch_id} has another schema: {odd}")
        self.runs[str(batch_id)] = overrides

    def frame(self, spark: SparkSession) -> DataFrame:
        kinds = self.schema or {}
        fields = [T.StructField("ord", T.LongType()), T.StructField("batch_id", T.StringType())]
        schema = T.StructType(fields + [T.StructField(k, TYPES[v]) for k, v in kinds.items()])
        return spark.createDataFrame([(i, b, *(run[k] for k in kinds)) for i, (b, run) in enumerate(self.runs.items())], schema)


@dataclass
class Step:
    """run(params, results) -> Result. expression: value columns over a sweep, for steps that columns can express.

    needs: steps run before, in this order. sweep(name, params, results): the
    Sweep over which a needed step runs, or None for a single run. swept: the
    needs that sweep may answer for. uses: the parameters (dotted) the step
    depends on; a function step may leave it out and have its reads recorded.
    returns: the columns of a function's values (DDL); with it and uses, a
    function that needs no other step runs over whole sweeps on the executors.
    """

    name: str
    run: Callable[[ParamSet, dict[str, Any]], Result] | None = None
    expression: dict[str, Column] | None = None
    uses: list[str] | None = None
    returns: str | None = None
    needs: list[str] = field(default_factory=list)
    swept: list[str] = field(default_factory=list)
    sweep: Callable[[str, ParamSet, dict[str, Any]], Sweep | None] | None = None
    changelog: str = ""
    description: str = ""
    history: bool = False
    plot: Callable[[Result, dict[str, Any]], None] | None = None

    def __post_init__(self):
        self.swept = list(dict.fromkeys(self.swept))
        if (self.run is None) == (self.expression is None):
            raise ValueError(f"step {self.name} needs either run or expression")
        if self.expression is not None and self.uses is None:
            raise ValueError(f"expression step {self.name} must say what it uses")

    @property
    def over_tables(self) -> bool:
        """Whether the step runs over a whole sweep at once."""
        return not self.needs and (self.expression is not None or bool(self.uses and self.returns))

    def value_names(self) -> list[str]:
        return list(self.expression) if self.expression is not None else T.StructType.fromDDL(self.returns).names


class Study:
    def __init__(self, spark: SparkSession, root: str, params: ParamSet | None = None, steps: list[Step] | dict[str, Step] | None = None, codecs: Registry | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.params = params if params is not None else ParamSet()
        self.store = Store(spark, f"{self.root}/store")
        self.codecs = codecs or default_registry()
        self.steps: dict[str, Step] = {}
        self._versions: dict[str, tuple[int, dict[str, str], dict] | None] = {}
        if steps:
            self.update_steps(list(steps.values()) if isinstance(steps, dict) else steps)

    # registration

    def update_step(self, step: Step, validate: bool = True) -> None:
        self.update_steps([step], validate)

    def update_steps(self, steps: list[Step], validate: bool = True) -> None:
        """Adds or replaces steps; if the graph is then invalid, none of them."""
        before = dict(self.steps)
        self.steps.update({s.name: s for s in steps})
        if validate:
            try:
                self.validate()
            except ValueError:
                self.steps = before
                raise

    def children(self) -> dict[str, list[str]]:
        return {n: list(dict.fromkeys([*s.needs, *s.swept])) for n, s in self.steps.items()}

    def validate(self, name: str | None = None, error: bool = True) -> list[str]:
        """What is wrong with the graph (under one step)."""
        graph = self.children()
        names = [name] if name else list(graph)
        gaps = missing(graph)
        under = {n for start in names for n in order(graph, start)}
        wrong = [f"{n} needs {', '.join(gaps[n])}, which no step is" for n in graph if n in gaps and n in under]
        loops = {tuple(sorted(set(way))): way for start in names if (way := cycle(graph, start))}
        wrong += [f"steps need one another: {' > '.join(way)}" for way in loops.values()]
        if wrong and error:
            raise ValueError("; ".join(wrong))
        return wrong

    def describe(self) -> str:
        lines = ["parameters:", *(f"  {k} = {v!r}" for k, v in copy.deepcopy(self.params).flat(unused=True, hidden=True).items()), "steps:"]
        lines += [f"  {s.name} <- {', '.join(self.children()[s.name]) or 'nothing'}" for s in self.steps.values()]
        return "\n".join(lines)

    __str__ = describe

    # single runs

    def run(self, name: str, options: Options | None = None) -> tuple[Result, dict[str, Any] | None]:
        """A step's result and those of the steps it needs."""
        if name not in self.steps:
            raise ValueError(f"no step is named {name}")
        return self._run(name, copy.deepcopy(self.params), options or Options(), top=True)

    def _run(self, name: str, params: ParamSet, options: Options, top: bool) -> tuple[Result, dict[str, Any] | None]:
        step = self.steps[name]
        params.begin_run(top)
        params.forget_use()
        found = self._load(step, params) if options.cache and not options.force else None
        if found is not None and not top:
            return found, None
        results = self._needed(step, params, options.below() if found is None else replace(options.below(), force=0))
        if found is None:
            found = self._execute(step, params, results)
            if options.cache:
                self._save(step, params, found)
        if options.verbose:
            print(f"{name}: {', '.join((found.values or {}).keys())}")
        if options.plot and step.plot:
            step.plot(found, results)
        return found, results

    def _execute(self, step: Step, params: ParamSet, results: dict[str, Any]) -> Result:
        params.lock()
        try:
            if step.expression is not None:
                values = {k: params.at(k) for k in step.uses}
                schema = T.StructType([T.StructField(k, TYPES[v]) for k, v in schema_of(values).items()])
                row = self.spark.createDataFrame([tuple(values.values())], schema).select(*[c.alias(k) for k, c in step.expression.items()]).first()
                return Result(row.asDict())
            for key in step.uses or ():
                params.at(key)
            return step.run(params, results)
        finally:
            params.lock(False)

    def _needed(self, step: Step, params: ParamSet, options: Options) -> dict[str, Any]:
        results: dict[str, Any] = {}
        for child in step.needs:
            batch = step.sweep(child, params, results) if step.sweep else None
            if batch is None:
                inner = copy.deepcopy(params)
                results[child] = self._run(child, inner, options, top=False)[0]
                params.merge_use(inner)
            else:
                results[child] = self._swept(child, params, batch, options)
        return results

    def _swept(self, child: str, params: ParamSet, batch: Sweep, options: Options) -> Any:
        step = self.steps[child]
        if step.over_tables:
            for key in step.uses:
                if key not in (batch.schema or {}):
                    params.at(key)
            base = {k: params.node(k).read() for k in step.uses if k not in (batch.schema or {})}
            done = self.run_sweep(child, batch.frame(self.spark), base, options)
            return SweptResults(done, step.value_names())
        out: dict[str, Result] = {}
        for batch_id, overrides in batch.runs.items():
            inner = params.overlaid(unflatten(overrides))
            inner.begin_run(True)
            out[batch_id] = self._run(child, inner, options, top=False)[0]
            for key in overrides:  # a swept parameter is no input of the parent
                node = inner
                for part in key.split("."):
                    node = node.parts().get(part, node)
                for below in node.walk():
                    below.used = False
            params.merge_use(inner)
        return out

    # whole sweeps

    def run_sweep(self, name: str, sweep: DataFrame, base: dict[str, Any] | None = None, options: Options | None = None) -> DataFrame:
        """The sweep with the step's value columns and source (cache or computed).

        sweep has a column per overridden parameter (named with dots as in
        the set); parameters it lacks come from base. Stored results are
        joined once; the others are computed in one pass and appended.
        """
        step, options = self.steps[name], options or Options()
        if not step.over_tables:
            raise TypeError(f"step {name} has neither an expression nor the uses and returns of a function to run over a sweep")
        rows = sweep
        for key, value in (base or {}).items():
            if key not in rows.columns:
                rows = rows.withColumn(key, F.lit(value))
        lacking = [k for k in step.uses if k not in rows.columns]
        if lacking:
            raise LookupError(f"{', '.join(lacking)}: neither swept nor given")
        quoted = rows.select(*[F.col(f"`{c}`").alias(c.replace(".", "__")) for c in rows.columns])
        keys = {k: k.replace(".", "__") for k in step.uses}
        env_schema = {k: self._stored_type(quoted.schema[c].dataType) for k, c in keys.items()}
        form = canonical_column(quoted, keys)
        keyed = quoted.withColumn("_form", form).withColumn("_key", address_column(F.col("_form")))
        values = step.value_names()
        if step.expression is not None:
            computed = F.struct(*[c.alias(v) for v, c in step.expression.items()])
            kinds = quoted.select(computed.alias("_c")).schema["_c"].dataType
        else:
            computed, kinds = None, T.StructType.fromDDL(step.returns)
        usable = options.cache and not options.force and not step.history
        version = self.store.version_of(step.name, env_schema, None, step.changelog, step.description) if options.cache else None
        if usable:
            stored = self.store.results(step.name, version).select(F.col("env_key").alias("_key"), F.from_json("data", kinds).alias("_stored"))
            keyed = keyed.join(stored, "_key", "left")
        else:
            keyed = keyed.withColumn("_stored", F.lit(None).cast(kinds))
        if computed is None:
            results = self._computed(step, keyed.filter("_stored is null").dropDuplicates(["_key"]), keys, kinds)
            keyed, computed = keyed.join(results, "_key", "left"), F.col("_made")
        chosen = keyed.withColumn("_out", F.coalesce("_stored", computed)).withColumn("_hit", F.col("_stored").isNotNull())
        if options.cache:
            fresh = chosen.filter("not _hit").select(
                F.col("_form").alias("environment"), F.col("_key").alias("env_key"), F.to_json("_out").alias("data"), F.lit(None).cast("string").alias("file_path")
            )
            if not step.history:
                fresh = fresh.dropDuplicates(["env_key"])
            marked = self._kept(chosen)
            self.store.save_all(step.name, version, fresh, step.history)
            chosen = marked
        return chosen.select(
            *[F.col(c.replace(".", "__")).alias(c) for c in sweep.columns],
            *[F.col(f"_out.{v}").alias(v) for v in values],
            F.when(F.col("_hit"), "cache").otherwise("computed").alias("source"),
        )

    def _computed(self, step: Step, missing: DataFrame, keys: dict[str, str], kinds: T.StructType) -> DataFrame:
        """(_key, _made): a function step over inputs that differ, in Arrow batches on the executors; written, so that it runs once."""
        import pandas as pd

        params, run, names = copy.deepcopy(self.params), step.run, kinds.names
        for node in params.walk():
            node.used = False

        def over(batches):
            for pdf in batches:
                made = []
                for row in pdf.to_dict("records"):
                    given = {k: None if pd.isna(row[c]) else row[c].item() if hasattr(row[c], "item") else row[c] for k, c in keys.items()}
                    inner = params.overlaid(unflatten(given))
                    inner.begin_run(True)
                    inner.lock()
                    values = run(inner, {}).values
                    made.append({v: values[v] for v in names})
                yield pd.DataFrame({"_key": pdf["_key"], "_made": made})

        schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_made", kinds)])
        return self._written(missing.select("_key", *keys.values()).mapInPandas(over, schema))

    def _kept(self, chosen: DataFrame) -> DataFrame:
        """Written before the store grows, so that source tells what this call found."""
        return self._written(chosen.drop("_form", "_stored", "_made"))

    def _written(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/sweeps/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _stored_type(kind: T.DataType) -> str:
        name = type_name(kind)
        return "float" if name == "datetime" else name

    # store

    def _current(self, step: Step) -> tuple[int, dict[str, str], dict] | None:
        if step.name not in self._versions:
            row = self.store.step(step.name)
            version = None if row is None else self.store.version_row(step.name, row.current_version)
            self._versions[step.name] = None if version is None else (version.version, dict(version.env_schema or {}), dict(version.file_schema or {}))
        return self._versions[step.name]

    def _load(self, step: Step, params: ParamSet) -> Result | None:
        current = None if step.history else self._current(step)
        if current is None:
            return None
        version, env_schema, files = current
        probe = copy.deepcopy(params)
        try:
            for key in env_schema:
                self._mark(probe, key)
            flat = probe.flat(unused=True)
            values = {k: flat[k] for k in env_schema}
        except (KeyError, AttributeError, LookupError):
            return None  # a parameter of the stored schema is gone: not known under this set
        row = self.store.find(step.name, version, values)
        if row is None:
            return None
        for key in env_schema:
            self._mark(params, key)
        loaded = {k: self.codecs.read(self.spark, v.writer, f"{row.file_path}/{safe_name(k)}") for k, v in files.items()} if row.file_path else None
        return Result(None if row.data is None else json.loads(row.data), loaded)

    @staticmethod
    def _mark(params: ParamSet, dotted: str) -> None:
        node = params
        for key in dotted.split("."):
            nodes = node.parts()
            if key not in nodes:
                if key == "var" and hasattr(node, "function"):
                    return
                inner = nodes.get("")
                if inner is None or key not in inner.parts():
                    raise KeyError(dotted)
                inner.used = True
                nodes = inner.parts()
            node = nodes[key]
            node.used = True

    def _save(self, step: Step, params: ParamSet, result: Result) -> None:
        values = params.flat()
        path, files = None, {}
        if result.files:
            path = f"{self.root}/files/{safe_name(step.name)}/{uuid.uuid4().hex}"
            files = {k: self.codecs.write(self.spark, v, f"{path}/{safe_name(k)}") for k, v in result.files.items()}
        version = self.store.version_of(step.name, schema_of(values), files, step.changelog, step.description)
        self.store.save(step.name, version, values, result.values, path, step.history)
        self._versions.pop(step.name, None)
