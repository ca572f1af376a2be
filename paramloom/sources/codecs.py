"""Codecs for results too large for a table cell, found by type or by name.

Tabular and array values are typed Parquet; anything else needs a codec of
its own. Nothing is ever unpickled unless ``trusted_pickle`` was registered by
the caller.
"""

from __future__ import annotations

import importlib
import pickle
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    write: Callable[[SparkSession, Any, str], None]
    read: Callable[[SparkSession, str], Any]


def qualified(cls: type) -> str:
    return f"{cls.__module__}.{cls.__qualname__}"


class Registry:
    def __init__(self):
        self._by_name: dict[str, Codec] = {}
        self._resolved: dict[str, str] = {}

    def register(self, cls: type, write: Callable, read: Callable) -> None:
        self._by_name[qualified(cls)] = Codec(write, read)
        self._resolved.clear()

    def writable(self, cls: type) -> Callable:
        """Decorator of a writer; the reader follows with ``readable``."""

        def add(write: Callable) -> Callable:
            old = self._by_name.get(qualified(cls))
            self.register(cls, write, old.read if old else _no_reader)
            return write

        return add

    def readable(self, cls: type) -> Callable:
        def add(read: Callable) -> Callable:
            old = self._by_name.get(qualified(cls))
            self.register(cls, old.write if old else _no_writer, read)
            return read

        return add

    def write(self, spark: SparkSession, value: Any, path: str) -> tuple[str, str]:
        """Writes by the nearest registered class of the value; returns (that class, the value's own)."""
        own = qualified(type(value))
        if own not in self._resolved:
            for cls in type(value).__mro__:
                if qualified(cls) in self._by_name:
                    self._resolved[own] = qualified(cls)
                    break
            else:
                raise TypeError(f"no codec for {own}")
        name = self._resolved[own]
        self._by_name[name].write(spark, value, path)
        return name, own

    def read(self, spark: SparkSession, writer: str, path: str) -> Any:
        if writer not in self._by_name:
            raise LookupError(f"no codec named {writer}")
        return self._by_name[writer].read(spark, path)


def _no_reader(spark, path):
    raise LookupError("this codec has no reader")


def _no_writer(spark, value, path):
    raise LookupError("this codec has no writer")


def safe_name(key: str) -> str:
    """A file name for a result key, one to one."""
    return urllib.parse.quote(key, safe="").replace(".", "%2E")


def _write_frame(spark: SparkSession, df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _write_list(spark: SparkSession, values: list, path: str) -> None:
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double").write.mode("overwrite").parquet(path)


#: Numbers of a stored list that may be read back to the driver; a longer one is read as a DataFrame.
MOST_NUMBERS = 10_000_000


def _read_list(spark: SparkSession, path: str) -> list[float]:
    stored = spark.read.parquet(path)
    if stored.count() > MOST_NUMBERS:
        raise ValueError(f"{path} holds more than {MOST_NUMBERS} numbers: read it as a DataFrame")
    return [r.value for r in stored.orderBy("i").collect()]


def _write_array(spark: SparkSession, array, path: str) -> None:
    _write_list(spark, array.tolist(), path)


def _read_array(spark: SparkSession, path: str):
    import numpy as np

    return np.array(_read_list(spark, path))


def _write_bytes(spark: SparkSession, value: bytes, path: str) -> None:
    spark.createDataFrame([(bytearray(value),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)


def _read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(path).first().content)


def default_registry() -> Registry:
    import numpy as np

    registry = Registry()
    registry.register(DataFrame, _write_frame, lambda spark, path: spark.read.parquet(path))
    registry.register(list, _write_list, _read_list)
    registry.register(np.ndarray, _write_array, _read_array)
    registry.register(bytes, _write_bytes, _read_bytes)
    return registry


def trusted_pickle(registry: Registry) -> None:
    """Pickle for any object, for stores that only trusted code writes."""
    registry.register(
        object,
        lambda spark, value, path: _write_bytes(spark, pickle.dumps(value), path),
        lambda spark, path: pickle.loads(_read_bytes(spark, path)),
    )


def load_object(dotted: str) -> Any:
    """A module's attribute by its dotted path; only for names that the caller trusts."""
    module, _, name = dotted.rpartition(".")
    if not module:
        raise LookupError(f"{dotted} names no attribute of a module")
    return getattr(importlib.import_module(module), name)


def foreign(registry: Registry, cls: type, to_bytes: Callable[[Any], bytes], from_bytes: Callable[[bytes], Any]) -> None:
    """A codec for a class with a file format of its own (HDF5, say): its bytes are stored, and parsed where they are read."""
    registry.register(
        cls,
        lambda spark, value, path: _write_bytes(spark, to_bytes(value), path),
        lambda spark, path: from_bytes(_read_bytes(spark, path)),
    )


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of foreign formats as bytes (path, content), to be decoded by a user's step."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content"))
