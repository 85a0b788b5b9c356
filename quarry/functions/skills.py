"""User code as functions: header, validation, typed parameters, registration."""

from __future__ import annotations

import ast
import inspect
import json
import os
import re
import select
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import sandbox

#: Names that code may not call and modules that it may not, or may, import (fixed values).
BLOCKED_CALLS = frozenset(["exec", "eval", "compile", "open", "__import__", "globals", "locals", "getattr", "setattr", "delattr"])
BLOCKED_MODULES = frozenset(["os", "sys", "subprocess", "shutil", "socket", "requests", "urllib", "http", "ctypes", "importlib"])
ALLOWED_MODULES = frozenset(["math", "statistics", "datetime", "json", "re", "collections", "itertools", "functools", "decimal", "fractions", "random", "string", "textwrap"])
#: Seconds that one call may take (fixed value).
CALL_SECONDS = 10
#: Seconds in which the code's process has to be there, and the bytes that it may use.
STARTUP_SECONDS = 30
MEMORY = 1 << 30
TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType()), "object": T.MapType(T.StringType(), T.StringType())}


#: A format field that reads a hidden attribute.
HIDDEN_FIELD = re.compile(r"\{[^{}]*[.\[]_[^{}]*\}")


def header(source: Column) -> Column:
    """The map of the leading ``# key: value`` lines."""
    top = F.regexp_extract(source, r"\A((?:# [^\n]*(?:\n|\z))*)", 1)
    pairs = F.filter(F.transform(F.split(top, "\n"), lambda s: F.struct(F.trim(F.regexp_extract(s, r"^# ([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(s, r"^# [^:]+:(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    distinct = F.filter(pairs, lambda p: F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), -1) == p)
    return F.map_from_entries(F.array_distinct(distinct))


def problems(source: str) -> list[str]:
    """What makes code unfit to run; nothing if it may.  Names that start with an underscore lead out of the sandbox (to classes, frames, modules of modules), so they are refused as well."""
    try:
        tree = ast.parse(source)
    except SyntaxError as x:
        return [f"syntax: {x.msg}"]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            found += [f"attribute: {a.name}" for a in node.names if a.name.startswith("_") or a.name in BLOCKED_MODULES | {"builtins"}]
        modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        found += [f"module: {m}" for m in modules if m.split(".")[0] in BLOCKED_MODULES]
        if isinstance(node, ast.Call):
            called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
            if called in BLOCKED_CALLS:
                found.append(f"call: {called}")
        if isinstance(node, ast.Attribute) and (node.attr.startswith("_") or node.attr in BLOCKED_MODULES | {"builtins"}):
            found.append(f"attribute: {node.attr}")
        if isinstance(node, ast.Name) and node.id.startswith("__"):
            found.append(f"name: {node.id}")
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and HIDDEN_FIELD.search(node.value):
            found.append(f"field: {HIDDEN_FIELD.search(node.value)[0]}")
    return found


def validated(source: Column) -> Column:
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield texts.map(lambda t: problems(t or ""))

    return F.pandas_udf(run, "array<string>")(source)


def parameters(schema: dict[str, dict]) -> T.StructType:
    """The struct of a parameter description; what is not required may be null."""
    return T.StructType([T.StructField(n, TYPES.get(p.get("type", "string"), T.StringType()), not p.get("required", False)) for n, p in schema.items()])


class Child:
    """A process of its own that has compiled the code and answers one call after another.

    It starts isolated, without the worker's environment, in an empty folder, and may open no further processes nor write files; what
    it sends back is JSON text.  A call that takes too long ends the process.
    """

    def __init__(self, source: str, seconds: float):
        self.seconds, self.rest = seconds, b""
        self.home = tempfile.TemporaryDirectory(prefix="code-")
        self.process = subprocess.Popen([sys.executable, "-I", "-c", inspect.getsource(sandbox)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=self.home.name, env={})
        self.send({"source": source, "allowed": sorted(ALLOWED_MODULES), "blocked": sorted(BLOCKED_CALLS), "memory": MEMORY})
        if found := self.answer(max(seconds, STARTUP_SECONDS)).get("error"):
            self.close()
            raise ValueError(found)

    def send(self, message: dict) -> None:
        self.process.stdin.write(json.dumps(message).encode() + b"\n")
        self.process.stdin.flush()

    def answer(self, seconds: float) -> dict:
        until = time.monotonic() + seconds
        while b"\n" not in self.rest:
            ready, _, _ = select.select([self.process.stdout], [], [], max(0.0, until - time.monotonic()))
            got = os.read(self.process.stdout.fileno(), 1 << 16) if ready else b""
            if not got:
                self.close()
                raise RuntimeError("the code's process has ended") if ready else TimeoutError(f"more than {seconds} s")
            self.rest += got
        line, self.rest = self.rest.split(b"\n", 1)
        return json.loads(line)

    def call(self, values: tuple):
        self.send({"values": values})
        told = self.answer(self.seconds)
        if "error" in told:
            raise ValueError(told["error"])
        return told["value"]

    def close(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()
        self.home.cleanup()


def _plain(value):
    """A value of a batch as JSON holds it."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value.tolist()]
    value = value.item() if isinstance(value, np.generic) else value
    return value if value is None or isinstance(value, (bool, int, float, str)) else [_plain(v) for v in value] if isinstance(value, (list, tuple)) else {str(k): _plain(v) for k, v in value.items()} if isinstance(value, dict) else str(value)


def register(spark: SparkSession, name: str, source: str, returns: str = "string", seconds: float = CALL_SECONDS) -> None:
    """The code's run function as an SQL function over Arrow batches: only code without problems, in a process of its own for each batch, and each call within its time."""
    if found := problems(source):
        raise ValueError("; ".join(found))

    def call(*columns: pd.Series) -> pd.Series:
        child = Child(source, seconds)
        try:
            made = [child.call(tuple(map(_plain, values))) for values in zip(*columns)]
        finally:
            child.close()
        return pd.Series([None if m is None else str(m) if returns == "string" else m for m in made], dtype=object)

    spark.udf.register(name, F.pandas_udf(call, returns))
