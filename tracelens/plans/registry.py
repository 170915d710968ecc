"""Extension points: analysis modules and outlier algorithms by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tracelens.operators import models as M

_ALGORITHMS: dict[str, Callable[..., DataFrame]] = {}
_MODULES: dict[str, Callable] = {}


def algorithm(name: str):
    """Registers ``f(df, keys, step, x, id_, params)``, which adds score and label."""

    def add(f):
        _ALGORITHMS[name.lower()] = f
        return f

    return add


def module(name: str):
    def add(f):
        _MODULES[name] = f
        return f

    return add


def find(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"unknown: {name}; there is {', '.join(sorted(kind))}")
    return kind[name]


def label(df: DataFrame, keys: list[str], step: str, x: str, id_: str, params: M.Params) -> DataFrame:
    """Labels by the algorithm that the parameters name, in any case."""
    return find(_ALGORITHMS, params.algorithm.lower())(df, keys, step, x, id_, params)


def run(name: str, *args, **kwargs):
    return find(_MODULES, name)(*args, **kwargs)


@algorithm("sstd")
def _sstd(df, keys, step, x, id_, params):
    return M.sstd_label(df.join(M.sstd_steps(df, keys, step, x), [*keys, step]), x, params.sstd_sigma)


def _stepwise(df, keys, step, x, id_, params):
    one = df.withColumn("__key", df[keys[0]].cast("string")) if len(keys) == 1 else df.selectExpr("*", f"concat_ws('|', {', '.join(keys)}) AS __key")
    return df.join(M.folded(one, "__key", step, x, id_, params), id_)


algorithm("hbos")(_stepwise)
algorithm("copod")(_stepwise)


@module("performance_analysis")
def analysis(execs: DataFrame, params: M.Params, keys: list[str] = ("func",)) -> DataFrame:
    """The default module: labels executions step by step."""
    return label(execs, list(keys), "step", "exclusive", "id", params)
