"""Named map and reduce functions, native (over columns) or opaque (plain Python)."""

from __future__ import annotations

import importlib
import operator
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    name: str
    call: Callable
    native: bool
    schema: str | None = None
    order_by: tuple[str, ...] = ()
    merge: Callable | None = None
    counts: bool = False


def add(a: tuple, b: tuple) -> tuple:
    """The ``merge`` of items whose values add up. Spark knows it, and adds whole numbers up itself."""
    return a[0], *map(operator.add, a[1:], b[1:])


_FOUND: dict[str, dict[str, Function]] = {"map": {}, "reduce": {}}


class ProjectNotFound(LookupError):
    """No such project, or no such function in it."""


def _register(kind: str, name: str, **facts):
    def keep(call: Callable) -> Callable:
        _FOUND[kind][name] = Function(name, call, **facts)
        return call

    return keep


def mapper(name: str, native: bool = False, schema: str | None = None, merge: Callable | None = None, counts: bool = False):
    """native: DataFrame (and auxiliary data) to DataFrame, its first column the key. Else: line, auxiliary data to items of ``schema``.

    merge: a function of two items of a key that makes one; a task then merges its items before they are dealt out. With ``add``
    a reducer gets one item of each key.
    counts: the function gets some lines at once and gives keys alone, each of which counts one; ``schema`` names key and count.
    """
    if not native and not schema:
        raise ValueError("an opaque function needs the schema of its items")
    if counts and (native or merge not in (None, add)):
        raise ValueError("counts of keys add up")
    return _register("map", name, native=native, schema=schema, merge=add if counts else merge, counts=counts)


def reducer(name: str, native: bool = False, schema: str | None = None, order_by: tuple[str, ...] = (), merge: Callable | None = None):
    """native: DataFrame to DataFrame. Else: iterator of a key's items, auxiliary data to items of ``schema``.

    merge: a function of two outputs of a key that makes one; it says that parts of the input may be reduced at different times.
    """
    if not native and not schema:
        raise ValueError("an opaque function needs the schema of its items")
    return _register("reduce", name, native=native, schema=schema, order_by=order_by, merge=merge)


def find(kind: str, name: str, project: str | None = None) -> Function:
    if project:
        # its functions go to the workers with it
        try:
            importlib.import_module(project)
        except ModuleNotFoundError as e:
            raise ProjectNotFound(f"no project {project}") from e
    if name not in _FOUND[kind]:
        raise ProjectNotFound(f"no {kind} function {name}")
    return _FOUND[kind][name]


reducer("identity", native=True)(lambda df, aux=None: df)
