"""Output trees: a DataFrame, or a dict / list / tuple of trees, or a plain value."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

Tree = Any


class _Missing:
    def __repr__(self) -> str:
        return "(missing)"


MISSING_LEAF = _Missing()


class Pair(NamedTuple):
    """The two leaves at one path; either may be ``MISSING_LEAF`` or a plain value."""

    path: str
    left: Any
    right: Any


_PLAIN_KEY = re.compile(r"[A-Za-z_]\w*", re.ASCII)


def _step(key: Any) -> str:
    """One step of a path. Keys that are no plain names are quoted, and keys that are no text stand in braces, so that
    no two trees share a path by accident: ``.a``, ``['a.b']``, ``['1']``, ``{1}``."""
    if not isinstance(key, str):
        return f"{{{key!r}}}"
    return f".{key}" if _PLAIN_KEY.fullmatch(key) else f"[{key!r}]"


def _children(tree: Tree) -> dict[str, Tree] | None:
    if isinstance(tree, dict):
        return {_step(key): value for key, value in tree.items()}
    if isinstance(tree, (list, tuple)):
        return {f"[{i}]": value for i, value in enumerate(tree)}
    return None


def flatten(tree: Tree, path: str = "$") -> dict[str, Any]:
    """Leaves by path: ``$``, ``$.key``, ``$[0]``. An empty dict or list is a leaf of its own: ``{}`` or ``[]``."""
    children = _children(tree)
    if children is None:
        return {path: tree}
    if not children:
        return {path: {} if isinstance(tree, dict) else []}
    return {p: leaf for step, child in children.items() for p, leaf in flatten(child, path + step).items()}


def frames(tree: Tree) -> dict[str, DataFrame]:
    """The DataFrame leaves alone."""
    return {path: leaf for path, leaf in flatten(tree).items() if isinstance(leaf, DataFrame)}


def pair_leaves(left: Tree, right: Tree) -> list[Pair]:
    """Leaves of both trees matched by path, in left order, then those only on the right."""
    l, r = flatten(left), flatten(right)
    paths = list(l) + [p for p in r if p not in l]
    return [Pair(p, l.get(p, MISSING_LEAF), r.get(p, MISSING_LEAF)) for p in paths]
