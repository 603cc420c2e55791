"""Configuration trees: parents, overrides, interpolation."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any, Mapping, Sequence

_REF = re.compile(r"\$\{([^${}]+)\}")


def merge(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    """b over a, mappings merged at every level."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_tree(path: str, _open: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A YAML file over its parents (``base``: a path or a list of paths, left to right).  A cycle raises."""
    import yaml

    p = Path(path).resolve()
    if p in _open:
        raise ValueError("cycle of parents: " + " -> ".join(str(x) for x in (*_open, p)))
    data = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
    parents = data.pop("base", data.pop("defaults", None)) or []
    out: dict[str, Any] = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merge(out, load_tree(str(p.parent / parent), (*_open, p)))
    return merge(out, data)


def lookup(tree: Mapping[str, Any], dotted: str) -> Any:
    for part in dotted.split("."):
        tree = tree[int(part)] if isinstance(tree, list) else tree[part]
    return tree


def resolve(tree: Any, root: Mapping[str, Any] | None = None, repo_root: str = ".") -> Any:
    """Replace ``${a.b}``, ``${env:NAME,default}``, ``${mul:x,y}``, ``${div:x,y}`` and ``${repo_root:}``."""
    root = tree if root is None else root
    if isinstance(tree, Mapping):
        return {k: resolve(v, root, repo_root) for k, v in tree.items()}
    if isinstance(tree, list):
        return [resolve(v, root, repo_root) for v in tree]
    if not isinstance(tree, str):
        return tree

    def one(expr: str) -> Any:
        name, _, rest = expr.partition(":")
        if not _:
            return resolve(lookup(root, expr.strip()), root, repo_root)
        args = [number(resolve(a.strip(), root, repo_root)) for a in rest.split(",")] if rest else []
        if name in ("env", "oc.env"):
            value = os.environ.get(str(args[0]), args[1] if len(args) > 1 else None)
            if value is None:
                raise KeyError(f"{args[0]} is not set")
            return value
        if name == "mul":
            out: Any = 1
            for a in args:
                out *= a
            return out
        if name == "div":
            return args[0] // args[1] if all(isinstance(a, int) for a in args) and args[0] % args[1] == 0 else args[0] / args[1]
        if name == "repo_root":
            return repo_root
        raise ValueError(f"unknown resolver {name!r}")

    for _ in range(50):
        m = _REF.search(tree)
        if not m:
            return tree
        value = one(m.group(1))
        if m.group() == tree:
            return value
        tree = tree[: m.start()] + str(value) + tree[m.end() :]
    raise ValueError(f"interpolation does not end: {tree}")


def number(v: Any) -> Any:
    if isinstance(v, str):
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
    return v


def apply_overrides(tree: dict[str, Any], overrides: Sequence[str]) -> dict[str, Any]:
    """``a.b=value`` entries; values are read as YAML."""
    import yaml

    for item in overrides:
        key, _, raw = item.partition("=")
        if not _:
            raise ValueError(f"not an override: {item!r}")
        at = tree
        *path, last = key.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = yaml.safe_load(raw)
    return tree


def load_config(path: str, overrides: Sequence[str] = (), repo_root: str = ".") -> dict[str, Any]:
    return resolve(apply_overrides(load_tree(path), overrides), repo_root=repo_root)
