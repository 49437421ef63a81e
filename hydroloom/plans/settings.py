"""Settings trees of JSON: look-up tables merged by priority, environment overrides, placeholders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from typing import Any

_NULLS = {"", "none", "null", "nan"}


def merge_by_priority(user: Mapping[str, Any], environment: Mapping[str, Any], first: str = "user") -> dict[str, Any]:
    """Both tables in one; where both have a key the preferred one's value counts unless it is none."""
    high, low = (user, environment) if first == "user" else (environment, user)
    return {k: high.get(k) if high.get(k) is not None else low.get(k) for k in {**low, **high}}


def cast_like(text: str, kind: str) -> Any:
    return {"int": int, "float": float, "bool": lambda t: t.strip().lower() in ("1", "true", "yes"), "string": str}[kind](text)


def override(table: Mapping[str, Any], environment: Mapping[str, str], kinds: Mapping[str, str]) -> dict[str, Any]:
    """Upper-case names of the environment replace the table's values, cast to their kinds."""
    return {k: cast_like(environment[k.upper()], kinds.get(k, "string")) if k.upper() in environment else v for k, v in table.items()}


def fill(tree: Any, table: Mapping[str, Any]) -> Any:
    """`{name}` filled throughout a tree; a string that is only an unset name becomes None, unknown names stay."""
    if isinstance(tree, Mapping):
        return {k: fill(v, table) for k, v in tree.items()}
    if isinstance(tree, list):
        return [fill(v, table) for v in tree]
    if not isinstance(tree, str):
        return tree
    whole = re.fullmatch(r"\{(\w+)\}", tree)
    if whole and whole[1] in table:
        value = table[whole[1]]
        return None if value is None or str(value).lower() in _NULLS else value
    filled = re.sub(r"\{(\w+)\}", lambda m: str(table[m[1]]) if table.get(m[1]) is not None else m[0], tree)
    return filled


def resolve(table: Mapping[str, Any], passes: int = 3) -> dict[str, Any]:
    """A table whose values may name its other keys."""
    out = dict(table)
    for _ in range(passes):
        out = {k: fill(v, {n: w for n, w in out.items() if n != k}) for k, v in out.items()}
    return out


def check_keys(found: Mapping[str, Any], expected: set[str], strict: bool = True) -> set[str]:
    """Expected keys that are missing; strict raises if there are any or others than expected."""
    missing = expected - set(found)
    if strict and (missing or set(found) - expected):
        raise KeyError(f"missing {sorted(missing)}, unexpected {sorted(set(found) - expected)}")
    return missing


def flatten(tree: Mapping[str, Any], sep: str = ":") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in tree.items():
        inner = {f"{key}{sep}{k}": v for k, v in flatten(value, sep).items()} if isinstance(value, Mapping) else {key: value}
        if clash := out.keys() & inner.keys():
            raise KeyError(f"{clash} stands twice")
        out |= inner
    return out


def flatten_by(tree: Mapping[str, Any], keys: str = "path", sep: str = ":") -> dict[str, Any]:
    """A flat table of a tree's values under their whole path, its first part (`first`) or its last (`last`); a key made twice raises."""
    if keys not in ("path", "first", "last"):
        raise ValueError(f"no kind of keys: {keys!r}")
    whole = flatten(tree, sep)
    part = {"path": lambda k: k, "first": lambda k: k.split(sep)[0], "last": lambda k: k.split(sep)[-1]}[keys]
    if twice := [k for k, n in Counter(map(part, whole)).items() if n > 1]:
        raise KeyError(f"{sorted(twice)} are made more than once")
    return {part(k): v for k, v in whole.items()}


def reconcile(data: Mapping[str, Any], wanted: Mapping[str, Any], mode: str = "strict") -> list[str]:
    """The keys that both have, in order; raises where the mode's rule is broken.

    strict: the same keys; less_from_data: each of `data` is wanted; less_from_fx: each wanted one is
    in `data`; lazy: at least one is in both.
    """
    left, missing, both = data.keys() - wanted.keys(), wanted.keys() - data.keys(), data.keys() & wanted.keys()
    broken = {"strict": left | missing, "less_from_data": left, "less_from_fx": missing, "lazy": set() if both else left | missing or {"no key at all"}}
    if mode not in broken:
        raise ValueError(f"no mode: {mode!r}")
    if broken[mode]:
        raise KeyError(f"{mode}: {sorted(broken[mode])}")
    return sorted(both)


def unflatten(flat: Mapping[str, Any], sep: str = ":") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in flat.items():
        *path, last = key.split(sep)
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out
