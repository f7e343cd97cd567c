"""Classes by name, and types as text."""

from __future__ import annotations

import dataclasses
import importlib
import re
import types
import typing


def full_name(cls: type) -> str:
    """Module and qualified name: classes of one name in two modules are two."""
    return f"{cls.__module__}.{cls.__qualname__}"


def resolve(name: str) -> type:
    """The class of a full name. Classes within functions have none that can be found again."""
    if "<locals>" in name:
        raise LookupError(f"{name} is local to a function and can't be found by name")
    parts = name.split(".")
    for cut in range(len(parts) - 1, 0, -1):
        try:
            found = importlib.import_module(".".join(parts[:cut]))
        except ModuleNotFoundError as e:
            # Only the module itself may be missing: what it imports is another matter.
            if e.name and ".".join(parts[:cut]).startswith(e.name):
                continue
            raise
        try:
            for p in parts[cut:]:
                found = getattr(found, p)
        except AttributeError:
            break
        return found
    raise LookupError(f"no class {name}")


def hints(cls: type) -> dict[str, object]:
    """The fields' types; as written where a name can't be resolved."""
    try:
        found = typing.get_type_hints(cls, include_extras=True)
    except (NameError, AttributeError, TypeError):
        found = {}
    return {f.name: found.get(f.name, f.type) for f in dataclasses.fields(cls)}


def element_type(kind: object, key: object) -> object:
    """The declared type of an element of a container: of a list, set or tuple by place, of a dict by key; ``Any`` if it has none."""
    if typing.get_origin(kind) is typing.Annotated:
        kind = typing.get_args(kind)[0]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (list, set, frozenset) and args:
        return args[0]
    if origin is dict and len(args) == 2:
        return args[1]
    if origin is tuple and args:
        if args[-1] is Ellipsis:
            return args[0]
        return args[key] if isinstance(key, int) and key < len(args) else typing.Any
    if dataclasses.is_dataclass(kind) and isinstance(kind, type):
        return hints(kind).get(key, typing.Any)
    return typing.Any


def describe(kind: object, keyed=lambda cls: dataclasses.fields(cls), seen: frozenset = frozenset()) -> str:
    """A type as text, records with their fields. Unions are sorted; a class within itself is its name alone."""
    if isinstance(kind, str):
        return kind
    if kind is None or kind is type(None):
        return "None"
    if isinstance(kind, typing.TypeAliasType):
        return describe(kind.__value__, keyed, seen)
    if isinstance(kind, typing.TypeVar):
        return repr(kind)
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return describe(args[0], keyed, seen)
    if origin in (typing.Union, types.UnionType):
        return " | ".join(sorted({describe(a, keyed, seen) for a in args}))
    if origin is typing.Literal:
        return f"Literal[{', '.join(sorted(map(repr, args)))}]"
    if origin is not None:
        return f"{describe(origin, keyed, seen)}[{', '.join('...' if a is Ellipsis else describe(a, keyed, seen) for a in args)}]"
    if not isinstance(kind, type):
        return getattr(kind, "__name__", None) or str(kind)
    if dataclasses.is_dataclass(kind) and kind not in seen:
        of = hints(kind)
        inner = sorted(f"{f.name}: {describe(of[f.name], keyed, seen | {kind})}" for f in keyed(kind))
        return f"{full_name(kind)}{{{', '.join(inner)}}}"
    return kind.__name__ if kind.__module__ == "builtins" else full_name(kind)


def shape(described: str) -> str:
    """A described type without the fields of its records."""
    while (less := re.sub(r"\{[^{}]*\}", "", described)) != described:
        described = less
    return described
