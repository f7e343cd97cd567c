"""Parameters as data: what keys are made of, and what a step is rebuilt from.

``canonical`` is JSON data that tells apart what keys must tell apart; a step
within it is its key. ``encode`` is the same with all fields of steps and
records, and ``decode`` turns it back.

Values of other types need an encoder: a method ``to_parameter`` (and a class
method ``from_parameter``) of their class, one in ``encoders`` of the step that
has them, or a registered one, in this order; two that match in one layer are
an error.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path, PurePath

from tarn.names import full_name, resolve


@dataclass(frozen=True)
class Encoder:
    """For values for which ``matches`` holds: a name, a function to a plain parameter, and one back."""

    matches: Callable[[object], bool]
    name: str
    encode: Callable[[object], object]
    decode: Callable[[object], object] | None = None


ENCODERS: list[Encoder] = []


def register_encoder(matches, name, encode, decode=None) -> None:
    """Let values for which ``matches`` holds be parameters; a value that two encoders claim is an error."""
    ENCODERS.append(Encoder(matches, name, encode, decode))


def is_step(value: object) -> bool:
    return getattr(type(value), "is_step", False)


def keyed_fields(value) -> list[dataclasses.Field]:
    return [f for f in dataclasses.fields(value) if not f.metadata.get("unkeyed")]


def _encoder(value: object, own: tuple[Encoder, ...]) -> Encoder | None:
    if hasattr(type(value), "to_parameter"):
        return Encoder(bool, full_name(type(value)), lambda v: v.to_parameter())
    for layer in (own, ENCODERS):
        found = [e for e in layer if e.matches(value)]
        if len(found) > 1:
            raise TypeError(f"several encoders match {value!r}: {[e.name for e in found]}")
        if found:
            return found[0]
    return None


def to_data(value: object, full: bool, own: tuple[Encoder, ...] = ()) -> object:
    """``value`` as JSON data; ``full`` keeps all fields of steps and records."""
    if e := _encoder(value, own):
        return {"|custom": e.name, "|value": to_data(e.encode(value), full, own)}
    if is_step(value) and not full:
        return {"|step": value.key()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, PurePath):
        return {"|path": value.as_posix()}
    if isinstance(value, datetime):
        return {"|time": value.isoformat()}
    if isinstance(value, list):
        return [to_data(v, full, own) for v in value]
    if isinstance(value, tuple):
        return {"|tuple": [to_data(v, full, own) for v in value]}
    if isinstance(value, (set, frozenset)):
        kind = "|frozenset" if full and isinstance(value, frozenset) else "|set"
        return {kind: sorted((to_data(v, full, own) for v in value), key=canonical_json)}
    if isinstance(value, dict):
        if any(not isinstance(k, str) or k.startswith("|") for k in value):
            raise TypeError(f"keys of a parameter must be plain strings: {list(value)}")
        return {k: to_data(v, full, own) for k, v in value.items()}
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        own = tuple(getattr(type(value), "encoders", ())) if is_step(value) else own
        fields = dataclasses.fields(value) if full else keyed_fields(value)
        return {"|class": full_name(type(value)), "|fields": {f.name: to_data(getattr(value, f.name), full, own) for f in fields}}
    if isinstance(value, type):
        return {"|type": full_name(value)}
    raise TypeError(f"not a parameter: {value!r}")


def canonical(value: object, own: tuple[Encoder, ...] = ()) -> object:
    """JSON data that tells apart what keys must tell apart: 1, 1.0, True, "1", lists, tuples and sets."""
    return to_data(value, False, own)


def encode(value: object) -> object:
    """JSON data from which ``decode`` gives the value back."""
    return to_data(value, True)


def decode(data: object, own: tuple[Encoder, ...] = ()) -> object:
    if isinstance(data, list):
        return [decode(v, own) for v in data]
    if not isinstance(data, dict):
        return data
    if "|custom" in data:
        return _decode_custom(data["|custom"], decode(data["|value"], own), own)
    if "|class" in data:
        cls, given = resolve(data["|class"]), data["|fields"]
        own = tuple(getattr(cls, "encoders", ())) or own
        names = {f.name for f in dataclasses.fields(cls)}
        # A field that is no part of the key may be new and have a default.
        free = {f.name for f in dataclasses.fields(cls) if f.metadata.get("unkeyed")}
        if names - free - given.keys() or given.keys() - names:
            raise ValueError(f"{data['|class']} has the fields {sorted(names)}, the record {sorted(given)}")
        return cls(**{k: decode(v, own) for k, v in given.items()})
    for mark, back in (("|path", Path), ("|time", datetime.fromisoformat), ("|type", resolve)):
        if mark in data:
            return back(data[mark])
    for mark, kind in (("|tuple", tuple), ("|set", set), ("|frozenset", frozenset)):
        if mark in data:
            return kind(decode(v, own) for v in data[mark])
    if "|step" in data:
        raise ValueError(f"a key alone can't be turned back into a step: {data['|step']}")
    return {k: decode(v, own) for k, v in data.items()}


def _decode_custom(name: str, value: object, own: tuple[Encoder, ...]) -> object:
    for e in (*own, *ENCODERS):
        if e.name == name:
            if e.decode is None:
                raise ValueError(f"the encoder {name} has no way back")
            return e.decode(value)
    cls = resolve(name)
    if not hasattr(cls, "from_parameter"):
        raise ValueError(f"{name} has no from_parameter")
    return cls.from_parameter(value)


def canonical_json(data: object) -> str:
    return json.dumps(data, sort_keys=True, separators=(",", ":"))


def digest(data: object) -> str:
    return hashlib.sha256(canonical_json(data).encode()).hexdigest()[:20]
