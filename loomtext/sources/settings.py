"""Settings: sections of a configuration, chosen and renamed values, and the environment. All of it is the driver's."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any


def flattened(config: Mapping[str, Any], sections: Sequence[str] | None = None) -> dict[str, Any]:
    """The values of these sections (None: all that are mappings) in one mapping; later sections win. A section that is missing is empty."""
    out: dict[str, Any] = {}
    for name in [k for k, v in config.items() if isinstance(v, Mapping)] if sections is None else sections:
        out |= dict(config.get(name) or {})
    return out


def chosen(values: Mapping[str, Any], names: Sequence[str] | Mapping[str, str]) -> dict[str, Any]:
    """These values, under their own or new names (old: new); a missing one is an error."""
    pairs = dict(names) if isinstance(names, Mapping) else {n: n for n in names}
    missing = [n for n in pairs if n not in values]
    if missing:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return {new: values[old] for old, new in pairs.items()}


@dataclass(frozen=True)
class Variable:
    """An environment variable: required, or with a default; converted to the kind of value."""

    name: str
    kind: type = str
    default: Any = None
    required: bool = False


def from_environment(variables: Mapping[str, Variable], environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings by name. A boolean is true if its text is `true` in any case, else false."""
    env = os.environ if environment is None else environment
    out = {}
    for name, v in variables.items():
        said = env.get(v.name)
        if said is None:
            if v.required:
                raise KeyError(f"{v.name} must be set")
            out[name] = v.default
        else:
            out[name] = said.lower() == "true" if v.kind is bool else v.kind(said)
    return out
