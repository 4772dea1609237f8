"""Run configuration: one table of keys, types and defaults, and one validator for it."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

_NEEDED = object()


def _text(value: Any) -> str:
    if not value:
        raise ValueError("it must not be empty")
    return str(value)


def _channels(value: Any) -> int:
    if value not in (1, 3):
        raise ValueError("it must be 1 or 3")
    return value


#: The document's keys by section, with what reads them and their defaults.
TABLE: dict[str, dict[str, tuple[Callable[[Any], Any], Any]]] = {
    "paths": {"background_dir": (str, ""), **{k: (_text, _NEEDED) for k in ("font_index", "russian_corpus", "english_corpus", "test_profile")}},
    "weights": {"english": (float, 2.0), "patterns": (float, 1.0), "russian": (float, 6.0)},
    "preprocess": {"channel_count": (_channels, 1), "height": (int, 32), "width": (int, 192)},
    "": {"train_length": (int, 1_000_000), "train_seed": (int, 1234), "validation_length": (int, 20_000), "validation_seed": (int, 9999)},
}


class RunConfig(SimpleNamespace):
    """A section is a namespace of its own, but ``paths``, which stays a dictionary."""

    REQUIRED = tuple(k for k, (_, default) in TABLE["paths"].items() if default is _NEEDED)


def _section(name: str, given: dict[str, Any]) -> dict[str, Any]:
    """Values of one section; what the document leaves out keeps its default, unknown keys raise in inner sections."""
    known = TABLE[name]
    if name in ("weights", "preprocess") and (odd := sorted(given.keys() - known.keys())):
        raise ValueError(f"{name} has unknown keys: {', '.join(odd)}")
    out = {k: v for k, v in given.items() if k not in known} if name == "paths" else {}
    for key, (read, default) in known.items():
        value = given.get(key, default)
        try:
            out[key] = read(None if value is _NEEDED else value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{f'{name}.' if name else ''}{key}: {e}") from e
    return out


def parse_config(document: dict[str, Any]) -> RunConfig:
    """A configuration from a parsed document."""
    inner = {name: _section(name, document.get(name) or {}) for name in TABLE if name}
    return RunConfig(paths=inner.pop("paths"), **{k: SimpleNamespace(**v) for k, v in inner.items()}, **_section("", document))


def read_config(path: str) -> RunConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse_config(yaml.safe_load(f) or {})
