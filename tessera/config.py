"""Settings from a mapping of names to texts, as an environment is one."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from .operators.service import newest_name

PRECISIONS, DEVICES, SELF_TESTS = ("fp32", "int4", "q8"), ("auto", "cpu", "cuda"), ("off", "warn", "strict")


@dataclass(frozen=True)
class Settings:
    models: tuple[tuple[str, str], ...]
    default_model: str
    lazy_models: frozenset[str]
    precision: str
    execution_provider: str
    self_test: str
    api_key: str | None
    max_texts: int
    max_text_chars: int
    idle_ttl_seconds: int


def specs(raw: str) -> tuple[tuple[str, str], ...]:
    """The pairs of "name=source,..."; what is malformed, empty or double is an error."""
    pairs = []
    for chunk in filter(None, map(str.strip, raw.split(","))):
        name, eq, source = map(str.strip, chunk.partition("="))
        if not (eq and name and source):
            raise ValueError(f"not name=source: {chunk!r}")
        if name in dict(pairs):
            raise ValueError(f"model named twice: {name!r}")
        pairs.append((name, source))
    if not pairs:
        raise ValueError("no models")
    return tuple(pairs)


def settings(env: Mapping[str, str], prefix: str = "TESSERA_") -> Settings:
    """Read prefix + MODELS, DEFAULT_MODEL, LAZY_MODELS, PRECISION, ALLOW_INT4, EXECUTION_PROVIDER, SELF_TEST, API_KEY, MAX_CONCURRENT, MAX_TEXTS,
    MAX_TEXT_CHARS and MODEL_IDLE_TTL_SECONDS; a value out of its range is an error, before anything is loaded."""

    def get(name: str, default: str = "") -> str:
        return env.get(prefix + name, "").strip() or default

    def choice(name: str, options: tuple[str, ...], default: str) -> str:
        value = get(name, default).lower()
        if value not in options:
            raise ValueError(f"{prefix}{name} must be one of {', '.join(options)}, not {value!r}")
        return value

    def number(name: str, default: int, least: int = 1) -> int:
        value = get(name, str(default))
        if not value.lstrip("+-").isdigit() or int(value) < least:
            raise ValueError(f"{prefix}{name} must be a whole number from {least}, not {value!r}")
        return int(value)

    models = specs(get("MODELS"))
    names = {n for n, _ in models}
    precision = choice("PRECISION", PRECISIONS, "fp32")
    if precision == "int4" and get("ALLOW_INT4") != "1":
        raise ValueError(f"int4 needs {prefix}ALLOW_INT4=1")
    if number("MAX_CONCURRENT", 1) > 1:
        raise ValueError("a model serves one request at a time")
    lazy = frozenset(filter(None, map(str.strip, get("LAZY_MODELS").split(","))))
    default = get("DEFAULT_MODEL") or newest_name([n for n, _ in models])
    if not lazy | {default} <= names:
        raise ValueError(f"not among the models: {', '.join(sorted(lazy | {default} - names))}")
    if default in lazy:
        raise ValueError(f"the default model {default!r} cannot be lazy")
    key = get("API_KEY") or None
    if key and not key.isascii():
        raise ValueError("the key must be ASCII")
    return Settings(models, default, lazy, precision, choice("EXECUTION_PROVIDER", DEVICES, "auto"), choice("SELF_TEST", SELF_TESTS, "warn"), key, number("MAX_TEXTS", 64), number("MAX_TEXT_CHARS", 200_000), number("MODEL_IDLE_TTL_SECONDS", 14_400))
