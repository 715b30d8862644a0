"""Settings from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields


class ConfigError(ValueError):
    """A file that can't be read, or says what isn't known or allowed."""


@dataclass(frozen=True)
class Defaults:
    context_tag: str = "context"
    token_budget: int = 10_000
    alpha: float = 0.6
    min_score: float = 0.15


@dataclass(frozen=True)
class Service:
    """A model service; mode `rules` means none, `auto` the local one if it answers, else the hosted one if its key is set, else none."""

    mode: str = "rules"
    url: str = ""
    model: str = ""
    protocol: str = "openai"
    key_env: str = ""
    timeout_ms: int = 3000
    aliases: dict[str, str] = field(default_factory=dict)
    thinking: bool | None = None
    hosted_url: str = ""
    hosted_model: str = ""
    hosted_protocol: str = "messages"
    hosted_key_env: str = ""


@dataclass(frozen=True)
class Embeddings:
    url: str = ""
    model: str = "stub"
    dims: int = 768
    launcher_cmd: str = ""
    query_timeout_ms: int = 3000
    sync_timeout_ms: int = 60_000


@dataclass(frozen=True)
class Indexer:
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    defaults: Defaults = field(default_factory=Defaults)
    router: Service = field(default_factory=Service)
    classifier: Service = field(default_factory=lambda: Service(timeout_ms=300_000))
    embeddings: Embeddings = field(default_factory=Embeddings)
    indexer: Indexer = field(default_factory=Indexer)


MODES = ("rules", "auto", "http")
TEMPLATE = """# Settings of the retrieval engine; every line is optional.
[defaults]
context_tag = "context"
token_budget = 10000
alpha = 0.6
min_score = 0.15

[router]
mode = "rules"  # or "http" with url, model, protocol and key_env, or "auto" with these and their hosted_... fellows

[embeddings]
model = "stub"
dims = 768
"""


def _section(kind: type, given: dict, name: str, base=None):
    known = {f.name for f in fields(kind)}
    if unknown := set(given) - known:
        raise ConfigError(f"[{name}]: unknown {', '.join(sorted(unknown))}")
    values = {f.name: getattr(base, f.name) for f in fields(kind)} if base else {}
    return kind(**values | {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load(path: str) -> Config:
    try:
        with open(os.path.expanduser(path), "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise ConfigError(f"{path}: {error}") from error
    base, kinds = Config(), {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    if unknown := set(raw) - set(kinds):
        raise ConfigError(f"unknown sections: {', '.join(sorted(unknown))}")
    config = Config(**{name: _section(kind, raw.get(name, {}), name, getattr(base, name)) for name, kind in kinds.items()})
    for name in ("router", "classifier"):
        if getattr(config, name).mode not in MODES:
            raise ConfigError(f"[{name}]: mode is one of {', '.join(MODES)}")
    if not 0 <= config.defaults.alpha <= 1:
        raise ConfigError("[defaults]: alpha lies between 0 and 1")
    if config.embeddings.dims <= 0:
        raise ConfigError("[embeddings]: dims must be positive")
    return config


def seed(path: str, force: bool = False) -> bool:
    """Writes the template where there is no file yet (or with `force`); whether it did."""
    path = os.path.expanduser(path)
    if os.path.exists(path) and not force:
        return False
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(TEMPLATE)
    os.chmod(path, 0o600)
    return True
