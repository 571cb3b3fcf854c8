"""Experiment configurations: checked settings with a stable hash. Driver-side only."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

SCHEMES = ("temporal", "ticker_disjoint", "combined")
TARGETS = ("v", "dv", "har_resid")


class ConfigError(ValueError):
    """A configuration with unknown keys or values that don't fit together."""


@dataclass(frozen=True)
class TargetConfig:
    horizons: tuple[int, ...] = (3, 7, 15, 30)
    kind: str = "v"

    def __post_init__(self) -> None:
        if not self.horizons or any(h < 2 for h in self.horizons) or len(set(self.horizons)) != len(self.horizons):
            raise ConfigError("horizons: distinct numbers from 2")
        if self.kind not in TARGETS:
            raise ConfigError(f"target kind: one of {TARGETS}")


@dataclass(frozen=True)
class SplitConfig:
    scheme: str = "temporal"
    embargo: int = 30
    seed: int = 0


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    dataset: str
    target: TargetConfig = field(default_factory=TargetConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    features: tuple[str, ...] = ()
    model: str = "har"
    seeds: tuple[int, ...] = (0,)

    def __post_init__(self) -> None:
        if self.split.scheme not in SCHEMES:
            raise ConfigError(f"split scheme: one of {SCHEMES}")
        if self.split.scheme in ("temporal", "combined") and self.split.embargo < max(self.target.horizons):
            raise ConfigError("the embargo must reach over the longest horizon")


def _checked(kind: type, given: dict, where: str):
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(given) - known):
        raise ConfigError(f"{where}: unknown keys {extra}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load_config(text: str) -> ExperimentConfig:
    """A configuration from JSON, or from YAML where a reader for it is installed."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("not JSON, and no YAML reader is installed") from e
        given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ConfigError("a configuration is a mapping")
    given = dict(given)
    parts = {k: _checked(t, given.pop(k), k) for k, t in (("target", TargetConfig), ("split", SplitConfig)) if k in given}
    try:
        return _checked(ExperimentConfig, {**given, **parts}, "config")
    except TypeError as e:
        raise ConfigError(str(e)) from e


def dump_config(config: ExperimentConfig) -> str:
    return json.dumps(asdict(config), sort_keys=True, separators=(",", ":"))


def config_hash(config: ExperimentConfig) -> str:
    return hashlib.sha256(dump_config(config).encode()).hexdigest()
