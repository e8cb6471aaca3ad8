"""Settings of the audit, checked once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from decimal import Decimal
from pathlib import Path

MICRO = 1_000_000
#: Languages of images that are supported unless the settings name others.
LANGUAGES = ("eng", "lav")


class ConfigError(ValueError):
    """The settings contradict themselves or cannot be read."""


def micros(value: float | str | Decimal) -> int:
    """A unit score as an integer number of millionths."""
    return int((Decimal(str(value)) * MICRO).to_integral_value())


# Weights, thresholds and bands of the scoring.
@dataclass(frozen=True)
class Weights:
    amount: float = 0.40
    currency: float = 0.15
    merchant: float = 0.25
    date: float = 0.10
    reference: float = 0.10


@dataclass(frozen=True)
class DateBands:
    strong_days: int = 0
    close_days: int = 1
    near_days: int = 3
    same_day_score: float = 1.0
    close_score: float = 0.90
    near_score: float = 0.45
    outer_score: float = 0.20


@dataclass(frozen=True)
class MerchantBands:
    strong: float = 0.90
    moderate: float = 0.70
    minimum_length: int = 4
    short_cap: float = 0.35
    token_score: float = 0.95


@dataclass(frozen=True)
class Combinations:
    enabled: bool = True
    max_documents: int = 3
    pool_limit: int = 12


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    dates: DateBands = field(default_factory=DateBands)
    merchants: MerchantBands = field(default_factory=MerchantBands)
    combinations: Combinations = field(default_factory=Combinations)
    confirmed: float = 0.85
    probable: float = 0.60
    date_tolerance_days: int = 5
    amount_tolerance: str = "0.00"
    reference_minimum_length: int = 5

    def __post_init__(self) -> None:
        if not isinstance(self.amount_tolerance, str):
            raise ConfigError("amount_tolerance is written as text, so that no binary fraction slips in")
        w, c, d, m = self.weights, self.combinations, self.dates, self.merchants
        for part in (w, d, m):
            for f in fields(part):
                v = getattr(part, f.name)
                if isinstance(v, bool) or v < 0 or (f.type == "float" and v > 1):
                    raise ConfigError(f"{f.name} is out of range: {v}")
        rules = {
            "weights sum to 1": abs(sum(micros(getattr(w, f.name)) for f in fields(w)) - MICRO) <= 1,
            "probable is at most confirmed": 0 <= self.probable <= self.confirmed <= 1,
            "date bands ascend": d.strong_days <= d.close_days <= d.near_days <= self.date_tolerance_days,
            "date scores descend": d.same_day_score >= d.close_score >= d.near_score >= d.outer_score,
            "moderate is at most strong": m.moderate <= m.strong,
            "amount and currency alone stay under probable": w.amount + w.currency < self.probable,
            "combinations hold 2 to 5 documents": 2 <= c.max_documents <= 5,
            "the pool holds a combination": c.pool_limit >= c.max_documents,
            "the tolerance is not negative": Decimal(self.amount_tolerance) >= 0,
            "the reference length is positive": self.reference_minimum_length >= 1,
        }
        if broken := [name for name, holds in rules.items() if not holds]:
            raise ConfigError("; ".join(broken))


def settings_from(tree: dict) -> Settings:
    """Settings from a nested mapping; unknown names are errors."""
    parts = {"weights": Weights, "dates": DateBands, "merchants": MerchantBands, "combinations": Combinations}
    try:
        return Settings(**{k: parts[k](**v) if k in parts else v for k, v in tree.items()})
    except TypeError as e:
        raise ConfigError(str(e)) from e


def ocr_languages(section: dict) -> str:
    """The languages of text recognition, codes joined by ``+``, from the
    settings ``language`` and ``supported_languages``: codes have three letters,
    in any case, and each must be supported."""
    language, supported = (section.get("language"), section.get("supported_languages")) if isinstance(section, dict) else (None, None)
    if not isinstance(language, str) or not isinstance(supported, list | tuple) or not supported:
        raise ConfigError("text recognition needs language and supported_languages")
    codes, known = ([c.strip().lower() if isinstance(c, str) else "" for c in part] for part in (language.split("+"), supported))
    if not all(re.fullmatch("[a-z]{3}", c) for c in (*codes, *known)):
        raise ConfigError("language codes have three letters")
    if lacking := [c for c in codes if c not in known]:
        raise ConfigError(f"languages that are not supported: {', '.join(lacking)}")
    return "+".join(codes)


def load_settings(path: str | Path | None = None, name: str = "tallyloom.yaml") -> Settings:
    """Read YAML from ``path``, or from the nearest ``name`` in the working
    folder and those above it; without such a file the defaults hold."""
    import yaml

    if path is None:
        here = Path.cwd()
        path = next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)
        if path is None:
            return Settings()
    try:
        tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(tree, dict):
        raise ConfigError(f"{path} holds no mapping")
    return settings_from(tree)
