"""Settings with their defaults; a YAML or JSON file and environment variables may override them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None


@dataclass
class Server:
    port: int = 8080


@dataclass
class Api:
    host: str = "0.0.0.0"
    port: int = 8080
    read_timeout_secs: int = 30
    write_timeout_secs: int = 30
    idle_timeout_secs: int = 60


@dataclass
class Store:
    path: str = "entities"
    class_name: str = "Entity"


@dataclass
class Embedding:
    url: str = "http://localhost:8000"
    batch_size: int = 32
    timeout: int = 30
    cache_size: int = 1000
    model_name: str = "all-MiniLM-L6-v2"
    embedding_dim: int = 384


@dataclass
class Matching:
    similarity_threshold: float = 0.85
    default_limit: int = 10
    field_weights: dict[str, float] = field(default_factory=lambda: {"name": 0.4, "address": 0.2, "city": 0.1, "state": 0.05, "zip": 0.05, "phone": 0.1, "email": 0.1})


@dataclass
class Normalization:
    enable_stopwords: bool = True
    enable_stemming: bool = True  # accepted, without effect
    enable_lowercase: bool = True
    name_options: dict[str, bool] = field(default_factory=lambda: {"remove_legal_suffixes": True, "normalize_initials": True})
    address_options: dict[str, bool] = field(default_factory=lambda: {"standardize_abbreviations": True, "remove_apartment_numbers": True})
    phone_options: dict[str, bool] = field(default_factory=lambda: {"e164_format": True})
    email_options: dict[str, bool] = field(default_factory=lambda: {"lowercase_domain": True})

    def options(self):
        from .functions.normalize import NormalizeOptions

        return NormalizeOptions(
            lowercase=self.enable_lowercase,
            stopwords=self.enable_stopwords,
            stemming=self.enable_stemming,
            remove_legal_suffixes=self.name_options.get("remove_legal_suffixes", False),
            normalize_initials=self.name_options.get("normalize_initials", False),
            standardize_abbreviations=self.address_options.get("standardize_abbreviations", False),
            remove_apartment_numbers=self.address_options.get("remove_apartment_numbers", False),
            e164_format=self.phone_options.get("e164_format", False),
            lowercase_domain=self.email_options.get("lowercase_domain", False),
        )


@dataclass
class Clustering:
    enabled: bool = False
    method: str = "canopy"  # a name only: blocking is by exact keys
    fields: list[str] = field(default_factory=lambda: ["name", "zip"])
    similarity_threshold: float = 0.8  # accepted, without effect


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    api: Api = field(default_factory=Api)
    store: Store = field(default_factory=Store)
    embedding: Embedding = field(default_factory=Embedding)
    matching: Matching = field(default_factory=Matching)
    normalization: Normalization = field(default_factory=Normalization)
    clustering: Clustering = field(default_factory=Clustering)


def _merge(into, values: dict) -> None:
    for f in fields(into):
        if f.name not in values:
            continue
        now, new = getattr(into, f.name), values[f.name]
        if is_dataclass(now):
            _merge(now, new or {})
        elif isinstance(now, bool) and isinstance(new, str):
            setattr(into, f.name, new.lower() in ("1", "true", "t", "yes"))
        elif isinstance(now, (int, float)) and not isinstance(now, bool):
            setattr(into, f.name, type(now)(new))
        elif isinstance(now, list) and isinstance(new, str):
            setattr(into, f.name, new.split(","))
        else:
            setattr(into, f.name, new)


def load(path: str | None = None, env_prefix: str = "ENTWINE_") -> Config:
    """Defaults, then the file if it can be read, then variables such as ENTWINE_MATCHING_DEFAULT_LIMIT."""
    out = Config()
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        _merge(out, (json.loads(text) if path.endswith(".json") or yaml is None else yaml.safe_load(text)) or {})
    for section in fields(out):
        part = getattr(out, section.name)
        found = {f.name: os.environ[k] for f in fields(part) if (k := f"{env_prefix}{section.name}_{f.name}".upper()) in os.environ and not isinstance(getattr(part, f.name), dict)}
        _merge(part, found)
    return out


def save_default(path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        values = asdict(Config())
        f.write(json.dumps(values, indent=2) if path.endswith(".json") or yaml is None else yaml.safe_dump(values, sort_keys=False))
