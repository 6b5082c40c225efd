"""Settings: defaults, then the configuration file, then CITELOOM_* variables, then the registry and the command line."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

log = logging.getLogger(__name__)
PREFIX = "CITELOOM_"


@dataclass(frozen=True)
class Settings:
    pdf_dir: str = "documents"
    store_dir: str = "store"
    images_dir: str = "images"
    state_dir: str = "state"
    embedding_backend: str = "hashing"
    embedding_model: str = "hashing"
    embedding_dim: int = 384
    chunk_target: int = 1100
    chunk_overlap: int = 180
    chunk_least: int = 120
    figure_min_area: float = 10_000.0
    figure_max_per_page: int = 8
    extract_images: bool = True
    image_min_pixels: int = 40_000
    strict_captions: bool = True
    table_max_rows: int = 80
    table_max_chars: int = 6000
    top_k: int = 5
    top_k_figures: int = 3
    candidates: int = 24
    lexical_weight: float = 0.35
    context_chars: int = 4500
    model: str = "llama3.2:3b"
    model_fallbacks: tuple = ()
    ingest_recursive: bool = True
    debounce_seconds: float = 4.0
    stability_seconds: float = 2.0
    log_level: str = "INFO"

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    def save(self, path: str) -> None:
        new = Path(f"{path}.new")
        new.parent.mkdir(parents=True, exist_ok=True)
        new.write_text(self.to_json() + "\n")
        os.replace(new, path)


def coerced(name: str, value):
    """value in the type of the setting's default; raises ValueError if it can't be."""
    kind = type(getattr(Settings(), name))
    if kind is bool:
        if isinstance(value, bool):
            return value
        word = str(value).strip().lower()
        if word in ("1", "true", "yes", "on"):
            return True
        if word in ("0", "false", "no", "off"):
            return False
        raise ValueError(value)
    if kind is tuple:
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    return kind(value)


def load(path: str | None = None, env: dict[str, str] | None = None, **last) -> Settings:
    """Settings by precedence; unknown names and values that don't fit are logged and left out."""
    settings, layers = Settings(), []
    if path and Path(path).exists():
        try:
            known = json.loads(Path(path).read_text())
            layers.append(known if isinstance(known, dict) else {})
        except ValueError as problem:
            log.warning("%s is not read: %s", path, problem)
    env = os.environ if env is None else env
    layers.append({k.removeprefix(PREFIX).lower(): v for k, v in env.items() if k.startswith(PREFIX)})
    layers.append({k: v for k, v in last.items() if v is not None})
    names = {f.name for f in fields(Settings)}
    for layer in layers:
        for name, value in layer.items():
            try:
                if name in names:
                    settings = replace(settings, **{name: coerced(name, value)})
            except (TypeError, ValueError):
                log.warning("setting %s can't be %r", name, value)
    return settings
