"""Settings of the pipeline's steps, with their defaults, and a summary of a result folder."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .functions.paths import EXTENSION_ORDER
from .functions.text import FIX_KEYWORDS
from .sources.files import load_yaml


@dataclass(frozen=True)
class Settings:
    """Everything that steers a run; values given by the caller win over the file, the file over these defaults."""

    stars: int = 10
    min_commits: int = 0
    limit: int = 50
    keywords: tuple[str, ...] = FIX_KEYWORDS
    exclude_keywords: tuple[str, ...] = ()
    extension_order: tuple[str, ...] = EXTENSION_ORDER
    excerpt_lines: int = 10
    message_length: int = 150
    sample_size: int = 1000
    min_per_month: int = 50
    top_tokens: int = 60
    require_patch: bool = False
    cluster_all: bool = False
    cluster_distinct: bool = True
    min_cluster_size: int | None = None
    min_samples: int | None = None
    epsilon: float = 0.0
    stop_words: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)


def settings(path: str | None = None, **given: Any) -> Settings:
    """Settings of a YAML file (nested sections are flattened) and of ``given``; None counts as not given.

    Numbers are coerced, and fall back to the default where that fails; unknown names go to ``extra``.
    """
    flat: dict[str, Any] = {}

    def collect(tree: dict[str, Any]) -> None:
        for k, v in tree.items():
            if isinstance(v, dict):
                collect(v)
            elif v is not None:
                flat[str(k).lower()] = v

    if path:
        collect(load_yaml(path))
    flat |= {k: v for k, v in given.items() if v is not None}
    known = {f.name: f for f in dataclasses.fields(Settings)}
    values: dict[str, Any] = {}
    for k, v in flat.items():
        if k not in known or k == "extra":
            continue
        default = known[k].default
        try:
            if isinstance(v, (list, tuple)):
                v = tuple(str(x) for x in v)
            elif isinstance(default, bool):
                v = bool(v)
            elif isinstance(default, int) or k in ("min_cluster_size", "min_samples"):
                v = int(v)
            elif isinstance(default, float):
                v = float(v)
        except (TypeError, ValueError):
            v = default
        values[k] = v
    return Settings(**values, extra={k: v for k, v in flat.items() if k not in known})


def result_summary(folder: str) -> dict[str, int]:
    """Bytes of each file or table in a result folder; empty if there is none."""
    root = Path(folder)
    if not root.is_dir():
        return {}
    return {p.name: p.stat().st_size if p.is_file() else sum(f.stat().st_size for f in p.rglob("*") if f.is_file()) for p in sorted(root.iterdir())}
