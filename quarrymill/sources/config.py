"""Settings of providers and folders.  Never part of a plan."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

FOLDERS = ("input", "input/processed", "cache", "cache/markdown", "cache/chunk", "cache/vectors", "cache/registry")


def ensure_folders(root: str = ".") -> list[str]:
    """Creates the working folders; RAG_INPUT_DIR and RAG_CACHE_DIR move them."""
    base = {"input": os.environ.get("RAG_INPUT_DIR", f"{root}/input"), "cache": os.environ.get("RAG_CACHE_DIR", f"{root}/cache")}
    made = []
    for f in FOLDERS:
        head, _, rest = f.partition("/")
        path = Path(base[head], rest)
        path.mkdir(parents=True, exist_ok=True)
        made.append(str(path))
    return made


def load_env(path: str = ".env", override: bool = False) -> dict[str, str]:
    """NAME=value lines into the environment; comments, blanks and quotes are stripped; set names stay unless overridden."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    for name, value in found.items():
        if override or name not in os.environ:
            os.environ[name] = value
    return found


def require(names: Iterable[str]) -> dict[str, str]:
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise KeyError(f"not set: {', '.join(missing)}")
    return {n: os.environ[n] for n in names}


@dataclass(frozen=True)
class ProviderConfig:
    endpoint: str
    key: str
    model: str
    version: str = ""


def provider_config(section: str, model: str, path: str | None = None) -> ProviderConfig:
    """A section of a JSON file of providers; what it lacks comes from SECTION_ENDPOINT, _KEY, _MODEL and _VERSION."""
    spec: dict = {}
    if path and Path(path).is_file():
        spec = json.loads(Path(path).read_text(encoding="utf-8")).get(section, {})
    get = lambda k, default="": spec.get(k) or os.environ.get(f"{section}_{k}".upper(), default)
    found = ProviderConfig(get("endpoint"), get("key"), get("model", model), get("version"))
    if not found.endpoint or not found.key:
        raise KeyError(f"{section}: endpoint and key are needed")
    return found


@dataclass(frozen=True)
class RetrievalConfig:
    top_k_broad: int = 20
    top_k_final: int = 8
    rrf_k: int = 60
    reranker: str = "cross-encoder"
    max_context_tokens: int = 4000
    expand_abbreviations: bool = True
    keep_ids_in_text: bool = False


@dataclass(frozen=True)
class GenerationConfig:
    model: str = "gpt-5-mini"
    section: str = "generation"
    temperature: float = 1.0
    max_tokens: int = 16384
    reasoning_effort: str | None = None
