"""Settings of a run, from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_type_hints

import yaml


# The keys of a settings file and their defaults.


@dataclass(frozen=True)
class Project:
    output_dir: Path = Path("./results")
    seed: int = 42
    mock: bool = False


@dataclass(frozen=True)
class Benchmark:
    name: str = "humaneval"
    tasks: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Provider:
    models: tuple[str, ...] = ()
    max_concurrent_requests: int = 5
    requests_per_minute: float = 20
    retry_max_attempts: int = 5
    retry_base_delay_s: float = 2.0
    cache_dir: Path = Path("./cache/llm_responses")


@dataclass(frozen=True)
class Execution:
    timeout_s: float = 10.0
    cpu_workers: int = 4


@dataclass(frozen=True)
class Equivalence:
    n_fuzz_inputs: int = 500


@dataclass(frozen=True)
class Mutation:
    operators: tuple[str, ...] = ("AOR", "ROR", "SDL")


@dataclass(frozen=True)
class Variants:
    n_completions: int = 10
    temperature: float = 0.8
    relations: tuple[str, ...] = ("original", "persona", "formal", "reorder", "terse")


@dataclass(frozen=True)
class Divergence:
    n_shared_inputs: int = 200
    divergence_threshold: float | None = None


@dataclass(frozen=True)
class Degradation:
    degradation_levels: tuple[float, ...] = (0.0, 0.2, 0.5, 0.8)


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    benchmark: Benchmark = field(default_factory=Benchmark)
    llm: Provider = field(default_factory=Provider)
    execution: Execution = field(default_factory=Execution)
    stage0: Equivalence = field(default_factory=Equivalence)
    rq1: Mutation = field(default_factory=Mutation)
    rq2: Variants = field(default_factory=Variants)
    rq3: Divergence = field(default_factory=Divergence)
    rq4: Degradation = field(default_factory=Degradation)


def _build(kind: type, data: dict):
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    if unknown := set(data) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for name, value in data.items():
        if is_dataclass(hints[name]):
            value = _build(hints[name], value or {})
        elif name == "models":
            value = tuple(m["id"] if isinstance(m, dict) else m for m in value or ())
        elif isinstance(value, list):
            value = tuple(value)
        elif hints[name] is Path:
            value = Path(value)
        out[name] = value
    return kind(**out)


def load_config(path: str | Path) -> Config:
    """Settings from a YAML file; what it leaves out keeps its default, and names it shouldn't have raise ValueError."""
    return _build(Config, yaml.safe_load(Path(path).read_text()) or {})
