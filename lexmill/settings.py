"""Settings: defaults, one YAML file over them, and the environment for what must not be in a file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from lexmill.sources.files import yaml_file

PREFIX = "LEXMILL_"
# What holds where no file says otherwise.
DEFAULTS = {
    "environment": "development", "log_level": "INFO",
    "extract": {
        "embedding_threshold": 0.50,
        "rung3": {
            "model": "qwen3:8b", "host": "http://127.0.0.1:11434", "timeout_seconds": 300, "num_ctx": 8192, "temperature": 0, "seed": 42,
            "prompt_version": "rung3_v1", "num_predict": 1024,
        },
    },
    "mining": {"char_budget": 9000, "num_predict": 4096},
}


def merged(below: dict, above: dict) -> dict:
    """``above`` over ``below``, section by section."""
    both = {k: merged(v, above[k]) if isinstance(v, dict) and isinstance(above.get(k), dict) else above.get(k, v) for k, v in below.items()}
    return both | {k: v for k, v in above.items() if k not in below}


def load(path: str | None = None) -> dict:
    """The defaults with the file's values; a file that isn't there, or is empty, changes nothing."""
    return merged(DEFAULTS, yaml_file(path) if path and Path(path).exists() else {})


@dataclass(frozen=True)
class Environment:
    """What comes from environment variables only; others with the prefix are ignored."""

    environment: str = "development"
    log_level: str = "INFO"
    openai_api_key: str | None = None
    anthropic_api_key: str | None = None

    @classmethod
    def read(cls, env_file: str = ".env") -> Environment:
        """From the lines ``NAME=value`` of a file, if there is one, and the process's own variables, which win."""
        found = {}
        if Path(env_file).exists():
            lines = Path(env_file).read_text(encoding="utf-8").splitlines()
            found = dict(line.strip().split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#"))
        found |= os.environ
        upper = {k.strip().upper(): v.strip().strip("\"'") for k, v in found.items()}
        return cls(**{f.name: upper[name] for f in fields(cls) if (name := PREFIX + f.name.upper()) in upper})
