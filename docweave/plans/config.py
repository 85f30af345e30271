"""Settings: defaults, environment, .env file; printed with secrets hidden."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

PREFIX = "DOCWEAVE_"


@dataclass
class Settings:
    vlm_provider: str = "rules"
    vlm_max_retries: int = 2
    llm_base_url: str = ""
    llm_api_key: str = ""
    llm_model: str = ""
    llm_timeout: float = 120.0
    llm_budget: int = 20
    text_strong_match_threshold: float = 0.95
    text_weak_match_threshold: float = 0.80
    paragraph_overlap: float = 0.30
    header_overlap: float = 0.80
    caption_ratio: float = 0.30
    min_block_area: float = 1.0

    def masked(self) -> dict:
        found = asdict(self)
        key = self.llm_api_key
        return found | {"llm_api_key": ("***" + key[-4:] if len(key) > 4 else "***") if key else ""}


def load(env_file: str | None = ".env", environ: dict | None = None) -> Settings:
    """Defaults, then the lines NAME=value of ``env_file``, then the environment."""
    values: dict[str, str] = {}
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            values |= dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
    values |= dict(os.environ if environ is None else environ)
    own = {f.name: type(f.default)(values[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in values}
    return Settings(**own)
