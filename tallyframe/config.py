"""Settings, from the environment, and the health report."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from . import sources


@dataclass(frozen=True)
class Config:
    upload_limit: int = sources.LIMIT
    assist_available: bool = False
    assist_threshold: float = 0.6

    @classmethod
    def from_environment(cls) -> Config:
        get = os.environ.get
        return cls(int(float(get("TALLYFRAME_UPLOAD_MB", "15")) * 1024 * 1024), get("TALLYFRAME_ASSIST", "") == "1", float(get("TALLYFRAME_ASSIST_THRESHOLD", "0.6")))


def health(config: Config | None = None) -> dict:
    return {"status": "ok", **asdict(config or Config.from_environment()), "extensions": list(sources.EXTENSIONS)}
