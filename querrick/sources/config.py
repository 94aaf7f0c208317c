"""Settings of an index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ..fixed import BATCH_MS, DEBOUNCE_MS, MAX_CHUNK_CHARS

# Dimensions of providers.
DIMENSIONS = {"local": 1024, "gemini": 1536, "mistral": 1536, "openai": 1536, "hash": 64}


@dataclass(frozen=True)
class Config:
    """No extensions: all text files. Dimensions follow the provider unless it is ``hash``."""

    provider: str = "hash"
    dimensions: int = 64
    extensions: tuple[str, ...] = ()
    chunk_max_size: int = MAX_CHUNK_CHARS
    watch: bool = True
    debounce_ms: int = DEBOUNCE_MS
    batch_ms: int = BATCH_MS
    extra: dict[str, object] = field(default_factory=dict)

    def corrected(self) -> Config:
        """With the dimensions that the provider has."""
        if self.provider not in DIMENSIONS:
            raise ValueError(f"unknown provider {self.provider}")
        return self if self.provider == "hash" else replace(self, dimensions=DIMENSIONS[self.provider])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Known settings over defaults; unknown ones go to ``extra``. Text that is no JSON object raises ValueError."""
        held = json.loads(text)
        if not isinstance(held, dict):
            raise ValueError("settings are not an object")
        known = {k: tuple(v) if k == "extensions" else v for k, v in held.items() if k in cls.__dataclass_fields__}
        more = {k: v for k, v in held.items() if k not in known}
        return cls(**known | {"extra": known.get("extra", {}) | more}).corrected()
