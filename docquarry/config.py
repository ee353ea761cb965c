"""Settings, with defaults where there is no file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

# --- fixed values: what is never indexed
TEMPORARY = ("~$", ".tmp", ".temp", ".cache")
COMPRESSED = ("zip", "7z", "rar")
MAX_FILE_SIZE_MB = 50
#: Extensions that an extractor reads.
SUPPORTED = ("txt", "xlsx", "docx", "pptx", "pdf")


@dataclass(frozen=True)
class Config:
    index_path: str = "docquarry-index"
    max_file_size_mb: int = MAX_FILE_SIZE_MB
    temporary: tuple[str, ...] = TEMPORARY
    compressed: tuple[str, ...] = COMPRESSED
    supported: tuple[str, ...] = field(default=SUPPORTED)

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Settings of a TOML file; an absent file means the defaults, unknown keys are ignored."""
        path = Path(path)
        if not path.exists():
            return cls()
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in tomllib.loads(path.read_text("utf-8")).items() if k in cls.__dataclass_fields__}
        return cls(**known)
