"""What a user may switch."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """mode: ``llm`` asks a recognizer for names, ``regex`` finds organizations by rule and no names or addresses.

    places: aliases of organizations also without the place that their name begins with; more_places are added to the
    places known.
    """

    mode: str = "llm"
    dates: bool = True
    exact_dates: bool = False
    amounts: bool = False
    places: bool = False
    more_places: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in ("llm", "regex"):
            raise ValueError(f"mode {self.mode!r}")
        if self.exact_dates and not self.dates:
            raise ValueError("exact dates need dates")

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Options:
        """What was saved; settings that are missing have their defaults, and unknown ones are an error."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
