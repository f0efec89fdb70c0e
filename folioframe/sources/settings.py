"""Settings of a run: a TOML file, found by environment, working folder or home, with defaults for all else."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

# Who may answer open questions, and the settings that a stage depends on.
ANSWER_MODES = ("agent", "api", "off")
STAGES = ("preprocess", "layout", "text", "recognize", "reconcile", "assemble")


@dataclass(frozen=True)
class Engine:
    name: str
    python: str | None = None
    device: str | None = None
    batch_size: int | None = None
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, raw: dict) -> Engine:
        """Keys that are no fields are the engine's own options."""
        own = {f.name for f in fields(cls)} - {"name", "options"}
        return cls(name, **{k: v for k, v in raw.items() if k in own}, options={k: v for k, v in raw.items() if k not in own})


@dataclass(frozen=True)
class Api:
    base_url: str = ""
    model: str = ""
    key_env: str = "FOLIOFRAME_API_KEY"
    concurrency: int = 4
    max_requests: int = 200
    max_output_tokens: int = 4096
    thinking: str = "disabled"


@dataclass(frozen=True)
class Settings:
    path: str | None = None
    layout: str = ""
    formula: tuple[str, ...] = ()
    formula_fallback: tuple[str, ...] = ()
    engines: dict[str, Engine] = field(default_factory=dict)
    answers: str = "agent"
    api: Api = Api()
    render_scale: float = 3.0

    @property
    def order(self) -> tuple[str, ...]:
        """Engines by preference: those that always run, then those of last resort."""
        return self.formula + self.formula_fallback

    def engine(self, name: str) -> Engine:
        return self.engines.get(name, Engine(name))

    def stage_key(self, stage: str) -> str | None:
        """Identity of what a stage depends on; null for stages that no setting changes."""
        used = {
            "layout": lambda: [asdict(self.engine(self.layout))],
            "recognize": lambda: [self.formula, self.formula_fallback, self.render_scale, [asdict(self.engine(e)) for e in self.order]],
            "reconcile": lambda: list(self.order)}.get(stage)
        return hashlib.sha256(json.dumps(used(), sort_keys=True).encode()).hexdigest()[:16] if used else None


def find() -> Path | None:
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "folioframe" / "settings.toml"
    named = os.environ.get("FOLIOFRAME_SETTINGS")
    return next((p for p in (*([Path(named)] if named else []), Path("folioframe.toml"), home) if p.is_file()), None)


def load(path: str | Path | None = None) -> Settings:
    where = Path(path) if path else find()
    if where is None:
        return Settings()
    raw = tomllib.loads(where.read_text(encoding="utf-8"))
    run, answers = raw.get("pipeline", {}), raw.get("answers", {})
    mode = answers.get("mode", "agent")
    if mode not in ANSWER_MODES:
        raise ValueError(f"{where}: answers.mode is {mode!r}, not one of {', '.join(ANSWER_MODES)}")
    return Settings(
        str(where), run.get("layout", ""), tuple(run.get("formula", ())), tuple(run.get("formula_fallback", ())),
        {name: Engine.of(name, x) for name, x in raw.get("engines", {}).items()}, mode, Api(**answers.get("api", {})), float(run.get("render_scale", 3.0)))
