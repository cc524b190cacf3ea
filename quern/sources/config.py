"""Settings of a run: one JSON document with five sections, checked when it is read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

SECTIONS = ("dataset", "split", "sampling", "preprocessing", "paths")


@dataclass(frozen=True)
class Config:
    """Sections by name; path(key) resolves a relative path against the file's folder."""

    root: Path
    sections: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> dict:
        return self.sections[name]

    def path(self, key: str) -> Path:
        p = Path(self.sections["paths"][key])
        return p if p.is_absolute() else self.root / p


def read_settings(path: str | Path) -> dict:
    """A JSON or YAML document, by the file's ending; YAML needs its library."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix not in (".yaml", ".yml"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def coord_dtype(output: dict, group: str) -> str:
    """The storage type of a group's coordinates: one for all, or by group."""
    found = output["coord_dtype"]
    return found if isinstance(found, str) else found[group]


def load_config(path: str | Path) -> Config:
    """Read and check: the five sections are there, split ratios add up to 1, the revision is 40 hex digits."""
    path = Path(path)
    doc = read_settings(path)
    missing = [s for s in SECTIONS if s not in doc]
    if missing:
        raise ValueError(f"{path}: sections missing: {missing}")
    ratios = doc["split"]["ratios"]
    if abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError(f"{path}: split ratios add up to {sum(ratios.values())}")
    if not re.fullmatch("[0-9a-f]{40}", doc["dataset"]["revision"]):
        raise ValueError(f"{path}: the revision must be a full 40-digit commit")
    return Config(path.parent, doc)


def with_profile(doc: dict, name: str | None) -> dict:
    """A copy of doc whose output follows a storage profile; configurations whose groups it lacks are left out."""
    out = json.loads(json.dumps(doc))
    if not name:
        return out
    if name not in doc.get("storage_profiles", {}):
        raise ValueError(f"unknown storage profile {name!r}")
    p = doc["storage_profiles"][name]
    out["output"] = out.get("output", {}) | {"groups_to_store": list(p["groups_to_store"]), "coord_dtype": dict(p["coord_dtype"])}
    out["configurations"] = {k: v for k, v in doc.get("configurations", {}).items() if set(v) <= set(p["groups_to_store"])}
    return out | {"storage_profile": name}


def parse_per_split(text: str | None, splits: tuple[str, ...] = ("train", "val", "test")) -> dict[str, int] | None:
    """"train=20,val=5" as a dictionary; nothing is no limit, an unknown split an error."""
    if not text:
        return None
    out = {k.strip(): int(v) for k, v in (part.split("=") for part in text.split(",") if part.strip())}
    if set(out) - set(splits):
        raise ValueError(f"unknown splits: {sorted(set(out) - set(splits))}")
    return out
