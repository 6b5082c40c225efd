"""Several knowledge bases side by side. What is known of them is one value, (active, {name: folders}); functions give the
next value for a change, and read() and write() keep it in a JSON file."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import NamedTuple

from citeloom.plans.settings import Settings

FOLDERS = ("pdf_dir", "store_dir", "images_dir", "state_dir")


class Bases(NamedTuple):
    active: str
    folders: dict[str, dict[str, str]]  # of each base by its name, with its description


def alone(settings: Settings) -> Bases:
    """The settings' own folders as the one base."""
    return Bases("default", {"default": {f: getattr(settings, f) for f in FOLDERS} | {"description": ""}})


def at_home(name: str, pdf_dir: str, home: str, description: str = "") -> dict[str, str]:
    """The folders of a base that keeps everything but its documents under home."""
    own = {f: f"{home}/bases/{name}/{f.removesuffix('_dir')}" for f in FOLDERS[1:]}
    return {"pdf_dir": pdf_dir, **own, "description": description}


def put(bases: Bases, name: str, folders: dict[str, str], replace: bool = False) -> Bases:
    if name in bases.folders and not replace:
        raise ValueError(f"{name!r} is taken by another knowledge base")
    return bases._replace(folders=bases.folders | {name: folders})


def drop(bases: Bases, name: str) -> Bases:
    """Without a base, whose files stay; where it was the active one, the first of the others is."""
    rest = {n: f for n, f in bases.folders.items() if n != known(bases, name)}
    if not rest:
        raise ValueError("a registry holds one knowledge base at least")
    return Bases(bases.active if bases.active in rest else next(iter(rest)), rest)


def activate(bases: Bases, name: str) -> Bases:
    return bases._replace(active=known(bases, name))


def known(bases: Bases, name: str) -> str:
    """name, if there is such a base."""
    if name not in bases.folders:
        raise KeyError(f"{name!r} is no knowledge base here; there are {', '.join(sorted(bases.folders))}")
    return name


def in_order(bases: Bases) -> list[str]:
    """The active base's name, then the others'."""
    return [bases.active, *sorted(bases.folders.keys() - {bases.active})]


def overrides(bases: Bases, name: str) -> dict[str, str]:
    """The settings that a base stands for."""
    return {f: bases.folders[known(bases, name)][f] for f in FOLDERS}


def _whole(entry) -> bool:
    return isinstance(entry, dict) and all(isinstance(entry.get(f), str) for f in ("name", *FOLDERS)) and not entry.keys() - {"name", "description", *FOLDERS}


def read(path: str, settings: Settings) -> Bases:
    """What the file at path knows; entries that aren't whole are left out, and without any it is the settings' base."""
    try:
        stored = json.loads(Path(path).read_text())
        entries, active = [e for e in stored["bases"] if _whole(e)], stored.get("active")
    except (OSError, ValueError, TypeError, KeyError, AttributeError):
        entries, active = [], None
    if not entries:
        return alone(settings)
    folders = {e["name"]: {"description": "", **{k: v for k, v in e.items() if k != "name"}} for e in entries}
    return Bases(active if active in folders else next(iter(folders)), folders)


def write(path: str, bases: Bases) -> None:
    """Puts a new file in the place of the old one."""
    new = Path(f"{path}.new")
    new.parent.mkdir(parents=True, exist_ok=True)
    new.write_text(json.dumps({"active": bases.active, "bases": [{"name": n, **f} for n, f in bases.folders.items()]}, indent=2))
    os.replace(new, path)
