"""Driver-side helpers on paths, environment names and references to credentials."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from feldspar.errors import NoIndex, NotFound

STATE_DIR, GRAPH_FILE = ".feldspar", "graph.json"
#: What marks a variable's name as a credential's, and names that are none all the same.
SENSITIVE = "KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTH|SESSION|COOKIE"
HARMLESS = ("SSH_AUTH_SOCK", "GPG_TTY")


def safe_environment(env: Mapping[str, str]) -> dict[str, str]:
    """``env`` without variables whose name, in any case, looks like a credential's."""
    return {k: v for k, v in env.items() if k in HARMLESS or not re.search(SENSITIVE, k, re.IGNORECASE)}


def credential_slot(reference: str, prefix: str = "CRED_") -> str | None:
    """The variable that holds what ``env:NAME`` refers to; None for anything else, so that a bare value is never used."""
    scheme, colon, name = reference.partition(":")
    return prefix + name.upper() if colon and scheme == "env" and name else None


def inside(root: str, path: str) -> bool:
    """Whether ``path``, taken from ``root`` and with links followed, is ``root`` or below it."""
    base = Path(root).resolve()
    return (base / path).resolve().is_relative_to(base)


def state_dir(start: str, name: str = STATE_DIR) -> str:
    """The state folder in ``start`` or the nearest folder above; NoIndex if there is none."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / name).is_dir():
            return str(folder / name)
    raise NoIndex(f"no {name} at {here} or above")


def create_state_dir(root: str, name: str = STATE_DIR) -> str:
    """A new state folder in ``root``; FileExistsError if it is there."""
    path = Path(root) / name
    path.mkdir(parents=True)
    return str(path)


def graph_path(explicit: str | None, start: str) -> str:
    """``explicit``, or the graph's document in the nearest state folder."""
    if explicit is not None:
        return explicit
    path = Path(state_dir(start)) / GRAPH_FILE
    if not path.exists():
        raise NotFound(f"no graph at {path}")
    return str(path)
