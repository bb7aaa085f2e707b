"""Settings from defaults, a global file, a folder's file and the environment, each above the one before."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

YES_NO = ("true", "false")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Setting:
    default: str
    about: str
    values: tuple[str, ...] = ()
    number: bool = False


#: Names of settings, their defaults and what they may be.
SETTINGS = {
    "INDEX_VARIABLES": Setting("true", "variables are nodes of the graph", YES_NO),
    "ALLOW_DB_DELETION": Setting("false", "everything may be deleted at once", YES_NO),
    "ENABLE_APP_LOGS": Setting("CRITICAL", "level of the engine's log", (*LEVELS, "DISABLED")),
    "LIBRARY_LOG_LEVEL": Setting("WARNING", "level of Spark's log", LEVELS),
    "MAX_FILE_SIZE_MB": Setting("10", "larger files are not indexed", number=True),
    "IGNORE_TEST_FILES": Setting("false", "test files are not indexed", YES_NO),
    "IGNORE_HIDDEN_FILES": Setting("true", "hidden files and folders are not indexed", YES_NO),
    "ENABLE_AUTO_WATCH": Setting("false", "a folder is watched once it is indexed", YES_NO),
    "COMPLEXITY_THRESHOLD": Setting("10", "functions above it are too complex", number=True),
    "MAX_DEPTH": Setting("unlimited", "folders below this depth are not indexed"),
    "IGNORE_DIRS": Setting("node_modules,venv,.venv,env,.env,dist,build,target,out,.git,.idea,.vscode,__pycache__", "folders that are not indexed"),
    "INDEX_SOURCE": Setting("true", "nodes keep their source", YES_NO),
    "SKIP_EXTERNAL_RESOLUTION": Setting("false", "calls that can only be guessed are left out", YES_NO),
}


def checked(name: str, value: str) -> str:
    """The value in its own spelling; ValueError for unknown names and values that a setting can't have."""
    known = SETTINGS.get(name)
    if known is None:
        raise ValueError(f"unknown setting {name!r}")
    if known.values:
        same = next((v for v in known.values if v.lower() == value.lower()), None)
        if same is None:
            raise ValueError(f"{name} is one of {', '.join(known.values)}, not {value!r}")
        return same
    if known.number and not value.replace(".", "", 1).isdigit():
        raise ValueError(f"{name} is a number, not {value!r}")
    if name == "MAX_DEPTH" and value != "unlimited" and not value.isdigit():
        raise ValueError(f"MAX_DEPTH is 'unlimited' or a number, not {value!r}")
    return value


def lines_of(path: Path) -> dict[str, str]:
    """NAME=value lines of a file that may not be there; unknown names are passed over."""
    if not path.is_file():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs if k.strip() in SETTINGS}


class Settings:
    def __init__(self, home: str | Path, folder: str | Path | None = None, environment: Mapping[str, str] | None = None):
        self.file, self.folder = Path(home) / ".env", None if folder is None else Path(folder) / ".env"
        self.environment = os.environ if environment is None else environment

    def all(self) -> dict[str, str]:
        layers = [{k: s.default for k, s in SETTINGS.items()}, lines_of(self.file), lines_of(self.folder) if self.folder else {}, {k: self.environment[k] for k in SETTINGS if k in self.environment}]
        found: dict[str, str] = {}
        for layer in layers:
            found |= {k: checked(k, v) for k, v in layer.items()}
        return found

    def get(self, name: str) -> str:
        checked(name, SETTINGS[name].default) if name in SETTINGS else checked(name, "")
        return self.all()[name]

    def flag(self, name: str) -> bool:
        return self.get(name) == "true"

    def set(self, name: str, value: str) -> None:
        """Into the global file; other lines there stay."""
        own = lines_of(self.file) | {name: checked(name, value)}
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.file.write_text("".join(f"{k}={v}\n" for k, v in sorted(own.items())))

    def reset(self) -> None:
        self.file.unlink(missing_ok=True)

    def scan_options(self) -> dict:
        """What the settings mean for srcgraph.sources.files.scan."""
        s = self.all()
        dirs = tuple(d.strip() for d in s["IGNORE_DIRS"].split(",") if d.strip())
        return {"ignore_dirs": dirs, "max_mb": float(s["MAX_FILE_SIZE_MB"]), "hidden": s["IGNORE_HIDDEN_FILES"] != "true", "tests": s["IGNORE_TEST_FILES"] != "true", "max_depth": None if s["MAX_DEPTH"] == "unlimited" else int(s["MAX_DEPTH"])}
