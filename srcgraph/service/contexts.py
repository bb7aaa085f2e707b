"""Contexts: named graphs, a repository's own graph, and which of them holds where."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: The folder in a repository that makes it a context of its own.
LOCAL = ".srcgraph"
MODES = ("global", "per-repo", "named")


@dataclass
class Context:
    """mode: why it was chosen; graph: where its tables are; ignore: its ignore file."""

    mode: str
    name: str
    graph: str
    ignore: str
    repos: list[str] = field(default_factory=list)

    @property
    def local(self) -> bool:
        return self.mode == "per-repo"


@dataclass
class _State:
    mode: str = "global"
    default: str = ""
    named: dict[str, dict] = field(default_factory=dict)
    mapped: dict[str, str] = field(default_factory=dict)


class Contexts:
    """The registry of contexts, a JSON file in a home folder."""

    def __init__(self, home: str | Path):
        self.home = Path(home)
        self.file = self.home / "contexts.json"

    def _state(self) -> _State:
        return _State(**json.loads(self.file.read_text())) if self.file.is_file() else _State()

    def _save(self, state: _State) -> None:
        self.home.mkdir(parents=True, exist_ok=True)
        self.file.write_text(json.dumps(asdict(state), indent=1, sort_keys=True))

    def _named(self, name: str, state: _State) -> Context:
        own = state.named.get(name, {})
        at = self.home / "contexts" / name
        return Context("named", name, own.get("graph") or str(at / "graph"), str(at / ".srcgraphignore"), list(own.get("repos", [])))

    @staticmethod
    def _local(folder: Path) -> Context:
        return Context("per-repo", "", str(folder / "graph"), str(folder / ".srcgraphignore"), [str(folder.parent)])

    def create(self, name: str, graph: str | None = None) -> bool:
        """False if there is one of that name."""
        state = self._state()
        if name in state.named:
            return False
        state.named[name] = {"graph": graph, "repos": []}
        self._save(state)
        return True

    def delete(self, name: str) -> bool:
        """Takes a context out of the registry; its tables stay."""
        state = self._state()
        if state.named.pop(name, None) is None:
            return False
        state.default = "" if state.default == name else state.default
        self._save(state)
        return True

    def register(self, name: str, repo: str, create: bool = False) -> bool:
        """Adds a repository to a context, once."""
        if create:
            self.create(name)
        state = self._state()
        if name not in state.named:
            return False
        repos = state.named[name]["repos"]
        if (path := str(Path(repo).resolve())) not in repos:
            repos.append(path)
            self._save(state)
        return True

    def list(self) -> list[Context]:
        state = self._state()
        return [self._named(name, state) for name in sorted(state.named)]

    def set_mode(self, mode: str) -> bool:
        state = self._state()
        if mode not in MODES:
            return False
        state.mode = mode
        self._save(state)
        return True

    def set_default(self, name: str) -> bool:
        state = self._state()
        if name and name not in state.named:
            return False
        state.default = name
        self._save(state)
        return True

    def switch(self, folder: str | Path, to: str | Path | None) -> None:
        """From now on a folder uses the context of another folder, or again its own."""
        state = self._state()
        key = str(Path(folder).resolve())
        if to is None:
            state.mapped.pop(key, None)
        else:
            state.mapped[key] = str(Path(to).resolve())
        self._save(state)

    def resolve(self, folder: str | Path, name: str | None = None) -> Context:
        """The context that holds in a folder: the one asked for by name, the repository's own, the one the folder was switched to, the default one, the global one."""
        state, folder = self._state(), Path(folder).resolve()
        if name:
            return self._named(name, state)
        own = next((p / LOCAL for p in (folder, *folder.parents) if (p / LOCAL).is_dir() and p / LOCAL != self.home), None)
        if own is None and state.mode == "per-repo":
            own = folder / LOCAL
            own.mkdir(parents=True)
        if own is not None:
            return self._local(own)
        to = Path(state.mapped.get(str(folder), "")) / LOCAL
        if str(folder) in state.mapped and to.is_dir():
            return self._local(to)
        if state.mode == "named" and state.default:
            return self._named(state.default, state)
        return Context("global", "", str(self.home / "global" / "graph"), str(self.home / "global" / ".srcgraphignore"))

    def discover(self, folder: str | Path, max_depth: int = 1) -> list[Context]:
        """Contexts of repositories up to so many levels below a folder, level by level; hidden folders are passed over."""
        found, level = [], [Path(folder).resolve()]
        for _ in range(max_depth + 1):
            below = []
            for at in level:
                try:
                    below += [p for p in sorted(at.iterdir()) if p.is_dir() and not p.name.startswith(".")]
                except PermissionError:
                    continue
            level = below
            found += [self._local(p / LOCAL) for p in level if (p / LOCAL).is_dir() and p / LOCAL != self.home]
        return found
