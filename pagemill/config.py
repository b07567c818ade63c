"""Settings of the stages: a tree as YAML gives it, checked when it is loaded.

Folders are places of Spark tables, so they may be URIs of any file system; relative ones
start from the folder of the settings.  Parts that no stage reads are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pagemill.operators.pages import LAYOUT
from pagemill.operators.structure import STRATEGIES

#: Folders of tables, by the stage that fills them (questions are given).
KINDS = ("processed", "chunks", "qa", "output")


def _check(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(f"settings: {what}")


def _page_ranges(sections: list) -> list[tuple[int, int]]:
    out = []
    for n, section in enumerate(sections):
        _check(isinstance(section, dict) and {"start", "end"} <= set(section), f"sections[{n}] needs start and end")
        first, last = section["start"], section["end"]
        _check(isinstance(first, int) and isinstance(last, int) and first <= last, f"sections[{n}] runs from {first} to {last}")
        out.append((first, last))
    return out


def _layout(tree: dict, where: str) -> dict:
    own = {k: v for k, v in (tree or {}).items() if k in LAYOUT}
    _check(all(isinstance(v, (int, float)) for v in own.values()), f"{where} has edges that are no numbers")
    return own


@dataclass(frozen=True)
class Config:
    """``base`` is the folder that relative places start from, ``raw`` the tree."""

    base: str
    raw: dict = field(default_factory=dict)
    page_ranges: list[tuple[int, int]] = field(init=False, repr=False)
    layout: dict = field(init=False, repr=False)
    overrides: dict = field(init=False, repr=False)
    k_values: tuple[int, ...] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        tree = self._part("layout")
        ks = tuple(self._part("evaluation").get("k_values") or (1, 3, 5))
        _check(all(isinstance(k, int) and k > 0 for k in ks), f"evaluation.k_values {ks} are not all positive")
        read = {
            "page_ranges": _page_ranges(self.raw.get("sections") or []), "k_values": ks,
            "layout": {**LAYOUT, **_layout(tree.get("defaults"), "layout.defaults")},
            "overrides": {str(lco): _layout(own, f"layout.overrides.{lco}") for lco, own in (tree.get("overrides") or {}).items()},
        }
        for name, value in read.items():
            object.__setattr__(self, name, value)
        for name in self.strategies():
            self.parameters(name)

    def _part(self, *names: str) -> dict:
        tree = self.raw
        for name in names:
            tree = tree.get(name) or {}
            _check(isinstance(tree, dict), f"{'.'.join(names)} is no mapping")
        return tree

    def place(self, path: str) -> str:
        """A path or URI as Spark takes it."""
        return path if "://" in path or path.startswith("/") else str(PurePosixPath(self.base) / path)

    def folder(self, kind: str) -> str:
        _check(kind in KINDS, f"no folder of {kind} tables")
        return self.place(str(self._part("paths").get(f"{kind}_dir", kind)))

    def table(self, kind: str, name: str) -> str:
        return f"{self.folder(kind)}/{name}"

    @property
    def model_name(self) -> str:
        return self._part("embedding_model").get("name", "hashing-64")

    def strategies(self, wanted: str = "all") -> list[str]:
        """The chunkers to run: one by name, or all that the settings list (every one if they list none)."""
        names = list(self._part("chunking").get("strategies") or STRATEGIES) if wanted == "all" else [wanted]
        _check(set(names) <= set(STRATEGIES), f"unknown chunking strategies {sorted(set(names) - set(STRATEGIES))}; known are {sorted(STRATEGIES)}")
        return names

    def parameters(self, strategy: str) -> dict:
        """What a chunker is called with: its defaults and what the settings change of them (a null changes nothing)."""
        own = self._part("chunking", "params", strategy)
        known = {*STRATEGIES[strategy][2], "batch_size", "model_name"}
        _check(set(own) <= known, f"unknown parameters of {strategy}: {sorted(set(own) - known)}")
        return {**STRATEGIES[strategy][2], **{k: v for k, v in own.items() if v is not None}}


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as file:
        tree = yaml.safe_load(file) or {}
    _check(isinstance(tree, dict), f"{path} holds no mapping")
    return Config(str(PurePosixPath(path).parent), tree)
