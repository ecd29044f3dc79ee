"""Settings with defaults, read from and written to YAML; unknown keys are ignored, missing ones keep their default."""

from __future__ import annotations

import logging
import os
from dataclasses import asdict, dataclass, field, fields

from ..functions.names import ROMAN

LOG = logging.getLogger("quillsift")


def setup_logging(level: str = "INFO", file: str | None = None) -> logging.Logger:
    """Messages of this package to standard error, and to ``file`` where one is given; called again, it replaces what it set up."""
    for h in list(LOG.handlers):
        LOG.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        LOG.addHandler(h)
    LOG.setLevel(level.upper())
    return LOG


def get_logger(name: str = "") -> logging.Logger:
    return LOG.getChild(name) if name else LOG


PLACES = ["quillsift.yaml", "quillsift.yml", ".quillsift.yaml", "~/.quillsift.yaml", "~/.config/quillsift/config.yaml", "/etc/quillsift/config.yaml"]


@dataclass
class Search:
    max_results: int = 20
    edits: list = field(default_factory=list)
    overlap: str = "all"
    clean: bool = True
    text_column: str = "text"
    id_column: str = "uniqid"


@dataclass
class Names:
    column: str = "Name"
    keep_all: bool = False
    prefix_column: str = "seat"
    roman: list = field(default_factory=lambda: list(ROMAN))
    parser: str = "auto"
    batch_size: int = 100
    ml_threshold: float = 0.8
    patterns: list = field(default_factory=lambda: ["FirstName LastName", "NickName LastName", "Prefix LastName"])


@dataclass
class Text:
    """Steps of text cleaning that are taken."""

    special: bool = True
    accents: bool = True
    stopwords: bool = True
    stem: bool = False
    snowball: bool = False
    punctuation: bool = True


@dataclass
class Files:
    folder: str = "./output"
    read: list = field(default_factory=lambda: ["csv", "json", "parquet"])
    write: list = field(default_factory=lambda: ["csv", "json", "parquet"])
    chunk: int = 1000


@dataclass
class Language:
    """Names found in texts and linked to known ones; ``finder``, ``model`` and ``embed`` are 'module:function', as no model comes along."""

    finder: str = ""
    model: str = ""
    embed: str = ""
    link: bool = False
    threshold: float = 0.8


@dataclass
class Config:
    search: Search = field(default_factory=Search)
    names: Names = field(default_factory=Names)
    text: Text = field(default_factory=Text)
    files: Files = field(default_factory=Files)
    language: Language = field(default_factory=Language)

    @classmethod
    def of(cls, given: dict) -> Config:
        made = cls()
        for part in fields(cls):
            own, values = getattr(made, part.name), given.get(part.name) or {}
            for f in fields(own):
                if f.name in values:
                    setattr(own, f.name, values[f.name])
        return made

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The file given, else the first of PLACES that exists, else defaults; a file that can't be read is reported and gives defaults."""
        import yaml

        found = path or next((p for p in map(os.path.expanduser, PLACES) if os.path.exists(p)), None)
        if not found:
            return cls()
        try:
            with open(found) as f:
                return cls.of(yaml.safe_load(f) or {})
        except (OSError, yaml.YAMLError, AttributeError) as e:
            LOG.warning("%s can't be read, defaults are used: %s", found, e)
            return cls()

    @staticmethod
    def function(name: str):
        """What 'module:function' names; None of an empty one."""
        import importlib

        module, _, f = name.partition(":")
        return getattr(importlib.import_module(module), f) if name else None

    def save(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(asdict(self), f, sort_keys=False)


def get_config(path: str | None = None) -> Config:
    return Config.load(path)


def save_config(config: Config, path: str) -> None:
    config.save(path)


def create_sample_config(path: str) -> None:
    """All settings at their defaults, to be edited."""
    Config().save(path)
