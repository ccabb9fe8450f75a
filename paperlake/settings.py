"""Settings from the environment and from .env files."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import quote


@dataclass(frozen=True)
class Settings:
    """Fields without a default must be given; empty values count as not given, unknown names are passed over."""

    DEBUG: bool
    MONGODB_SERVER: str
    MONGODB_PORT: int
    MONGODB_DATABASE: str
    API_V1_STR: str = "/api/v1"
    PROJECT_NAME: str = "Research Agent API"
    MONGODB_ROOT_USERNAME: str | None = None
    MONGODB_ROOT_PASSWORD: str | None = None

    @property
    def store_uri(self) -> str:
        """Address of the store; the credentials take part only if both are there."""
        both = self.MONGODB_ROOT_USERNAME is not None and self.MONGODB_ROOT_PASSWORD is not None
        who = ""
        if both:
            who = f"{quote(self.MONGODB_ROOT_USERNAME, safe='')}:{quote(self.MONGODB_ROOT_PASSWORD, safe='')}@"
        return f"mongodb://{who}{self.MONGODB_SERVER}:{self.MONGODB_PORT}/{self.MONGODB_DATABASE}" + "?authSource=admin" * both

    @property
    def shown_uri(self) -> str:
        """The same with the credentials masked."""
        return re.sub("//[^/@]*@", "//***:***@", self.store_uri)


def _pairs(path: Path) -> dict[str, str]:
    """NAME=value lines of a file; blank lines, comments and quotes around values are left out."""
    out = {}
    for line in path.read_text().splitlines() if path.is_file() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def load(environ: Mapping[str, str] | None = None, files: tuple[str, ...] = ("../.env", ".env")) -> Settings:
    """Settings of the environment and, where it is silent, of the files; a later file goes before an earlier one."""
    given: dict[str, str] = {}
    for source in (*(_pairs(Path(f)) for f in files), os.environ if environ is None else environ):
        given.update({k: v for k, v in source.items() if v != ""})
    out: dict = {}
    for f in fields(Settings):
        if f.name not in given:
            continue
        text = given[f.name]
        if f.type == "bool":
            low = text.lower()
            if low not in ("1", "0", "true", "false", "yes", "no", "on", "off", "t", "f", "y", "n"):
                raise ValueError(f"{f.name}: {text!r} is neither true nor false")
            out[f.name] = low in ("1", "true", "yes", "on", "t", "y")
        else:
            out[f.name] = int(text) if f.type == "int" else text
    missing = [f.name for f in fields(Settings) if f.name not in out and f.name in ("DEBUG", "MONGODB_SERVER", "MONGODB_PORT", "MONGODB_DATABASE")]
    if missing:
        raise ValueError(f"settings not given: {', '.join(missing)}")
    return Settings(**out)
