"""Settings that a user may change, kept as a JSON file: known names only, checked one by one."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def one_of(*values: str) -> Callable[[Any], str]:
    def check(value: Any) -> str:
        if value not in values:
            raise ValueError(f"not one of {', '.join(values)}: {value}")
        return value

    return check


def positive(value: Any) -> int:
    if (number := int(value)) < 1:
        raise ValueError(f"not positive: {value}")
    return number


def folder(value: Any) -> str:
    """A folder that exists, or the empty string for the usual one."""
    if not value:
        return ""
    path = Path(str(value)).expanduser()
    if not path.is_dir():
        raise ValueError(f"no such folder: {value}")
    return str(path)


@dataclass(frozen=True)
class Rule:
    default: Any
    check: Callable[[Any], Any]


#: Names, defaults and allowed values.
RULES = {
    "asr_model": Rule("large-v3-turbo", one_of("tiny", "base", "small", "medium", "large-v3-turbo")),
    "device": Rule("auto", one_of("auto", "cuda", "cpu")),
    "theme": Rule("dark", one_of("dark", "light")),
    "max_frames_per_video": Rule(12, positive),
    "snippet_words": Rule(25, positive),
    "download_dir": Rule("", folder),
}


class Settings:
    """The settings of a file. What the file lacks, or has wrongly, is the default; a file that is no JSON object counts as empty."""

    def __init__(self, path: str):
        self.path, self.refused = Path(path), {}
        self.values = {name: rule.default for name, rule in RULES.items()}
        for name, value in self._stored().items():
            if name in RULES:
                try:
                    self.values[name] = RULES[name].check(value)
                except (ValueError, TypeError) as e:
                    self.refused[name] = str(e)

    def _stored(self) -> dict:
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def update(self, changes: dict[str, Any]) -> dict[str, Any]:
        """All changes or, if one is refused, none; unknown names and nulls are left out. The file is replaced as a whole."""
        checked = {name: RULES[name].check(value) for name, value in changes.items() if name in RULES and value is not None}
        self.values |= checked
        self.path.parent.mkdir(parents=True, exist_ok=True)
        own = self.path.with_name(f"{self.path.name}.{os.getpid()}")
        own.write_text(json.dumps(self.values, ensure_ascii=False, indent=2), encoding="utf-8")
        own.replace(self.path)
        return self.values

    @property
    def download_dir(self) -> Path:
        """Where exports go: the chosen folder while it exists, else the user's downloads, else their home."""
        for path in (self.values["download_dir"], Path.home() / "Downloads"):
            if path and Path(path).is_dir():
                return Path(path)
        return Path.home()

    def rows(self, spark: SparkSession) -> DataFrame:
        """key, value as JSON."""
        return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in sorted(self.values.items())], "key string, value string")
