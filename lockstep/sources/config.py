"""Where a project's files lie: one root folder, given or taken from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Roots:
    """Folders under the project's root; paths are plain strings that Spark readers and writers take."""

    root: str

    @property
    def raw_videos(self) -> str:
        return f"{self.root}/raw_videos"

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def logs(self) -> str:
        return f"{self.root}/logs"

    @property
    def checkpoints(self) -> str:
        return f"{self.root}/checkpoints"

    def source(self, filename: str) -> str:
        return f"{self.raw_videos}/{filename}"

    def frames(self, view: str) -> str:
        return f"{self.data}/{view}"


def roots(root: str | None = None, env_file: str = ".env") -> Roots:
    """The given root, else DRIVE_ROOT of the environment, else of a KEY=VALUE file; KeyError if there is none."""
    if root is None and "DRIVE_ROOT" not in os.environ and os.path.exists(env_file):
        with open(env_file) as lines:
            for line in lines:
                key, found, value = line.strip().partition("=")
                if found and key.strip() == "DRIVE_ROOT":
                    root = value.strip().strip("'\"")
    return Roots((root if root is not None else os.environ["DRIVE_ROOT"]).rstrip("/"))
