"""Archive files on shared storage, written by tasks and committed by a manifest.

A task writes files under names that no other attempt uses and returns one row a file; only files in the manifest (the
rows of the attempts that succeeded) count, so retried and speculative attempts leave nothing that a reader would see.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Rolling:
    """Files of at most about ``roll`` bytes below ``folder``; ``files`` has (uri, bytes, members) of each closed one."""

    def __init__(self, folder: str, suffix: str, roll: int):
        self.folder, self.suffix, self.roll = folder.rstrip("/"), suffix, roll
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.files: list[tuple[str, int, int]] = []
        self.out, self.name, self.at, self.members = None, "", 0, 0

    def add(self, data: bytes) -> int:
        """Append a member; its offset."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.at, self.members = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, 0
        at = self.at
        self.out.write(data)
        self.at += len(data)
        self.members += 1
        return at

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.roll

    def close(self, trailer: bytes = b"") -> None:
        if self.out is not None:
            self.out.write(trailer)
            self.out.close()
            self.files.append((f"{self.folder}/{self.name}", self.at + len(trailer), self.members))
            self.out = None
