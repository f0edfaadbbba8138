"""Small files of a source by path or address, on any store that pyarrow knows."""

from __future__ import annotations

import json

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (file:, hdfs:, s3:, gs:, ...), and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What is in a folder, by name; nothing if it isn't there."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(found, key=lambda f: f.base_name)


def text(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def json_lines(fs: pafs.FileSystem, folder: str) -> list[dict]:
    """The objects of all JSON-lines files of a folder; names that begin with a dot or underscore are not data."""
    files = [f for f in listed(fs, folder) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    return [json.loads(line) for f in files for line in text(fs, f.path).splitlines() if line]
