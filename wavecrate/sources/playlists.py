"""Paged JSON playlists as a data source: one partition a playlist, whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavecrate.sources.paths import json_lines, listed, store, text


class PlaylistPartition(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


#: How each source names a track's fields.
FIELDS = {
    "alpha": ("id", "title", "artist", "isrc"),
    "beta": ("track_id", "name", "artist_name", "isrc"),
    "gamma": ("uid", "label", "by", "code"),
}


class PlaylistReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.source, self.path = options.get("source", ""), options["path"]
        if self.source not in FIELDS:
            raise ValueError(f"unknown playlist source: {self.source!r}")

    def partitions(self) -> list[PlaylistPartition]:
        fs, top = store(self.path)
        return [PlaylistPartition(f.base_name) for f in listed(fs, top) if f.type == pafs.FileType.Directory]

    def page(self, folder: str, number: int) -> dict:
        """A page is the file page-N.json, or the only object of the folder page=N. One that is missing fails the playlist: part of a list would look like removals."""
        fs, top = store(self.path)
        file = f"{top}/{folder}/page-{number}.json"
        if fs.get_file_info(file).type == pafs.FileType.File:
            return json.loads(text(fs, file))
        found = json_lines(fs, f"{top}/{folder}/page={number}")
        if len(found) != 1:
            raise FileNotFoundError(file)
        return found[0]

    def read(self, partition: PlaylistPartition) -> Iterator[tuple]:
        rows, number = [], 0
        name = partition.folder.rsplit("=", 1)[-1]
        while number is not None:
            body = self.page(partition.folder, number)
            for t in body.get("tracks") or []:
                rows.append((name, len(rows), *(None if t.get(k) is None else str(t[k]) for k in FIELDS[self.source])))
            number = body.get("next")
        yield from rows


class Playlists(DataSource):
    """``spark.read.format("playlists").option("source", "alpha").load(folder)``; a folder a playlist (name or anything=name), pages with tracks and next."""

    @classmethod
    def name(cls) -> str:
        return "playlists"

    def schema(self) -> str:
        return "playlist string, position int, external_id string, title string, artist string, isrc string"

    def reader(self, schema) -> PlaylistReader:  # noqa: ANN001
        return PlaylistReader(self.options)
