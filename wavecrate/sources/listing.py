"""A newest-first paged listing as a stream that can be stopped and resumed.

The listing shows the newest entries first, so everything moves to later pages as
entries are added. A position is therefore not a page but two full timestamps:
all entries from ``oldest`` to ``newest`` have been taken. A batch takes what is
newer, and then goes on below ``oldest`` until it has ``limit`` entries. Timestamps
are compared as the full ISO text, so entries of one day on either side of a
position are told apart; entries of the very timestamp that ends a batch are all
taken with it.

The page where the last batch ended is kept as a hint and checked before use: if it
is empty now (entries were deleted), or already begins below the position (content
moved up), the listing is read from the top. Tasks get intervals of timestamps with
such a hint and check it again, as the listing may have moved since the batch was
planned.

``page=N/*.json`` below ``path`` are the pages, from 0, a JSON object a line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wavecrate.sources.paths import json_lines, store


def resume_page(hint: int, first: str | None, position: str) -> int:
    """The page to go on from: the hinted one if its first entry is not below the position, else the top."""
    return hint if hint > 0 and first is not None and first >= position else 0


class Pages:
    """The pages of a listing; entries without a timestamp are left out."""

    def __init__(self, path: str, field: str):
        self.path, self.field = path, field

    def page(self, number: int) -> list[tuple[str, str]] | None:
        """(timestamp, JSON text) of a page's entries; None beyond the last page."""
        fs, top = store(self.path)
        entries = json_lines(fs, f"{top}/page={number}")
        return [(e[self.field], json.dumps(e, sort_keys=True, ensure_ascii=False)) for e in entries if e.get(self.field)] if entries else None

    def down(self, hint: int, position: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """Pages from the hinted one, or from the top if the hint doesn't hold."""
        at = self.page(hint) if hint > 0 else None
        number = resume_page(hint, at[0][0] if at else None, position)
        while (entries := self.page(number)) is not None:
            yield number, entries
            number += 1


@dataclass
class Interval(InputPartition):
    """Entries from ``low`` to ``high``, both included, that were on page ``page`` or soon after when the batch was planned."""

    low: str
    high: str
    page: int


class ListingStreamReader(DataSourceStreamReader):
    def __init__(self, pages: Pages, limit: int):
        self.pages, self.limit = pages, limit
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"newest": "", "oldest": "", "page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Where a batch that begins at the position known last would end; the same again until a batch moves the position."""
        at = dict(self.at or self.initialOffset())
        newest, taken = at["newest"], 0
        for _, entries in self.pages.down(0, ""):  # what came since
            fresh = [t for t, _ in entries if t > newest]
            if fresh and fresh[0] > at["newest"]:
                at["newest"] = fresh[0]
            taken += len(fresh) if newest else 0
            if not newest or len(fresh) < len(entries):
                break
        end, start = at["oldest"], at["oldest"]
        if at["newest"] and taken < self.limit:
            for number, entries in self.pages.down(at["page"], start or at["newest"]):
                for t, _ in entries:
                    if start and t >= start:
                        continue
                    if taken >= self.limit and t != end:
                        return at
                    taken += 1
                    end = at["oldest"] = t
                    at["page"] = number
        return at

    def partitions(self, start: dict, end: dict) -> list[Interval]:
        """An interval for each page that the batch takes from: newer than before, then further down."""
        self.at, out = end, []
        if start["newest"] and end["newest"] > start["newest"]:
            self._cover(out, 0, end["newest"], start["newest"], lambda t: start["newest"] < t <= end["newest"])
        if end["oldest"] != start["oldest"]:
            high = start["oldest"] or end["newest"]
            self._cover(out, start["page"], high, end["oldest"], lambda t: end["oldest"] <= t <= high and t != start["oldest"])
        return out

    def _cover(self, out: list[Interval], hint: int, high: str, low: str, inside: Callable[[str], bool]) -> None:
        for number, entries in self.pages.down(hint, high):
            held = sorted({t for t, _ in entries if inside(t)})
            if out and held and held[-1] == out[-1].low:  # a timestamp that two pages share belongs to the first
                held.pop()
            if held:
                out.append(Interval(held[0], held[-1], number))
            if entries and entries[-1][0] < low:
                return

    def read(self, partition: Interval) -> Iterator[tuple[str, str]]:
        for _, entries in self.pages.down(partition.page, partition.high):
            yield from (e for e in entries if partition.low <= e[0] <= partition.high)
            if entries and entries[-1][0] < partition.low:
                break

    def commit(self, end: dict) -> None:
        self.at = end


class ListingReader(DataSourceReader):
    """The whole listing at once."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n, _ in self.pages.down(0, "")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        yield from self.pages.page(partition.value) or []


class Listing(DataSource):
    """``spark.readStream.format("newest_first").option("field", "added_on").option("limit", 1000).load(folder)``: (added_on, entry), entry as JSON."""

    @classmethod
    def name(cls) -> str:
        return "newest_first"

    def schema(self) -> str:
        return "added_on string, entry string"

    def _pages(self) -> Pages:
        return Pages(self.options["path"], self.options.get("field", "added_on"))

    def reader(self, schema) -> ListingReader:  # noqa: ANN001
        return ListingReader(self._pages())

    def streamReader(self, schema) -> ListingStreamReader:  # noqa: ANN001, N802
        return ListingStreamReader(self._pages(), int(self.options.get("limit", "1000")))
