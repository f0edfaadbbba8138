"""A DJ library's own rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders whose names differ from their tag, and the tag for fresh imports.
FOLDERS = {"Classic/Min. Techno": "W - Classic_Min. Techno", "Hard/Dark Techno": "W - Hard_Dark Techno", "Nu-Disco": "W - Nu Disco"}
IMPORT_TAG, IMPORT_FOLDER = "soundcloud", "_IMPORT"


def style_tag(tags: Column) -> Column:
    """The first tag that names a style: neither a to-do nor an import mark."""
    return F.try_element_at(F.filter(tags, lambda t: ~F.startswith(F.upper(t), F.lit("TO_")) & (F.lower(t) != IMPORT_TAG)), F.lit(1))


def expected_folder(tags: Column) -> Column:
    """The folder that a track's tags put it in; null if they name no style."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), style_tag(tags))
    fresh = F.exists(tags, lambda t: F.lower(t) == IMPORT_TAG)
    return F.when(fresh, IMPORT_FOLDER).when(style_tag(tags).isNotNull(), F.coalesce(own, F.concat(F.lit("W - "), style_tag(tags))))


def relocation(tags: Column, folder: Column) -> Column:
    """Where a track should move; null if it stays."""
    to = expected_folder(tags)
    return F.when(to != folder, to)
