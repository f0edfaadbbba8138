"""Pages with data in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists that a page may hold, in the order tried.
LISTS = ("tracks", "releases", "results")


def page_fields(pages: DataFrame) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("links"))


def embedded_items(pages: DataFrame, cap: int = 10) -> DataFrame:
    """(page_id, pos, item): the first ``cap`` entries of the first query with a list, from the JSON in a page's data script.

    item is JSON text. Pages without the script or a list have no row.
    """
    body = F.regexp_extract("html", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    queries = F.from_json(F.get_json_object(body, "$.props.pageProps.dehydratedState.queries"), "array<struct<state:struct<data:string>>>")
    each = pages.select("page_id", F.posexplode(queries).alias("nth", "q"))
    lists = [F.from_json(F.get_json_object("q.state.data", f"$.{name}"), "array<string>") for name in LISTS]
    found = each.select("page_id", "nth", F.coalesce(*lists).alias("items")).filter("items is not null")
    first = found.groupBy("page_id").agg(F.min_by("items", "nth").alias("items"))
    return first.select("page_id", F.posexplode(F.slice("items", 1, cap)).alias("pos", "item"))
