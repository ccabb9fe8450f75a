"""Column functions on URLs and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(url: Column) -> Column:
    """conference, search or paper, by the first of the telling path parts; case matters."""
    return (
        F.when(url.contains("/events/") | url.contains("/volumes/"), "conference")
        .when(url.contains("/search/"), "search")
        .when(url.isNotNull(), "paper")
    )


def last_segment(url: Column) -> Column:
    """The last part between slashes that is not empty, with any query or fragment; null if there is none."""
    parts = F.filter(F.split(url, "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def base_url(url: Column) -> Column:
    """What stands before the first #."""
    return F.get(F.split(url, "#", 2), F.lit(0))


def fragment(url: Column) -> Column:
    """What stands after the first #: empty after a bare #, null without one."""
    return F.get(F.split(url, "#", 2), F.lit(1))


def href_to_id(href: Column) -> Column:
    """Last path part without its last extension."""
    return F.regexp_replace(F.regexp_extract(href, "([^/]*)$", 1), r"\.[^.]*$", "")


def search_href_to_id(href: Column) -> Column:
    """Last path part, outer slashes ignored, without the ending .pdf."""
    bare = F.regexp_replace(href, "^/+|/+$", "")
    return F.regexp_replace(F.regexp_extract(bare, "([^/]*)$", 1), r"\.pdf$", "")


def search_url(base: str, query: Column) -> Column:
    """Address of a search; spaces become +, nothing else is encoded."""
    return F.concat(F.lit(f"{base}/search/?q="), F.replace(query, F.lit(" "), F.lit("+")))


def paper_url(base: str, source_id: Column) -> Column:
    return F.concat_ws("/", F.lit(base), source_id)


def pdf_path(folder: Column, source_id: Column) -> Column:
    return F.concat(folder, F.lit("/"), source_id, F.lit(".pdf"))


def mask_credentials(uri: Column, mask: str = "***") -> Column:
    """A URI with user and password masked; one without credentials is unchanged."""
    return F.regexp_replace(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:[^/?#@]*)@", f"$1{mask}:{mask}@")


def store_uri(host: Column, port: Column, name: Column, user: Column, password: Column) -> Column:
    """Connection URI; the credentials take part only if both are there."""
    both = (F.length(user) > 0) & (F.length(password) > 0)
    auth = F.when(both, F.concat(user, F.lit(":"), password, F.lit("@"))).otherwise(F.lit(""))
    return F.concat(F.lit("mongodb://"), auth, host, F.lit(":"), port.cast("string"), F.lit("/"), name)
