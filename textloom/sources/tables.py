"""Scans as the table API gives them: projection, filter, order, cap, and rows of related tables embedded by foreign key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.documents import nested, with_children
from textloom.operators.library import Visible

#: Rows of one call at most (fixed value).
MOST = 1000
#: (table, its column) to the table whose id it holds.
FOREIGN_KEYS = {
    ("sections", "work_id"): "works", ("sections", "parent_id"): "sections", ("verses", "work_id"): "works", ("verses", "section_id"): "sections",
    ("editions", "work_id"): "works", ("editions", "rights_id"): "rights", ("editions", "source_id"): "sources", ("rights", "source_id"): "sources",
    ("contents", "verse_id"): "verses", ("contents", "edition_id"): "editions", ("tracks", "section_id"): "sections", ("tracks", "edition_id"): "editions",
    ("segments", "track_id"): "tracks", ("segments", "verse_id"): "verses", ("mentions", "verse_id"): "verses", ("xrefs", "from_verse_id"): "verses", ("xrefs", "to_verse_id"): "verses",
}


@dataclass(frozen=True)
class Embed:
    """Columns of a related table. ``inner`` drops the rows that have no related one; ``by`` names the foreign key where
    there are several between two tables."""

    table: str
    columns: Sequence[str]
    inner: bool = False
    by: str | None = None


def _link(table: str, embed: Embed) -> tuple[str, bool]:
    """The foreign key of an embedding, and whether it is the scanned table's own (one row) or the other's (many)."""
    own = [c for (t, c), to in FOREIGN_KEYS.items() if t == table and to == embed.table and embed.by in (None, c)]
    theirs = [c for (t, c), to in FOREIGN_KEYS.items() if t == embed.table and to == table and embed.by in (None, c)]
    if len(own) + len(theirs) != 1:
        raise LookupError(f"{len(own) + len(theirs)} foreign keys link {table} and {embed.table}")
    return (own or theirs)[0], bool(own)


def scan(lib: Visible, table: str, columns: Sequence[str], embeds: Sequence[Embed] = (), where: Column | None = None, order: Sequence[Column] = (), limit: int = MOST, offset: int = 0) -> DataFrame:
    """Rows of a visible table. A row that the scanned table refers to becomes a struct (null if there is none), rows that
    refer to it an array of structs; both are named after their table. Embedded rows are as visible as rows are. The filter
    and the columns reach the scan; ``order`` may use embedded fields. At most MOST rows."""
    if not isinstance(lib, Visible):
        raise TypeError("scan takes library.visible_to(context)")
    rows = getattr(lib, table)
    rows = rows if where is None else rows.where(where)
    links = [(e, *_link(table, e)) for e in embeds]
    needed = dict.fromkeys([*columns, *(c for _, c, own in links if own), *(["id"] if not all(own for *_, own in links) else [])])
    rows = rows.select(*rows.columns) if order else rows.select(*needed)
    for e, key, own in links:
        other = getattr(lib, e.table)
        if own:
            one = other.select(F.col("id").alias(key), F.struct(*e.columns).alias(e.table))
            rows = rows.join(one, key, "inner" if e.inner else "left")
        else:
            many = nested(other.withColumnRenamed(key, "_id"), ["_id"], list(e.columns), list(e.columns), e.table).withColumnRenamed("_id", "id")
            rows = rows.join(many, "id") if e.inner else with_children(rows, many, ["id"], e.table)
    rows = rows.orderBy(*order) if order else rows
    return rows.offset(max(0, offset)).limit(max(0, min(limit, MOST))).select(*columns, *[e.table for e in embeds])
