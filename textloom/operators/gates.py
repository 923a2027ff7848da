"""Row-level gates: every query builds on the views of one SecurityContext."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from least to most, and rights that count as cleared.
ROLES = ("reader", "contributor", "editor", "admin")
CLEARED = ("public_domain", "open_license", "permission_granted", "original")


def rights_cleared(status: Column, expires_on: Column, today: Column, cleared: tuple[str, ...] = CLEARED) -> Column:
    return status.isin(*cleared) & (expires_on.isNull() | (expires_on >= today))


def force_draft(editions: DataFrame, cleared: Column) -> DataFrame:
    """On load, editions without cleared rights become drafts."""
    return editions.withColumn("status", F.when(F.coalesce(cleared, F.lit(False)), F.col("status")).otherwise("draft"))


@dataclass(frozen=True)
class SecurityContext:
    """Who asks. Unknown roles count as reader; ``today`` is fixed by the caller."""

    uid: str | None = None
    role: str | None = None
    today: str | None = None

    def at_least(self, role: str) -> bool:
        mine = self.role if self.role in ROLES else "reader"
        return ROLES.index(mine) >= ROLES.index(role)

    def _today(self) -> Column:
        return F.lit(self.today).cast("date") if self.today else F.current_date()

    def public_editions(self, editions: DataFrame, works: DataFrame, rights: DataFrame) -> DataFrame:
        """Keys of editions that are published, of a published work, with cleared rights."""
        r = rights.where(rights_cleared(F.col("status"), F.col("permission_expires_on"), self._today())).select(F.col("id").alias("rights_id"))
        w = works.where("status = 'published'").select(F.col("id").alias("work_id"))
        return editions.where("status = 'published'").join(r, "rights_id", "left_semi").join(w, "work_id", "left_semi").select(F.col("id").alias("edition_id"))

    def contents(self, contents: DataFrame, public: DataFrame) -> DataFrame:
        if self.at_least("contributor"):
            return contents
        return contents.where("status = 'published'").join(public, "edition_id", "left_semi")

    def works(self, works: DataFrame) -> DataFrame:
        return works if self.at_least("editor") else works.where("status = 'published'")

    def editions(self, editions: DataFrame, public: DataFrame) -> DataFrame:
        if self.at_least("editor"):
            return editions
        return editions.join(public.select(F.col("edition_id").alias("id")), "id", "left_semi")

    def units(self, rows: DataFrame, works: DataFrame) -> DataFrame:
        """Sections or verses: own status and the work's."""
        if self.at_least("editor"):
            return rows
        return rows.where("status = 'published'").join(works.where("status = 'published'").select(F.col("id").alias("work_id")), "work_id", "left_semi")

    def tracks(self, tracks: DataFrame, public: DataFrame) -> DataFrame:
        if self.at_least("editor"):
            return tracks
        return tracks.where("status = 'published'").join(public, "edition_id", "left_semi")

    def audio_segments(self, segments: DataFrame, tracks: DataFrame, public: DataFrame) -> DataFrame:
        """Through their track, and its edition."""
        if self.at_least("editor"):
            return segments
        return segments.join(self.tracks(tracks, public).select(F.col("id").alias("track_id")), "track_id", "left_semi")

    def embeddings(self, rows: DataFrame) -> DataFrame:
        """Not for readers; a search by vector runs over all and gates what it returns."""
        return rows if self.at_least("editor") else rows.where(F.lit(False))

    def own(self, rows: DataFrame, owner: str = "user_id") -> DataFrame:
        return rows.where(F.col(owner) == F.lit(self.uid))

    def own_children(self, rows: DataFrame, parents: DataFrame, key: str, owner: str = "user_id") -> DataFrame:
        """Rows that belong to a parent row of the caller (messages of a session)."""
        return rows.join(self.own(parents, owner).select(key), key, "left_semi")

    def events(self, rows: DataFrame) -> DataFrame:
        """Written by anyone, read by admins."""
        return rows if self.at_least("admin") else rows.where(F.lit(False))

    def graph(self, rows: DataFrame) -> DataFrame:
        return rows if self.at_least("contributor") else rows.where("status = 'published'")

    def columns(self, rights: DataFrame) -> DataFrame:
        return rights if self.at_least("editor") else rights.drop("permission_document_url")

    def rejected_writes(self, changes: DataFrame) -> DataFrame:
        """Rows of a change set (status, role) that this role may not write."""
        bad = F.lit(False)
        if not self.at_least("editor"):
            bad = bad | ~F.col("status").isin("draft", "in_review")
        if not self.at_least("contributor"):
            bad = F.lit(True)
        if "role" in changes.columns and not self.at_least("admin"):
            bad = bad | F.col("role").isNotNull()
        return changes.where(F.coalesce(bad, F.lit(True)))
