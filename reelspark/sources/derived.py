"""Tables that follow others bucket by bucket: what a bucket's rows come to is kept, and made anew only where they changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from .store import Snapshot, Transaction


class Derived:
    """A table in parts, one for each bucket of the ``base`` tables (bucketed alike), made by make(rows of each base table, with
    their bucket in ``part``) -> rows with ``part``. Each part notes the base folders, and the versions of
    their columns, that it was made from, so refresh() reads the buckets only that have changed since."""

    def __init__(self, name: str, base: list[str], make: Callable[..., DataFrame], **options):
        self.name, self.base, self.make, self.options = name, base, make, options

    def stale(self, t: Snapshot) -> dict[int, str]:
        """{bucket: its source now} of the buckets that have changed since their parts were made."""
        buckets = sorted({b for x in self.base for b in t.parts(x)} | set(t.parts(self.name)))
        known = t.tables.get(self.name, {}).get("of", {})
        now = {b: " ".join(f"{t.newest(x)}:{t.tables.get(x, {}).get('files', {}).get(str(b), '')}" for x in self.base) for b in buckets}
        return {b: x for b, x in now.items() if known.get(str(b)) != x}

    def refresh(self, t: Transaction) -> list[int]:
        """Make the parts of changed buckets anew; which."""
        stale = self.stale(t)
        if stale:
            rows = [t.read(x, buckets=list(stale)).withColumn("part", t.bucket(x)) for x in self.base]
            t.put_parts(self.name, self.make(*rows), stale, **self.options)
        return sorted(stale)

    def read(self, t: Snapshot, where: Column | None = None) -> DataFrame:
        """All parts; an error if some are stale, as what they say doesn't hold any more."""
        if self.stale(t):
            raise LookupError(f"{self.name} must be refreshed first")
        rows = t.read(self.name)
        return rows if where is None else rows.where(where)


def refreshed(t: Transaction, *tables: Derived) -> dict[str, list[int]]:
    return {x.name: x.refresh(t) for x in tables}
