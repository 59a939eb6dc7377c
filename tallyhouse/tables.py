"""The set of inventory tables that every operator takes as its input."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame

from tallyhouse.schemas import DDL


class Tables:
    """Holds one DataFrame per inventory table, read when first asked for.

    ``Tables(loader)`` asks ``loader(name)`` for a table; ``Tables.of(part=df)``
    holds ready DataFrames. ``marks`` are the highest numbers given out in tables of which they
    are known without reading the rows, ``standing`` gives the movement sums of the ledger where
    they are kept, ``months`` the months to which line tables are cut whose rows carry their ``month``.
    """

    def __init__(
        self,
        loader: Callable[[str], DataFrame],
        marks: Mapping[str, int] | None = None,
        standing: Callable[[], DataFrame] | None = None,
        months: Mapping[str, Collection[str]] | None = None,
    ):
        self._loader = loader
        self.marks = dict(marks or {})
        self.standing = standing
        self.months = dict(months or {})

    @classmethod
    def of(cls, **frames: DataFrame) -> Tables:
        return cls(frames.__getitem__)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DDL:
            raise AttributeError(f"no inventory table named {name!r}")
        frame = self._loader(name)
        setattr(self, name, frame)
        return frame

    def replace(self, **frames: DataFrame) -> Tables:
        """A copy in which the named tables are exchanged."""
        return Tables(lambda name: frames[name] if name in frames else getattr(self, name))
