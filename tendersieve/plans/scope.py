"""The one scope filter that every analysis starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tendersieve.functions.scalars import fold


@dataclass(frozen=True)
class TenderFilter:
    """Which tenders are meant; unset fields don't filter. Column names are those of ``domain.tenders``."""

    since: str | None = None
    until: str | None = None  # the whole day counts
    regions: tuple[str, ...] = ()
    provinces: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    not_kinds: tuple[str, ...] = ()  # unknown kinds stay
    tags: tuple[str, ...] = ()  # any of them
    least: float | None = None
    most: float | None = None
    text: str | None = None  # folded, in the body's name
    prefixes: tuple[str, ...] = ()  # of the id
    body_words: tuple[str, ...] = ()  # all of them
    codes: tuple[str, ...] = ()  # prefixes of the column ``code``
    body_types: tuple[str, ...] = ()  # column ``body_type``
    days_left: tuple[int, int] | None = None  # least and most days from ``today`` to the column ``deadline``
    today: str | None = None
    unique: bool = False  # no tenders that another one stands for (column ``canonical``, null or the own id for those that stay)

    def is_empty(self) -> bool:
        return self == TenderFilter()

    def column(self) -> Column:
        c, parts = F.col, []
        for name, values in (("region", self.regions), ("province", self.provinces), ("status", self.statuses), ("kind", self.kinds)):
            if values:
                parts.append(c(name).isin(*values))
        if self.since:
            parts.append(c("published") >= F.lit(self.since).cast("timestamp"))
        if self.until:
            parts.append(c("published") < F.date_add(F.lit(self.until).cast("date"), 1))
        if self.not_kinds:
            parts.append(c("kind").isNull() | ~c("kind").isin(*self.not_kinds))
        if self.tags:
            parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags])))
        if self.least is not None:
            parts.append(c("amount") >= self.least)
        if self.most is not None:
            parts.append(c("amount") <= self.most)
        if self.text:
            parts.append(F.contains(fold(c("body")), fold(F.lit(self.text))))
        if self.prefixes:
            parts.append(reduce(lambda a, b: a | b, [c("id").cast("string").startswith(p) for p in self.prefixes]))
        if self.codes:
            parts.append(reduce(lambda a, b: a | b, [F.startswith(c("code"), F.lit(p)) for p in self.codes]))
        if self.body_types:
            parts.append(c("body_type").isin(*self.body_types))
        if self.days_left:
            parts.append(F.datediff(c("deadline"), F.lit(self.today).cast("date")).between(*self.days_left))
        if self.unique:
            parts.append(c("canonical").isNull() | (c("canonical") == c("id")))
        parts += [F.contains(fold(c("body")), fold(F.lit(w))) for w in self.body_words]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, tenders: DataFrame) -> DataFrame:
        return tenders if self.is_empty() else tenders.where(self.column())
