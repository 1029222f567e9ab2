"""Metadata predicates, what a corpus declares, and why a search came back empty."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LISTED = 12


@dataclass(frozen=True)
class Filters:
    type: str | None = None
    module: str | None = None
    tags: tuple[str, ...] = ()
    excluded_statuses: tuple[str, ...] = ()

    @classmethod
    def of(cls, type: str | None = None, module: str | None = None, tags: Iterable[str] = (), excluded_statuses: Iterable[str] = (), include_excluded: bool = False) -> Filters:
        """Blank values are no filter; tags are compared in lower case."""
        text = lambda v: v.strip() or None if v else None
        return cls(text(type), text(module), tuple(t.strip().lower() for t in tags or () if t.strip()), () if include_excluded else tuple(excluded_statuses))

    def predicate(self) -> Column:
        """All filters together, over type, module, status and tags; a missing status passes the deny-list."""
        clauses = [F.lit(True)]
        if self.type is not None:
            clauses.append(F.col("type") == self.type)
        if self.module is not None:
            clauses.append(F.col("module") == self.module)
        if self.excluded_statuses:
            clauses.append(F.col("status").isNull() | ~F.col("status").isin(*self.excluded_statuses))
        if self.tags:
            clauses.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))), F.lit(False)))
        return reduce(and_, clauses)

    def any(self) -> bool:
        return self.type is not None or self.module is not None or bool(self.tags)


def facets(documents: DataFrame) -> DataFrame:
    """One row with the sorted distinct types, modules, tags (lower case) and statuses."""
    tags = documents.select(F.explode("tags").alias("tag")).agg(F.sort_array(F.collect_set(F.lower("tag"))).alias("tags"))
    rest = documents.agg(*[F.sort_array(F.collect_set(c)).alias(n) for c, n in (("type", "types"), ("module", "modules"), ("status", "statuses"))])
    return rest.crossJoin(tags).select("types", "modules", "tags", "statuses")  # one row each


@dataclass(frozen=True)
class Facets:
    types: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()

    @classmethod
    def of(cls, documents: DataFrame) -> Facets:
        row = facets(documents).first()
        return cls(*(tuple(row[c]) for c in ("types", "modules", "tags", "statuses")))

    @classmethod
    def of_counts(cls, counts: DataFrame) -> Facets:
        """From counts (field, value, n) kept beside the documents, as many rows as there are values."""
        found: dict[str, list[str]] = {}
        for r in counts.where(F.col("field").isin("type", "module", "tag", "status")).orderBy("value").collect():
            found.setdefault(r["field"], []).append(r["value"])
        return cls(*(tuple(found.get(f, ())) for f in ("type", "module", "tag", "status")))


def without_impossible(filters: Filters, known: Facets) -> tuple[Filters, list[str]]:
    """Filters without those on fields that no document declares, and the names of these."""
    dropped = [n for n, have in (("type", known.types), ("module", known.modules), ("tags", known.tags)) if getattr(filters, n) and not have]
    return replace(filters, **{n: () if n == "tags" else None for n in dropped}), dropped


def listed(values: Iterable[str]) -> str:
    values = list(values)
    shown = ", ".join(f'"{v}"' for v in values[:MAX_LISTED])
    return f"{shown} and {len(values) - MAX_LISTED} more" if len(values) > MAX_LISTED else shown


@dataclass(frozen=True)
class Reason:
    """One cause of an empty or widened result: the field, what is wrong with it, what was asked for and what there is."""

    field: str
    kind: str  # a key of TEXTS
    asked: tuple[str, ...] = ()
    declared: tuple[str, ...] = ()

    def __str__(self) -> str:
        return TEXTS[self.kind].format(field=self.field, asked=listed(self.asked), declared=listed(self.declared))


TEXTS = {
    "undeclared": "{field}: the corpus has no values for this field, drop the filter",
    "unknown": "{field}: {asked} is not in use; in use are {declared}",
    "denied": "{field}: hidden by the settings are {asked}; include_excluded shows them",
    "combined": "each filter has matches, but no document passes all of them; drop some",
    "ignored": "{field}: filter left out, since the corpus has no values for this field (convention.frontmatterFields says which key holds it)",
}


def reasons(filters: Filters, known: Facets) -> list[Reason]:
    """What in the filters alone keeps every document out, field by field."""
    asked = {"type": ((filters.type,) if filters.type is not None else (), known.types), "module": ((filters.module,) if filters.module is not None else (), known.modules), "tags": (filters.tags, known.tags)}
    found = []
    for name, (values, declared) in asked.items():
        if values and not {v.lower() if name == "tags" else v for v in values} & set(declared):
            found.append(Reason(name, "unknown" if declared else "undeclared", tuple(values), declared))
    hidden = tuple(s for s in filters.excluded_statuses if s in known.statuses)
    found += [Reason("status", "denied", hidden)] if hidden else []
    return found or ([Reason("", "combined")] if filters.any() else [])


def dropped_notice(dropped: list[str]) -> str:
    return "; ".join(str(Reason(name, "ignored")) for name in dropped)


def explain_empty(filters: Filters, known: Facets) -> str | None:
    """Why nothing matched, as far as the filters tell."""
    return "; ".join(map(str, reasons(filters, known))) or None


def explained(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, n, why) of a batch of requests (request_id, type, module; null asks for nothing): how many documents pass,
    and where none does, which values no document has, or that the values do not come together."""
    pairs = documents.groupBy("type", "module").agg(F.count("*").alias("n"))  # as many rows as there are pairs of values
    asked = requests.select("request_id", F.col("type").alias("_type"), F.col("module").alias("_module"))
    # values meet by equality; a request that leaves one open meets the sums over it
    sums = pairs.cube("type", "module").agg(F.grouping_id().alias("_level"), F.sum("n").alias("n"))
    # documents without a value count in the sums only
    sums = sums.where(~(F.col("_level").isin(0, 1) & F.col("type").isNull()) & ~(F.col("_level").isin(0, 2) & F.col("module").isNull()))

    def matched(name: str, level: Column, type_: Column, module: Column) -> DataFrame:
        found = sums.select(F.col("_level").alias("_at"), F.col("type").alias("_t"), F.col("module").alias("_m"), F.col("n").alias(name))
        return asked.join(found, (F.col("_at") == level) & F.col("_t").eqNullSafe(type_) & F.col("_m").eqNullSafe(module)).select("request_id", name)

    none, t, m = F.lit(None).cast("string"), F.col("_type"), F.col("_module")
    level = F.when(t.isNull(), 2).otherwise(0) + F.when(m.isNull(), 1).otherwise(0)
    out = asked.join(matched("n", level, t, m), "request_id", "left").join(matched("of_type", F.lit(1), t, none), "request_id", "left").join(matched("of_module", F.lit(2), none, m), "request_id", "left")
    unknown = F.array_compact(F.array(F.when(t.isNotNull() & F.col("of_type").isNull(), "type"), F.when(m.isNotNull() & F.col("of_module").isNull(), "module")))
    why = F.when(F.col("n") > 0, "").when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))).otherwise("combined")
    return out.select("request_id", F.coalesce("n", F.lit(0)).alias("n"), why.alias("why"))
