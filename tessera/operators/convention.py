"""Metadata of documents from their frontmatter: resolved loosely, or validated strictly with all errors at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


@dataclass(frozen=True)
class Convention:
    mode: str = "loose"
    types: tuple[str, ...] | None = None
    statuses: tuple[str, ...] | None = None
    excluded_statuses: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=lambda: {"type": "type", "module": "module", "status": "status"})


TAGS_ERROR = "tags: not a list of texts"


def normalized_tags(tags: Column) -> Column:
    """Trimmed, lower case, none empty; order and repeats stay."""
    return F.coalesce(F.filter(F.transform(tags, lambda t: F.lower(X.trim(t))), lambda t: t != ""), F.array().cast("array<string>"))


def _one_of(name: str, value: Column, key: str, allowed: tuple[str, ...] | None) -> Column:
    missing = F.when(value.isNull(), F.lit(f"{key}: no value"))
    if allowed is None:
        return missing
    wrong = F.concat(F.lit(f"{name}: "), value, F.lit(f" is none of {', '.join(allowed)}"))
    return missing.when(~value.isin(*allowed) if allowed else F.lit(True), wrong)


def resolved(parsed: DataFrame, convention: Convention, roots: tuple[str, ...] = ()) -> DataFrame:
    """Adds title, summary, type, module, status, owner, updated, tags and errors (empty: accepted).

    parsed: path, title, summary, tags (array or null), tags_ok (boolean) and fields, the map of frontmatter texts.
    """
    read = lambda key: X.present(F.col("fields")[key])
    kind, module, status = (read(convention.fields[n]) for n in ("type", "module", "status"))
    title = X.present(F.col("title"))
    errors = [F.when(~F.col("tags_ok"), F.lit(TAGS_ERROR))]
    if convention.mode == "strict":
        errors = [
            _one_of("type", kind, convention.fields["type"], convention.types),
            _one_of("module", module, convention.fields["module"], None),
            _one_of("status", status, convention.fields["status"], convention.statuses),
            F.when(title.isNull(), F.lit("title: no heading of the first level")),
            *errors,
        ]
    else:
        title = F.coalesce(title, X.humanized(F.col("path")))
        module = F.coalesce(module, X.module_of(F.col("path"), roots))
    new = {
        "title": title, "summary": X.trim(F.coalesce("summary", F.lit(""))), "type": kind, "module": module, "status": status,
        "owner": read("owner"), "updated": read("updated"), "tags": normalized_tags(F.col("tags")), "errors": F.array_compact(F.array(*errors)),
    }
    return parsed.select(*[F.col(c) for c in parsed.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def index_order(convention: Convention) -> list[Column]:
    """Order of index lines: declared types first (unknown ones before all), then the path as people sort it."""
    path = F.collate(F.col("path"), "UNICODE")
    if convention.mode == "strict" and convention.types:
        return [F.coalesce(F.array_position(F.array(*map(F.lit, convention.types)), F.col("type")), F.lit(0)), path]
    return [path]
