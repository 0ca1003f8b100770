"""Settings documents (JSON): entries of hooks by event, of which some are owned by a tool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import col

EVENTS = "map<string,array<variant>>"


def hooks(document) -> Column:
    """Entries by event of a settings document's `hooks`; none if it has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(col(document)), "$.hooks", EVENTS), F.create_map().cast(EVENTS))


def owned(entry: Column, prefix: str) -> Column:
    """Whether an entry's own command, or one of its hooks', begins with the prefix."""
    begins = lambda v: F.coalesce(F.startswith(F.try_variant_get(v, "$.command", "string"), F.lit(prefix)), F.lit(False))
    inner = F.coalesce(F.exists(F.try_variant_get(entry, "$.hooks", "array<variant>"), begins), F.lit(False))
    return begins(entry) | inner


def stripped(events: Column, prefix: str) -> Column:
    """Events without owned entries; an event that has no entry left goes."""
    return F.map_filter(F.transform_values(events, lambda _, entries: F.filter(entries, lambda e: ~owned(e, prefix))), lambda _, entries: F.size(entries) > 0)


def merged(events: Column, shipped: Column, prefix: str) -> Column:
    """Events with the shipped entries at the end of theirs, in place of owned ones; done twice it is as done once.

    Events that nothing is shipped for stay as they are."""
    named = F.array_distinct(F.concat(F.map_keys(events), F.map_keys(shipped)))
    none = F.array().cast("array<variant>")

    def entries(event: Column) -> Column:
        have, new = F.coalesce(F.try_element_at(events, event), none), F.try_element_at(shipped, event)
        return F.when(new.isNull(), have).otherwise(F.concat(F.filter(have, lambda e: ~owned(e, prefix)), new))

    return F.map_from_arrays(named, F.transform(named, entries))
