"""Metrics layer: entities, relationships, measures, dimensions and calculated metrics.

A model names its tables once; queries name metrics and dimensions. Every measure is
aggregated on its own entity at the grain of the requested dimensions before results of
different entities meet, so joins never multiply the rows a SUM sees.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import col, quote

ONE_TO_ONE, MANY_TO_ONE, ONE_TO_MANY = "One-to-One", "Many-to-One", "One-to-Many"
_REFERENCE = re.compile(r"\[([^\]]+)\]")
_DIVISOR = re.compile(r"/\s*\[([^\]]+)\]")
_TIME_WORDS = ("date", "time", "day")


@dataclass(frozen=True)
class Field:
    source: str
    display_name: str | None = None
    visible: bool = True

    @property
    def name(self) -> str:
        return (self.display_name or self.source).replace(" ", "_")


@dataclass(frozen=True)
class Entity:
    name: str
    source: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Relationship:
    from_entity: str
    from_field: str
    to_entity: str
    to_field: str
    kind: str = MANY_TO_ONE


@dataclass(frozen=True)
class Metric:
    """A measure (aggregated expression), dimension or calculated metric.

    Expressions are Spark SQL over the entity's visible fields. ``Other.field`` reaches an
    entity on the "one" side; calculated metrics refer to others as ``[Name]``.
    """

    name: str
    kind: str
    expression: str
    entity: str = ""
    aggregation: str = ""
    filter: str | None = None


AGGREGATIONS = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "COUNT": F.count,
    "COUNT DISTINCT": F.count_distinct,
}


@dataclass(frozen=True)
class Model:
    tables: dict[str, DataFrame]
    entities: tuple[Entity, ...]
    relationships: tuple[Relationship, ...] = ()
    metrics: tuple[Metric, ...] = ()
    _index: dict = field(default_factory=dict, compare=False)

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)

    def metric(self, name: str) -> Metric:
        return next(m for m in self.metrics if m.name == name)


def entity_df(model: Model, name: str, prefix: str = "") -> DataFrame:
    """Visible fields of an entity under their display names."""
    entity = model.entity(name)
    return model.tables[entity.source].select(
        *[col(f.source).alias(prefix + f.name) for f in entity.fields if f.visible]
    )


def _keyed(model: Model, name: str, extra: set[str]) -> DataFrame:
    """Entity with its fields packed in one struct plus raw join keys ``<entity>#<field>``.

    Catalyst prunes unused struct members back to the scan.
    """
    entity = model.entity(name)
    packed = F.struct(*[col(f.source).alias(f.name) for f in entity.fields if f.visible])
    keys = [col(k).alias(f"{name}#{k}") for k in sorted(extra)]
    return model.tables[entity.source].select(packed.alias(name), *keys)


def _walk(model: Model, start: str, many_to_one_only: bool) -> list[tuple[str, str, str, str, str]]:
    """Breadth-first joins from ``start``: (known, known field, new, new field, join type)."""
    seen, steps, queue = {start}, [], deque([start])
    while queue:
        here = queue.popleft()
        for r in model.relationships:
            if r.from_entity == here:
                step, many = (here, r.from_field, r.to_entity, r.to_field), r.kind == ONE_TO_MANY
            elif r.to_entity == here:
                step, many = (here, r.to_field, r.from_entity, r.from_field), r.kind == MANY_TO_ONE
            else:
                continue
            if step[2] in seen or (many and many_to_one_only):
                continue
            seen.add(step[2])
            queue.append(step[2])
            steps.append((*step, "inner" if r.kind == ONE_TO_ONE else "left"))
    return steps


def _joined(model: Model, start: str, needed: set[str] | None, many_to_one_only: bool) -> DataFrame:
    steps = _walk(model, start, many_to_one_only)
    if needed is not None:  # keep only the joins on a path to a needed entity
        keep = set(needed)
        for known, _, new, _, _ in reversed(steps):
            if new in keep:
                keep.add(known)
        steps = [s for s in steps if s[2] in keep]
        reached = {start} | {s[2] for s in steps}
        if not needed <= reached:
            raise ValueError(f"{sorted(needed - reached)} not reachable from {start} on the one side")
    keys: dict[str, set[str]] = {start: set()}
    for known, known_field, new, new_field, _ in steps:
        keys.setdefault(known, set()).add(known_field)
        keys.setdefault(new, set()).add(new_field)
    df = _keyed(model, start, keys[start])
    for known, known_field, new, new_field, how in steps:
        right = _keyed(model, new, keys[new])
        df = df.join(right, col(f"{known}#{known_field}") == col(f"{new}#{new_field}"), how)
    return df


def model_view(model: Model, start: str | None = None) -> DataFrame:
    """All entities reachable from the first one, joined along the walk.

    Fields of the base entity keep their display name; joined ones carry ``<Entity>_``.
    One-to-One relationships join inner, all others left.
    """
    base = start or model.entities[0].name
    df = _joined(model, base, None, many_to_one_only=False)
    names = [base] + [s[2] for s in _walk(model, base, False)]
    columns = []
    for name in names:
        prefix = "" if name == base else f"{name}_"
        columns += [
            F.col(name).getField(f.name).alias(prefix + f.name) for f in model.entity(name).fields if f.visible
        ]
    return df.select(*columns)


def neighbours(model: Model, name: str) -> DataFrame:
    """One entity joined with its direct neighbours only."""
    direct = tuple(r for r in model.relationships if name in (r.from_entity, r.to_entity))
    return model_view(Model(model.tables, model.entities, direct, model.metrics), name)


def _mentioned(model: Model, text: str, home: str) -> set[str]:
    return {e.name for e in model.entities if e.name != home and re.search(rf"\b{re.escape(e.name)}\.", text)}


def _measure_column(metric: Metric) -> Column:
    value = F.expr(metric.expression)
    if metric.filter:
        value = F.when(F.expr(metric.filter), value)
    return AGGREGATIONS[metric.aggregation.upper()](value).alias(metric.name)


def _fact(model: Model, home: str, needed: set[str]) -> DataFrame:
    """Fact rows with their own fields at top level and joined entities as structs."""
    df = _joined(model, home, needed, many_to_one_only=True)
    own = [F.col(home).getField(f.name).alias(f.name) for f in model.entity(home).fields if f.visible]
    return df.select(*own, *[F.col(n) for n in sorted(needed | {home})])


def measure(model: Model, name: str) -> DataFrame:
    """One-row frame with the value of a measure."""
    return query_metrics(model, [name])


def dimension(model: Model, name: str) -> DataFrame:
    """Distinct values of a dimension."""
    metric = model.metric(name)
    return entity_df(model, metric.entity).select(F.expr(metric.expression).alias(name)).distinct()


def calculated(model: Model, name: str) -> DataFrame:
    return query_metrics(model, [name])


def _resolve(model: Model, name: str, measures: dict[str, Metric], trail: tuple[str, ...] = ()) -> str:
    """Spark SQL of a metric over measure columns; collects the measures it needs."""
    if name in trail:
        raise ValueError(f"metrics refer to each other in a circle: {' > '.join((*trail, name))}")
    metric = model.metric(name)
    if metric.kind == "measure":
        measures[name] = metric
        return quote(name)
    if metric.kind != "calculated":
        raise ValueError(f"{name} is a {metric.kind}, not a value")
    inner = lambda ref: f"({_resolve(model, ref, measures, (*trail, name))})"
    text = _DIVISOR.sub(lambda m: f"/ nullif({inner(m.group(1))}, 0)", metric.expression)
    return _REFERENCE.sub(lambda m: inner(m.group(1)), text)


def query_metrics(
    model: Model,
    metrics: list[str],
    dims: list[str] | None = None,
    time_filter: str | None = None,
    as_of: date | None = None,
) -> DataFrame:
    """Metrics by dimensions, time-like dimensions first in the sort order.

    ``time_filter`` (see :func:`time_predicate`) applies to the first time-like dimension.
    """
    dims = dims or []
    measures: dict[str, Metric] = {}
    outputs = {m: _resolve(model, m, measures) for m in metrics}
    dim_metrics = [model.metric(d) for d in dims]
    time_dims = [d for d in dims if any(w in d.lower() for w in _TIME_WORDS)]

    homes: dict[str, list[Metric]] = {}
    for m in measures.values():
        homes.setdefault(m.entity, []).append(m)
    parts = []
    for home, group in homes.items():
        texts = " ".join(m.expression + " " + (m.filter or "") for m in group)
        needed = {d.entity for d in dim_metrics} | _mentioned(model, texts, home)
        df = _fact(model, home, needed - {home})
        # "@" keeps grouping keys apart from fact fields of the same name
        keys = [F.expr(f"{quote(d.entity)}.{d.expression}").alias("@" + d.name) for d in dim_metrics]
        df = df.select("*", *keys)
        if time_filter and time_dims:
            df = df.where(time_predicate(col("@" + time_dims[0]), time_filter, as_of))
        grouped = df.groupBy(*[col("@" + d).alias(d) for d in dims])
        parts.append(grouped.agg(*[_measure_column(m) for m in group]))

    result = parts[0]
    for other in parts[1:]:
        if not dims:
            extra = F.struct(*[col(c) for c in other.columns])
            packed = other.select(extra).scalar()
            result = result.select("*", *[packed.getField(c).alias(c) for c in other.columns])
            continue
        renamed = other.select(*[col(c).alias(f"#{c}") if c in dims else col(c) for c in other.columns])
        same = F.lit(True)
        for d in dims:
            same = same & col(d).eqNullSafe(col(f"#{d}"))
        joined = result.join(renamed, same, "full")
        result = joined.select(
            *[F.coalesce(col(d), col(f"#{d}")).alias(d) for d in dims],
            *[col(c) for c in joined.columns if c not in dims and not c.startswith("#")],
        )
    result = result.select(*[col(d) for d in dims], *[F.expr(text).alias(name) for name, text in outputs.items()])
    order = time_dims + [d for d in dims if d not in time_dims]
    return result.orderBy(*[col(d) for d in order]) if order else result


TIME_FILTERS = (
    "today", "yesterday", "this week", "last week", "this month", "last month", "this year", "last year",
)


def time_predicate(column: Column, name: str, as_of: date | None = None) -> Column:
    """Relative time filter on a date or timestamp column, seen from ``as_of`` (default today).

    Bounds are plain date literals, so they reach the parquet scan as pushed filters.
    """
    today = F.lit(as_of) if as_of else F.current_date()
    tomorrow = F.date_add(today, 1)
    unit = name.split()[-1]
    if name not in TIME_FILTERS:
        raise ValueError(f"unknown time filter {name!r}")
    if name == "today":
        low, high = today, tomorrow
    elif name == "yesterday":
        low, high = F.date_sub(today, 1), today
    elif name.startswith("this"):
        return column >= F.trunc(today, unit)
    else:
        back = {"week": F.date_sub(today, 7), "month": F.add_months(today, -1), "year": F.add_months(today, -12)}
        low, high = F.trunc(back[unit], unit), F.trunc(today, unit)
    return (column >= low) & (column < high)
