"""Unit conversion at table scale: equivalences as edges, their closure per graph, and an equi-join of measures to it.

A table of mappings holds many graphs (one for each ingredient, say), told apart by `graph_id`. Each graph is small; its edges are
gathered in a row, and a task reads graphs in batches, so nothing depends on how many there are. Measures meet their graph by one join on
graph_id.

Defined results: mappings without both sides, and null graph_ids, make no edge. Of several mappings of a pair of units the one with
the highest `seq` holds, of equal ones the one that sorts last. A measure that no path leads from gives null. Of paths with equally few steps the first in order of units is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.kernel import convert as K
from larder.kernel.measures import Measure, rational, unit_of
from larder.runtime import spread

CLOSURE = "graph_id string, from_unit string, to_unit string, factor double, upper_factor double, steps array<struct<from_unit:string,to_unit:string,factor:double>>"
EDGES = 100_000  # mappings to a partition
GRAPHS = 256  # graphs whose rows a worker holds at once
_STEPS = pa.list_(pa.struct([("from_unit", pa.string()), ("to_unit", pa.string()), ("factor", pa.float64())]))
_SCHEMA = pa.schema([("graph_id", pa.string()), ("from_unit", pa.string()), ("to_unit", pa.string()), ("factor", pa.float64()), ("upper_factor", pa.float64()), ("steps", _STEPS)])


def _measure(d: dict) -> Measure:
    return unit_of(d["unit"]), rational(d["value"]), None if d.get("upper_value") is None else rational(d["upper_value"])


def _graph(edges: list[dict]) -> K.Graph:
    return K.make_graph([(_measure(r["a"]), _measure(r["b"])) for r in edges])


def _in_slices(batches: Iterator[pa.RecordBatch], rows_of: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows_of(graph_id, graph) of batches of (graph_id, edges), a few graphs at a time: a graph's rows are many times its edges."""
    for batch in batches:
        for at in range(0, batch.num_rows, GRAPHS):
            part = batch.slice(at, GRAPHS)
            made = [r for name, edges in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows_of(name, _graph(edges))]
            yield pa.RecordBatch.from_pylist(made, schema)


def _per_graph(mappings: DataFrame, rows_of, schema: pa.Schema, sql: str) -> DataFrame:
    """rows_of(graph_id, graph) of each graph, in as many partitions as the counted mappings need, which _converted() keeps to."""
    parts = math.ceil(mappings.count() / EDGES)
    rows = spread(_edges(mappings), "graph_id", parts=parts).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("seq", "a", "b"))).alias("edges"))
    made = rows.mapInArrow(lambda batches: _in_slices(batches, rows_of, schema), sql)
    made._larder_parts = parts
    return made


def _edges(mappings: DataFrame) -> DataFrame:
    side = lambda c: F.struct(*(F.col(c)[k].alias(k) for k in ("unit", "value", "upper_value"))).alias(c)
    rows = mappings.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("seq").cast("bigint").alias("seq"), side("a"), side("b"))
    return rows.where("graph_id is not null and a.unit is not null and a.value is not null and b.unit is not null and b.value is not null")


def goal_unit(target: str, unit: bool = False) -> str:
    """The unit that a kind, or with `unit` a unit's spelling, is converted to."""
    return K.normal_unit(K.base_unit(K.target_kind(target) if unit else target))


def closure(mappings: DataFrame, goals: list[str] | None = None) -> DataFrame:
    """CLOSURE of every graph of (graph_id, seq, a, b): factors between all units that a path joins, with the steps.

    With `goals` (units, as goal_unit gives them) only the ways to these, and for each unit a row without a goal.
    """

    def row(name, a, b, low, high, steps):
        return {"graph_id": name, "from_unit": a, "to_unit": b, "factor": low, "upper_factor": high, "steps": None if steps is None else [dict(zip(("from_unit", "to_unit", "factor"), s)) for s in steps]}

    def rows_of(name, g):
        if goals is None:
            return [row(name, *w) for w in K.closure(g)]
        return [row(name, u, None, None, None, None) for u in g] + [row(name, a, goal, *w) for goal in goals for a, *w in K.ways(g, goal)]

    return _per_graph(mappings, rows_of, _SCHEMA, CLOSURE)


_WAY = "struct<factor:double,upper_factor:double,steps:array<struct<from_unit:string,to_unit:string,factor:double>>>"


def _converted(measures: DataFrame, closed: DataFrame, goals: dict[str, str], measure: str, each) -> DataFrame:
    """The measures, each joined once to its graph's units and ways to all goals, with the columns that `each` makes of the results by name."""
    units = list(dict.fromkeys(goals.values()))
    way = F.when(F.col("to_unit").isin(*units), F.struct("factor", "upper_factor", "steps").cast(_WAY))  # other ways aren't shuffled
    ways = closed.select(F.col("graph_id").alias("__g"), "from_unit", "to_unit", way.alias("__way"))
    ways = spread(ways, "__g", parts=getattr(closed, "_larder_parts", 0))
    held = [F.map_from_entries(F.collect_list(F.when(F.col("to_unit") == u, F.struct("from_unit", "__way")))).alias(f"__w{i}") for i, u in enumerate(units)]
    graphs = ways.groupBy("__g").agg(F.collect_set("from_unit").alias("__known"), *held)
    m = N.normalize_measure(measure)
    rows = measures.withColumn("__m", F.struct(*(m[k].alias(k) for k in ("unit", "value", "upper_value"))))
    rows = rows.join(graphs, F.col("graph_id").cast("string") == F.col("__g"), "left")
    tiny = F.element_at(F.create_map(*[F.lit(x) for kv in K.TINY.items() for x in kv]), F.col("__m.unit"))
    rows = rows.withColumn("__small", F.when(~F.coalesce(F.array_contains("__known", F.col("__m.unit")), F.lit(False)), tiny))
    small = F.coalesce("__small", F.lit(1.0))
    step = "array<struct<from_unit:string,to_unit:string,factor:double>>"
    first = F.when(F.col("__small").isNotNull(), F.array(F.struct(F.col("__m.unit"), F.lit("tsp"), F.col("__small"))).cast(step)).otherwise(F.array().cast(step))
    rows = rows.select("*", F.when(F.col("__small").isNotNull(), "tsp").otherwise(F.col("__m.unit")).alias("__unit"), (F.col("__m.value") * small).alias("__low"), (F.col("__m.upper_value") * small).alias("__high"), first.alias("__first"))
    rows = rows.withColumns({f"__way{i}": F.try_element_at(f"__w{i}", F.col("__unit")) for i in range(len(units))})
    out = {}
    for name, goal in goals.items():
        found = F.col(f"__way{units.index(goal)}")
        here = F.col("__unit") == goal
        low = N.round_sig(F.when(here, F.col("__low")).otherwise(F.col("__low") * found["factor"]))
        high = N.round_sig(F.when(here, F.col("__high")).otherwise(F.coalesce("__high", "__low") * found["upper_factor"]))
        made = F.struct(F.lit(goal).alias("unit"), low.alias("value"), F.when(high > low, high).alias("upper_value"))
        reached = here | found["factor"].isNotNull()
        out[name] = F.when(reached, N.denormalize_measure(made)), F.when(reached, F.when(here, F.col("__first")).otherwise(F.concat("__first", found["steps"])))
    return rows.select(*measures.columns, *each(out))


def convert(measures: DataFrame, closed: DataFrame, kind: str, measure: str = "measure", unit: bool = False) -> DataFrame:
    """The measures with `converted` (in the kind's friendly unit) and `steps`; both null where the graph has no way.

    `measures` has `graph_id` and a struct<unit, value, upper_value>. Pinches and dashes are teaspoons where the graph doesn't know them.
    With `unit` the target is a unit's spelling instead of a kind.
    """
    return _converted(measures, closed, {"x": goal_unit(kind, unit)}, measure, lambda out: [out["x"][0].alias("converted"), out["x"][1].alias("steps")])


def convert_to_nutrients(measures: DataFrame, closed: DataFrame, nutrients: list[str], measure: str = "measure") -> DataFrame:
    """The measures with `nutrients`: a map from each target ("g protein") to its amount, null where the graph has no way."""
    goals = {n: goal_unit(f"nutrient:{n}") for n in nutrients}
    return _converted(measures, closed, goals, measure, lambda out: [F.create_map(*[x for n in nutrients for x in (F.lit(n), out[n][0])]).alias("nutrients")])


def convert_to_all(measures: DataFrame, closed: DataFrame, kinds: list[str], measure: str = "measure") -> DataFrame:
    """One row for each measure and kind, `kind` naming it; the closure is read and joined once for all kinds."""
    goals = {k: goal_unit(k) for k in kinds}

    def each(out):
        return [F.explode(F.array(*[F.struct(out[k][0].alias("converted"), out[k][1].alias("steps"), F.lit(k).alias("kind")) for k in kinds])).alias("__one")]

    return _converted(measures, closed, goals, measure, each).select(*measures.columns, "__one.converted", "__one.steps", "__one.kind")


def islands(mappings: DataFrame) -> DataFrame:
    """(graph_id, units) of each connected part with more than one unit."""
    schema = pa.schema([("graph_id", pa.string()), ("units", pa.list_(pa.string()))])
    return _per_graph(mappings, lambda name, g: [{"graph_id": name, "units": u} for u in K.islands(g)], schema, "graph_id string, units array<string>")


def dot(mappings: DataFrame) -> DataFrame:
    """(graph_id, dot): each graph as DOT text."""
    schema = pa.schema([("graph_id", pa.string()), ("dot", pa.string())])
    return _per_graph(mappings, lambda name, g: [{"graph_id": name, "dot": K.dot(g)}], schema, "graph_id string, dot string")
