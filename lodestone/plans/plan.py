"""Query plans: verbs, the text form, validation, and execution over a graph.

A plan is data: version, operation, targets by role, options, source. It is built and checked without a graph; names are
resolved when it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import metrics, search, traverse
from lodestone.operators.build import Graph

VERSION, DEPTH, RESULTS = 1, 32, 200


class PlanError(ValueError):
    """code: empty_query, unknown_query_verb, invalid_query_format, invalid_plan or node_not_found."""

    def __init__(self, code: str, text: str, **more):
        super().__init__(text)
        self.code, self.more = code, more


@dataclass(frozen=True)
class Plan:
    operation: str
    targets: tuple[tuple[str, str], ...] = ()
    options: dict[str, int] = field(default_factory=dict)
    source: str = "query"
    plan_version: int = VERSION

    def json(self) -> dict:
        return asdict(self) | {"targets": [{"role": r, "input": t} for r, t in self.targets]}


@dataclass(frozen=True)
class Verb:
    name: str
    roles: tuple[str, ...]
    limits: dict[str, int]
    run: Callable[[Graph, dict[str, str], dict[str, int]], DataFrame]
    aliases: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()


def _neighbours(out: bool, relations: tuple[str, ...] = ()):
    def run(g, ids, options):
        return traverse.listed(traverse.neighbours(g, ids["node"], out, relations), options["max_results"])

    return run


def _path(relations: tuple[str, ...] = ()):
    def run(g, ids, options):
        found, cut = traverse.path(g, ids["source"], ids["target"], options["max_depth"], relations)
        return g.nodes.sparkSession.createDataFrame([(found is not None, found or [], cut)], "found boolean, path array<string>, truncated boolean")

    return run


def _stats(g, ids, options):
    """what: nodes and edges, kind, relation, in and out (the five nodes of most edges), communities where there are any."""
    rows = [metrics.kinds(g).select(F.lit("kind").alias("what"), F.col("kind").alias("name"), "n"), metrics.relations(g).select(F.lit("relation"), "relation", "n")]
    rows += [df.agg(F.lit(what).alias("what"), F.lit(None).cast("string").alias("name"), F.count("*").alias("n")) for what, df in (("nodes", g.nodes), ("edges", g.edges))]
    rows += [metrics.busiest(g, side).select(F.lit(side), "id", f"{side}_degree") for side in ("in", "out")]
    if "community" in g.nodes.columns:
        rows.append(g.nodes.agg(F.lit("communities"), F.lit(None).cast("string"), F.countDistinct("community")))
    return reduce(DataFrame.union, rows)


VERBS: dict[str, Verb] = {}


def register(verb: Verb) -> None:
    """Extensions add verbs here."""
    VERBS[verb.name] = verb


for _verb in (
    Verb("callers", ("node",), {"max_results": RESULTS}, _neighbours(False, traverse.CALLS), ("called-by",), ("calls",)),
    Verb("calls", ("node",), {"max_results": RESULTS}, _neighbours(True, traverse.CALLS), ("callees",), ("calls",)),
    Verb("depends-on", ("node",), {"max_results": RESULTS}, _neighbours(True), ("out",), ("imports",)),
    Verb("imported-by", ("node",), {"max_results": RESULTS}, _neighbours(False), ("in",), ("imports",)),
    Verb("path", ("source", "target"), {"max_depth": DEPTH}, _path()),
    Verb("reaches", ("source", "target"), {"max_depth": DEPTH}, _path(traverse.CALLS), (), ("calls",)),
    Verb("community-of", ("node",), {}, lambda g, ids, o: g.nodes.where(F.col("id") == ids["node"]).select("id", "community")),
    Verb("stats", (), {}, _stats),
):
    register(_verb)


def _named(word: str) -> Verb | None:
    return VERBS.get(word) or next((v for v in VERBS.values() if word in v.aliases), None)


def build(text: str) -> Plan:
    """A plan from its text: a verb and its targets, two of them with -> between."""
    parts = text.lower().split()
    if not parts:
        raise PlanError("empty_query", "empty query")
    verb = _named(parts[0])
    if verb is None:
        raise PlanError("unknown_query_verb", f"unknown verb: {parts[0]}", verbs=sorted(VERBS))
    rest = " ".join(parts[1:])
    given = [x.strip() for x in rest.split("->")] if len(verb.roles) == 2 else [rest] if rest else []
    if len(given) != len(verb.roles) or not all(given):
        raise PlanError("invalid_query_format", f"{verb.name} takes {' -> '.join(verb.roles) or 'nothing'}")
    return Plan(verb.name, tuple(zip(verb.roles, given, strict=True)), dict(verb.limits))


def check(plan: Plan) -> None:
    """Raises PlanError where a plan, from wherever it came, can't run."""
    verb = VERBS.get(plan.operation)
    wrong = None
    if plan.plan_version != VERSION:
        wrong = "version"
    elif verb is None:
        wrong = "operation"
    elif tuple(r for r, _ in plan.targets) != verb.roles or not all(t.strip() for _, t in plan.targets):
        wrong = "targets"
    elif set(plan.options) - set(verb.limits) or any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in plan.options.values()):
        wrong = "options"
    if wrong:
        raise PlanError("invalid_plan", f"invalid plan: {wrong}")


def _resolved(plan: Plan, graph: Graph) -> list[dict]:
    """How each target of a plan is understood; node is None, and candidates are named, where nothing fits."""
    check(plan)
    how = []
    for role, token in plan.targets:
        hits = search.resolve(graph.nodes, token).orderBy("place").collect()
        near = [] if hits or not search.words(search.clean(token)) else [r.id for r in search.candidates(graph.nodes, token).collect()]
        first = hits[0] if hits else None
        how.append({"role": role, "input": token, "node": first and first.id, "type": first and first.match_type, "alternates": [h.id for h in hits[1:]], "candidates": near})
    return how


def preview(plan: Plan, graph: Graph) -> dict:
    """The plan, how its targets are understood, and whether it can run; nothing is run."""
    how = _resolved(plan, graph)
    return {"plan": plan.json(), "targets": how, "limits": VERBS[plan.operation].limits | plan.options, "executable": all(h["node"] for h in how)}


def execute(plan: Plan, graph: Graph) -> tuple[DataFrame, list[dict]]:
    """The rows, and how each target was resolved."""
    how = _resolved(plan, graph)
    for h in how:
        if h["node"] is None:
            raise PlanError("node_not_found", f"{h['role']} not found: {h['input']}", candidates=h["candidates"])
    verb = VERBS[plan.operation]
    return verb.run(graph, {h["role"]: h["node"] for h in how}, verb.limits | plan.options), how


def query(text: str, graph: Graph) -> DataFrame:
    return execute(build(text), graph)[0]


def capabilities() -> list[dict]:
    return [{"operation": v.name, "aliases": list(v.aliases), "roles": list(v.roles), "limits": v.limits, "relations": list(v.relations)} for v in VERBS.values()]
