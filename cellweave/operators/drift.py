"""Schemas that drift between deliveries: find each change and read everything into one table.

Records are parsed once, in the JVM, into maps of typed values. Per delivery and column only a
bounded summary is kept: the kinds seen and, over the barcodes that both neighbouring
deliveries hold, a count and hash sums of (barcode, value), so that two columns with equal
sums have equal values for every barcode. Per dataset (columns only, no records) schema
graphs of neighbouring deliveries are matched by similarity flooding. The flooding proposes which
column became which, best first; a proposal whose values are equal is a rename.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import bounded, cut

#: Flooding stops when no score moves by more than this.
SETTLED = 1e-4
#: Columns of the unified table; further ones, the rarest, are kept together in a map.
MOST_COLUMNS = 2_000
#: Most deliveries whose lists of columns are broadcast.
MOST_DELIVERIES = 100_000

_CHANGES = "dataset_name string, delivery_no int, change string, column_name string, old_name string"
_LINEAGE = "dataset_name string, delivery_no int, name string, unified string, kind string"
_KINDS = ("boolean", "integer", "number", "string")
_BLANK = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def listed_columns(report: DataFrame) -> DataFrame:
    """(dataset_name, delivery_no, name): the columns of each dataset at each delivery, trimmed, once each.

    Both lists together; null and empty lists and empty names add nothing; repeated rows count once.
    """
    both = F.concat_ws(",", "common_columns", "unique_columns")
    rows = report.where("dataset_name is not null and delivery_no is not null").select("dataset_name", "delivery_no", F.explode(F.split(both, ",")).alias("name"))
    return rows.select("dataset_name", "delivery_no", F.regexp_replace("name", _BLANK, "").alias("name")).where("name != ''").distinct()


def records(raw: DataFrame) -> DataFrame:
    """(dataset_name, delivery_no, barcode, in_before, in_after, payload), one row per record.

    Of records with the same barcode in a delivery the one with the greatest ``record_no`` counts
    (repeats are equal). A record without barcode stands for itself. ``in_before`` and
    ``in_after`` say whether the barcode is in the neighbouring deliveries too. Barcodes are
    spread over tasks, datasets are not, and payloads are shuffled once.
    """
    rows = raw.where("_source_file is not null and delivery_no is not null").select(F.col("_source_file").alias("dataset_name"), "delivery_no", "record_no", "payload", F.get_json_object("payload", "$.barcode").alias("barcode"))
    keyless = rows.where("barcode is null").select("dataset_name", "delivery_no", "barcode", F.lit(False).alias("in_before"), F.lit(False).alias("in_after"), "payload")
    keyed = rows.where("barcode is not null").repartition("dataset_name", "barcode").groupBy("dataset_name", "barcode", "delivery_no").agg(F.max(F.struct("record_no", "payload")).alias("r"))
    order = Window.partitionBy("dataset_name", "barcode").orderBy("delivery_no")
    keyed = keyed.select(
        "dataset_name", "delivery_no", "barcode",
        F.coalesce(F.lag("delivery_no").over(order) == F.col("delivery_no") - 1, F.lit(False)).alias("in_before"),
        F.coalesce(F.lead("delivery_no").over(order) == F.col("delivery_no") + 1, F.lit(False)).alias("in_after"),
        F.col("r.payload").alias("payload"),
    )
    return keyed.unionByName(keyless)


def _firsts(entries, name: str) -> F.Column:
    """Of the structs of an array that are equal in one field the first."""
    names = F.transform(entries, lambda e: e[name])
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x[name]), e[name]) == i + 1)
    return F.when(F.size(F.array_distinct(names)) < F.size(names), firsts).otherwise(entries)


def fields() -> F.Column:
    """Array of (name, value) of a ``payload``: names trimmed, of equal names the first, empty ones left out.

    A payload that is not a JSON object has none. Values are kept as written, with their type.
    """
    entries = F.transform(F.map_entries(F.from_json("payload", "map<string,variant>")), lambda e: F.struct(F.regexp_replace(e["key"], _BLANK, "").alias("name"), e["value"].alias("value")))
    return F.filter(_firsts(entries, "name"), lambda e: e["name"] != "")


def kind_of(value) -> F.Column:
    """boolean, integer, number (written with a fraction or exponent) or string (objects and lists too); null for null."""
    t = F.schema_of_variant(value)
    whole = (t == "BIGINT") | t.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")  # integers beyond 64 bits
    return F.when(whole, "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(t == "BOOLEAN", "boolean").when(t != "VOID", "string")


def text_of(value, kind) -> F.Column:
    """One text for equal values: 5 and 5.0 are equal, objects have their keys in order."""
    number = F.try_variant_get(value, "$", "double")
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind.isNull(), F.lit(None)).when(kind == "number", F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))).otherwise(F.coalesce(plain, F.to_json(value)))


def parsed(raw: DataFrame) -> DataFrame:
    """(dataset_name, delivery_no, barcode, in_before, in_after, name, kind, value): one row per record and non-null value."""
    rows = records(raw).withColumn("e", F.explode(fields())).drop("payload")
    rows = rows.select("*", F.col("e.name").alias("name"), kind_of(F.col("e.value")).alias("kind")).where("kind is not null")
    return rows.withColumn("value", text_of(F.col("e.value"), F.col("kind"))).drop("e")


def column_summaries(values: DataFrame) -> DataFrame:
    """Per dataset, delivery and column: kinds seen, and count and hash sums towards both neighbours; summed before the shuffle."""
    add = [F.max((F.col("kind") == k).cast("int")).alias(k) for k in _KINDS]
    for side in ("before", "after"):
        inside = F.col("in_" + side)
        add.append(F.count_if(inside).alias(f"n_{side}"))
        for seed in (1, 2):
            code = F.xxhash64("barcode", F.when(F.col("kind").isin("integer", "number"), F.lit("n")).otherwise(F.substring("kind", 1, 1)), "value", F.lit(seed))
            for part, bits in (("a", code.bitwiseAND(0xFFFFFFFF)), ("b", F.shiftrightunsigned(code, 32))):
                add.append(F.coalesce(F.sum(F.when(inside, bits)), F.lit(0)).alias(f"h{seed}{part}_{side}"))
    return values.groupBy("dataset_name", "delivery_no", "name").agg(*add)


def _tokens(name: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)] or [name]


def _paths(name: str) -> list[str]:
    steps = name.split(".")
    return [".".join(steps[:i]) for i in range(1, len(steps))]


class _Shared:
    """Nodes that both schema graphs have (types, name parts or nesting paths), and which column pairs touch each of them."""

    def __init__(self, left: list[list[str]], right: list[list[str]]):
        both = sorted({x for xs in left for x in xs} & {x for xs in right for x in xs})
        at = {x: i for i, x in enumerate(both)}
        self.a, self.b = (np.zeros((len(side), len(both))) for side in (left, right))
        for matrix, side in ((self.a, left), (self.b, right)):
            for i, xs in enumerate(side):
                matrix[i, [at[x] for x in xs if x in at]] = 1
        self.per_pair = self.a @ self.b.T  # shared nodes of each pair of columns
        self.per_node = self.a.sum(0) * self.b.sum(0)  # pairs of columns at each shared node
        self.score = np.ones(len(both))

    def exchange(self, pairs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the column pairs get from the nodes, what the nodes get from the pairs): each gives in equal shares."""
        given = (self.a * (nodes / np.maximum(self.per_node, 1))) @ self.b.T
        shares = pairs / np.maximum(self.per_pair, 1)
        return given, np.einsum("in,ij,jn->n", self.a, shares, self.b, optimize=True)


def flood(left: dict[str, str | None], right: dict[str, str | None]) -> dict[tuple[str, str], float]:
    """Match scores of the columns of two schemas (name -> type) by similarity flooding.

    A schema graph has the schema, its columns, their types, name parts and nesting paths as
    nodes. Pairs of nodes of both graphs that equally labelled edges join form the propagation
    graph: two columns pass similarity to and from the pair of schemas and the types, parts and paths that they
    share. Scores start from the likeness of names, flow along the edges in shares, are scaled to 1 and go
    round until they have settled. Every pair of columns gets a score.
    """
    a, b = list(left), list(right)
    if not a or not b:
        return {}
    parts = [[_tokens(n) for n in side] for side in (a, b)]
    first = np.array([[1.0 if x == y else len(set(p) & set(q)) / len(set(p) | set(q)) for y, q in zip(b, parts[1])] for x, p in zip(a, parts[0])])
    kinds = _Shared([[left[n] or "none"] for n in a], [[right[n] or "none"] for n in b])
    shared = [kinds, _Shared(*parts), _Shared([_paths(n) for n in a], [_paths(n) for n in b])]
    score, schema = first.copy(), 1.0
    moved = 1.0
    while moved >= SETTLED:
        base, top = first + score, 1.0 + schema
        new, new_top = base + top / base.size, top + base.sum()
        nodes = []
        for s in shared:
            given, got = s.exchange(base, 1.0 + s.score)
            new = new + given
            nodes.append(1.0 + s.score + got)
        most = max(new.max(), new_top, *(n.max(initial=0.0) for n in nodes))
        moved = max(np.abs(new / most - score).max(), abs(new_top / most - schema))
        score, schema = new / most, new_top / most
        for s, n in zip(shared, nodes):
            s.score = n / most
    return {(x, y): float(score[i, j]) for i, x in enumerate(a) for j, y in enumerate(b)}


_SUMS = ("n", "h1a", "h1b", "h2a", "h2b")


def _renames(before: dict[str, dict], now: dict[str, dict], gone: list[str], new: list[str]) -> dict[str, str]:
    """New name -> old name: proposals of the flooding, best first, whose values are equal; each column once."""
    score = flood({n: x["kind"] for n, x in before.items()}, {n: x["kind"] for n, x in now.items()})
    lost, fresh = set(gone), set(new)
    renamed: dict[str, str] = {}
    for g, c in sorted((p for p in score if p[0] in lost and p[1] in fresh), key=lambda p: (-score[p], p)):
        if g in lost and c in fresh and all(before[g]["row"][f"{k}_after"] == now[c]["row"][f"{k}_before"] for k in _SUMS):
            renamed[c] = g
            lost.remove(g)
            fresh.remove(c)
    return renamed


def _kind(row: dict) -> str | None:
    """One type for the values of a delivery; null without any."""
    kinds = {k for k in _KINDS if row[k]}
    return None if not kinds else kinds.pop() if len(kinds) == 1 else "number" if kinds == {"integer", "number"} else "string"


def _dataset_changes(rows: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """Changes of one dataset, and its columns as (dataset, delivery, name, name in the unified table, type)."""
    changes, lineage = [], []
    before: dict[str, dict] = {}
    last = None
    deliveries: dict[int, list[dict]] = {}
    for r in rows:
        deliveries.setdefault(r["delivery_no"], []).append(r)
    for n in sorted(deliveries):
        dataset = deliveries[n][0]["dataset_name"]
        now = {r["name"]: {"kind": _kind(r), "row": r, "root": r["name"]} for r in sorted(deliveries[n], key=lambda r: r["name"])}
        follows = last is not None and n == last + 1
        renamed: dict[str, str] = {}
        if follows:
            gone, new = sorted(set(before) - set(now)), sorted(set(now) - set(before))
            if gone and new:
                renamed = _renames(before, now, gone, new)
            changes += [(dataset, n, "renamed", c, g) for c, g in renamed.items()]
            changes += [(dataset, n, "removed", g, "") for g in gone if g not in renamed.values()]
            changes += [(dataset, n, "added", c, "") for c in new if c not in renamed]
        formers = {name: before.get(renamed.get(name, name)) for name in now}
        taken = {f["root"] for f in formers.values() if f}
        for name, x in now.items():
            former = formers[name]
            if former:
                x["root"] = former["root"]
                if x["kind"] is None:
                    x["kind"] = former["kind"]
                if follows and name not in renamed and former["kind"] and x["kind"] != former["kind"]:
                    changes.append((dataset, n, "retyped", name, ""))
            elif name in taken:  # the name lives on under another one
                x["root"] = f"{name}_from_{n}"
            lineage.append((dataset, n, name, x["root"], x["kind"]))
        before, last = now, n
    return changes, lineage


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(c.split() for c in schema.split(", "))})


def _columns(raw: DataFrame, report: DataFrame) -> DataFrame:
    """Summaries of the listed columns, zeros where a delivery has no value of one."""
    return listed_columns(report).join(column_summaries(parsed(raw)), ["dataset_name", "delivery_no", "name"], "left").fillna(0)


def schema_changes(raw: DataFrame, report: DataFrame) -> DataFrame:
    """(dataset_name, delivery_no, change, column_name, old_name): each change from delivery n-1 to n.

    A column gone and a column new are one ``renamed`` if the flooding proposes them, which it does with
    every such pair, best first, and their values are equal for all barcodes of both deliveries (left out
    and null are equal, so two columns without any value are equal too); each column takes part
    once. A type over no values stays the former one. A delivery without its direct predecessor
    shows no changes.
    """

    def changes(table: pa.Table) -> pa.Table:
        return _table(_dataset_changes(table.to_pylist())[0], _CHANGES)

    return _columns(raw, report).groupBy("dataset_name").applyInArrow(changes, _CHANGES)


def column_lineage(raw: DataFrame, report: DataFrame) -> DataFrame:
    """(dataset_name, delivery_no, name, unified, kind): the unified column that each listed column feeds.

    A renamed column keeps the name under which it first came; a new column that takes such a name
    while the renamed one is there gets ``_from_<delivery>`` appended.
    """

    def lineage(table: pa.Table) -> pa.Table:
        return _table(_dataset_changes(table.to_pylist())[1], _LINEAGE)

    return _columns(raw, report).groupBy("dataset_name").applyInArrow(lineage, _LINEAGE)


def unified_table(raw: DataFrame, report: DataFrame) -> DataFrame:
    """All records in one table: dataset_name, delivery_no, barcode and the unified columns, cast to one type each.

    Every record stays: those without barcode, without any value, and those of deliveries that the
    report does not list. A column that the report does not list keeps its own name, with
    ``_unlisted`` appended where a listed one feeds that name. A column with several types over
    datasets and deliveries becomes the narrowest that holds all (integer and number give
    double, else string). Columns whose names differ in case only get a number appended, as do names that
    the key columns take. Beyond ``MOST_COLUMNS`` columns those of the fewest deliveries stand
    together in a map ``other_columns``. The unified names, as the schema, reach the driver.
    """
    summaries = column_summaries(parsed(raw)).select("dataset_name", "delivery_no", "name", *_KINDS)
    summaries = cut(summaries)
    lineage = cut(column_lineage(raw, report).where("name != 'barcode'"))
    by_delivery = lineage.groupBy("dataset_name", "delivery_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "unified"))).alias("roots"))
    by_delivery = F.broadcast(by_delivery) if bounded(lineage.select("dataset_name", "delivery_no").distinct(), MOST_DELIVERIES) else by_delivery
    roots = F.coalesce(F.col("roots"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    def unified(name):
        return F.coalesce(F.try_element_at(roots, name), F.when(F.array_contains(F.map_values(roots), name), F.concat(name, F.lit("_unlisted"))).otherwise(name))

    keys = ["dataset_name", "delivery_no"]
    kinds = summaries.where("name != 'barcode'").join(by_delivery, keys, "left").withColumn("unified", unified(F.col("name")))
    kinds = kinds.groupBy("unified").agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in _KINDS])
    empty = lineage.select("unified").distinct().join(kinds, "unified", "left_anti")
    chosen = kinds.unionByName(empty, allowMissingColumns=True).fillna(0).orderBy(F.desc("n"), "unified").collect()
    shown, rest = sorted(chosen[:MOST_COLUMNS], key=lambda r: r["unified"]), [r["unified"] for r in chosen[MOST_COLUMNS:]]
    rows = records(raw).withColumn("fields", fields()).join(by_delivery, keys, "left")
    named = F.filter(F.col("fields"), lambda e: e["name"] != "barcode")
    values = F.map_from_entries(_firsts(F.transform(named, lambda e: F.struct(unified(e["name"]).alias("k"), text_of(e["value"], kind_of(e["value"])).alias("v"))), "k"))
    rows = rows.select("dataset_name", "delivery_no", "barcode", F.coalesce(values, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("m"))
    taken = {"dataset_name", "delivery_no", "barcode", "other_columns"}
    columns = []
    for r in shown:
        seen = {k for k in _KINDS if r[k]}
        kind = "boolean" if seen == {"boolean"} else "bigint" if seen == {"integer"} else "double" if seen and seen <= {"integer", "number"} else "string"
        name, k = r["unified"], 2
        while name.lower() in taken:
            name, k = f"{r['unified']}_{k}", k + 1
        taken.add(name.lower())
        columns.append(F.try_element_at("m", F.lit(r["unified"])).try_cast(kind).alias(name))
    if rest:
        columns.append(F.map_filter("m", lambda k, _: ~k.isin([r["unified"] for r in shown])).alias("other_columns"))
    return rows.select("dataset_name", "delivery_no", "barcode", *columns)
