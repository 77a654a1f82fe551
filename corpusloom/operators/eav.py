"""Entity, attribute, value rows to one typed row per entity.

Readings of the values are built-in expressions; equal facts collapse on the map side, so an entity that holds
a third of all rows sends no more than its distinct facts. Entities are then hashed into buckets (one task each),
where entity and attribute are dictionary-encoded and the values scattered into one numpy array per type by row
and column index; each chunk leaves as an Arrow table.

Cases: a null entity is a group of its own; null, empty and unreadable values are no fact; a null or unknown
name is no column, nor is a value that can't be read as declared: with others=True both come out in other_names, else
nowhere; an entity with no usable fact and nothing in other_names has no row; repeated rows count once; if usable
values of one cell differ, the smallest is taken for a single-valued section and all, sorted, for a multi-valued
string section; names are compared in their plain form; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.names import plain_name
from corpusloom.functions.typed import as_boolean, as_double, as_epoch_seconds, as_long

#: The registry is the schema of the result, so it has to fit a driver.
MAX_SECTIONS = 4096
#: Entities in one Arrow table.
CHUNK = 20_000
OTHERS = "other_names"

_SPARK = {"int": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def section_registry(sections: DataFrame, valtypes: list[str] | None = None) -> list[tuple[str, str, bool]]:
    """(plain name, valtype, single) of the declared sections, by name; a name declared twice keeps its lowest secno."""
    rows = sections.select(plain_name(F.col("sname")).alias("n"), F.lower("valtype").alias("t"), (F.coalesce(F.col("single"), F.lit(0)) == 1).alias("s"), F.col("secno").alias("k"))
    got = rows.filter("n is not null and t is not null").limit(MAX_SECTIONS + 1).collect()
    if len(got) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections are declared")
    first: dict[str, tuple[str, str, bool]] = {}
    for r in sorted(got, key=lambda r: (r.n, r.k is None, r.k or 0, r.t)):
        first.setdefault(r.n, (r.n, r.t if r.t in _SPARK else "string", r.s))
    return [x for x in first.values() if not valtypes or x[1] in valtypes]


def _scatter(columns: list[tuple[str, str, bool]], schema: pa.Schema, entity: str, others: bool):
    """The function for mapInArrow: rows sorted by entity in, wide tables out."""
    slots = {code: i for i, code in enumerate(c for c, x in enumerate(columns) if x[1] in ("int", "timestamp", "boolean"))}
    reals = {code: i for i, code in enumerate(c for c, x in enumerate(columns) if x[1] == "double")}
    table = lambda d: np.array([d.get(c, -1) for c in range(len(columns) + 1)])  # noqa: E731; the last code is of other names
    slot_of, real_of = table(slots), table(reals)

    def ordered(group: np.ndarray, texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """Groups and texts in order of group and text."""
        t = pa.table({"g": pa.array(group, pa.int64()), "t": texts})
        t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("t", "ascending")]))
        return np.asarray(t.column("g")), t.column("t").combine_chunks()

    def wide(batch: pa.Table) -> pa.RecordBatch:
        keys = batch.column("e").combine_chunks().dictionary_encode()
        row = np.asarray(keys.indices.fill_null(len(keys.dictionary)))
        entities = pa.concat_arrays([keys.dictionary, pa.nulls(int(keys.null_count > 0), keys.dictionary.type)])
        n, code = len(entities), np.asarray(batch.column("code"))
        whole, has = np.zeros((n, max(1, len(slots))), np.int64), np.zeros((n, max(1, len(slots))), bool)
        real, real_has = np.zeros((n, max(1, len(reals)))), np.zeros((n, max(1, len(reals))), bool)
        at = slot_of[code]
        m = at >= 0
        whole[row[m], at[m]], has[row[m], at[m]] = np.asarray(batch.column("v_long").fill_null(0))[m], True
        at = real_of[code]
        m = at >= 0
        real[row[m], at[m]], real_has[row[m], at[m]] = np.asarray(batch.column("v_double").fill_null(0.0))[m], True
        out = [entities]
        texts = batch.column("v_text") if "v_text" in batch.column_names else None
        for c, (_, kind, single) in enumerate(columns):
            field = schema.field(c + 1)
            if c in slots:
                v, h = whole[:, slots[c]], has[:, slots[c]]
                a = pa.array(v.astype(bool) if kind == "boolean" else v * 1_000_000 if kind == "timestamp" else v, mask=~h)
                out.append(a.cast(field.type))
            elif c in reals:
                out.append(pa.array(real[:, reals[c]], mask=~real_has[:, reals[c]]))
            else:
                mine = np.flatnonzero(code == c)
                at, values = ordered(row[mine], texts.take(pa.array(mine)))
                first = np.searchsorted(at, np.arange(n + 1))
                none = first[1:] == first[:-1]
                if single:  # the smallest
                    out.append(values.take(pa.array(first[:-1], mask=none)).cast(field.type))
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values, mask=pa.array(none)).cast(field.type))
        if others:
            mine = np.flatnonzero(code == len(columns))
            at = pa.array(mine)
            names = batch.column("v_name").take(at).combine_chunks().dictionary_encode()
            rank = pc.rank(names.dictionary, sort_keys="ascending").to_numpy() if len(names.dictionary) else np.zeros(0, int)
            key = np.append(rank, rank.max(initial=0) + 1)[np.asarray(names.indices.fill_null(len(names.dictionary)))].astype(np.int64)  # null names last
            width = int(key.max(initial=0)) + 1
            pair, values = ordered(row[mine] * width + key, texts.take(at))
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
            inner = pa.ListArray.from_arrays(pa.array(np.r_[start, len(pair)].astype(np.int32)), values)
            back = np.full(width + 1, len(names.dictionary))
            back[rank.astype(int)] = np.arange(len(rank))
            which = back[(pair[start] % width).astype(int)]
            shown = names.dictionary.take(pa.array(which, mask=which == len(names.dictionary)))
            kind = schema.field(OTHERS).type
            entry = pa.StructArray.from_arrays([shown.cast(pa.string()), inner.cast(kind.value_type.field(1).type)], fields=[kind.value_type.field(0), kind.value_type.field(1)])
            bounds = np.searchsorted(pair[start] // width, np.arange(n + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(bounds), entry, mask=pa.array(bounds[1:] == bounds[:-1])).cast(kind))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = whole = 0  # rows held, and those of them before the last entity begins
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode()
            index = np.asarray(keys.indices.fill_null(-1))
            goes_on = bool(held) and held[-1].column(0)[-1].as_py() == b.column(0)[0].as_py()
            turn = np.flatnonzero(np.r_[not goes_on, index[1:] != index[:-1]])
            if len(turn):
                whole = size + int(turn[-1])
            held.append(b)
            size += b.num_rows
            if whole >= CHUNK:
                t = pa.Table.from_batches(held)
                yield wide(t.slice(0, whole))
                held, size, whole = t.slice(whole).to_batches(), size - whole, 0
        if held:
            yield wide(pa.Table.from_batches(held))

    return run


def widen(facts: DataFrame, sections: DataFrame, entity: str = "url_id", name: str = "sname", value: str = "sval", valtypes: list[str] | None = None, others: bool = False) -> DataFrame:
    """One row per entity that has a usable value, with one typed column per declared section of the valtypes (all if None).

    int is bigint, timestamp is a timestamp, a string section is a string if it is single, else array<string>.
    others: with a column other_names, (name, values) for each name that is not declared or null, and for the values that can't be read as their section's type.
    """
    columns = section_registry(sections, valtypes)
    kinds = {kind: [c for c, x in enumerate(columns) if x[1] == kind] for kind in (*_SPARK, "string")}
    fields = [T.StructField(n, _SPARK.get(k) or (T.StringType() if s else T.ArrayType(T.StringType())), True) for n, k, s in columns]
    kind_of_entity = facts.schema[entity].dataType
    if others:
        fields.append(T.StructField(OTHERS, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]))))
    schema = T.StructType([T.StructField(entity, kind_of_entity, True), *fields])
    if not columns and not others:
        return facts.sparkSession.createDataFrame([], schema)
    codes = F.create_map(*[x for c, (n, _, _) in enumerate(columns) for x in (F.lit(n), F.lit(c))] or [F.lit(""), F.lit(None).cast("int")])
    code, text = F.col("code"), F.col("v")
    rows = facts.select(F.col(entity).alias("e"), codes[plain_name(F.col(name))].alias("code"), plain_name(F.col(name)).alias("name"), F.col(value).alias("v")).filter("v is not null")
    if not others:
        rows = rows.filter("code is not null")
    whole = F.when(code.isin(kinds["int"] or [-1]), as_long(text)).when(code.isin(kinds["timestamp"] or [-1]), as_epoch_seconds(text)).when(code.isin(kinds["boolean"] or [-1]), as_boolean(text).cast("bigint"))
    real = F.when(code.isin(kinds["double"] or [-1]), as_double(text))
    parts = ["e", "code"]
    picks = [F.min("v_long").alias("v_long"), F.min("v_double").alias("v_double")]
    typed = rows.select("e", "code", "name", "v", whole.alias("v_long"), real.alias("v_double"), F.when(code.isin(kinds["string"] or [-1]) & (F.trim(text) != ""), text).alias("v_text"))
    usable = "v_long is not null or v_double is not null or v_text is not null"
    if others:
        parts += ["v_text", "v_name"]
        left = F.col("code").isNull() | ~F.expr(usable)
        typed = typed.select("e", F.when(left, F.lit(len(columns))).otherwise(F.col("code")).alias("code"), "v_long", "v_double", F.when(left, F.col("v")).otherwise(F.col("v_text")).alias("v_text"), F.when(left, F.col("name")).alias("v_name"))
    elif kinds["string"]:
        parts.append("v_text")
    else:
        typed, usable = typed.drop("v_text"), "v_long is not null or v_double is not null"
    cells = typed.filter(usable).groupBy(*parts).agg(*picks)
    spread = cells.repartition("e").sortWithinPartitions("e")
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])
    return spread.mapInArrow(_scatter(columns, arrow, entity, others), schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def melt(wide: DataFrame, entity: str = "url_id") -> DataFrame:
    """The wide table's scalar cells as (entity, sname, val string) rows: int in digits, double with three decimals, timestamp in UTC."""
    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            from corpusloom.functions.typed import utc_text

            return utc_text(F.unix_seconds(c))
        if isinstance(f.dataType, T.DoubleType):
            return F.round(c, 3).cast("decimal(30,3)").cast("string")
        return c.cast("string")

    cells = F.array(*[F.struct(F.lit(f.name).alias("sname"), shown(f).alias("val")) for f in wide.schema if f.name != entity and not isinstance(f.dataType, T.ArrayType)])
    return wide.select(F.col(entity), F.explode(cells).alias("c")).select(entity, "c.sname", "c.val").filter("val is not null")
