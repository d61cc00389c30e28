"""Nested records into flat, linked tables by columnar shredding.

Every leaf path of a record becomes a column of (repetition level, definition level, value) triples, as columnar file
formats store nested data: the repetition level says at which repeated ancestor a triple starts a new instance (0 = a
new record), the definition level how much of its path is present. A table for a repeated ancestor is then rebuilt
from the level sequences alone - instance boundaries are the triples whose repetition level doesn't exceed the
ancestor's, presence is a definition level that reaches it, and positions are counted inside the parent instance.

Two shredders feed the same assembly: one reads the levels of typed columns straight from Arrow offsets and validity
(no Python object per row), one walks JSON text whose shape drifts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """A repeated group of the target schema; ``member`` is the field of its parent, ``fields`` its leaves."""

    child: str
    member: str
    fields: tuple[str, ...]
    groups: tuple["Group", ...] = ()
    #: at most one instance, which may also come as a plain string
    single: bool = False


#: fixed values: field names of the response schema
PART_FIELDS = (
    "item_name", "description", "sku", "part_number", "manufacturer_part_number", "quantity", "unit", "unit_price",
    "list_price", "discount", "tax_percentage", "tax_amount", "total_amount",
)
PAYMENT_FIELDS = ("method", "reference", "card_type", "card_last4", "bank_bsb", "bank_account", "receipt_number")
DELIVERY_FIELDS = ("date", "delivery_date", "tracking_number", "carrier", "shipping_method")
ADDRESS_FIELDS = ("street", "city", "state", "postal_code", "country", "full_address")
RECORD_FIELDS = (
    "metadata", "supplier", "buyer", "transaction", "parts", "totals", "payment_details", "delivery_details", "notes",
    "raw_text", "invoice_number", "document_type",
)

RESPONSE_GROUPS = (
    Group("part", "parts", PART_FIELDS, (Group("component", "components", PART_FIELDS),)),
    Group("payment", "payment_details", PAYMENT_FIELDS),
    Group("delivery", "delivery_details", DELIVERY_FIELDS, (Group("address", "address", ADDRESS_FIELDS, (), True),)),
)

TEXT_VALUE = "value"
_BLANKS = re.compile(r"^[\s﻿]+|[\s﻿]+$")


def canonical(key: str) -> str:
    """``itemName``, ``item_name`` and ``ITEM-NAME`` are one key."""
    return re.sub(r"[^a-z0-9]", "", key.lower())


# ---------------------------------------------------------------------------------------------------------------
# JSON text


def parse_json(text: str | None):
    """The value of one complete JSON text, else ``None``; blanks and a byte order mark around it don't matter."""
    if not text:
        return None
    try:
        return json.loads(_BLANKS.sub("", text), parse_int=str, parse_float=str, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def _no_constant(name: str):
    raise ValueError(name)


def decoded(value):
    """A string that holds a JSON object or array counts as what it encodes."""
    for _ in range(8):
        if not isinstance(value, str):
            return value
        bare = _BLANKS.sub("", value)
        if bare[:1] not in ("{", "[", '"'):
            return value
        inner = parse_json(bare)
        if inner is None:
            return value
        value = inner
    return value


def is_empty(value) -> bool:
    """Nothing but nulls, blank strings and empty objects or arrays, at any depth."""
    stack = [value]
    while stack:
        v = stack.pop()
        if v is None:
            continue
        if isinstance(v, str):
            v = decoded(v)
            if isinstance(v, str):
                if _BLANKS.sub("", v):
                    return False
                continue
        if isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
        elif v is not None:
            return False
    return True


class Shape:
    """Looks up the members of a group in objects whose keys drift."""

    def __init__(self, group: Group):
        self.group = group
        self.known = {canonical(f): f for f in group.fields} | {canonical(g.member): g.member for g in group.groups}
        self.groups = {g.member: Shape(g) for g in group.groups}

    def instances(self, value) -> Iterator[object]:
        """The group's objects in text order, whatever arrays, wrappers, index keys or string encodings hold them."""
        stack = [value]
        while stack:
            v = decoded(stack.pop())
            if isinstance(v, list):
                stack.extend(reversed(v))
            elif isinstance(v, dict):
                if any(canonical(k) in self.known for k in v):
                    if not is_empty(v):
                        yield v
                elif (inner := [x for x in (decoded(x) for x in v.values()) if isinstance(x, dict | list)]):
                    stack.extend(reversed(inner))
                elif not is_empty(v):
                    yield v
            elif self.group.single and isinstance(v, str) and not is_empty(v):
                yield v


_RECORD = {canonical(f) for f in RECORD_FIELDS}
#: fixed values: members under which a client keeps copies of other records
COPY_KEYS = {"previous", "prior", "history", "original", "old", "before", "copy", "copies"}


def records(payload) -> Iterator[dict]:
    """The records in a parsed payload: through envelopes and string encodings, never through kept copies."""
    stack = [payload]
    while stack:
        v = decoded(stack.pop())
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            if any(canonical(k) in _RECORD for k in v):
                yield v
            else:
                stack.extend(reversed([x for k, x in v.items() if canonical(k) not in COPY_KEYS]))


# ---------------------------------------------------------------------------------------------------------------
# Level columns


class Column:
    """Triples of one leaf path."""

    def __init__(self, group: Group, ancestors: tuple[Group, ...], field: str):
        self.group, self.ancestors, self.field = group, ancestors, field
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.val: list[str | None] = []


class JsonShredder:
    """Shreds parsed payloads into level columns. Levels: a depth-k group repeats at level k and is defined at k."""

    def __init__(self, groups: tuple[Group, ...] = RESPONSE_GROUPS, values: bool = True):
        self.shapes = [Shape(g) for g in groups]
        self.values = values
        self.columns: dict[tuple[str, str], Column] = {}
        for g in groups:
            self._declare(g, ())

    def _declare(self, g: Group, ancestors: tuple[Group, ...]) -> None:
        for f in (*g.fields, TEXT_VALUE) if self.values else (TEXT_VALUE,):
            self.columns[g.child, f] = Column(g, ancestors, f)
        for sub in g.groups:
            self._declare(sub, (*ancestors, g))

    def add(self, payload) -> None:
        """One record; a payload without a record still takes its place in every column."""
        found = list(records(payload)) if payload is not None else []
        for shape in self.shapes:
            want = canonical(shape.group.member)
            self._group(shape, [v for r in found for k, v in r.items() if canonical(k) == want], 0, 1)

    def _group(self, shape: Shape, values: list, rep: int, depth: int) -> None:
        g, n = shape.group, 0
        for v in values:
            for obj in shape.instances(v):
                if g.single and n:
                    break
                at = rep if n == 0 else depth
                n += 1
                self._leaves(shape, obj, at, depth)
                fields = {canonical(k): x for k, x in obj.items()} if isinstance(obj, dict) else {}
                for sub in shape.groups.values():
                    have = canonical(sub.group.member)
                    self._group(sub, [fields[have]] if have in fields else [], at, depth + 1)
        if n == 0:
            self._absent(g, rep, depth - 1)

    def _leaves(self, shape: Shape, obj, rep: int, depth: int) -> None:
        g = shape.group
        if not self.values:
            self._put(g.child, TEXT_VALUE, rep, depth, None)
            return
        given = {canonical(k): v for k, v in obj.items()} if isinstance(obj, dict) else {}
        for f in g.fields:
            v = given.get(canonical(f))
            text = v if isinstance(v, str) else None if v is None else json.dumps(v)
            self._put(g.child, f, rep, depth + (text is not None), text)
        plain = obj if isinstance(obj, str) else None
        self._put(g.child, TEXT_VALUE, rep, depth + (plain is not None), plain)

    def _absent(self, g: Group, rep: int, dfn: int) -> None:
        for f in (*g.fields, TEXT_VALUE) if self.values else (TEXT_VALUE,):
            self._put(g.child, f, rep, dfn, None)
        for sub in g.groups:
            self._absent(sub, rep, dfn)

    def _put(self, child: str, field: str, rep: int, dfn: int, value: str | None) -> None:
        c = self.columns[child, field]
        c.rep.append(rep)
        c.dfn.append(dfn)
        c.val.append(value)


def assemble(rep: np.ndarray, dfn: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the levels of a leaf of a group at ``depth`` (1 or 2): record, parent position, position, and where it stood.

    ``parent position`` is -1 at depth 1. Positions count the present instances inside the parent instance.
    """
    starts = rep <= depth
    at = np.flatnonzero(starts)
    r, d = rep[at], dfn[at]
    record = np.cumsum(r == 0) - 1
    present = d >= depth
    if depth == 1:
        inside, parent = record, np.full(len(at), -1)
    else:
        has_parent = d >= depth - 1
        opens = (r < depth) & has_parent
        inside = np.cumsum(r < depth) - 1
        opened = np.cumsum(opens)
        first = np.maximum.accumulate(np.where(r == 0, opened - opens, 0)) if len(at) else opened
        parent = opened - first - 1
    count = np.cumsum(present)
    begin = np.r_[True, inside[1:] != inside[:-1]] if len(at) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(begin, count - present, 0)) if len(at) else count
    pos = count - base - 1
    return record[present], parent[present], pos[present], at[present]


def level_rows(shredder: JsonShredder) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, dict[str, list]]]:
    """For each child table: name, record index, parent position, position, and its value columns."""
    for (child, field), col in shredder.columns.items():
        if field != TEXT_VALUE:
            continue
        depth = len(col.ancestors) + 1
        rec, parent, pos, at = assemble(np.asarray(col.rep, np.int64), np.asarray(col.dfn, np.int64), depth)
        vals = {}
        if shredder.values:
            for f in (*col.group.fields, TEXT_VALUE):
                v = shredder.columns[child, f].val
                vals[f] = [v[i] for i in at]
        yield child, rec, parent, pos, vals


KEYS = "rec_id long, child string, parent_pos int, pos int"
FLAT = KEYS + ", fields map<string,string>"
_ARROW_KEYS = pa.schema([("rec_id", pa.int64()), ("child", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32())])
_ARROW_FLAT = _ARROW_KEYS.append(pa.field("fields", pa.map_(pa.string(), pa.string())))


def _emit(ids: pa.Array, child: str, rec: np.ndarray, parent: np.ndarray, pos: np.ndarray, vals: dict | None) -> pa.RecordBatch:
    cols = [ids.take(pa.array(rec)), pa.array([child] * len(rec), pa.string()), pa.array(parent, pa.int32()), pa.array(pos, pa.int32())]
    if vals is None:
        return pa.RecordBatch.from_arrays(cols, schema=_ARROW_KEYS)
    maps = [[(k, v[i]) for k, v in vals.items() if v[i] is not None] for i in range(len(rec))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(maps, pa.map_(pa.string(), pa.string()))], schema=_ARROW_FLAT)


def shred_json(df: DataFrame, id_col: str, json_col: str, values: bool = True) -> DataFrame:
    """The child objects of the JSON payloads of ``df`` as rows ``rec_id, child, parent_pos, pos[, fields]``.

    Nulls, blanks, cut-off texts and texts nested deeper than the parser's limit (about 1,000 levels) give no rows; a
    null id is kept as null. Repeated rows give repeated rows; an empty table gives none. Other columns of ``df`` are
    not read, so clashing names don't matter. No shuffle: one pass per scan partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            shredder = JsonShredder(values=values)
            for t in texts.to_pylist():
                shredder.add(parse_json(t))
            for child, rec, parent, pos, vals in level_rows(shredder):
                if len(rec):
                    yield _emit(ids, child, rec, parent, pos, vals if values else None)

    own = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(json_col).cast("string").alias("payload"))
    return own.mapInArrow(run, FLAT if values else KEYS)


# ---------------------------------------------------------------------------------------------------------------
# Typed columns


def _filled(arr: pa.Array) -> np.ndarray:
    """Per slot: does it hold anything but nulls, blank strings and empty children?"""
    valid = np.asarray(arr.is_valid())
    if pa.types.is_struct(arr.type):
        out = np.zeros(len(arr), bool)
        for x in arr.flatten():
            out |= _filled(x)
        return out & valid
    if pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type):
        inner = _filled(arr.flatten()) if len(arr) else np.zeros(0, bool)
        owner = np.asarray(pc.list_parent_indices(arr))
        out = np.zeros(len(arr), bool)
        np.logical_or.at(out, owner, inner)
        return out & valid
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        return valid & np.asarray(pc.fill_null(pc.not_equal(pc.utf8_length(pc.utf8_trim_whitespace(arr)), 0), False))
    return valid


def typed_levels(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of a depth-1 group from a list<struct> or struct column: repetition, definition, index into the flat items.

    Straight from offsets and validity; an absent or empty group keeps one undefined triple per record.
    """
    n = len(arr)
    if pa.types.is_struct(arr.type):
        filled = _filled(arr)
        return np.zeros(n, np.int64), filled.astype(np.int64), np.arange(n)
    owner = np.asarray(pc.list_parent_indices(arr)).astype(np.int64)
    filled = _filled(arr.flatten())
    sizes = np.bincount(owner, minlength=n)
    lone = np.flatnonzero(sizes == 0)
    rec = np.r_[owner, lone]
    dfn = np.r_[filled.astype(np.int64), np.zeros(len(lone), np.int64)]
    item = np.r_[np.arange(len(owner)), np.full(len(lone), -1)]
    order = np.argsort(rec, kind="stable")
    rec, dfn, item = rec[order], dfn[order], item[order]
    rep = np.r_[0, (rec[1:] == rec[:-1]).astype(np.int64)] if len(rec) else np.zeros(0, np.int64)
    return rep, dfn, item


def _renamed(s: pa.Array) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in s.type], s.flatten(), strict=True))


def shred_responses(df: DataFrame, id_col: str = "response_id", values: bool = True) -> DataFrame:
    """The child objects of typed ``parts``, ``payment_details`` and ``delivery_details`` as ``rec_id, child, parent_pos, pos[, fields]``.

    Levels come from Arrow offsets, a whole batch at a time. Null or empty groups, and members that hold nothing, give
    no rows; positions count what remains. Repeated rows give repeated rows. Only the four columns are read.
    """

    def text(a: pa.Array, at: np.ndarray) -> list:
        return a.take(pa.array(at)).cast(pa.string()).to_pylist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for child, arr in (("part", batch.column(1)), ("payment", batch.column(2)), ("delivery", batch.column(3))):
                rep, dfn, item = typed_levels(arr)
                rec, parent, pos, at = assemble(rep, dfn, 1)
                flat = arr.flatten() if child == "part" else arr
                vals = None
                if values:
                    vals = {f: text(a, item[at]) for f, a in _renamed(flat).items() if not pa.types.is_nested(a.type)}
                if len(rec):
                    yield _emit(ids, child, rec, parent, pos, vals)
                if child != "delivery":
                    continue
                address = _renamed(arr)["address"]
                if not pa.types.is_struct(address.type):
                    continue
                both = dfn * (1 + _filled(address).astype(np.int64))
                rec, parent, pos, at = assemble(rep, both, 2)
                if len(rec):
                    vals = {f: text(a, item[at]) for f, a in _renamed(address).items()} if values else None
                    yield _emit(ids, "address", rec, parent, pos, vals)

    own = df.select(F.col(id_col).cast("long").alias("rec_id"), "parts", "payment_details", "delivery_details")
    return own.mapInArrow(run, FLAT if values else KEYS)


def child_table(flat: DataFrame, child: str) -> DataFrame:
    """One flat child table: the link ``(rec_id, parent_pos, pos)`` and a column for each field of the group."""

    def find(groups: tuple[Group, ...]) -> Group | None:
        for g in groups:
            if g.child == child:
                return g
            if (sub := find(g.groups)) is not None:
                return sub
        return None

    group = find(RESPONSE_GROUPS)
    if group is None:
        raise ValueError(f"no child table {child!r}")
    rows = flat.filter(F.col("child") == child)
    return rows.select("rec_id", "parent_pos", "pos", *[F.col("fields")[f].alias(f) for f in (*group.fields, *([TEXT_VALUE] if group.single else []))])


def found(responses: DataFrame, raw: DataFrame) -> DataFrame:
    """``src, rec_id, child, parent_pos, pos`` of every child object of both tables, each once."""
    a = shred_responses(responses, values=False).select(F.lit("responses").alias("src"), "*")
    b = shred_json(raw, "record_id", "payload", values=False).select(F.lit("raw_responses").alias("src"), "*")
    return a.unionByName(b).distinct()
