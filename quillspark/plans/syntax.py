"""Parsing as a plan: one Arrow function over (doc_id, text), then flat tables from its arrays.

A level says how far to go: ``lex`` stops at tokens, ``parse`` adds the tree, ``sidecar`` the
documentation. Only the arrays that are asked for are built, and of an array only the fields that
are (``elements.kind,text``), so a query for tokens pays for no tree and one for kinds for no text.
The function runs once a query; flat tables are ``inline`` of its columns, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon, sidecar
from ..functions.grammar import MISSING, ParserOptions, flatten, parse
from ..functions.kinds import ID
from ..functions.scan import scan

_S, _L, _I, _B = pa.string(), pa.int64(), pa.int32(), pa.bool_()


def _list(**fields) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


COLUMNS: dict[str, pa.DataType] = {
    "tokens": _list(tok=_I, kind=_S, kind_id=_I, start=_L, end=_L, text=_S, tag=_S, line_ending=_S, comment=_S, indent=_S, dir_physical=_L, dir_logical=_L, dir_source=_S),
    "lex_diagnostics": _list(ord=_I, code=_S, start=_L, end=_L, message=_S),
    "lex_flags": pa.struct([("had_errors", _B), ("diagnostics_truncated", _B), ("tokens_truncated", _B)]),
    "status": _S,
    "completeness": _S,
    "needs_more_input": _B,
    "diagnostics_truncated": _B,
    "resource_limited": _B,
    "diagnostics": _list(ord=_I, code=_S, severity=_S, start=_L, end=_L, message=_S, recovery=_S, recovery_start=_L, recovery_end=_L, recovery_token=_S),
    "elements": _list(id=_I, parent_id=_I, child_index=_I, depth=_I, is_token=_B, kind=_S, kind_id=_I, start=_L, end=_L, last_desc=_I, text=_S, kids=pa.list_(_I), path_hash=_L, path=pa.list_(_I)),
    "tree64": _S,
    "snapshot_digest": _S,
    "diagnostics_digest": _S,
    "tree_digest": _S,
    "projected": _S,
    "rox_tokens": _list(tok=_I, kind=_S, p_start=_L, p_end=_L, h_start=_L, h_end=_L, text=_S),
    "rox_elements": _list(id=_I, parent_id=_I, child_index=_I, depth=_I, is_token=_B, kind=_S, p_start=_L, p_end=_L, last_desc=_I, tok=_I),
    "rox_blocks": _list(block=_I, h_start=_L, h_end=_L, p_start=_L, p_end=_L, line_count=_I),
    "rox_assoc": _list(block=_I, state=_S, expr_start=_L, expr_end=_L, gap_start=_L, gap_end=_L),
    "rox_diagnostics": _list(ord=_I, code=_S, start=_L, end=_L, message=_S),
    "rox_embedded": _list(block=_I, p_start=_L, p_end=_L, h_start=_L, h_end=_L, status=_S, text=_S),
    "rox_mappings": _list(block=_I, ord=_I, e_start=_L, e_end=_L, p_start=_L, p_end=_L, h_start=_L, h_end=_L),
    "rox_status": pa.struct([("limited", _B), ("discovery_incomplete", _B), ("diagnostics_truncated", _B), ("valid", _B)]),
    "sidecar_digest": _S,
    "associations_digest": _S,
    "mappings_digest": _S,
}
#: Fields that come only when they are named: an array for each element, or work for each.
_NAMED = {"elements": ("kids", "path_hash", "path")}
_LEX = {"tokens", "lex_diagnostics", "lex_flags"}
_DIGESTS = {c for c in COLUMNS if c.endswith("_digest")}
_SIDE = {c for c in COLUMNS if c.startswith("rox_")} | {"projected", "sidecar_digest", "associations_digest", "mappings_digest"}


def wanted_columns(columns: Iterable[str]) -> dict[str, pa.DataType]:
    """Name and type of each column; ``name.field,field`` has those fields, a plain name all but the named ones."""
    out = {}
    for spec in columns:
        name, _, fields = spec.partition(".")
        kind = COLUMNS[name]
        if pa.types.is_list(kind):
            every = {f.name: f for f in kind.value_type}
            chosen = [every[x] for x in fields.split(",")] if fields else [f for f in every.values() if f.name not in _NAMED.get(name, ())]
            kind = pa.list_(pa.struct(chosen))
        out[name] = kind
    return out


def fields_of(kind: pa.DataType) -> set[str]:
    return {f.name for f in kind.value_type} if pa.types.is_list(kind) else set()


def sql_type(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{sql_type(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{sql_type(f.type)}" for f in t) + ">"
    return {_S: "string", _L: "bigint", _I: "int", _B: "boolean"}[t]


_NOTES = {"tag": "tag", "line_ending": "line_ending", "comment": "comment", "indent": "indent", "dir_physical": "physical", "dir_logical": "logical", "dir_source": "source"}


def _token_columns(lexed, fields: set[str]) -> dict[str, list]:
    n = len(lexed.kinds)
    make = {
        "tok": lambda: range(n),
        "kind": lambda: lexed.kinds,
        "kind_id": lambda: list(map(ID.__getitem__, lexed.kinds)),
        "start": lambda: lexed.starts,
        "end": lambda: lexed.ends,
        "text": lambda: [lexed.text[a:z] for a, z in zip(lexed.char_starts, lexed.char_ends)],
    }
    out = {c: f() for c, f in make.items() if c in fields}
    notes = {c: key for c, key in _NOTES.items() if c in fields}
    out |= {c: [None] * n for c in notes}
    for i, note in lexed.notes.items():
        for column, key in notes.items():
            out[column][i] = note.get(key)
    return out


def path_hash(parent: int, child: int) -> int:
    """What ``xxhash64(parent, child)`` gives in SQL; a root's is 0."""
    inner = xxhash.xxh64_intdigest(parent.to_bytes(8, "little", signed=True), 42)
    return int.from_bytes(xxhash.xxh64_digest(child.to_bytes(8, "little"), inner), "big", signed=True)


def _path_hashes(flat) -> list[int]:
    out: list[int] = []
    for parent, child in zip(flat.parent, flat.child):
        out.append(0 if parent is None else path_hash(out[parent], child))
    return out


def _paths(flat, located: frozenset[str] | None) -> list:
    """Child indices from the root down, for elements of the located kinds; as long as an element is deep."""
    out: list = []
    for i, kind in enumerate(flat.kind):
        if located is not None and kind not in located:
            out.append(None)
            continue
        at, path = i, []
        while flat.parent[at] is not None:
            path.append(flat.child[at])
            at = flat.parent[at]
        out.append(path[::-1])
    return out


def _kids(flat) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in flat.kind]
    for i, parent in enumerate(flat.parent):
        if parent is not None:
            out[parent].append(i)
    return out


def _element_text(p, flat) -> list:
    pieces = [p.lexed.text] if p.whole_error else [p.lexed.text[a:z] for a, z in zip(p.lexed.char_starts, p.lexed.char_ends)]
    return [None if t is None else "" if t == MISSING else pieces[t] for t in flat.token]


def _element_columns(p, flat, fields: set[str], located: frozenset[str] | None) -> dict[str, list]:
    make = {
        "id": lambda: range(len(flat.kind)),
        "parent_id": lambda: flat.parent,
        "child_index": lambda: flat.child,
        "depth": lambda: flat.depth,
        "is_token": lambda: [t is not None for t in flat.token],
        "kind": lambda: flat.kind,
        "kind_id": lambda: list(map(ID.__getitem__, flat.kind)),
        "start": lambda: flat.start,
        "end": lambda: flat.end,
        "last_desc": lambda: flat.last,
        "text": lambda: _element_text(p, flat),
        "kids": lambda: _kids(flat),
        "path_hash": lambda: _path_hashes(flat),
        "path": lambda: _paths(flat, located),
    }
    return {c: f() for c, f in make.items() if c in fields}


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; documents given as columns of their own are strung together without row objects."""
    if not values or not isinstance(values[0], dict) or not pa.types.is_list(kind):
        return pa.array(values, kind)
    fields = list(kind.value_type)
    sizes = [len(v[fields[0].name]) for v in values]
    parts = [pa.array(list(chain.from_iterable(v[f.name] for v in values)), f.type) for f in fields]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(parts, fields=fields))


def _rox_elements(s) -> list[dict]:
    out: list[dict] = []
    at = 0

    def add(parent, child, depth, token, kind, a, z, tok=None):
        out.append({"id": len(out), "parent_id": parent, "child_index": child, "depth": depth, "is_token": token, "kind": kind, "p_start": a, "p_end": z, "last_desc": len(out), "tok": tok})
        return len(out) - 1

    stack = [[s.root, add(None, 0, 0, False, s.root.kind, 0, 0), 0]]
    while stack:
        node, own, k = stack[-1]
        if k == len(node.kids):
            out[own]["p_end"], out[own]["last_desc"] = at, len(out) - 1
            stack.pop()
            continue
        stack[-1][2] += 1
        kid, depth = node.kids[k], out[own]["depth"] + 1
        if hasattr(kid, "kids"):
            stack.append([kid, add(own, k, depth, False, kid.kind, at, at), 0])
        elif kid == MISSING:
            add(own, k, depth, True, "MISSING", at, at)
        else:
            t = s.tokens[kid]
            at = t.end
            add(own, k, depth, True, t.kind, t.start, t.end, kid)
    return out


def facts(text: str, want: dict[str, pa.DataType], options: ParserOptions, side: sidecar.SidecarOptions, entry: str = "source", issues=(), located=None) -> dict:
    """The wanted columns of one source; digests come as what they absorb (see ``syntax``)."""
    out: dict = {}
    names = want.keys()
    if names <= _LEX:
        lexed = scan(text, options.lexer, options.recognize_line_directives)
    else:
        p = parse(text, options, entry, issues)
        lexed = p.lexed
        out |= {"status": p.status, "completeness": p.completeness, "needs_more_input": p.needs_more_input, "diagnostics_truncated": p.diagnostics_truncated, "resource_limited": p.resource_limited}
        if "diagnostics" in want:
            out["diagnostics"] = [{"ord": i, "code": d.code, "severity": "Error", "start": d.start, "end": d.end, "message": d.message, "recovery": d.recovery, "recovery_start": d.recovery_range()[0], "recovery_end": d.recovery_range()[1], "recovery_token": d.recovery_token} for i, d in enumerate(p.diagnostics)]
        flat = flatten(p) if names & ({"elements", "tree64", "snapshot_digest", "tree_digest"} | _SIDE) else None
        if "elements" in want:
            out["elements"] = _element_columns(p, flat, fields_of(want["elements"]), located)
        if "tree64" in want:
            out["tree64"] = f"{canon.tree_hash64(p, flat):016x}"
        if "snapshot_digest" in want:
            out["snapshot_digest"] = canon.digest_input(b"parse-snapshot", (1, canon.snapshot(p, flat)))
        if "tree_digest" in want:
            out["tree_digest"] = canon.digest_input(b"r-tree", (1, canon.r_tree(p, flat)))
        if "diagnostics_digest" in want:
            out["diagnostics_digest"] = canon.digest_input(b"r-diagnostics", (1, canon.r_diagnostics(p)))
        if names & _SIDE:
            s = sidecar.build(p, side, flat, p.resource_limited)
            out |= {
                "projected": s.projected,
                "rox_tokens": [{"tok": i, "kind": t.kind, "p_start": t.start, "p_end": t.end, "h_start": t.host_start, "h_end": t.host_end, "text": t.text} for i, t in enumerate(s.tokens)],
                "rox_blocks": [{"block": i, "h_start": b.host_start, "h_end": b.host_end, "p_start": b.start, "p_end": b.end, "line_count": b.lines} for i, b in enumerate(s.blocks)],
                "rox_assoc": [{"block": a.block, "state": a.state, "expr_start": a.expression and a.expression[0], "expr_end": a.expression and a.expression[1], "gap_start": a.gap[0], "gap_end": a.gap[1]} for a in s.associations],
                "rox_diagnostics": [{"ord": i, "code": c, "start": a, "end": z, "message": m} for i, (c, a, z, m) in enumerate(s.diagnostics)],
                "rox_embedded": [{"block": e.block, "p_start": e.projected[0], "p_end": e.projected[1], "h_start": e.host[0], "h_end": e.host[1], "status": e.parse.status, "text": e.parse.lexed.text} for e in s.embedded],
                "rox_mappings": [dict(zip(("e_start", "e_end", "p_start", "p_end", "h_start", "h_end"), m), block=e.block, ord=i) for e in s.embedded for i, m in enumerate(e.mappings)],
                "rox_status": {"limited": s.limited, "discovery_incomplete": s.discovery_incomplete, "diagnostics_truncated": s.diagnostics_truncated, "valid": s.is_valid},
            }
            if "rox_elements" in want:
                out["rox_elements"] = _rox_elements(s)
            if "sidecar_digest" in want:
                out["sidecar_digest"] = canon.digest_input(b"roxygen-sidecar", (1, sidecar.sidecar_frames(s)))
            if "associations_digest" in want:
                out["associations_digest"] = canon.digest_input(b"roxygen-associations", (1, sidecar.association_frames(s.associations)))
            if "mappings_digest" in want:
                out["mappings_digest"] = canon.digest_input(b"roxygen-mappings", (1, sidecar.mapping_frames([m for e in s.embedded for m in e.mappings])))
    if names & _LEX:
        out["tokens"] = _token_columns(lexed, fields_of(want["tokens"])) if "tokens" in want else None
        out["lex_diagnostics"] = [{"ord": i, "code": d.code, "start": d.start, "end": d.end, "message": d.message} for i, d in enumerate(lexed.diagnostics)]
        out["lex_flags"] = {"had_errors": lexed.had_errors, "diagnostics_truncated": lexed.diagnostics_truncated, "tokens_truncated": lexed.tokens_truncated}
    return out


def syntax(sources: DataFrame, columns: Iterable[str], options: ParserOptions = ParserOptions(), side: sidecar.SidecarOptions = sidecar.SidecarOptions(), entry: str = "source", keep: Iterable[str] = (), group: int = 200, located: Iterable[str] | None = None) -> DataFrame:
    """doc_id, the ``keep`` columns of ``sources``, and the wanted facts of each text. Null text is empty.

    ``columns``: names of COLUMNS, with ``name.field,field`` for some fields of an array. ``located``:
    the kinds of elements that get a ``path``, all by default. Filter ``sources`` first: nothing is
    pushed through the function. ``sources`` may have ``issues``, ranges of text that decoding replaced.
    """
    wanted = wanted_columns(columns)
    located = None if located is None else frozenset(located)
    kept = list(keep)
    issues = "issues" in sources.columns
    taken = list(dict.fromkeys(["doc_id", "text", *(["issues"] if issues else []), *kept]))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, group):
                b = whole.slice(lo, group)
                texts = b.column(1).to_pylist()
                found = b.column(2).to_pylist() if issues else [()] * len(texts)
                rows = [facts(t or "", wanted, options, side, entry, [(i["dec_start"], i["dec_end"]) for i in x or ()], located) for t, x in zip(texts, found)]
                arrays = [b.column(0), *[b.column(taken.index(k)) for k in kept]]
                for c, kind in wanted.items():
                    values = [r[c] for r in rows]
                    arrays.append(_array(canon.absorb_many(values) if c in _DIGESTS else values, kind))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *kept, *wanted])

    types = {f.name: f.dataType.simpleString() for f in sources.schema}
    schema = ", ".join(["doc_id long", *[f"`{k}` {types[k]}" for k in kept], *[f"{c} {sql_type(kind)}" for c, kind in wanted.items()]])
    rows = sources.select(F.col("doc_id").cast("long").alias("doc_id"), *taken[1:])
    return rows.mapInArrow(run, schema)


def table(sources: DataFrame, column: str, **more) -> DataFrame:
    """One of the array columns (``name`` or ``name.field,field``) as a flat table: doc_id and its fields."""
    return syntax(sources, [column], **more).select("doc_id", F.inline(column.partition(".")[0]))


def tokens(sources: DataFrame, **more) -> DataFrame:
    return table(sources, "tokens", **more)


def elements(sources: DataFrame, **more) -> DataFrame:
    return table(sources, "elements", **more)


def diagnostics(sources: DataFrame, **more) -> DataFrame:
    return table(sources, "diagnostics", **more)
