"""Navigation, locations and validation of trees.

Views of syntax (calls, arguments, formals, operands, ...) read parsed rows, ``syntax(s, [FIELDS])``: a
row's elements lie in the order of their ids and name their kids, so a view is a pass over the row
and shuffles nothing. ``children`` and ``descendants`` join tables that are flat already; ids are in
preorder, the descendants of ``n`` are the ids from n + 1 to n.last_desc, so nothing is recursive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import EXPRESSIONS, ID, LITERALS, NAMES, NAMES_OR_STRINGS, TAGS, TRIVIA


def kinds(spark) -> DataFrame:
    """The dimension table of kinds: kind, kind_id and the predicates."""
    keywords = {k for k in ID if k.endswith("_KW")}
    rows = [(k, n, n < 256, k in TRIVIA, k in LITERALS, k in NAMES, k in NAMES_OR_STRINGS, k in TAGS, k in keywords, k in EXPRESSIONS) for k, n in ID.items()]
    return spark.createDataFrame(rows, "kind string, kind_id int, is_token boolean, is_trivia boolean, is_literal boolean, is_name boolean, is_name_or_string boolean, is_tag boolean, is_keyword boolean, is_expression boolean")


def is_expression() -> Column:
    return F.col("kind").isin(*sorted(EXPRESSIONS))


#: Fields of the elements that the functions over parsed rows read.
FIELDS = "elements.id,parent_id,child_index,is_token,kind,start,end,last_desc,text,kids"


def _at(i: Column) -> Column:
    """The element of that id: elements lie in the order of their ids."""
    return F.element_at("elements", i + 1)


def _kids(e: Column) -> Column:
    return F.transform(e["kids"], _at)


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _of(kind: str):
    return F.filter("elements", lambda e: e["kind"] == kind)


def _nodes(e: Column) -> Column:
    return F.filter(_kids(e), lambda k: ~k["is_token"])


def _tokens(e: Column) -> Column:
    return F.filter(_kids(e), lambda k: k["is_token"] & ~k["kind"].isin(*sorted(TRIVIA)))


def _expression(k: Column) -> Column:
    return ~k["is_token"] & k["kind"].isin(*sorted(EXPRESSIONS))


def _rows(parsed: DataFrame, found: Column) -> DataFrame:
    """A row for each struct of an array; the parse it comes from goes."""
    return parsed.select("doc_id", F.inline(found))


def children(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """Child elements of some nodes of a flat table, with the parent's columns named p_*."""
    p = parents.select(F.col("doc_id").alias("p_doc"), F.col("id").alias("p_id"), F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return elements.join(p, (elements["doc_id"] == p["p_doc"]) & (elements["parent_id"] == p["p_id"])).drop("p_doc")


def tops() -> Column:
    """Of the array of a parse: what stands at the top of the source."""
    lists = F.filter(_kids(_at(F.lit(0))), lambda k: k["kind"] == "EXPRESSION_LIST")
    found = F.filter(_kids(_first(lists)), _expression)
    return F.coalesce(found, F.filter("elements", lambda e: F.lit(False)))


def top_expressions(parsed: DataFrame) -> DataFrame:
    """doc_id, id, kind, start, end, last_desc of the expressions of each source, in order."""
    return _rows(parsed, F.transform(tops(), lambda e: F.struct(*[e[c].alias(c) for c in ("id", "kind", "start", "end", "last_desc")])))


def calls(parsed: DataFrame) -> DataFrame:
    """doc_id, id, start, end, callee (text of a plain name, else null), callee_kind, n_args."""

    def one(e):
        callee, listed = _first(_nodes(e)), _first(F.filter(_nodes(e), lambda k: k["kind"] == "ARGUMENT_LIST"))
        name = _first(F.filter(_kids(callee), lambda k: k["kind"] == "IDENTIFIER"))["text"]
        n = F.size(F.filter(_kids(listed), lambda k: k["kind"] == "ARGUMENT")).cast("long")
        return F.struct(e["id"].alias("id"), e["start"].alias("start"), e["end"].alias("end"), F.when(callee["kind"] == "IDENTIFIER_EXPR", name).alias("callee"), callee["kind"].alias("callee_kind"), n.alias("n_args"))

    return _rows(parsed, F.transform(_of("CALL_EXPR"), one))


def call_arguments(parsed: DataFrame, node: str = "CALL_EXPR", listed: str = "ARGUMENT_LIST") -> DataFrame:
    """doc_id, call_id, position, tag, value_kind of every argument of a call, or of an index (see ``indices``)."""

    def one(e):
        own = F.filter(_kids(_first(F.filter(_nodes(e), lambda k: k["kind"] == listed))), lambda k: k["kind"] == "ARGUMENT")
        # A tag is told by its ``=``: a name alone is the value's.
        return F.transform(
            own,
            lambda a, i: F.struct(
                e["id"].alias("call_id"),
                i.alias("position"),
                _first(F.filter(_kids(a), lambda k: k["is_token"] & k["kind"].isin(*sorted(TAGS))))["text"].alias("tag"),
                _last(_nodes(a))["kind"].alias("value_kind"),
            ),
        )

    return _rows(parsed, F.flatten(F.transform(_of(node), one)))


def indices(parsed: DataFrame, node: str = "SUBSET_EXPR") -> DataFrame:
    """The same of ``x[...]``, or of ``x[[...]]`` as SUBSET2_EXPR: arguments that are no errors."""
    return call_arguments(parsed, node, "INDEX_ARGUMENT_LIST")


def function_params(parsed: DataFrame) -> DataFrame:
    """doc_id, function_id, position, name, has_default of every formal; body_kind of its function."""

    def one(e):
        own = F.filter(_kids(_first(F.filter(_nodes(e), lambda k: k["kind"] == "PARAMETER_LIST"))), lambda k: k["kind"] == "PARAMETER")
        return F.transform(
            own,
            lambda a, i: F.struct(
                e["id"].alias("function_id"),
                i.alias("position"),
                _first(F.filter(_kids(a), lambda k: k["kind"].isin("IDENTIFIER", "ELLIPSIS", "DOT_DOT_I")))["text"].alias("name"),
                F.exists(_kids(a), lambda k: k["kind"] == "EQ").alias("has_default"),
                _last(F.filter(_kids(e), _expression))["kind"].alias("body_kind"),
            ),
        )

    return _rows(parsed, F.flatten(F.transform(_of("FUNCTION_EXPR"), one)))


def duplicate_formals(parsed: DataFrame) -> DataFrame:
    """Formals whose name came before in the same list."""
    f = function_params(parsed)
    order = Window.partitionBy("doc_id", "function_id", "name").orderBy("position")
    return f.withColumn("nth", F.row_number().over(order)).where("nth > 1").drop("nth")


def operands(parsed: DataFrame, kind: str = "BINARY_EXPR") -> DataFrame:
    """doc_id, id, operator, operator_kind, left_kind, right_kind of binary nodes, assignments, pipes, formulas, members or namespaces."""

    def one(e):
        operator = _first(_tokens(e))
        return F.struct(e["id"].alias("id"), operator["text"].alias("operator"), operator["kind"].alias("operator_kind"), _first(_nodes(e))["kind"].alias("left_kind"), _last(_nodes(e))["kind"].alias("right_kind"))

    return _rows(parsed, F.transform(_of(kind), one))


def selections(parsed: DataFrame, kind: str = "MEMBER_EXPR") -> DataFrame:
    """doc_id, id, operator, left_kind, name of ``x$name``, ``x@name`` or, as NAMESPACE_EXPR, ``package::name``."""

    def one(e):
        return F.struct(e["id"].alias("id"), _first(_tokens(e))["text"].alias("operator"), _first(_nodes(e))["kind"].alias("left_kind"), F.when(F.size(_tokens(e)) > 1, _last(_tokens(e))["text"]).alias("name"))

    return _rows(parsed, F.transform(_of(kind), one))


def branches(parsed: DataFrame) -> DataFrame:
    """doc_id, id, then_kind, has_else of conditionals."""

    def one(e):
        return F.struct(e["id"].alias("id"), _first(F.filter(_kids(e), _expression))["kind"].alias("then_kind"), F.exists(_kids(e), lambda k: k["kind"] == "ELSE_CLAUSE").alias("has_else"))

    return _rows(parsed, F.transform(_of("IF_EXPR"), one))


def loops(parsed: DataFrame) -> DataFrame:
    """doc_id, id, kind, variable (of ``for``), jumps (all inside) and body_kind of loops."""

    def one(e):
        condition = _first(F.filter(_nodes(e), lambda k: k["kind"] == "CONDITION"))
        variable = F.when(e["kind"] == "FOR_EXPR", _first(F.filter(_kids(condition), lambda k: k["kind"] == "IDENTIFIER"))["text"])
        inside = F.slice("elements", e["id"] + 2, e["last_desc"] - e["id"])
        return F.struct(e["id"].alias("id"), e["kind"].alias("kind"), variable.alias("variable"), F.size(F.filter(inside, lambda k: k["kind"].isin("NEXT_EXPR", "BREAK_EXPR"))).cast("long").alias("jumps"), _last(F.filter(_kids(e), _expression))["kind"].alias("body_kind"))

    found = F.filter("elements", lambda e: e["kind"].isin("WHILE_EXPR", "FOR_EXPR", "REPEAT_EXPR"))
    return _rows(parsed, F.transform(found, one))


def descendants(elements: DataFrame, of: DataFrame) -> DataFrame:
    """Elements below some nodes (with node_id) of a flat table: an equality on doc_id and a range on ids."""
    n = of.select(F.col("doc_id").alias("n_doc"), F.col("id").alias("node_id"), F.col("last_desc").alias("n_last"))
    return elements.join(n, (elements["doc_id"] == n["n_doc"]) & (F.col("id") > F.col("node_id")) & (F.col("id") <= F.col("n_last"))).drop("n_doc", "n_last")


#: What ``locations`` needs of elements, and ``resolve`` of those that it looks in.
LOCATED = "elements.path,kind,start,end,is_token"
RESOLVED = "elements.id,path_hash,kind,start,end,is_token"


def locations(elements: DataFrame) -> DataFrame:
    """A durable location of every element that has a path: doc_id, path, kind, start, end, is_token."""
    return elements.where("path IS NOT NULL").select("doc_id", "path", "kind", "start", "end", "is_token")


def resolve(locs: DataFrame, elements: DataFrame) -> DataFrame:
    """Locations with the id they resolve to, or WrongDocument, MissingElement or StaleElement.

    Paths meet by a hash of 64 bits that goes down the tree step by step, so elements need no paths.
    Locations and elements go through one shuffle by document, never a broadcast: what is guessed of the
    size of parsed tables is far too small.
    """
    e = elements.select("doc_id", F.col("path_hash").alias("_hash"), F.struct("id", "kind", "start", "end", "is_token").alias("_e"))
    hashed = F.aggregate("path", F.lit(0).cast("long"), lambda h, k: F.xxhash64(h, k.cast("long")))
    rows = locs.withColumn("_hash", hashed).unionByName(e, allowMissingColumns=True)
    rows = rows.withColumn("_known", F.col("doc_id").isNotNull() & F.coalesce(F.max(F.col("_e.id") == 0).over(Window.partitionBy("doc_id")), F.lit(False)))
    rows = rows.withColumn("_found", F.collect_list("_e").over(Window.partitionBy("doc_id", "_hash"))).where("_e IS NULL")
    out = rows.select(*locs.columns, "_known", F.explode_outer(F.when(F.col("_known"), F.col("_found"))).alias("_at"))
    same = F.lit(True)
    for c in ("kind", "start", "end", "is_token"):
        same &= F.col(c) == F.col(f"_at.{c}")
    error = F.when(~F.col("_known"), "WrongDocument").when(F.col("_at").isNull(), "MissingElement").when(~same, "StaleElement")
    return out.select(*[F.col(c) for c in locs.columns], F.when(error.isNull(), F.col("_at.id")).alias("id"), error.alias("error"))


def validate(elements: DataFrame, diagnostics: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, kind of each violation: root, class of kinds, text, bounds of diagnostics. Empty if all is well."""
    root = elements.where("id = 0 AND kind <> 'SOURCE_FILE'").select("doc_id", F.lit("InvalidRoot").alias("violation"))
    as_node = elements.where("NOT is_token AND kind_id < 256").select("doc_id", F.lit("TokenKindUsedAsNode").alias("violation"))
    as_token = elements.where("is_token AND kind_id >= 256").select("doc_id", F.lit("NodeKindUsedAsToken").alias("violation"))
    text = elements.where("is_token").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "").alias("joined"))
    other = sources.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(text, "doc_id", "left").where(F.coalesce("joined", F.lit("")) != F.col("text")).select("doc_id", F.lit("SourceMismatch").alias("violation"))
    size = sources.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    out = diagnostics.join(size, "doc_id").where("end > size OR recovery_end > size").select("doc_id", F.lit("OutOfBoundsDiagnostic").alias("violation"))
    return root.unionByName(as_node).unionByName(as_token).unionByName(other).unionByName(out)


#: What ``violations`` reads.
CHECKED = ["elements.is_token,kind_id,text", "diagnostics.end,recovery_end"]


def violations(parsed: DataFrame) -> DataFrame:
    """doc_id and the same violations as an array, from a parse with elements, diagnostics and text: no shuffle."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.filter("elements", lambda e: e["is_token"]), lambda e: e["text"]), "")
    several = [
        F.when(F.element_at("elements", 1)["kind_id"] != ID["SOURCE_FILE"], F.array(F.lit("InvalidRoot"))),
        F.transform(F.filter("elements", lambda e: ~e["is_token"] & (e["kind_id"] < 256)), lambda e: F.lit("TokenKindUsedAsNode")),
        F.transform(F.filter("elements", lambda e: e["is_token"] & (e["kind_id"] >= 256)), lambda e: F.lit("NodeKindUsedAsToken")),
        F.when(joined != F.coalesce("text", F.lit("")), F.array(F.lit("SourceMismatch"))),
        F.transform(F.filter("diagnostics", lambda d: (d["end"] > size) | (d["recovery_end"] > size)), lambda d: F.lit("OutOfBoundsDiagnostic")),
    ]
    empty = F.array().cast("array<string>")
    return parsed.select("doc_id", F.concat(*[F.coalesce(x, empty) for x in several]).alias("violations"))
