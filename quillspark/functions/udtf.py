"""SQL table functions over one text: r_tokens, r_nodes, r_diagnostics, r_lines."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .grammar import flatten, parse
from .scan import scan


@udtf(returnType="tok: int, kind: string, start: bigint, end: bigint, text: string")
class Tokens:
    def eval(self, text: str):
        x = scan(text or "")
        for i, (k, a, z) in enumerate(zip(x.kinds, x.starts, x.ends)):
            yield i, k, a, z, x.token_text(i)


@udtf(returnType="id: int, parent_id: int, child_index: int, depth: int, kind: string, start: bigint, end: bigint, last_desc: int")
class Nodes:
    def eval(self, text: str):
        f = flatten(parse(text or ""))
        for i, k in enumerate(f.kind):
            if f.token[i] is None:
                yield i, f.parent[i], f.child[i], f.depth[i], k, f.start[i], f.end[i], f.last[i]


@udtf(returnType="code: string, start: bigint, end: bigint, message: string")
class Diagnostics:
    def eval(self, text: str):
        for d in parse(text or "").diagnostics:
            yield d.code, d.start, d.end, d.message


#: Lines need no Python and no join: a text is split, and starts are sums of what came before, in the row: by fold
#: within blocks of about the root of the number of lines, then over the blocks. Steps name what later ones read
#: (``flatten(transform(array(x), v -> ...))``). The body is one generator over no table, which LATERAL turns into
#: a generator over the texts' own rows. Endings are matched alone: a pattern for a line with its ending tries
#: every place of a last line that has none.
_LINES = r"""
CREATE OR REPLACE TEMPORARY FUNCTION r_lines(source STRING) RETURNS TABLE (line INT, start BIGINT, content STRING) RETURN
SELECT * FROM inline(
  flatten(transform(array(struct(split(coalesce(source, ''), '\r\n|\r|\n', -1) AS c, regexp_extract_all(coalesce(source, ''), '\r\n|\r|\n', 0) AS e)), v ->
    flatten(transform(array(struct(v.c AS c, concat(array(0L), transform(v.e, (x, i) -> CAST(octet_length(get(v.c, i)) + octet_length(x) AS BIGINT))) AS w, CAST(ceil(sqrt(size(v.c))) AS INT) AS k)), v ->
      flatten(transform(array(struct(v.c AS c, v.k AS k, transform(sequence(0, CAST(ceil(size(v.w) / v.k) AS INT) - 1), i -> aggregate(slice(v.w, i * v.k + 1, v.k), CAST(array() AS ARRAY<BIGINT>), (a, x) -> concat(a, array(coalesce(get(a, size(a) - 1), 0L) + x)))) AS b)), v ->
        flatten(transform(array(struct(v.c AS c, v.k AS k, v.b AS b, aggregate(v.b, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + element_at(x, -1)))) AS o)), v ->
          transform(v.c, (c, i) -> struct(i AS line, get(get(v.b, CAST(i DIV v.k AS INT)), i % v.k) + get(v.o, CAST(i DIV v.k AS INT)) AS start, c AS content)))))))))))
"""


def register(spark: SparkSession) -> None:
    for name, function in (("r_tokens", Tokens), ("r_nodes", Nodes), ("r_diagnostics", Diagnostics)):
        spark.udtf.register(name, function)
    spark.sql(_LINES)
