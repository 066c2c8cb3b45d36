"""Corpora of R sources: the tables' own texts, texts made from their columns, and fixed fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import from_text

# Regression fixtures (case, source) and their expected status and digests.
FIXTURES = {
    "precedence": "a <- b + c * d ^ e |> f()\n",
    "malformed": 'f(, x = 1 + * 2, y = "closed")\n',
    "incomplete": "if (x > 1) {\n  f(x +\n",
    "lossless": '# Mixed trivia and operator/literal spelling stay exact.\nx  <-  1 ** 2 # tail\n`odd name` <- r"-(raw text)-"\n',
    "roxygen-grouping": "#' First line\n  #' Same adjacent block\nx <- 1\n\n#' Detached block\n",
    "roxygen-tags-fences": "#' Title with `code` and [link]\n#' @param x,y values\n#' @section Details: prose\n#' ```r\n#' x <- \"@param not-a-tag\"\n#' ```\n#' @examples\n#' f(1)\nf <- function(x, y) x\n",
    "roxygen-null": "#' Stops here\nNULL\n#' Associates normally\nf <- function() 1\n",
}
_NONE = ("136bd41b9e40ea4690e21ab3e2cc2cca80046f1bcb70fed53871303cfe57444c", "754a70993137f1db899233a5790e84c5f529516b39f5b6d04dba67d235107613", "6c89ece45c0a032e535614c9831832e27e16adb24610aa202731f8fd78423676", "18a29ce4fb25420ccdae5f340cbffdde6ed077aec334ed82f98f0e6ef09797fc")
EXPECTED = {
    "precedence": ("Complete", "28ce217a0fb1130c6311cb6a5b2407c93e6a44f0423055d61a9b09328648abda", *_NONE),
    "malformed": ("Invalid", "fbdf9a0d73c67594018d4693bd26a3d3bf6a724611563c5b728f22ba86f812d4", "34b4fa7d042ae76eed639ebf3a6f728edab389fdd68c46db668790c9a39edcc9", *_NONE[1:]),
    "incomplete": ("Incomplete", "d61a700b838a346067dad1d6e16c66d1aaa42f1f49c6fe66ddb2f06bbc9875ef", "effa5b780bbc3bade7d0e6fc770fa8e3816da9f134de52a7e4f69f201279794e", *_NONE[1:]),
    "lossless": ("Complete", "deb9b2e9937e8dd66a6fdb2674fd66d5b108b4647857d9f817e943e57933c44d", *_NONE),
    "roxygen-grouping": ("Complete", "0ff1d405d7e32aa7d5f85e170efdc2d31427b9560a53258290af08ff7d0010ea", _NONE[0], "6fa72e069f5784a1fb687b601eec89d2c3f35981b1653edd66bd4d3cb06eafdc", "c56fa377b3d6bfc50c55301fbe29081462e8a6698571455010c39a637bb835d8", _NONE[3]),
    "roxygen-tags-fences": ("Complete", "55f4c9b3d08a9131f3ea506cb74adda7fa98b982bb70d482dc1bd3a00b929b0e", _NONE[0], "bc141b92ea64e42be7efe56952b760f00762f9a6f2c9d34c7277f614bb9c81fc", "7e06a8bacdd0d895d66beca9474875257b3abc6a8e8bf36ac128056523d3a847", "00ad65ae5258d13fa93d0cf58259b5d8eb9d5b4a22794aa72984426861a4b183"),
    "roxygen-null": ("Complete", "a955d3b65563f2d31daaf81e9a1ec9e4e32585b4a43e30a92f74a204fa8ee6d9", _NONE[0], "bcf16edc6cc8992c5b91f4a546d9de533ee420f965bbb860f2819a294cc848bc", "f1e37e95b31c4e87bcacb6955173e80adb17670684b23f841ccf34f91c8ba0fc", _NONE[3]),
}


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class Streaming:
    """In place of a session: its tables are read as streams."""

    def __init__(self, spark: SparkSession):
        self.spark = spark


def table(spark: SparkSession | Streaming, sf_dir: str, name: str) -> DataFrame:
    if isinstance(spark, Streaming):
        schema = spark.spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        # A stream reads folders or patterns: this one fits the table's file alone.
        return spark.spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("source"))


def fixtures(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i, name, text) for i, (name, text) in enumerate(FIXTURES.items())], "doc_id long, source_name string, text string")


def _made(spark, sf_dir, name, key, template: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.lit(None).cast("string").alias("source_name"), F.expr(template).alias("text"))


#: SQL of the texts made from a table's columns; both engines read it alike.
ASSIGNMENTS = "concat('v', c_custkey, ' <- ', c_nationkey, 'L + 1', chr(10))"
CALLS = "concat('f', o_custkey % 7, '(', o_orderkey, ', x = \"', o_orderstatus, '\", g(', o_custkey, '))', chr(10))"
DIRECTIVES = "concat('#line ', o_orderkey + 1, ' \"', o_orderstatus, '.R\"', chr(10), 'x <- 1', chr(10), '  # line 7', chr(10), 'y', chr(10))"
FUNCTIONS = "concat('#'' Title ', p_name, chr(10), '#'' @param x,y size ', p_size, chr(10), '#'' @examples', chr(10), '#'' f(', p_partkey, ')', chr(10), 'f', p_partkey, ' <- function(x, y = ', p_size, ', x, ...) x + y', chr(10))"
BROKEN = "concat('x <- \"a\\\\q', s_suppkey, '\" + 1e; y <- 0x + ', s_suppkey, '.5L', chr(10), '§', chr(10), '%in', chr(10), '\"open ', s_name)"
PIPES = "concat('d |> f', c_custkey, '(x = _) |> g', chr(10), 'a <- b = ', c_custkey, chr(10))"
CONTROL = "concat('for (i in 1:', c_custkey, ') { next }', chr(10), 'while (x < ', c_custkey, ') break', chr(10), 'repeat { f(i) }', chr(10), 'break', chr(10), 'if (a) { b } else ', c_custkey, chr(10))"
INDICES = "concat('x', p_partkey, '[1, , drop = FALSE]', chr(10), 'y[[', p_size, ']]', chr(10), 'z[[1, 2]]', chr(10), 'w[[]]', chr(10))"
NAMES = "concat('pkg', s_suppkey, '::f(a$b', s_suppkey, '@c)', chr(10), '\"s\":::g', chr(10), 'f()::h', chr(10), 'a$1', chr(10))"
TRIVIA = "concat('..1 ... ..', c_custkey, 'a', chr(13), chr(10), '\"l', chr(10), 'm\" ', c_nationkey, chr(13), 'y', chr(10))"
MARKUP = "concat('#'' @param ,x', chr(10), '#'' [a `b', chr(10), '#'' @foo ', p_size, chr(10), '#'' @section t', chr(10), 'f', p_partkey, chr(10))"


def assignments(spark, sf_dir):
    return _made(spark, sf_dir, "customer", "c_custkey", ASSIGNMENTS)


def calls(spark, sf_dir):
    return _made(spark, sf_dir, "orders", "o_orderkey", CALLS)


def directives(spark, sf_dir):
    return _made(spark, sf_dir, "orders", "o_orderkey", DIRECTIVES)


def functions(spark, sf_dir):
    return _made(spark, sf_dir, "part", "p_partkey", FUNCTIONS)


def broken(spark, sf_dir):
    return _made(spark, sf_dir, "supplier", "s_suppkey", BROKEN)


def pipes(spark, sf_dir):
    return _made(spark, sf_dir, "customer", "c_custkey", PIPES)


def control(spark, sf_dir):
    return _made(spark, sf_dir, "customer", "c_custkey", CONTROL)


def indices(spark, sf_dir):
    return _made(spark, sf_dir, "part", "p_partkey", INDICES)


def names(spark, sf_dir):
    return _made(spark, sf_dir, "supplier", "s_suppkey", NAMES)


def trivia(spark, sf_dir):
    return _made(spark, sf_dir, "customer", "c_custkey", TRIVIA)


def markup(spark, sf_dir):
    return _made(spark, sf_dir, "part", "p_partkey", MARKUP)
