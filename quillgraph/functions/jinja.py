"""What the blocks of a template call and read, with their lines, as built-in functions over its text.

A text is split at its blocks: comments, raw blocks (to the first tag that ends one, or to the text's end), expressions and statements; one that isn't closed ends the
scan. Expressions and statements are cut into tokens, quoted strings being one each, so what stands in a string, a comment, a raw block or
outside of blocks is never seen. A word is judged by the tokens beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import is_secret, reads_as_credential

RAW = r"\{%[-+\s]*raw[-+\s]*%\}"
BLOCK = rf"(?s)\{{#.*?#\}}|{RAW}.*?(?:\{{%[-+\s]*endraw[-+\s]*%\}}|\z)|\{{\{{.*?\}}\}}|\{{%.*?%\}}|\{{[\{{%#].*\z"
# possessive, so that long strings with many escapes are matched without recursion
STRING = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)"""
WORD = r"[A-Za-z_][A-Za-z0-9_.]*"
TOKEN = rf"(?s){STRING}|{WORD}|\s+|\S"

# Keys of the target that are alike everywhere, and calls that read the warehouse.
ALIKE = ("type", "threads")
LOADS = ("run_query", "load_result", "load_relation")

FACT = "array<struct<line:int,kind:string,name:string>>"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often it is named; inside of lambdas Spark computes a repeated expression every time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(code: Column) -> Column:
    """The expressions and statements of a text, without their brackets, each with the line it begins in."""
    each = F.zip_with(F.split(code, BLOCK, -1), F.regexp_extract_all(code, F.lit(BLOCK), F.lit(0)), lambda p, b: F.struct(_newlines(p).alias("gap"), b.alias("b"), _newlines(b).alias("own")))
    start = lambda found, x, i: F.lit(1) + x["gap"] + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, y: s + y["gap"] + F.coalesce(y["own"], F.lit(0)))
    lined = _let(each, lambda found: F.transform(found, lambda x, i: F.struct(x["b"].alias("b"), start(found, x, i).alias("line"))))
    live = F.filter(lined, lambda x: F.coalesce(x["b"].rlike(r"(?s)^(\{\{.*\}\}|\{%.*%\})$") & ~x["b"].rlike(rf"(?s)^{RAW}"), F.lit(False)))
    return F.transform(live, lambda x: F.struct(F.substring(x["b"], F.lit(3), F.length(x["b"]) - 4).alias("text"), x["line"].alias("line")))


def _unquoted(token: Column) -> Column:
    """The text of a closed string, null for other tokens."""
    return F.when(token.rlike(r"""(?s)^('.*'|".*")$""") & (F.length(token) > 1), F.substring(token, F.lit(2), F.length(token) - 2))


def _of_block(block: Column) -> Column:
    solid = lambda tokens: F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~x["t"].rlike(r"^\s"))
    # every fact is a call or a key of the target
    told = lambda solid, x, k: (x["t"].startswith("target") | F.coalesce(F.get(solid, k + 1)["t"] == "(", F.lit(False))) & x["t"].rlike(f"^{WORD}$")
    said = lambda tokens, solid: F.transform(solid, lambda x, k: F.when(told(solid, x, k), _of_word(block["line"], tokens, solid, x, k)).otherwise(F.array().cast(FACT)))
    return F.flatten(_let(F.regexp_extract_all(block["text"], F.lit(TOKEN), F.lit(0)), lambda tokens: _let(solid(tokens), lambda solid: said(tokens, solid))))


def _of_word(first: Column, tokens: Column, solid: Column, x: Column, k: Column) -> Column:
    """What a word says, as a list of facts; solid: the tokens that aren't spaces."""
    none = F.lit("")
    at = lambda j: F.coalesce(F.when(j >= 0, F.get(solid, j))["t"], none)
    beside = F.struct(at(k - 2).alias("second_before"), at(k - 1).alias("before"), at(k + 1).alias("after"), at(k + 2).alias("second"), F.substring_index(x["t"], ".", -1).alias("last"), _unquoted(at(k + 2)).alias("quoted"))
    return _let(beside, lambda near: _judged(first, tokens, x, near))


def _judged(first: Column, tokens: Column, x: Column, near: Column) -> Column:
    word, none, before, after, last = x["t"], F.lit(""), near["before"], near["after"], near["last"]
    edge = F.right(before, F.lit(1))
    opens, method = after == "(", edge == "."
    line = first + F.aggregate(F.slice(tokens, 1, x["i"]), F.lit(0), lambda s, t: s + _newlines(t))
    key = F.when((word == "target") & (after == "["), near["quoted"]).when(word.startswith("target.get") & (F.get(F.split(word, r"\."), F.lit(1)) == "get") & opens, near["quoted"])
    key = key.when(word.startswith("target."), F.get(F.split(word, r"\."), F.lit(1)))
    name = F.coalesce(near["quoted"], none)
    shown = F.when(is_secret(name) | reads_as_credential(name), none).otherwise(name)
    fact = lambda kind, name: F.struct(line.cast("int").alias("line"), F.lit(kind).alias("kind"), name.alias("name"))
    read = (
        F.when(method, F.lit(None))
        .when(key.isNotNull(), F.when((key != "") & ~key.isin(*ALIKE), fact("target", key)))
        .when(opens & (word == "env_var"), fact("env_var", shown))
        .when(opens & (word.startswith("adapter.get_") | last.isin(*LOADS)), fact("warehouse", word))
        .when(opens & (last == "is_incremental"), fact("incremental", none))
    )
    joined = ~F.coalesce(F.get(tokens, x["i"] + 1), none).rlike(r"^\s*[^\s \t]*[\n\r\f\x0b]")  # a call's bracket is on its line
    tested = (before == "is") | ((before == "not") & (near["second_before"] == "is"))
    plain = ~word.endswith(".") & (F.length(word) - F.length(F.replace(word, F.lit("."), none)) <= 1)
    call = F.when(opens & joined & plain & ~edge.isin(".", "|") & ~tested, fact("call", word))
    return F.array_compact(F.array(read, call)).cast(FACT)


def facts(code: Column) -> Column:
    """array<struct<line, kind, name>> of a text, in order: what it reads of its surroundings (target, env_var, warehouse, incremental), each
    variable that reads as a credential without its name, and what it calls (call)."""
    return F.when(code.contains("{"), F.flatten(F.transform(_blocks(code), _of_block))).otherwise(F.array().cast(FACT))


def table(texts: DataFrame) -> DataFrame:
    """(id, line, kind, name) of texts (id, code): each fact of a text once, at its first line; lines count from 1."""
    rows = dealt(texts, "id").select("id", F.explode(facts(F.col("code"))).alias("f")).select("id", "f.*")
    return rows.groupBy("id", "kind", "name").agg(F.min("line").alias("line")).select("id", "line", "kind", "name")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: a small file of many short texts is read by a task or two, and scanning texts takes far
    longer than reading them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def environment_reads(code: Column) -> Column:
    """What code reads of its surroundings, each once, in order: target.x, env_var X, is_incremental, calls of the warehouse."""
    told = lambda x: F.when(x["kind"] == "target", F.concat(F.lit("target."), x["name"])).when(x["kind"] == "env_var", F.rtrim(F.concat(F.lit("env_var "), x["name"]))).when(x["kind"] == "incremental", "is_incremental").otherwise(x["name"])
    return F.array_sort(F.array_distinct(F.transform(F.filter(facts(code), lambda x: x["kind"] != "call"), told)))


def jinja_calls(code: Column) -> Column:
    """Names called inside blocks, each once, in order of name."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(facts(code), lambda x: x["kind"] == "call"), lambda x: x["name"])))
