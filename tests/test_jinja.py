"""Template facts against a scanner that walks characters."""

from __future__ import annotations

import random
import re
import string

from pyspark.sql import functions as F
from quillgraph.functions import jinja

LETTERS = string.ascii_letters + "_"


def scanner(code: str) -> set:
    """(kind, name) of a text, character by character, without lines."""
    out, i = set(), 0
    while (i := code.find("{", i)) >= 0:
        close = {"{": "}}", "%": "%}", "#": "#}"}.get(code[i + 1 : i + 2])
        if close is None:
            i += 1
            continue
        end = code.find(close, i + 2)
        if end < 0:
            break
        inner, i = code[i + 2 : end], end + 2
        if close == "%}" and inner.strip("-+ \t\n") == "raw":
            after = re.search(r"\{%[-+\s]*endraw[-+\s]*%\}", code[i:])  # the first tag that reads so
            if after is None:
                break
            i += after.end()
            continue
        if close != "#}":
            out |= said(inner)
    return out


def said(s: str) -> set:
    tokens, i = [], 0  # (text, what follows it on its line)
    while i < len(s):
        j = i + 1
        if s[i] in "'\"":
            while j < len(s) and s[j] != s[i]:
                j += 2 if s[j] == "\\" else 1
            j += 1
        elif s[i] in LETTERS:
            while j < len(s) and (s[j] in LETTERS or s[j] in "0123456789."):
                j += 1
        if not s[i].isspace():
            tokens.append((s[i:j], s[j:].lstrip(" \t")[:1]))
        i = j
    out = set()
    text = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    for k, (w, near) in enumerate(tokens):
        if w[0] not in LETTERS:
            continue
        edge, last, opens = text(k - 1)[-1:], w.split(".")[-1], text(k + 1) == "("
        quoted = text(k + 2)[1:-1] if text(k + 2)[:1] in "'\"" and text(k + 2)[:1] else ""
        if edge != ".":
            if w == "target" and text(k + 1) == "[" or w.startswith("target.get") and w.split(".")[1] == "get" and opens:
                out |= {("target", quoted)} if quoted not in ("", *jinja.ALIKE) else set()
            elif w.startswith("target."):
                out |= {("target", w.split(".")[1])} if w.split(".")[1] not in ("", *jinja.ALIKE) else set()
            elif opens and w == "env_var":
                out.add(("env_var", quoted))
            elif opens and (w.startswith("adapter.get_") or last in jinja.LOADS):
                out.add(("warehouse", w))
            elif opens and last == "is_incremental":
                out.add(("incremental", ""))
        test = text(k - 1) == "is" or text(k - 1) == "not" and text(k - 2) == "is"
        if near == "(" and w.count(".") <= 1 and w[-1] != "." and edge not in (".", "|") and not test:
            out.add(("call", w))
    return out


def test_facts_are_those_of_the_scanner(spark):
    some = ["{{", "}}", "{%", "%}", "{#", "#}", "{% raw %}", "{%- endraw -%}", "{%-raw-%}", " ", "\n", "f(", "x.y(", "x.y.z(", ")", "'a(b)'", '"it\\"s g("', "'", "is", "not", "odd(", "|", ".", "target.schema", "target['name']", "target.get( 'k')", "target.type", "env_var('V')", "env_var(x)", "run_query (", "adapter.get_columns(", "m.is_incremental(", "is_incremental\n(", "{", "}", "word", "_w1(", "é("]
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["", "{{ ", "{% "]) + rnd.choice(some) + rnd.choice(["", " ", " }}", " %}"]) for _ in range(rnd.randint(1, 25))) for _ in range(700)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "id long, code string")
    got: dict = {i: set() for i in range(len(texts))}
    for r in jinja.table(df).collect():
        got[r.id].add((r.kind, r.name))
    assert [(texts[i], g ^ scanner(texts[i])) for i, g in got.items() if g != scanner(texts[i])] == []
    assert sum(map(len, got.values())) > 500


def test_lines_and_secrets(spark):
    code = "a\n{{ f(1)\n  + g(env_var('DB_PASSWORD')) }}{#\n#}\n{% raw %}\n{{ no() }}{% endraw %}{{ f(2) }}\n{{ target.schema }}"
    df = spark.createDataFrame([(1, code), (2, "x" * 200_000 + "{{ '" + "\\'" * 3000 + "' ~ h(1) }}")], "id long, code string")
    rows = {(r.id, r.kind, r.name): r.line for r in jinja.table(df).collect()}
    assert rows == {(1, "call", "f"): 2, (1, "call", "g"): 3, (1, "call", "env_var"): 3, (1, "env_var", ""): 3, (1, "target", "schema"): 7, (2, "call", "h"): 1}
    plan = df.select(F.explode(jinja.facts(F.col("code"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_texts_are_cut_once_and_dealt(spark):
    """A text's blocks and tokens are computed once, however many conditions look at them, and a small file's texts go to many tasks."""
    rows = spark.createDataFrame([(k, "{{ f(1) }}{{ target.schema }}") for k in range(40)], "id long, code string").coalesce(1)
    plan = rows.select(jinja.facts(F.col("code")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("split(code") == 1
    assert jinja.dealt(rows, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert jinja.table(rows).count() == 80
