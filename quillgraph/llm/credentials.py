"""Secret scans by linking the parts of a credential, with DataFrame functions only.

Each kind of part is a pattern; its matches are leftmost and don't overlap, and those that are too short are dropped. A credential has
parts of three roles: an identifier (an access key's id, a login, an address), a secret (an assigned one, a digest, a password, a
mixed token) and an endpoint (a URL, an IPv4 address). The base kinds are always reported. The weak kinds mean little alone; one of them
is reported only where a part that complements it stands in the same scope: a secret complements identifiers and endpoints, and they
a secret. A scope is what lies between blank lines, and parts belong together if they don't overlap and no more than `reach`
characters are between them.

A text is split at a kind's matches, so what lies between them and how long they are gives their places, by a running sum; texts
never leave their scan. Parts meet by an interval join: a part is two points, its start and its end, and a candidate looks for
complementary ends in the `reach` characters before it and for complementary starts in those behind it. Points are dealt into bins of that
length, so each look is at two bins, and a join by document, scope and bin follows; what meets is bounded by the parts that fit into
`reach` characters. Places count code points, ends are exclusive.

Null and empty texts have no parts. Rows of one id, and rows without an id, are rows of their own, told apart by a number that is written
once. Very long texts are scanned whole; each pattern reads a text in time linear in its length. Parts of two kinds may overlap and are both
reported; ties of a start go by the order of kinds. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, n_parts, table

IDENTIFIER, SECRET, ENDPOINT, BREAK = "identifier", "secret", "endpoint", "break"


def either_case(word: str) -> str:
    """A pattern of a word whose letters stand in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def assigned(words: str) -> str:
    """One of the words, an equals sign or a colon, and a value as group 2."""
    return f"({either_case(words)})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Kind:
    """least: characters of the group, or of the whole match. has: what any match holds, to pass over texts quickly. also: patterns that a
    match must hold besides."""

    name: str
    role: str
    pattern: str
    least: int = 1
    group: int = 0
    has: str = ""
    also: tuple[str, ...] = ()
    weak: bool = True


#: In the order in which parts of one start are listed. Of a run of one class of characters the whole is matched or nothing, so a pattern
#: can ask for its length; after a value that is too short the search goes on behind it, so there the length is looked at afterwards.
KINDS = (
    Kind("assign", SECRET, assigned("password|passwd|secret|token|api_?key"), 6, 2, weak=False),
    Kind("access", IDENTIFIER, "AKIA[A-Z0-9]{16,}", 20, has="AKIA", weak=False),
    Kind("hex", SECRET, "[0-9a-f]{24,}", 24, weak=False),
    Kind("login", IDENTIFIER, assigned("user|user_?name|login|client_?id|account_?id|key_?id"), 3, 2),
    Kind("mail", IDENTIFIER, r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+", 6, has="@"),
    Kind("key_id", IDENTIFIER, "(ASIA|AROA|AIDA|AGPA|ANPA|ANVA|AIPA)[A-Z0-9]{12,}", 16),
    Kind("pass", SECRET, assigned("pass|pwd|passphrase|auth|credential|private_?key|access_?key"), 4, 2),
    Kind("mixed", SECRET, "[A-Za-z0-9+/_-]{32,}", 32, also=("[A-Z]", "[a-z]", "[0-9]")),
    Kind("url", ENDPOINT, r"""[a-z]{2,12}://[^\x20\x09-\x0D"'<>]+""", 10, has="://"),
    Kind("host", ENDPOINT, r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?", 7),
    Kind("break", BREAK, r"\n[\x20\x09\x0D]*\n", 2),
)
BASE = [k for k in KINDS if not k.weak]


@dataclass(frozen=True)
class Scan:
    """reach: characters between parts that belong together, at most."""

    reach: int = 200
    kinds: tuple[Kind, ...] = KINDS


PART = "array<struct<kind:int,n:int,gap:int,len:int,ok:boolean>>"


def _matches(number: int, k: Kind) -> Column:
    """All matches of a kind, in order: what lies before each, how long it is, and whether it counts."""
    text, pattern = F.col("text"), F.lit(k.pattern)
    value = (lambda m: F.regexp_extract(m, k.pattern, k.group)) if k.group else (lambda m: m)
    ok = lambda m: reduce(Column.__and__, (m.rlike(p) for p in k.also), F.length(value(m)) >= k.least)
    gaps = F.split("text", k.pattern, -1)
    found = F.zip_with(F.regexp_extract_all("text", pattern, F.lit(0)), gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("m")))
    # pieces are one more than matches; the last has no match behind it
    rows = F.transform(F.filter(found, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), ok(x["m"]).alias("ok")))
    none = F.array().cast(PART)
    here = text.contains(k.has) if k.has else text.isNotNull()
    return F.when(here, rows.cast(PART)).otherwise(none)


def _any(columns: list[str]) -> Column:
    return reduce(Column.__or__, (F.exists(c, lambda x: x["ok"]) for c in columns), F.lit(False))


def matches(spark: SparkSession, docs: DataFrame, p: Scan) -> DataFrame:
    """(row, doc_id, parts) of docs (doc_id, text), written once: each row has a number of its own. Weak kinds are there only where a
    text has parts that could complement each other."""
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    of = {k.name: _matches(i, k) for i, k in enumerate(p.kinds)}
    rows = rows.select("doc_id", *(of[k.name].alias(f"_{k.name}") for k in p.kinds))
    role = lambda *roles: _any([f"_{k.name}" for k in p.kinds if k.role in roles])
    rows = rows.withColumn("whole", role(SECRET) & role(IDENTIFIER, ENDPOINT))
    weak = F.concat(*(F.col(f"_{k.name}") for k in p.kinds if k.weak))
    base = F.concat(*(F.col(f"_{k.name}") for k in p.kinds if not k.weak))
    parts = F.concat(base, F.when(F.col("whole"), weak).otherwise(F.array().cast(PART)))
    return scratch.save(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts")), "matches")


def located(found: DataFrame, p: Scan) -> DataFrame:
    """(row, kind, start, stop, scope) of the parts that count; scope: how many blank lines are before it."""
    number = {k.name: i for i, k in enumerate(p.kinds)}
    rows = found.select("row", F.explode("parts").alias("x")).select("row", "x.*").repartition(n_parts(found.sparkSession), "row")
    order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum((F.col("gap") + F.col("len")).cast("long")).over(order)).where("ok")
    rows = rows.select("row", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop")
    along = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scope = F.sum(F.when(F.col("kind") == number["break"], 1).otherwise(0)).over(along)
    return rows.withColumn("scope", scope).where(F.col("kind") != number["break"])


def complemented(parts: DataFrame, p: Scan) -> DataFrame:
    """(row, kind, start, stop) of weak parts that a complementary one stands by; a row for each."""
    secret = F.col("kind").isin([i for i, k in enumerate(p.kinds) if k.role == SECRET])
    weak = F.col("kind").isin([i for i, k in enumerate(p.kinds) if k.weak])
    at = lambda side, place: F.struct(F.lit(side).alias("side"), place.alias("place"))
    # what stands before a candidate shows its end to it, what stands behind shows its start
    points = parts.select("row", "scope", secret.alias("secret"), F.explode(F.array(at(0, F.col("stop")), at(1, F.col("start")))).alias("x"))
    points = points.select("row", "scope", "secret", "x.side", "x.place", F.expr(f"x.place div {p.reach}").alias("bin"))
    looks = parts.where(weak).select("row", "scope", "kind", "start", "stop", (~secret).alias("secret"), F.explode(F.array(at(0, F.col("start")), at(1, F.col("stop")))).alias("x"))
    first = F.when(F.col("x.side") == 0, F.col("x.place") - p.reach).otherwise(F.col("x.place")).alias("low")
    looks = looks.select("row", "scope", "kind", "start", "stop", "secret", "x.side", first)
    looks = looks.withColumn("bin", F.explode(F.array_distinct(F.array(F.expr(f"greatest(low, 0) div {p.reach}"), F.expr(f"(low + {p.reach}) div {p.reach}")))))
    keys = ["row", "scope", "secret", "side", "bin"]
    near = F.col("place").between(F.col("low"), F.col("low") + p.reach)
    on = reduce(Column.__and__, (looks[c] == points[c] for c in keys)) & near
    return looks.join(points, on, "left_semi").select("row", "kind", "start", "stop").distinct()


def scan(spark: SparkSession, docs: DataFrame, p: Scan = Scan()) -> DataFrame:  # noqa: B008
    """(row, doc_id, parts), a row for each of docs (doc_id, text): parts, array<struct<start, order, kind, stop, weak>>, sorted, are the base
    parts and the weak ones that are linked."""
    found = matches(spark, docs, p)
    parts = Scratch(spark).save(located(found, p), "parts")
    base = parts.where(~F.col("kind").isin([i for i, k in enumerate(p.kinds) if k.weak]))
    named = F.element_at(F.array(*(F.lit(k.name) for k in p.kinds)), F.col("kind") + 1)
    is_weak = F.element_at(F.array(*(F.lit(k.weak) for k in p.kinds)), F.col("kind") + 1)
    one = F.struct("start", F.col("kind").alias("order"), named.alias("kind"), "stop", is_weak.alias("weak"))
    spans = base.select("row", "kind", "start", "stop").unionByName(complemented(parts, p)).select("row", F.lit(None).cast("long").alias("doc_id"), one.alias("part"))
    every = found.select("row", "doc_id", F.lit(None).cast(spans.schema["part"].dataType).alias("part"))
    per = spans.unionByName(every).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))  # of one text
    return per


def digests(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of what scan found."""
    listed = lambda ps: F.array_join(F.transform(ps, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("parts", lambda x: ~x["weak"])
    count = lambda name: F.size(F.filter("parts", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return scanned.select("doc_id", *(count(k.name) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("parts")).alias("spans"), F.size(F.filter("parts", lambda x: x["weak"])).cast("long").alias("n_linked"))


def op13_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(spark, table(spark, sf_dir, "documents")))


def _sql(p: Scan) -> str:
    """The same in DuckDB: patterns by its own engine, places by running sums, links by comparing all parts of a scope."""
    each = []
    for i, k in enumerate(p.kinds):
        pattern = k.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{pattern}', {k.group})" if k.group else "m"
        ok = " AND ".join([f"length({value}) >= {k.least}", *(f"regexp_matches(m, '{a}')" for a in k.also)])
        each.append(
            f"SELECT r, {i} AS kind, n, length(g[n]) AS gap, length(m) AS len, {ok} AS ok FROM (SELECT r, g, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS n"
            f" FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d))"
        )
    inside = lambda f: ", ".join(str(i) for i, k in enumerate(p.kinds) if f(k))
    names = ", ".join(f"'{k.name}'" for k in p.kinds)
    brk = next(i for i, k in enumerate(p.kinds) if k.role == BREAK)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({' UNION ALL '.join(each)}),
s AS (SELECT *, sum(gap + len) OVER (PARTITION BY r, kind ORDER BY n) AS stop FROM m),
w AS (SELECT r, kind, stop - len AS start, stop, sum(CASE WHEN kind = {brk} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY stop - len, kind ROWS UNBOUNDED PRECEDING) AS scope FROM s WHERE ok),
p AS MATERIALIZED (SELECT *, kind IN ({inside(lambda k: k.role == SECRET)}) AS secret, kind IN ({inside(lambda k: k.weak)}) AS weak FROM w WHERE kind <> {brk}),
k AS (SELECT r, kind, start, stop, weak FROM p WHERE NOT weak UNION ALL SELECT r, kind, start, stop, weak FROM p a WHERE weak AND EXISTS (SELECT 1 FROM p b
WHERE b.r = a.r AND b.scope = a.scope AND b.secret <> a.secret AND (a.start - b.stop BETWEEN 0 AND {p.reach} OR b.start - a.stop BETWEEN 0 AND {p.reach}))),
t AS (SELECT *, [{names}][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS t FROM k),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
string_agg(t, ',' ORDER BY start, kind) FILTER (NOT weak) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans, count(*) FILTER (weak) AS n_linked FROM t GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g ON g.r = d.r"""


SQL = _sql(Scan())
