"""Scalars over names, statuses, versions, schedules, paths and times, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses of runs and what they count as, and the schedules that names stand for.
STATUSES = {
    "success": "ok", "pass": "ok", "ok": "ok", "error": "error", "runtime error": "error", "fail": "fail", "warn": "warn",
    "skipped": "skipped", "skip": "skipped", "partial success": "partial", "no op": "noop", "reused": "reused",
}
PRESETS = {
    "@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *",
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *",
}


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(value == k, v).otherwise(out)
    return out


def status(raw: Column) -> Column:
    """A run's status in one spelling; an unknown one stays, in small letters."""
    s = F.regexp_replace(F.lower(F.trim(raw)), "[_-]", " ")
    return F.coalesce(_lookup(s, STATUSES), s)


def normal_cron(cron: Column) -> Column:
    """A schedule with single spaces, a preset's name spelled out; names are told apart by case."""
    c = F.trim(F.regexp_replace(cron, r"\s+", " "))
    return F.coalesce(_lookup(c, PRESETS), c)


def relation_key(name: Column) -> Column:
    """Small letters without quotes or brackets."""
    return F.lower(F.translate(name, "\"`[]", ""))


def identifier(name: Column) -> Column:
    """A name as it is compared: without the quotes around it, in small letters."""
    return F.lower(F.regexp_replace(F.trim(name), "^[\"`\\[]+|[\"`\\]]+$", ""))


def relation_parts(relation: Column) -> Column:
    """The parts of a relation, split at dots outside double quotes."""
    return F.regexp_extract_all(relation, F.lit('((?:"[^"]*"|[^."])+)'), F.lit(1))


def valid_relation(relation: Column) -> Column:
    """Whether a relation has three parts, 512 characters at most and no control characters."""
    return (F.size(relation_parts(relation)) == 3) & (F.length(relation) <= 512) & ~relation.rlike(r"[\x00-\x1f\x7f]")


def cut(text: Column, most: int = 600) -> Column:
    """At most so many characters, then an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def version_before(a: Column, b: Column) -> Column:
    """Whether version a is older than b: as numbers where both read as numbers, else as text."""
    x, y = (F.trim(c.cast("string")).try_cast("double") for c in (a, b))
    return F.coalesce(x < y, a.cast("string") < b.cast("string"))


def version_state(own: Column, latest: Column) -> Column:
    """latest, prerelease, old or none of a version against the latest one; zero and blank count as no version."""
    given = lambda c: F.coalesce((c != "") & F.coalesce(c.try_cast("double") != 0, F.lit(True)), F.lit(False))
    both = given(own) & given(latest)
    return F.when(own == latest, "latest").when(both & version_before(latest, own), "prerelease").when(both & version_before(own, latest), "old").otherwise("none")


def semver_before(a: Column, b: Column) -> Column:
    """Whether a dotted version is older, part by part as numbers."""
    parts = lambda c: F.transform(F.split(F.regexp_extract(c, r"\d+(?:\.\d+)*", 0), r"\."), lambda x: x.try_cast("int"))
    return parts(a) < parts(b)


# The settings of tests and what they are by default.
SETTINGS = {"store_failures": "false", "store_failures_as": "", "where": "", "limit": "", "fail_calc": "count(*)", "warn_if": "!=0", "error_if": "!=0"}


def settings_diff(config: Column) -> Column:
    """key=value of the settings (a struct of strings) that were moved off their defaults; blanks don't count."""
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    each = [F.when(~bare(config[k]).isin("", d), F.concat(F.lit(f"{k}="), config[k])) for k, d in SETTINGS.items()]
    return F.array_compact(F.array(*each))


# Strategies that insert without matching on a key.
KEYLESS = ("append", "insert_overwrite", "replace_where")


def key_ignored(strategy: Column, adapter: str) -> Column:
    """Whether an incremental strategy leaves its key unread; microbatch does but on one adapter."""
    s = F.lower(F.coalesce(strategy, F.lit("")))
    return s.isin(*KEYLESS) | ((s == "microbatch") & F.lit(adapter.lower() != "postgres"))


def freshness(warn_after: Column, error_after: Column, given: Column) -> Column:
    """yes if a threshold (count, period) is whole, no if freshness is given without one, none if nothing is said."""
    whole = lambda t: t["count"].isNotNull() & t["period"].isNotNull()
    return F.when(F.coalesce(whole(warn_after) | whole(error_after), F.lit(False)), "yes").when(given, "no").otherwise("none")


def folder(path: Column) -> Column:
    """The path without its last part; of a bare file name, nothing."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def folders_above(path: Column) -> Column:
    """Every folder above a file, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# The prefix of variables that are never shown, and the words of names that read as credentials.
SECRET_PREFIX = "DBT_ENV_SECRET_"
ALWAYS = ("PASSWORD", "PASSWD", "PWD", "PW", "SECRET", "TOKEN", "CREDENTIAL", "CREDENTIALS", "PRIVATE", "PASSPHRASE")
LAST = ("PASS", "DSN")
BEFORE_KEY = ("API", "ACCESS", "PRIVATE", "SECRET", "ENCRYPTION", "SIGNING")
BEFORE_URL = ("DATABASE", "DB", "CONNECTION", "CONN")


def is_secret(name: Column) -> Column:
    return name.startswith(SECRET_PREFIX)


def reads_as_credential(name: Column) -> Column:
    """By its words between underscores: one that always tells, a last one after another, or a key or address after a telling one."""
    n = F.concat(F.lit("_"), F.upper(name), F.lit("_"))
    any_of = "|".join
    return (
        n.rlike(f"_({any_of(ALWAYS)})_") | n.rlike(f"[^_]_+({any_of(LAST)})_+$") | n.rlike(f"_({any_of(BEFORE_KEY)})_+KEY_") | n.rlike(f"_({any_of(BEFORE_URL)})_+(URL|URI|STR|STRING)_")
    )


def carries_credential(value: Column) -> Column:
    """Whether a value holds a password, as a parameter or in a URL's user part, whatever its name."""
    head = F.substring_index(value, "#", 1)
    parameter = head.rlike(r"(?i)(^|[;&?\s])\s*(password|passwd|pwd)\s*=[^;&?\s]")
    authority = F.regexp_extract(value, r"://([^/?#]*)", 1)
    user = authority.rlike(r"^[^:]*:.+@")
    odd = authority.rlike(r"^[^:@]*:[^@]*[^0-9@][^@]*$") & value.rlike(r"://\S*@")
    return parameter | (value.contains("://") & (user | odd))


def withheld(name: Column, value: Column) -> Column:
    """The value, but of secrets and credentials."""
    hide = is_secret(name) | reads_as_credential(name) | F.coalesce(carries_credential(value), F.lit(False))
    return F.when(hide, F.lit("(withheld)")).otherwise(value)


def substituted(text: Column, known: dict[str, str]) -> Column:
    """text with each {{ env_var('X') }} replaced by what is known of X, else by its default, else left as it is."""
    for k, v in known.items():
        text = F.regexp_replace(text, rf"\{{\{{\s*env_var\(\s*['\"]{k}['\"]\s*(?:,\s*['\"][^'\"]*['\"]\s*)?\)\s*\}}\}}", v.replace("\\", "\\\\").replace("$", "\\$"))
    return F.regexp_replace(text, r"\{\{\s*env_var\(\s*['\"][A-Za-z_0-9]+['\"]\s*,\s*['\"]([^'\"]*)['\"]\s*\)\s*\}\}", "$1")


def macro_arguments(code: Column, name: Column) -> Column:
    """The names of a macro's arguments, in order, from the text of its file; null if the file doesn't define it."""
    found = F.regexp_extract_all(code, F.lit(r"\{%-?\s*macro\s+([A-Za-z_0-9]+\s*\([^)]*)\)"), F.lit(1))
    own = F.get(F.filter(found, lambda x: F.trim(F.substring_index(x, "(", 1)) == name), F.lit(0))
    args = F.split(F.call_function("substring_index", own, F.lit("("), F.lit(-1)), ",")
    return F.filter(F.transform(args, lambda x: F.trim(F.substring_index(x, "=", 1))), lambda x: x != "")


def unset_variables(sql: Column, known: list[str]) -> Column:
    """Variables read without a default that aren't known, in order of name; comments don't count."""
    names = F.regexp_extract_all(F.regexp_replace(sql, r"(?s)\{#.*?#\}", ""), F.lit(r"env_var\(\s*['\"]([A-Za-z_0-9]+)['\"]\s*\)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(names), F.array(*map(F.lit, known)).cast("array<string>")))
