"""Release hygiene: drop private fields, redact texts, scan for leaks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import lexicons as lx
from sluice.session import stored


def _pruned(value: Column, kind: T.DataType, private: set[str]) -> Column:
    """The value without private fields at any depth."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in private]
        fields = [_pruned(value.getField(f.name), f.dataType, private).alias(f.name) for f in kept]
        rebuilt = F.struct(*fields) if fields else F.lit(None)
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType) and _has_struct(kind.elementType):
        return F.transform(value, lambda x: _pruned(x, kind.elementType, private))
    if isinstance(kind, T.MapType):
        kept_keys = F.map_filter(value, lambda k, v: ~k.isin(*private)) if kind.keyType == T.StringType() else value
        if _has_struct(kind.valueType):
            return F.transform_values(kept_keys, lambda k, v: _pruned(v, kind.valueType, private))
        return kept_keys
    return value


def _has_struct(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_struct(kind.elementType)
    return isinstance(kind, (T.StructType, T.MapType))


def drop_private(df: DataFrame, private: Sequence[str] = tuple(lx.PRIVATE_FIELDS)) -> DataFrame:
    """Remove named fields from columns, structs, arrays of structs and string-keyed maps."""
    names = set(private)
    kept = [f for f in df.schema.fields if f.name not in names]
    return df.select(*[_pruned(F.col(f.name), f.dataType, names).alias(f.name) for f in kept])


def redacted(text: Column, terms: Sequence[str] = (), patterns: Sequence[str] = tuple(lx.PATH_PATTERNS)) -> Column:
    """Local paths and identifying terms replaced by placeholders."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, "<local-path>")
    for term in terms:
        out = F.replace(out, F.lit(term), F.lit("<anonymous>"))
    return out


def _redact_value(value: Column, kind: T.DataType, terms: Sequence[str]) -> Column:
    if isinstance(kind, T.StringType):
        return redacted(value, terms)
    if isinstance(kind, T.StructType):
        fields = [_redact_value(value.getField(f.name), f.dataType, terms).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redact_value(x, kind.elementType, terms))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _redact_value(v, kind.valueType, terms))
    return value


def redact(df: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """Redact every string of a table, nested ones included."""
    return df.select(*[_redact_value(F.col(f.name), f.dataType, terms).alias(f.name) for f in df.schema.fields])


def leak_scan(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    terms: Sequence[str] = (),
    rules: dict[str, str] | None = None,
) -> DataFrame:
    """(keys, rule) for every text and rule that matched; one pass over the texts."""
    return df.select(*keys, F.explode(_matched(F.col(text), terms, rules)).alias("rule"))


def _matched(text: Column, terms: Sequence[str], rules: dict[str, str] | None) -> Column:
    """The names of all rules and terms that a text matches.  A pattern is tried only where the text has what it can't match without."""
    rules = dict(lx.LEAK_PATTERNS if rules is None else rules)

    def matches(pattern: str) -> Column:
        part = needed(pattern)
        return text.contains(part) & text.rlike(pattern) if part else text.rlike(pattern)

    hits = [F.when(matches(p), F.lit(name)) for name, p in rules.items()]
    hits += [F.when(text.contains(t), F.lit(f"term_{i}")) for i, t in enumerate(terms)]
    return F.array_compact(F.array(*hits))


PARTS = re.compile(r"\\(?P<plain>[^A-Za-z0-9])|\\.|(?P<open>[(\[])|(?P<close>[)\]])|(?P<loose>[?*]|\{[^}]*\})|(?P<bar>\|)|[+.^$]|(?P<char>.)", re.S)


def needed(pattern: str) -> str:
    """The longest literal that every match of a pattern holds, read outside of groups and classes; empty where none is certain."""
    if re.search(r"\\[QEcxuNk0-9]|\(\?[a-zA-Z-]|\[\^?\]", pattern):  # quotes, numbered characters, references, flags, a class that begins with its end
        return ""
    runs, groups, classes = [""], 0, 0
    for m in PARTS.finditer(pattern):
        if m["open"] == "[" or (classes and m["close"] == "]"):
            classes += 1 if m["open"] else -1
            runs.append("")
        elif classes:
            continue
        elif m["open"] or m["close"] == ")":
            groups += 1 if m["open"] else -1
            runs.append("")
        elif groups:
            continue
        elif m["bar"]:
            return ""
        elif m["plain"] or m["char"]:
            runs[-1] += m["plain"] or m["char"]
        else:
            if m["loose"]:
                runs[-1] = runs[-1][:-1]  # the character before may be missing
            runs.append("")
    return max(runs, key=len)


def leak_counts(hits: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return hits.groupBy(*groups, "rule").agg(F.count(F.lit(1)).alias("n"))


def forbidden_paths(schema: T.DataType, names: Sequence[str] = tuple(lx.FORBIDDEN_FIELDS), at: str = "") -> list[str]:
    """Dotted paths of forbidden fields in a schema."""
    found: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            if f.name in names:
                found.append(path)
            found += forbidden_paths(f.dataType, names, path)
    elif isinstance(schema, T.ArrayType):
        found += forbidden_paths(schema.elementType, names, f"{at}[]")
    elif isinstance(schema, T.MapType):
        found += forbidden_paths(schema.valueType, names, f"{at}{{}}")
    return found


def walked(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, json_columns: Sequence[str] = ()) -> DataFrame:
    """Every key and leaf of a table at any depth, without a schema: keys, path, name, text (null unless a string)."""
    return _walked(df, keys, columns, json_columns, lambda text: text).withColumnRenamed("found", "text")


def _walked(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None, json_columns: Sequence[str],
    found: Callable[[Column], Column], kept: Callable[[Column], Column] = lambda found: F.lit(True),
) -> DataFrame:
    """Keys, path, name and what ``found`` makes of the text (null unless a string), where ``kept`` holds of that.

    Columns become variants, strings of ``json_columns`` by what they hold as JSON (a text that is none
    stays a string).  Each level of nesting is one step: containers are unfolded in a lateral join, and
    the steps end when none is left.  A level is unfolded once: what was found there and its containers are
    written together.  Names come as they are meant, whatever escapes spell them.
    """
    spark = df.sparkSession
    names = [c for c in (df.columns if columns is None else columns) if c not in keys]

    def as_variant(c: str) -> Column:
        plain = F.to_variant_object(F.struct(F.col(c).alias("v")))
        if c not in json_columns:
            return F.variant_get(plain, "$.v", "variant")
        return F.coalesce(F.try_parse_json(c), F.variant_get(plain, "$.v", "variant"))

    start = F.array(*(F.struct(F.lit(c).alias("path"), F.lit(c).alias("name"), as_variant(c).alias("v")) for c in names))
    level, out = df.select(*keys, F.explode(start).alias("e")).select(*keys, "e.*"), None
    while True:
        kind = F.schema_of_variant("v")
        container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        text = F.when(kind == "STRING", F.variant_get("v", "$", "string"))
        both = level.select(*keys, "path", "name", text.alias("text"), F.when(container, F.to_json("v")).alias("json"))
        both = both.select(*keys, "path", "name", found(F.col("text")).alias("found"), "json")
        seen = stored(both, "level")
        shown = seen.filter(kept(F.col("found"))).drop("json")
        out = shown if out is None else out.unionByName(shown)
        inner = seen.filter("json is not null").drop("found")
        if inner.isEmpty():
            return out
        inner = inner.withColumn("v", F.parse_json("json")).drop("json").withColumnsRenamed({"path": "above", "name": "within"})
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            *keys,
            F.when(F.col("key").isNull(), F.concat("above", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", "above", "key")).alias("path"),
            F.coalesce("key", "within").alias("name"), F.col("value").alias("v"),
        )


def leak_paths(
    df: DataFrame, keys: Sequence[str], terms: Sequence[str] = (), rules: dict[str, str] | None = None, json_columns: Sequence[str] = ()
) -> DataFrame:
    """(keys, path, rule) for every string of a table, nested ones too, and every rule that matched it."""
    hits = _walked(df, keys, None, json_columns, lambda text: _matched(text, terms, rules), lambda found: F.size(found) > 0)
    return hits.select(*keys, "path", F.explode("found").alias("rule"))


def forbidden_json_keys(df: DataFrame, json_col: str, names: Sequence[str] = tuple(lx.FORBIDDEN_FIELDS)) -> DataFrame:
    """Rows per forbidden key that occurs, at any depth and however spelled, in a JSON string column."""
    row = df.select(F.monotonically_increasing_id().alias("_row"), F.col(json_col).alias("payload"))
    found = _walked(row, ["_row"], None, ["payload"], lambda text: F.lit(None).cast("string")).filter(F.col("name").isin(*names) & (F.col("path") != "payload") & ~F.col("path").endswith("]"))
    return found.select("_row", F.col("name").alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
