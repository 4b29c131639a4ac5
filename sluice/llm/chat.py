"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Events of a conversation are messages, calls and results, each with its place.  Results meet calls in a
hash join on conversation and identifier.  A call may name the call that it follows; the depth of each
call and the last place that any call before it reaches come from pointer doubling, so a chain of n
calls takes log2(n) joins, in a hot conversation too.  Events are ordered by (the latest place they
depend on, depth, own place): a topological order that keeps the given order where it can.  Positions
are distributed ranks, so a conversation is never collected into one task.  Arguments are checked
against the tool's schema, and each event becomes one line of JSON with sorted keys and no blanks.

Status: ``ok``; ``invalid`` (arguments); ``unknown_tool``; ``unanswered`` (call without result);
``duplicate`` (a later call with the same id, or a further result); ``orphan`` (result without call);
``cycle`` (a call that follows itself).  The first that applies, in the order cycle, duplicate, orphan,
unknown_tool, invalid, unanswered.  Defined cases: null conversations are one conversation; null
places come first; null ids link nothing; equal rows stay apart; an empty table gives an empty result.
Arguments that are no JSON, or nested deeper than ``DEEPEST``, are ``invalid`` and kept as their text.
Schemas may nest (``properties``, ``items``), name one type or several, or none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch
from sluice.operators.prefix import ranked

#: JSON types by schema name.
KINDS = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}
DEEPEST = 200


def parsed(text: str | None) -> tuple[object, str | None]:
    """A JSON value, or what is wrong with it: no JSON (NaN and infinities are none), or nested too deep."""
    deepest = depth = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"?', "", text or ""):
        depth += (c in "[{") - (c in "]}")
        deepest = max(deepest, depth)
    if deepest > DEEPEST:
        return None, "too deep"
    try:
        value = json.loads(text if text is not None else "", parse_constant=_no_number)
        canonical(value)
    except (ValueError, RecursionError):
        return None, "not json"
    return value, None


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def value_errors(path: str, given: object, rule: dict) -> list[str]:
    """What a value violates of type (one or a list), enum, minimum, maximum, minLength, properties, required, items."""
    kinds = rule.get("type", list(KINDS))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = any(isinstance(given, KINDS.get(k, ())) and (k == "boolean" or not isinstance(given, bool)) for k in kinds)
    if not fits:
        return [f"{path}: not {' or '.join(kinds)}"]
    if "enum" in rule and given not in rule["enum"]:
        return [f"{path}: not allowed"]
    if isinstance(given, int | float) and not isinstance(given, bool) and not rule.get("minimum", given) <= given <= rule.get("maximum", given):
        return [f"{path}: out of range"]
    if isinstance(given, str) and len(given) < rule.get("minLength", 0):
        return [f"{path}: too short"]
    if isinstance(given, dict) and ("properties" in rule or "required" in rule):
        return field_errors(f"{path}.", given, rule)
    if isinstance(given, list) and "items" in rule:
        return [e for i, x in enumerate(given) for e in value_errors(f"{path}[{i}]", x, rule["items"])]
    return []


def field_errors(path: str, value: dict, schema: dict) -> list[str]:
    fields = schema.get("properties", {})
    errors = [f"{path}{name}: missing" for name in schema.get("required", []) if name not in value]
    for name, given in value.items():
        if name in fields:
            errors += value_errors(path + name, given, fields[name])
        elif not schema.get("additionalProperties", False):
            errors.append(f"{path}{name}: unknown")
    return errors


def argument_errors(arguments: str | None, schema: dict) -> list[str]:
    """What a call's arguments violate, in order of field names."""
    value, wrong = parsed(arguments)
    if wrong:
        return [wrong]
    return sorted(field_errors("", value, schema)) if isinstance(value, dict) else ["not an object"]


def canonical(value: object) -> str:
    """Sorted keys, no blanks; a character that UTF-8 can't hold (half a surrogate pair) stays escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda c: f"\\u{ord(c[0]):04x}", text)


def link_calls(events: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """``events``: conv long, place long, kind, role, call_id, follows, name, payload (strings).

    Returns conv, position (from 1), place, kind, call_id, status, json; one row per event.
    """
    scratch = Scratch(events.sparkSession, "chat")
    base = scratch.put(
        events.select(
            F.coalesce("conv", F.lit(-(1 << 63))).alias("c"), F.coalesce("place", F.lit(-(1 << 63))).alias("p"), "conv", "place",
            "kind", "role", "call_id", "follows", "name", "payload", F.monotonically_increasing_id().alias("row"),
        ),
        "events",
    )
    linked = base.filter("call_id is not null and kind in ('call', 'result')")
    firsts = linked.groupBy("c", "call_id", "kind").agg(F.min(F.struct("p", "row")).alias("first"))
    heads = scratch.put(
        firsts.filter("kind = 'call'").select("c", "call_id", F.col("first.row").alias("row"), F.col("first.p").alias("call_place"))
        .join(firsts.filter("kind = 'result'").select("c", "call_id", F.col("first.row").alias("result_row"), F.col("first.p").alias("result_place")).hint("shuffle_hash"), ["c", "call_id"], "left")
        .join(base.select("c", "row", F.col("follows").alias("parent")), ["c", "row"]),
        "calls",
    )
    chains = _chains(heads, scratch)
    known = heads.select("c", "call_id", "row", "result_row").join(chains, ["c", "call_id"]).withColumnRenamed("row", "call_row")
    joined = base.join(known.hint("shuffle_hash"), ["c", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    at = F.when(is_call | is_result, F.greatest("p", F.col("before"), F.when(is_result, F.col("call_place")))).otherwise(F.col("p"))
    first_status = (
        F.when(is_call & F.coalesce("looped", F.lit(False)), "cycle")
        .when(is_call & (F.col("row") != F.col("call_row")), "duplicate")
        .when(is_result & F.col("call_row").isNotNull() & (F.col("row") != F.col("result_row")), "duplicate")
        .when(is_result & F.col("call_row").isNull(), "orphan")
    )
    placed = joined.select(
        "c", "conv", "place", "p", "row", "kind", "role", "call_id", "name", "payload", F.coalesce(at, F.col("p")).alias("at"),
        F.when(is_call, 2 * F.coalesce("depth", F.lit(0))).when(is_result, 2 * F.coalesce("depth", F.lit(0)) + 1).otherwise(0).cast("long").alias("depth"),
        first_status.alias("status"), (is_call & F.col("result_row").isNull()).alias("open"),
    )
    placed = scratch.put(placed, "placed")
    numbered = ranked(placed.select("c", "at", "depth", "p", "row"), ["at", "depth", "p", "row"], ["c"], "position")
    done = placed.join(numbered.select("row", "position"), "row").select(
        "conv", "position", "place", "kind", "role", "call_id", "name", "payload", "status", "open"
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            status, lines = [], []
            for r in pdf.itertuples(index=False):
                body: dict = {"kind": r.kind, "position": int(r.position)}
                state = r.status
                if r.kind == "call":
                    errors = argument_errors(r.payload, tools[r.name]) if r.name in tools else None
                    state = state or ("unknown_tool" if errors is None else "invalid" if errors else "unanswered" if r.open else "ok")
                    value, wrong = parsed(r.payload) if errors is not None else (None, "unread")
                    body |= {"id": r.call_id, "name": r.name, "arguments": r.payload if wrong else value, "errors": errors or []}
                elif r.kind == "result":
                    body |= {"id": r.call_id, "content": r.payload}
                else:
                    body |= {"role": r.role, "content": r.payload}
                status.append(state or "ok")
                lines.append(canonical(body | {"status": status[-1]}))
            yield pd.DataFrame({"conv": pdf["conv"], "position": pdf["position"], "place": pdf["place"], "kind": pdf["kind"], "call_id": pdf["call_id"], "status": status, "json": lines})

    return done.mapInPandas(write, "conv long, position long, place long, kind string, call_id string, status string, json string")


def _chains(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """Per call: depth in its chain, last place that the calls before it reach, whether it is in a loop."""
    reach = F.greatest("call_place", F.col("result_place"))
    ids = heads.select("c", F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    state = scratch.put(
        heads.join(ids, ["c", "parent"], "left").select(
            "c", "call_id", "call_place", reach.alias("reach"), F.when(F.col("there"), F.col("parent")).alias("up"),
            F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("before"),
        ),
        "chains",
    )
    calls = max(1, heads.count())
    for _ in range(64):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select("c", F.col("call_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("before").alias("over"), F.col("reach").alias("top_reach"))
        state = scratch.put(
            state.join(above, ["c", "up"], "left").select(
                "c", "call_id", "call_place", "reach", F.col("top").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.greatest("before", "over", "top_reach").alias("before"),
            ),
            "chains",
        )
        if state.filter(f"up is not null and depth <= {calls}").isEmpty():
            break
    looped = F.col("up").isNotNull()
    return state.select(
        "c", "call_id", "call_place", F.when(looped, F.lit(0)).otherwise(F.col("depth")).alias("depth"),
        F.when(~looped, F.col("before")).alias("before"), looped.alias("looped"),
    )
