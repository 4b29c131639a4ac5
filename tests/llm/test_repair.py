"""Structure repair against exhaustive search over all edits, with blocks small enough to need every level."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sluice.llm import auction, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at long, place string"
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text): '', 'blank', 'duplicate', 'truncated'."""
    seen, out = set(), []
    for role, text in rows:
        left = text.strip(BLANK)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by dynamic programming over the role string, least audit first."""
    marks = faults(rows)
    accepts = re.compile("(s?(ua)+)?").fullmatch
    # state: what the roles so far end in; solved from the back so that audits compare as strings
    following = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for state, role in following.items():
                if role in best:
                    cost, audit, left = best[role]
                    name = {"u": "user", "a": "assistant"}[role]
                    option = (cost + 5, "I" + audit, [f"{name}:", *left])
                    if state not in best or option[:2] < best[state][:2]:
                        best[state] = option
        return best

    best = inserted({"": (0, "", []), "a": (0, "", [])})
    for (role, text), mark in list(zip(rows, marks, strict=True))[::-1]:
        now = {}
        more = 5 if mark == "truncated" else 0
        for state, expected in following.items():
            options = []
            if state in best:
                cost, audit, left = best[state]
                options.append((cost + 2, "D" + audit, left))
            if mark not in ("blank", "duplicate"):
                first = role[:1]
                to = state if not first else first if first == expected or (state == "" and first == "s") else None
                if to is not None and to in best:
                    cost, audit, left = best[to]
                    options.append((cost + more, "K" + audit, [f"{role}:{text}", *left]))
                if expected in best:
                    cost, audit, left = best[expected]
                    name = {"u": "user", "a": "assistant"}[expected]
                    options.append((cost + 1 + more, "R" + audit, [f"{name}:{text}", *left]))
            if options:
                now[state] = min(options, key=lambda o: o[:2])
        best = inserted(now)
    cost, audit, left = best[""]
    assert accepts("".join(x[:1] for x in left if x[:1] != ":"))
    return cost, audit, "\n".join(left)


def expected(turns):
    """Rows (conv, turn, role, text) before damage -> result rows by conversation."""
    kept = defaultdict(list)
    for conv, turn, role, text in turns:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: told(rows) for conv, rows in kept.items()}


def told(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    pairs = [(role, text) for _, role, text in rows]
    marks = faults(pairs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
    cost, audit, repaired = cheapest(pairs)
    digest = hashlib.sha256(repaired.encode()).hexdigest()
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest)


def conversations(rng, n):
    rows = []
    texts = ["Fine.", "Right!", "Why?", "cut off", " \t", "", None, "Fine.  \n", "é?", "a\nb"]
    for conv in [*range(n), None]:
        size = rng.choice([1, 2, 3, 5, 8, 14])
        for i in range(size):
            turn = rng.choice([i, i, i, i + 1, None])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(99)}.", "x", 1, "y"))
    rows += [(n + 1, i, ["user", "assistant"][i % 2], f"Long talk {i % 70}{'.' if i % 7 else ''}", "x", 1, "y") for i in range(300)]
    rows += rows[:5]  # repeated rows
    rows.append((n + 2, 0, "user", "long word " * 200_000 + ".", "x", 1, "y"))
    return rows


def results(spark, rows, tmp_path, monkeypatch):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:] for r in queries.op12_structure_repair(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("block, fan", [(7, 7), (2, 1), (0, 2)])
def test_cheapest_edits(spark, tmp_path, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK_BITS", block)
    monkeypatch.setattr(repair, "FAN_BITS", fan)
    rows = conversations(random.Random(block), 25)
    got, wanted = results(spark, rows, tmp_path, monkeypatch), expected([r[:4] for r in rows])
    assert got == wanted


def test_empty_table(spark, tmp_path, monkeypatch):
    assert results(spark, [], tmp_path, monkeypatch) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes.")]
    report, repaired = repair.ConversationRepair().apply(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.cost, r.audit) for r in report.collect()] == [(4, "DKDK")]
    assert [(r.role, r.text, r.edit) for r in repaired.orderBy("at", "place").collect()] == [("user", "Hi?", "K"), ("assistant", "Yes.", "K")]


def test_prices_expose_every_shortest_path():
    """Distances and least letters against a search over all paths, whole and cut in stretches."""
    rng = random.Random(4)
    for _ in range(400):
        codes = "".join(auction.symbol(rng.choice([0, 1, 1, 2, 2, 3, 4]), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(1, 7)))

        def paths(row, state, cost, letters, limit):
            if cost > limit:
                return
            if row == len(codes) and state in (auction.START, auction.ASSISTANT):
                yield cost, letters
            if row < len(codes):
                for letter, to, more in auction.row_arcs(codes[row])[state]:
                    yield from paths(row + 1, to, cost + more, letters + letter, limit)
            yield from paths(row, auction.FOLLOWING[state], cost + auction.INSERT, letters + "I", limit)

        letters, _ = auction.rows_trace(codes, auction.ACCEPT, True, (auction.START,))[0]
        cost = auction.walk(codes, letters, auction.START)[1]
        assert (cost, letters) == min(paths(0, auction.START, 0, "", cost))
        if len(codes) > 1:
            parts = [auction.matrix_arcs(auction.rows_stretch(p)) for p in (codes[:1], codes[1:])]
            assert auction.Lattice(parts, auction.ACCEPT, False, True).distance(0) == cost
