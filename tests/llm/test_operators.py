"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, decontaminate, jaccard, language, lines, mixing, order_minhash, quality, sharding, substrings
from sluice.llm.words import shingles, text_slices, window_hashes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _row string, root string"


def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(300), make(70)
    out = [make(120) for _ in range(12)] + [base, base, base.upper(), base + " tail", "head " + base]
    for i in (10, 150, 290):
        words = base.split()
        words[i] = "changed"
        out.append(" ".join(words))
    out += [make(30) + " " + passage + " " + make(20), passage, make(5) + "\n" + passage + "\tend", make(5000)]
    out += ["one", "one two", "One\x0bTWO", "", None, None, " \n\t ", "Line\nline \n\nLINE", "näïve Ünïcode   text", "same line\nother"]
    out += ["same line\n" + make(3) for _ in range(11)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx" if t and "a" in t else None, ["a", "b", None, "ä"][i % 4], 0, "s", "r", "t") for i, t in enumerate(texts())]
    rows.append((0, rows[0][1], "xx", "a", 0, "s", "r", "t"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text, fold=False):
    data = (text or "").encode()
    return (data.lower() if fold else data).split()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_word_hashes_follow_words():
    column = pa.array(["A b\x0bc", None, "", "a B  c ", "xy"])
    (_, _, data, offsets), = text_slices(column)
    words = words_of(data, offsets, fold=True)
    assert words.counts.tolist() == [3, 0, 0, 3, 1]
    assert words.hash[:3].tolist() == words.hash[3:6].tolist()
    runs, _, bounds = shingles(words, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 2, 1] and runs[0] == runs[2]


@pytest.mark.parametrize("k, percent", [(3, 90)])
def test_jaccard_components(docs, k, percent):
    got = by_id(jaccard.near_duplicates(docs, k, percent))
    sets, root = {}, {}
    for r in docs.collect():
        w = plain_words(r.text, fold=True)
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        root[r.doc_id] = r.doc_id

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), find(d)) for d in sets}
    assert len({find(d) for d in sets}) < len(sets) - 5


def test_jaccard_pivots_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "WORK", 0)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90))
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(98)} for d, t in rows}
    root = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {d: r.component_id for d, r in got.items()} == root


def test_one_per_component_keeps_blank_rows(docs):
    kept = [r.doc_id for r in jaccard.one_per_component(docs).select("doc_id").collect()]
    rows = docs.collect()
    assert sum(not plain_words(r.text) for r in rows) == sum(not plain_words(texts()[d]) for d in kept)
    assert 12 in kept and 13 not in kept and kept.count(0) == 1


def test_substring_dedup(docs):
    got = by_id(substrings.SubstringDedup().apply(docs))
    first = {}
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect()})
    for d, t in rows:
        w = plain_words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in rows:
        w = plain_words(t)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), len(gone), kept)
    assert sum(r.n_removed for r in got.values()) > 500


@pytest.mark.parametrize("period", [1, 7, 13, 31])
def test_difference_cover_reaches_every_distance(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup_over_batches(docs):
    rows = docs.collect()
    batches = [docs.filter(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(docs, batches, min_docs=10).collect())
    held = Counter()
    for r in rows:
        held.update({line_key(x) for x in (r.text or "").split("\n")})
    want = Counter()
    for r in rows:
        every = (r.text or "").split("\n")
        kept = [x for x in every if not line_key(x) or held[line_key(x)] < 10]
        want[r.doc_id, len(every), len(every) - len(kept), "\n".join(kept)] += 1
    assert got == want and any(k[2] for k in got)


def test_settled_lines_are_not_counted_again(spark):
    runs = lines.LineRuns(spark, min_docs=2, fanout=8)
    batch = spark.createDataFrame([("x",), ("x\ny",)], "text string")
    for _ in range(3):
        runs.add(batch)
    assert [run.count() for run in runs.runs()] == [2, 1, 1]  # x is settled by the first batch
    assert runs.frequent().count() == 2


def test_shards_fit_and_are_prefixes(docs):
    limit = 2000
    out = sharding.shard(docs.union(docs).union(docs), limit).collect()
    held, rows = defaultdict(int), Counter()
    for r in out:
        assert r.n_bytes == len((r.text or "").encode())
        held[r.shard] += r.n_bytes
        rows[r.shard] += 1
    assert len(out) == 3 * docs.count() and len(held) > 10
    assert all(b <= limit or rows[s] == 1 for s, b in held.items())
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_mix_targets_and_copies(docs):
    mix = mixing.SourceMix()
    rows, targets, _ = mix.plan(docs, F.array("source"), ["doc_id"])
    again, _, _ = mix.plan(docs, F.array("source"), ["doc_id"])
    found = rows.collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again.collect())
    size, taken = Counter(), Counter()
    for r in found:
        assert r["_size"] == len(plain_words(texts()[r.doc_id])) and 0 <= r.taken <= 3 * r["_size"]
        size[r["_pattern"][0]] += r["_size"]
        taken[r["_pattern"][0]] += r.taken
    weight = {s: [1.0, 2.0, 3.0, 1.0][i] for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    level = sum(size.values()) / sum(weight.values())
    for _ in range(50):
        full = {s for s in size if weight[s] * level >= 3 * size[s]}
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
    for r in targets.collect():
        assert r.source_size == size[r.s] and r.target == pytest.approx(min(weight[r.s] * level, 3 * size[r.s]))
        largest = max(x["_size"] for x in found if x["_pattern"][0] == r.s)
        assert abs(taken[r.s] - r.target) <= largest / 2 + 1


def test_flow_repeats_only_when_it_must():
    ab, a = ("a", "b"), ("a",)
    flow = mixing.min_cost_flow({a: 10.0, ab: 10.0}, {a: ["a"], ab: ["a", "b"]}, {"a": 10.0, "b": 10.0}, 3)
    assert flow == {(a, "a"): 10.0, (ab, "b"): 10.0}
    flow = mixing.min_cost_flow({a: 10.0, ab: 10.0}, {a: ["a"], ab: ["a", "b"]}, {"a": 5.0, "b": 25.0}, 3)
    assert sum(v for (p, s), v in flow.items() if s == "b") == pytest.approx(25.0)
    flow = mixing.min_cost_flow({a: 10.0}, {a: ["a"]}, {"a": 100.0}, 3)
    assert flow == {(a, "a"): 30.0}


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        bits = {}
        for i, c in enumerate(item):
            bits[c] = bits.get(c, 0) | 1 << i
        assert decontaminate.myers(bits, len(item), text) == edit_distance_inside(item, text)


def test_decontamination_against_brute_force(spark, docs, empty):
    rng = random.Random(5)
    items = [(i, " ".join(texts()[i].split()[5:25])) for i in range(4)] + [(8, None), (9, "short")]
    rows = docs.select("doc_id", "text").collect()
    changed = []
    for i, (_, item) in enumerate(items[:4]):
        for edits in (1, 4, 30):
            chars = list(item)
            for _ in range(edits):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            changed.append((100 + 10 * i + edits, "before " + "".join(chars).upper() + "!! after"))
    table = spark.createDataFrame([tuple(r) for r in rows] + changed, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    tool = decontaminate.Decontaminator()
    got = {(r.doc_id, r.item_id): r.distance for r in tool.matches(table, benchmark).collect()}
    want = {}
    for r in table.collect():
        for i, item in items:
            m, t = decontaminate.normalised(item), decontaminate.normalised(r.text)
            if len(m) >= 40 and len(t) < 2000 and (d := edit_distance_inside(m, t)) <= int(0.08 * len(m)):
                want[r.doc_id, i] = d
    assert got == want and len(want) > 8
    clean = tool.clean(table, benchmark)
    assert clean.count() == table.count() - sum((r.doc_id, i) in want for r in table.collect() for i, _ in items)
    assert tool.matches(empty, benchmark).count() == 0 and tool.matches(table, benchmark.limit(0)).count() == 0


def test_order_minhash_with_successors(docs):
    tool = order_minhash.OrderMinHash()
    table = docs.dropDuplicates(["doc_id"])
    got = by_id(tool.against_edits(table))
    rows = sorted((r.doc_id, r.text or "") for r in table.collect())[::-1]
    for i, (d, t) in enumerate(rows):
        after, third = rows[(i + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, two, three = tool.sketches([t, edited, after])
        assert r.fingerprint == tool.written(one[None])[0] and r.near_edited == (one == two).mean() and r.near_next == (one == three).mean()
    assert got[12].fingerprint == got[13].fingerprint
    unlike = [r for d, r in got.items() if 1 <= d < 12]
    assert min(r.near_edited for r in unlike) > max(r.near_next for r in unlike) + 0.05


def test_order_minhash_sees_order():
    tool = order_minhash.OrderMinHash()
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    a, near, swapped = tool.sketches([" ".join(words), " ".join([*words[:190], *words[:10]]), " ".join(words[100:] + words[:100])])
    assert (a == near).mean() > (a == swapped).mean()


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["the", "that", "with", "nation"], "bb": ["der", "nicht", "einheit", "über"], "cc": ["que", "está", "ción", "para"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(sorted(words) * 60)]
    rows += [(900, None, "aa"), (901, "12 -- 34", None), (902, "", "bb"), (903, "nicht über", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.pmod("doc_id", F.lit(5)) == 0)
    model = language.LanguageTrainer(per_class=50).fit(language.train_rows(table, F.col("held_out"), "lang", "text"))
    got = by_id(language.identify(table, model, ["doc_id"]))
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    right = [got[d].lang_pred == k for d, t, k in rows[:180] if d % 5 == 0]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    none = language.LanguageTrainer().fit(language.train_rows(table.limit(0), F.col("held_out"), "lang", "text"))
    assert {r.lang_pred for r in language.identify(table, none, ["doc_id"]).collect()} == {"und"}


def test_language_of_many_copies(spark):
    few = ["the nation that was", "with that nation", "the one with the hat", "that and this"]
    many = [f"der nicht einheit{chr(97 + i % 26) * (i // 26 + 1)} \u00fcber" for i in range(60)]
    rows = [(t, "aa") for t in few for _ in range(500)] + [(t, "bb") for t in many]
    rows += [("con esta palabra", "cc")] * 2000 + [(f"que para {chr(97 + i) * 3}", "cc") for i in range(20)]
    train = spark.createDataFrame(rows, "_text string, _label string")
    trainer = language.LanguageTrainer(per_class=20)
    drawn = defaultdict(list)
    for r in trainer.sample(train).collect():
        drawn[r._label].append(r._text)
    assert sorted(drawn["aa"]) == sorted(few)
    assert {k: (len(v), len(set(v))) for k, v in drawn.items()} == {"aa": (4, 4), "bb": (20, 20), "cc": (20, 20)}
    model = trainer.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    assert model.predict([*few, many[0], "que para aaa"])[0] == ["aa"] * 4 + ["bb", "cc"]


def test_every_language_trains():
    sample = [(f"{c * 5} {c * n}", c, n) for c in "abcdefghij" for n in range(1, 13)]  # the tenth place of the order is always j's
    learnt = language.LanguageTrainer().learn(pd.DataFrame(sample, columns=["_text", "_label", "_rank"]), np.ones(1 << 16)).iloc[0]
    model = language.LanguageModel(learnt.languages, np.frombuffer(learnt.weights, np.float32).reshape(10, -1), learnt.temperature, language.NgramFeatures())
    assert model.predict([c * 4 for c in "abcdefghij"])[0] == list("abcdefghij")


def test_quality(spark, sf_dir):
    from sluice.llm.queries import op9_quality

    got = by_id(op9_quality(spark, sf_dir))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for d, r in got.items() if d in labels and r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.7
    one = spark.createDataFrame([("a b", 1), (None, 1)], "_text string, _label int")
    model = quality.AdditiveTrainer().fit(one)
    assert model.scores(pa.array(["x", None, ""])).tolist() == pytest.approx([2.5 / 3] * 3)
    assert len(quality.AdditiveTrainer().fit(one.limit(0)).scores(pa.array(["x"]))) == 1
    assert quality.features(pa.array([None, "", "a" * 10**6])).shape == (3, len(quality.NAMES))


def test_chat_links(spark):
    tools = {"f": {"properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"]}}
    event = "conv long, place long, kind string, role string, call_id string, follows string, name string, payload string"
    rows = [
        (1, 5, "call", None, "a", None, "f", '{ "n": 3 }'), (1, 2, "result", None, "a", None, None, "three"),
        (1, 1, "call", None, "b", "a", "f", '{"n": 0}'), (1, 9, "result", None, "b", None, None, "zero"),
        (1, 9, "result", None, "b", None, None, "again"), (1, 0, "message", "user", None, None, None, 'sä"y'),
        (2, 0, "call", None, "a", None, "g", "{}"), (2, 1, "result", None, "z", None, None, None), (2, 2, "call", None, "x", None, "f", "no"),
        (2, 3, "call", None, "p", "q", "f", '{"n":1}'), (2, 4, "call", None, "q", "p", "f", '{"n":1}'),
        (2, 5, "call", None, "o", "nowhere", "f", '{"n":1}'), (None, None, "message", None, None, None, None, None),
    ]
    got = chat.link_calls(spark.createDataFrame(rows, event), tools).collect()
    status = {(r.conv, r.call_id, r.kind, json.loads(r.json).get("content")): r.status for r in got}
    assert status[1, "a", "call", None] == "ok" and status[1, "b", "call", None] == "invalid"
    assert sorted(r.status for r in got if r.call_id == "b" and r.kind == "result") == ["duplicate", "ok"]
    assert status[2, "a", "call", None] == "unknown_tool" and status[2, "z", "result", None] == "orphan"
    assert status[2, "x", "call", None] == "invalid" and status[2, "p", "call", None] == status[2, "q", "call", None] == "cycle"
    assert status[2, "o", "call", None] == "unanswered"
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv == 1), key=lambda r: r.position)]
    assert order == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("result", "b")]
    assert all(r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got)
    assert chat.link_calls(spark.createDataFrame([], event), tools).count() == 0


def test_calls_hold_whole_texts(spark):
    from sluice.llm.queries import TOOLS, conversation_events

    said = ["short", "a" * 39 + "é" + "b" * 5000, 'quoted "x"\n' + "word " * 400, "", None]
    rows = [(1, i, "assistant", t) for i, t in enumerate(said)] + [(2, 0, "system", "s" * 100), (2, 1, "user", "u" * 100)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls = [r for r in conversation_events(turns).collect() if r.kind == "call"]
    assert {r.place: json.loads(r.payload)["query"] for r in calls} == {i: t or "" for i, t in enumerate(said)}
    for r in chat.link_calls(conversation_events(turns), TOOLS).collect():
        body = json.loads(r.json)
        if r.kind == "call":
            arguments = body["arguments"] if isinstance(body["arguments"], dict) else json.loads(body["arguments"])
            assert arguments["query"] == (said[r.place] or "")
        else:
            assert body["content"] == ("s" if r.kind == "message" else "u") * 100


def test_long_chain_of_calls(spark):
    event = "conv long, place long, kind string, role string, call_id string, follows string, name string, payload string"
    rows = [(1, i, "call", None, f"c{i}", f"c{i - 1}", "f", "{}") for i in range(40)]
    got = chat.link_calls(spark.createDataFrame(rows[::-1], event), {"f": {}}).collect()
    assert [r.place for r in sorted(got, key=lambda r: r.position)] == list(range(40))


def test_empty_tables(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    assert substrings.SubstringDedup().apply(empty).count() == 0
    assert lines.dedup_lines(empty, []).count() == 0
    assert sharding.shard(empty, 10).count() == 0
    assert mixing.mixed(empty, mixing.SourceMix(), F.array("source")).count() == 0
    assert order_minhash.OrderMinHash().against_edits(empty).count() == 0
    assert order_minhash.OrderMinHash().fingerprints(empty).count() == 0


def mirrored(length):
    """Two words, unlike in every place, that cancel out in polynomials modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 2048])
def test_hashes_hold_against_patterns(spark, length):
    one, two = mirrored(length)
    words = [f"w{i}" for i in range(24)]
    rows = [(1, one), (2, two), (3, " ".join([*words, one, *words, "end"])), (4, " ".join([*words, two, *words, "end"]))]
    rows += [(5, " ".join(mirrored(length)[0])), (6, " ".join(mirrored(length)[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(jaccard.near_duplicates(docs, 3, 90))
    assert [found[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert jaccard.one_per_component(docs).filter("doc_id < 5").count() == 4
    kept = by_id(substrings.SubstringDedup().apply(docs))
    assert kept[4].n_removed == 0


def test_window_hashes_are_of_the_run_alone():
    values = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    twice = np.concatenate((values, values))
    for length in (1, 2, 3, 7, 20, 50, 64):
        one, two = window_hashes(twice, length), window_hashes(twice, length, 1)
        assert len(one) == 400 - length + 1 and (one[: 200 - length + 1] == one[200:]).all() and (two[: 200 - length + 1] == two[200:]).all()
        assert len(np.unique(one)) == 200 and not (one == two).any()


@pytest.mark.parametrize("kind, ids", [("int", [1, 2, None]), ("string", ["a", "b", None])])
def test_items_by_any_id_and_of_any_length(spark, kind, ids):
    items = ["a question of one line that is long enough", "short one", "..."]
    benchmark = spark.createDataFrame(list(zip(ids, items, strict=True)), f"item_id {kind}, text string")
    texts = ["nothing here", f"x {items[0]}? y", "A short, one!", "short oneself", "nothing", None, "", f"{items[1]} {items[0]}"] * 2
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts[:8])], "doc_id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = decontaminate.Decontaminator().matches(docs.repartition(1), benchmark)
        assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == {("1", ids[0], 0), ("2", ids[1], 0), ("7", ids[0], 0), ("7", ids[1], 0)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert decontaminate.Decontaminator().clean(docs, benchmark).count() == 5


def test_arguments_of_any_shape():
    schema = {
        "properties": {"q": {"type": ["string", "null"]}, "n": {}, "l": {"type": "array", "items": {"type": "integer", "minimum": 1}}, "o": {"type": "object", "properties": {"a": {"type": "boolean"}}, "required": ["a"]}},
        "required": ["q"],
    }
    cases = {
        '{"q":"\\ud800"}': [], '{"q":null,"n":[1]}': [], '{"q":"]]]]{{"}': [], "[" * 100_000: ["too deep"], '{"q":NaN}': ["not json"], '{"q":1e999}': ["not json"],
        '{"q":1}': ["q: not string or null"], '{"q":"x","l":[1,0,"a"],"o":{}}': ["l[1]: out of range", "l[2]: not integer", "o.a: missing"], "[1]": ["not an object"], "": ["not json"],
    }
    assert {a: chat.argument_errors(a, schema) for a in cases} == cases
    assert chat.canonical(chat.parsed('{"b":"\\ud800é","a":1}')[0]).encode() == '{"a":1,"b":"\\ud800é"}'.encode()


def test_odd_arguments_are_written(spark):
    rows = [(1, i, "call", "assistant", f"c{i}", None, "t", a) for i, a in enumerate(['{"q":"\\ud800"}', "[" * 3000, '{"q":NaN}', None, '{"q":{"q":1}}'])]
    events = spark.createDataFrame(rows, "conv long, place long, kind string, role string, call_id string, follows string, name string, payload string")
    got = {r.place: (r.status, json.loads(r.json)["errors"]) for r in chat.link_calls(events, {"t": {"properties": {"q": {}}}}).collect()}
    assert got == {0: ("unanswered", []), 1: ("invalid", ["too deep"]), 2: ("invalid", ["not json"]), 3: ("invalid", ["not json"]), 4: ("unanswered", [])}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["_row", "_copy", "_h1", "_h2", "_c1", "_depth0", "_id", "_doc", "component", "copies"]
    rows = [(i, f"text number {i} of many words in a line", "s", *(f"{n}-{i}" for n in names)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    wanted = sorted(map(tuple, rows))
    assert sorted(map(tuple, jaccard.one_per_component(docs).collect())) == wanted
    assert set(map(tuple, mixing.mixed(docs, mixing.SourceMix(), F.array("source")).collect())) == set(wanted)
    assert sorted(tuple(r)[: len(wanted[0])] for r in sharding.shard(docs, 100).collect()) == wanted
