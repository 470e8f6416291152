"""Templates against the same tree in plain Python, flows against a search of the graph."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from tidemark import stored
from tidemark.operators import flows, templates

START = dt.datetime(2024, 3, 1)
NAMES = ["ann", "bob", "cy", "dee", "eli", "fay", "gus", "hal"]


def messages(seed: int, n: int = 400) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.choice(NAMES), rng.choice(NAMES[:3])
        text = rng.choice([f"login of {a} from {b}", f"{a} closed session s{i}", f"job {b} took {i}ms on host-{i % 3} for {a}", "started", f"  paid {i}.50 (ref=A{i}) [{b}]\n  at frame {i}", None, "", " \t"])
        rows.append((rng.choice(["web", "db", None]), text, START + dt.timedelta(seconds=rng.randrange(1000)), f"f{i % 4}", i, 0, None, i))
    return rows + rows[:20]


SCHEMA = "service string, message string, timestamp timestamp, file_id string, line_no int, seq int, template_id string, n int"


def pattern(text: str | None) -> str | None:
    return re.sub(r"\s+", " ", re.sub(templates.VARYING, "<*>", (text or "").split("\n")[0])).strip(" ") or None


def tree(rows: list[tuple], depth: int, most: int) -> dict[tuple, str]:
    """{(service, pattern): template}"""
    found = {(s or "", p): ((s or "", p.count(" ")), []) for s, p in {(r[0], pattern(r[1])) for r in rows} if p}
    for level in range(depth):
        below = defaultdict(set)
        for (_, p), (node, _) in found.items():
            if len(p.split(" ")) > level:
                below[node].add(p.split(" ")[level])
        for key, (node, path) in list(found.items()):
            tokens = key[1].split(" ")
            if len(tokens) > level:
                step = "<*>" if len(below[node]) > most else tokens[level]
                found[key] = ((*node, step), [*path, step])
    places = defaultdict(set)
    for (_, p), (node, _) in found.items():
        for i, t in enumerate(p.split(" ")[depth:]):
            places[node, i].add(t)
    return {key: " ".join(path + ["<*>" if len(places[node, i]) > most else t for i, t in enumerate(key[1].split(" ")[depth:])]) for key, (node, path) in found.items()}


@pytest.mark.parametrize("depth,most,parts", [(3, 2, 1), (3, 2, 7), (1, 4, 3), (0, 3, 3), (9, 5, 2)])
def test_templates_as_the_tree_has_them(spark, depth, most, parts):
    rows = messages(1)
    mined = templates.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts), depth, most)
    of = tree(rows, depth, most)
    assert {(r.service, r.pattern): r.template for r in mined.collect()} == of
    held = defaultdict(list)
    for r in rows:
        if pattern(r[1]):
            held[r[0] or "", of[r[0] or "", pattern(r[1])]].append(r[2])
    found = {(r.service, r.template): (r.n, r.first, r["last"]) for r in templates.templates(mined).collect()}
    assert found == {k: (len(v), min(v), max(v)) for k, v in held.items()}


@pytest.mark.parametrize("most_bytes", [16 << 20, 0])
def test_entries_get_the_id_of_their_template(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(stored, "MAX_BROADCAST_BYTES", most_bytes)
    rows = messages(2)
    entries = spark.createDataFrame(rows, SCHEMA)
    mined = templates.mine(entries, 3, 2)
    ids = {(r.service, r.template): r.template_id for r in mined.collect()}
    of, found = tree(rows, 3, 2), templates.with_template_ids(entries, mined).collect()
    assert len(found) == len(rows) and len(set(ids.values())) == len(ids)
    for r in found:
        p = pattern(r.message)
        assert r.template_id == (ids[r.service or "", of[r.service or "", p]] if p else None)


def test_templates_of_nothing(spark):
    assert templates.templates(templates.mine(spark.createDataFrame([], SCHEMA))).collect() == []


KEYED = "id int, correlation_keys map<string,string>, trace_id string, flow_id string, file_id string, line_no int, seq int, service string, timestamp timestamp"


def keyed(seed: int, n: int = 500) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for i in range(n):
        keys = {k: v for k, v in (("request_id", f"r{i // 3}"), ("user_id", f"u{rng.randrange(200)}"), ("pid", "")) if rng.random() < 0.5} if i % 11 else None
        if keys is not None and i % 10 < 3:
            keys["tenant"] = "hot"
        rows.append((i, keys, rng.choice([None, "", f"t{rng.randrange(400)}"]), None, f"f{i % 3}", i, 0, rng.choice(["a", "b"]), START))
    return rows + rows[:5]


def components(rows: list[tuple], names=None) -> dict[int, frozenset | None]:
    def ids(r):
        every = {(k, v) for k, v in (r[1] or {}).items() if v} | ({("trace_id", r[2])} if r[2] else set())
        return {x for x in every if names is None or x[0] in names}

    holders = defaultdict(set)
    for r in rows:
        for x in ids(r):
            holders[x].add(r[0])
    by_id, out = {r[0]: ids(r) for r in rows}, {}
    for i in by_id:
        if i in out:
            continue
        seen, todo = {i}, [i]
        while todo:
            for x in by_id[todo.pop()]:
                todo += [j for j in holders[x] if j not in seen]
                seen |= holders[x]
        out |= {j: frozenset(seen) if by_id[i] else None for j in seen}
    return out


@pytest.mark.parametrize("most_bytes,hot,names", [(16 << 20, 10_000, None), (0, 5, None), (0, 5, {"request_id", "user_id"})])
def test_flows_are_the_connected_parts(spark, monkeypatch, most_bytes, hot, names):
    monkeypatch.setattr(stored, "MAX_BROADCAST_BYTES", most_bytes)
    monkeypatch.setattr(flows, "HOT", hot)
    rows = keyed(3)
    entries = spark.createDataFrame(rows, KEYED).repartition(3)
    labels = flows.flow_labels(entries, names)
    found = flows.with_flow_ids(entries, labels, names).collect()
    assert len(found) == len(rows)
    parts, named = components(rows, names), defaultdict(set)
    for r in found:
        assert (r.flow_id is None) == (parts[r.id] is None)
        if r.flow_id:
            named[r.flow_id].add(r.id)
    assert {frozenset(v) for v in named.values()} == {p for p in parts.values() if p}
    sizes = {r.flow_id: r.n for r in flows.flows(flows.with_flow_ids(entries, labels, names)).collect()}
    assert sum(sizes.values()) == sum(r.flow_id is not None for r in found)


def test_a_hot_identifier_is_no_task_of_its_own(spark, monkeypatch):
    """Rows of an identifier on a third of the entries are spread over the parts of the join."""
    monkeypatch.setattr(stored, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(flows, "HOT", 50)
    ties = spark.range(3000).selectExpr("concat('r', id) u", "case when id % 3 = 0 then 'hot' else concat('k', id) end v")
    labels = ties.selectExpr("v id", "v label").distinct()
    rows = flows._with_label(ties, "v", labels, spark.createDataFrame([("hot",)], "id string"), "u")
    assert rows.count() == 3000 and rows.filter("label = 'hot'").count() == 1000
    parts = rows.filter("v = 'hot'").selectExpr("pmod(xxhash64(u), 32) p").groupBy("p").count().collect()
    assert len(parts) == 32 and max(r["count"] for r in parts) < 100


def test_flows_of_chains_and_of_nothing(spark):
    chain = [(i, {"a": f"{i}", "b": f"{i + 1}"}, None, None, "f0", i, 0, "s", START) for i in range(60)]
    chain = [(i, {("a" if i % 2 else "b"): f"{i:03d}", ("b" if i % 2 else "a"): f"{i + 1:03d}"}, *r[2:]) for i, r in enumerate(chain)]
    entries = spark.createDataFrame(chain, KEYED)
    assert len({r.flow_id for r in flows.with_flow_ids(entries, flows.flow_labels(entries)).collect()}) == 1
    none = entries.limit(0)
    assert flows.flow_labels(none).collect() == [] == flows.with_flow_ids(none, flows.flow_labels(none)).collect()
