import json
import random
import re

from marlstone.llm.chat import format_chats, op7_chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "note": {"type": "string"}}, "required": ["a", "b"]}}]}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(out, key=lambda r: (str(r.conv_id), r.anchor if r.anchor is not None else -1, r.step, r.turn or 0, r.place))


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)), (1, 1, "user", "add things"),
        (1, 2, "assistant", call(("c2", "add", {"b": "$ref:c1", "a": 2}), ("c1", "add", {"b": 1.5, "a": 1, "note": "x"}), content="on it")),
        (1, 3, "tool", result("c2", "5")), (1, 4, "tool", result("c1", "2.5")), (1, 5, "tool", result("zz", "?")),
        (1, 6, "assistant", call(("c3", "add", {"a": "1", "z": {"q": 1, "b": [1]}}), ("c4", "nope", {}), ("c5", "add", {"a": "$ref:c6", "b": 1}), ("c6", "add", {"a": "$ref:c5", "b": 1}))),
        (2, 0, "user", None), (2, 0, "user", None), (2, 1, "tool", result("c1", "other conversation")), (None, None, "assistant", "{not json"),
    ]
    got = run(spark, rows)
    one = [(r.status, r.call_id, r.role) for r in got if r.conv_id == 1]
    assert one[:7] == [("message", None, "system"), ("message", None, "user"), ("message", None, "assistant"), ("linked", "c1", "assistant"), ("linked", "c1", "tool"), ("linked", "c2", "assistant"), ("linked", "c2", "tool")]
    by = {(r.call_id, r.role): r for r in got if r.conv_id == 1}
    assert by["zz", "tool"].status == "orphan" and by["c3", "assistant"].status == "unanswered"
    assert by["c5", "assistant"].status == by["c6", "assistant"].status == "cycle"
    assert by["c1", "assistant"].problems == [] and by["c3", "assistant"].problems == ["missing b", "type of a", "unknown z"] and by["c4", "assistant"].problems == ["undeclared tool"]
    assert json.loads(by["c3", "assistant"].json)["arguments"] == '{"a":"1","z":{"b":[1],"q":1}}'
    assert [r.status for r in got if r.conv_id != 1] == ["message", "message", "orphan", "message"]
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_repeated_identifiers_link_in_order(spark):
    rows = [(1, 0, "assistant", call(("c", "f", {"k": 1}))), (1, 1, "tool", result("c", "one")), (1, 2, "assistant", call(("c", "f", {"k": 2}))), (1, 3, "tool", result("c", "two"))]
    assert [(r.role, r.status) for r in run(spark, rows)] == [("assistant", "linked"), ("tool", "linked")] * 2


def test_whole_table_and_empty(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = op7_chat(spark, sf_dir).collect()
    assert sorted((r.conv_id, r.turn, r.role, json.loads(r.json)["content"]) for r in got) == sorted((r.conv_id, r.turn, r.role, r.text) for r in source)
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def brute(rows):
    """(conv, call id, turn, place, role) -> (status, anchor, step) of calls and results, by plain Python."""
    calls, results = [], []
    for conv, turn, role, text in rows:
        if not (text or "").lstrip().startswith("{"):
            continue
        x = json.loads(text)
        if role == "assistant" and x.get("tool_calls"):
            calls += [[conv, turn, place, c["id"], re.findall(r'"\$ref:([^"]+)"', json.dumps(c["arguments"], separators=(",", ":")))] for place, c in enumerate(x["tool_calls"])]
        elif role == "tool" and x.get("tool_call_id") is not None:
            results.append([conv, turn, 0, x["tool_call_id"]])
    for events in (calls, results):
        seen = {}
        for e in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
            k = (e[0], e[3])
            seen[k] = seen.get(k, 0) + 1
            e.append(seen[k] if None not in k else 1)
    first = {(c[0], c[3]): i for i, c in enumerate(calls) if c[5] == 1 and c[3] is not None and c[0] is not None}
    done, more = {}, True
    while more:
        ready = {}
        for i, (conv, turn, place, name, refs, use) in enumerate(calls):
            on = [first.get((conv, r)) for r in set(refs)]
            if i not in done and all(o in done for o in on):
                ready[i] = (max([done[o][0] + 2 for o in on], default=0), max([turn, *(done[o][1] for o in on)]))
        done |= ready
        more = bool(ready)
    answered = {(r[0], r[3], r[4]) for r in results if None not in (r[0], r[3])}
    out, of = {}, {}
    for i, (conv, turn, place, name, refs, use) in enumerate(calls):
        step, anchor = done.get(i, (0, turn))
        status = "cycle" if i not in done else "linked" if (conv, name, use) in answered else "unanswered"
        out[conv, name, turn, place, "assistant"] = (status, anchor, step)
        if None not in (conv, name):
            of[conv, name, use] = (anchor, step, place)
    for conv, turn, place, name, use in results:
        there = of.get((conv, name, use)) if None not in (conv, name) else None
        out[conv, name, turn, there[2] if there else 0, "tool"] = ("linked", there[0], there[1] + 1) if there else ("orphan", turn, 0)
    return out


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for conv in range(30):
        names = [f"c{k}" for k in range(rng.randint(1, 9))] + ["again", "again"]
        rng.shuffle(names)
        for turn, name in enumerate(names):
            refs = {f"a{k}": f"$ref:{rng.choice(names)}" if rng.random() < 0.5 else k for k in range(rng.randint(0, 2))}
            rows.append((conv, 2 * turn, "assistant", call((name, "f", refs), *([(f"x{turn}", "f", {"r": f"$ref:{name}"})] if rng.random() < 0.3 else []))))
            if rng.random() < 0.7:
                rows.append((conv, 2 * turn + 1, "tool", result(rng.choice(names), "r")))
    rows += [(99, k, "assistant", call((f"d{k}", "f", {"of": f"$ref:d{k - 1}"} if k else {}))) for k in range(19)]
    rows += [(98, k, "assistant", call((None, "f", {}))) for k in range(3)]
    got = [r for r in run(spark, rows) if r.status != "message"]
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.status, r.anchor, r.step) == want[r.conv_id, r.call_id, r.turn, r.place, r.role], r


def test_the_last_declaration_of_a_tool_holds(spark):
    declare = lambda **p: json.dumps({"tools": [{"name": "f", "parameters": {"properties": p, "required": list(p)}}]})
    rows = [(1, 5, "system", declare(b={"type": "string"})), (1, 2, "system", declare(z={"type": "string"})), (1, 6, "assistant", call(("c", "f", {"b": "x"})))]
    assert next(r.problems for r in run(spark, rows) if r.call_id == "c") == []
