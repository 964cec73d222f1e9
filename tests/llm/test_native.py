"""Tool calls and URL filters."""

import inspect
import json
import random
from collections import Counter, defaultdict

import pytest

from stockroom.llm import chat, urls
from stockroom.llm.chat import format_chat
from stockroom.llm.urls import RULES, judge

TOOLS = json.dumps({"content": "hi", "tools": [{"name": "f", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}, "c": {"type": "array"}}, "required": ["a"]}}]})


def calls(*found, **more):
    return json.dumps({"tool_calls": list(found), **more})


def messages(spark, rows):
    got = format_chat(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, status string")).collect()
    key = lambda r: (r["conv_id"] is None, r["conv_id"] or 0, -1 if r["order_turn"] is None else r["order_turn"], r["order_level"], r["order_at"], r["order_kind"], -1 if r["turn"] is None else r["turn"])
    return sorted(got, key=key)


def test_no_python_on_the_main_path():
    for m in (chat, urls):
        assert not any(x in inspect.getsource(m) for x in ("udf", "mapIn", "applyIn", "rdd", "toPandas"))


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "user", "q"),
        (1, 2, "assistant", calls({"id": "c2", "name": "f", "arguments": {"b": "z", "a": 1}, "depends_on": ["c1", "never"]}, {"id": "c1", "name": "f", "arguments": {"a": "no", "c": [1]}}, {"id": "c3", "name": "f", "arguments": {"b": "x"}}, {"id": "c4", "name": "g", "arguments": {}}, {"name": "f", "arguments": {"a": 1}}, {"id": "c5", "name": "f", "arguments": [1]}, content="x")),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": {"y": 1, "b": [2, {"d": 1, "c": None}]}})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (1, 5, "tool", json.dumps({"tool_call_id": "c2", "content": "ok"})), (1, 6, "tool", json.dumps({"tool_call_id": "c2", "content": "again"})),
    ]
    got = messages(spark, rows)
    assert [(r["kind"], r["call_id"], r["status"], r["problem"]) for r in got] == [
        ("message", None, None, None), ("message", None, None, None), ("message", None, None, None),
        ("call", "c1", "linked", "type: a"), ("result", "c1", "linked", None), ("call", "c3", "unanswered", "missing: a"), ("call", "c4", "unanswered", "no schema"), ("call", "c5", "unanswered", "not an object"),
        ("call", "c2", "linked", None), ("result", "c2", "linked", None), ("result", "c2", "linked", None), ("call", None, "unanswered", "no id"), ("result", "zz", "orphan", None),
    ]
    assert got[4]["json"] == '{"content":{"b":[2,{"c":null,"d":1}],"y":1},"role":"tool","tool_call_id":"c1"}'
    assert got[8]["valid"] and got[8]["json"] == '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":"z"},"id":"c2","name":"f"}}'
    assert all(json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"] for r in got)


def test_cycles_chains_and_awkward_rows(spark):
    chain = [{"id": f"n{i}", "name": "f", "arguments": {"a": i}, "depends_on": [f"n{i + 1}"]} for i in range(6)] + [{"id": "n6", "name": "f"}]
    rows = [
        (2, 0, "assistant", calls({"id": "p", "name": "f", "depends_on": ["q"]}, {"id": "q", "name": "f", "depends_on": ["p"]}, {"id": "r", "name": "f", "depends_on": ["q"]})), (2, 1, None, None), (3, 0, "assistant", '{bad "tool_calls"'), (3, 1, "user", TOOLS), (3, 2, "tool", "plain"),
        (4, 0, "assistant", calls(*chain)), (None, 0, "user", "x"), (None, None, None, None), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (6, 0, "user", "long " * 50_000), (7, 0, "assistant", '{"tool_calls": "none"}'), (7, 1, "assistant", '{"tool_calls": []}'),
    ]
    got = messages(spark, rows)
    by = defaultdict(list)
    for r in got:
        by[r["conv_id"]].append(r)
    assert [r["status"] for r in by[2] if r["kind"] == "call"] == ["cycle"] * 3 and json.loads(by[2][1]["json"]) in ({"content": "", "role": "unknown"}, {"role": "assistant", "tool_call": {"id": "p", "name": "f"}})
    assert [r["kind"] for r in by[3]] == ["message"] * 3 and json.loads(by[3][1]["json"])["content"] == TOOLS
    assert [r["call_id"] for r in by[4] if r["kind"] == "call"] == [f"n{i}" for i in range(6, -1, -1)]
    assert len(by[5]) == 2 and len(by[None]) == 2 and len(json.loads(by[6][0]["json"])["content"]) == 250_000
    assert [json.loads(r["json"])["content"] for r in by[7]] == ['{"tool_calls": "none"}', ""]
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_all_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    assert sorted((r["conv_id"], r["turn"], json.loads(r["json"])["role"], json.loads(r["json"])["content"]) for r in got) == sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows)


def judged(spark, rows):
    return {r["page_id"]: r for r in judge(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, rule string, trust double")).collect()}


def test_rules(spark):
    cases = {
        "https://A.Example.ORG/en/12?q": ("a.example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/es/x": ("example.org", "/es/x", "example.org/es/", "block"), "http://notexample.org/es/x": ("notexample.org", "/es/x", "org/", "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"), "http://x.com/de": ("x.com", "/de", None, "allow"), "http://x.org#/": ("x.org", "", None, "allow"), "http://x.org?/": ("x.org", "", None, "allow"), "x.org/": ("", "", None, "allow"), "http://x.org/://y/": ("x.org", "/://y/", "org/", "allow"), "": ("", "", None, "allow"),
        "ftp://É.COM/fr/": ("É.com", "/fr/", "com/fr/", "allow"),
    }
    got = judged(spark, [(i, u, None) for i, u in enumerate(cases)] + [(99, None, None), (None, None, None)])
    for i, (u, (host, path, rule, verdict)) in enumerate(cases.items()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert rule is None or got[i]["verdict"] == verdict
    assert (got[99]["host"], got[99]["verdict"]) == ("", "allow") and len(got) == len(cases) + 2
    assert [len(r) for r in RULES] == [3] * 5


def test_trust_and_distrust_spread(spark):
    hub = "".join(f'<a href="http://t{i}.net/">' for i in range(40))
    rows = [(0, "http://good.org/", hub), (1, "http://t1.net/", "<a href='http://t2.net/x'><a HREF=//t2.net>"), (2, "http://t2.net/", None), (3, "http://bad.net/", "<a href=http://c.com/de/>"), (4, "http://c.com/de/", ""), (5, "http://worse.net/", '<a href="https://bad.net/">'), (6, "http://lone.net/", '<a href="/local">')]
    got = judged(spark, rows)
    assert {i: got[i]["verdict"] for i in got} == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}
    # brute force
    edges = {("good.org", f"t{i}.net"): 1 for i in range(40)} | {("t1.net", "t2.net"): 1, ("bad.net", "c.com"): 1, ("worse.net", "bad.net"): 1}
    for kind, pairs, seed in (("trust", edges, {"good.org": 1}), ("distrust", {(b, a): n for (a, b), n in edges.items()}, {"c.com": 1})):
        out, start = defaultdict(float), {h: 0.15 * n / 2 for h, n in seed.items()}
        for (a, _), n in pairs.items():
            out[a] += n
        now = dict(start)
        for _ in range(400):
            nxt = defaultdict(float, start)
            for (a, b), n in pairs.items():
                nxt[b] += 0.85 * now.get(a, 0) * n / out[a]
            now = nxt
        for i, u in ((0, "good.org"), (1, "t1.net"), (2, "t2.net"), (3, "bad.net"), (4, "c.com"), (5, "worse.net")):
            assert got[i][kind] == pytest.approx(now.get(u, 0), rel=1e-6, abs=1e-15)
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_chains_and_cycles_are_told_apart(spark):
    """A chain of 150 calls, a ladder whose calls have two needs, both in one conversation, beside cycles of 3 and what waits for them."""
    chain = [{"id": f"n{i}", "name": "f", "depends_on": [f"n{i + 1}"]} for i in range(149)] + [{"id": "n149", "name": "f"}]
    ladder = [{"id": f"m{i}", "name": "f", "depends_on": [x for x in (f"m{i + 1}", f"m{i + 2}") if int(x[1:]) < 9]} for i in range(9)]
    loop = [{"id": "x", "name": "f", "depends_on": ["y"]}, {"id": "y", "name": "f", "depends_on": ["z", "n149"]}, {"id": "z", "name": "f", "depends_on": ["x"]}, {"id": "own", "name": "f", "depends_on": ["own"]}, {"id": "behind", "name": "f", "depends_on": ["n5", "x"]}]
    mixed = [{"id": "top", "name": "f", "depends_on": ["n3", "m2", "n80"]}]
    got = [r for r in messages(spark, [(1, 0, "assistant", calls(*chain, *ladder, *loop, *mixed))]) if r["kind"] == "call"]
    want = {f"n{i}": 149 - i for i in range(150)} | {f"m{i}": 8 - i for i in range(9)} | {"top": 147}
    assert {r["call_id"]: r["order_level"] for r in got if r["status"] != "cycle"} == want
    assert {r["call_id"] for r in got if r["status"] == "cycle"} == {"x", "y", "z", "own", "behind"} == {r["call_id"] for r in got[-5:]}


@pytest.mark.parametrize("n", [26, 45])
def test_distrust_reaches_the_end_of_a_chain_of_hosts(spark, n):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(n)] + [(n, f"http://h{n}.net/", '<a href="http://end.com/">'), (n + 1, "http://end.com/de/", None), (n + 2, "http://apart.net/", None)]
    got = judged(spark, rows)
    assert {i for i in got if got[i]["verdict"] == "block"} == set(range(n + 2))


def test_equal_trust_and_distrust_do_not_block(spark):
    rows = [(0, "http://a.org/", '<a href="http://mid.net/"> <a href="http://x.net/">'), (1, "http://mid.net/", '<a href="http://b.com/">'), (2, "http://b.com/de/", None), (3, "http://y.net/", '<a href="http://b.com/">'), (4, "http://x.net/", None)]
    got = judged(spark, rows)
    assert got[1]["trust"] == pytest.approx(got[1]["distrust"], rel=1e-9) and got[1]["verdict"] == "allow" and got[3]["verdict"] == "block"


def test_hubs_and_hot_hosts_give_the_same(spark, monkeypatch):
    """A hub with many links in and out, and a host of most pages, with buckets and joins apart from a few rows on."""
    rnd = random.Random(1)
    rows = [(i, f"http://n{i % 40}.{'org' if i % 7 == 0 else 'net'}/", "".join(f'<a href="http://n{rnd.randrange(40)}.net/">' for _ in range(3)) + '<a href="http://hub.net/">') for i in range(120)]
    rows += [(200 + i, "http://hub.net/", "".join(f'<a href="http://n{j}.net/">' for j in range(40))) for i in range(100)] + [(400, "http://x.com/de/", ""), (401, "http://n3.net/q", '<a href="http://x.com/">'), (402, None, None)]
    want = judged(spark, rows)
    from stockroom.llm import scratch

    monkeypatch.setattr(scratch, "HOT", 5)
    monkeypatch.setattr(urls, "HUB", 4)
    got = judged(spark, rows)
    assert {i: r["verdict"] for i, r in got.items()} == {i: r["verdict"] for i, r in want.items()} and len(got) == len(rows)
    assert all(got[i]["distrust"] == pytest.approx(want[i]["distrust"], rel=1e-9) and got[i]["trust"] == pytest.approx(want[i]["trust"], rel=1e-9) for i in want)
    assert len({r["verdict"] for r in want.values()}) == 2


def breaks(schema, v, path=""):
    """(keyword, place) of all that is wrong with a JSON value, by plain Python."""
    out, here = [], path or "$"
    at = lambda k: f"{path}.{k}" if path else k
    if schema is False:
        return [("type", here)]
    if schema is True:
        return []
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    is_a = {"string": isinstance(v, str), "integer": number and float(v).is_integer(), "number": number, "boolean": isinstance(v, bool), "object": isinstance(v, dict), "array": isinstance(v, list), "null": v is None}
    same = lambda a, b: type(a) is not bool and type(b) is not bool and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b or json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    types = schema.get("type")
    if types is not None and not any(is_a[t] for t in ([types] if isinstance(types, str) else types)):
        out.append(("type", here))
    if "enum" in schema and not any(same(v, e) for e in schema["enum"]):
        out.append(("enum", here))
    if "const" in schema and not same(v, schema["const"]):
        out.append(("const", here))
    if number:
        for k, bad in (("minimum", lambda m: v < m), ("maximum", lambda m: v > m), ("exclusiveMinimum", lambda m: v <= m), ("exclusiveMaximum", lambda m: v >= m), ("multipleOf", lambda m: v % m != 0)):
            out += [(k, here)] if k in schema and bad(schema[k]) else []
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        if isinstance(v, kind):
            out += [(low, here)] if len(v) < schema.get(low, 0) else []
            out += [(high, here)] if len(v) > schema.get(high, 10**9) else []
    if isinstance(v, list):
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            out.append(("uniqueItems", here))
        if "items" in schema:
            out += [b for i, x in enumerate(v) for b in breaks(schema["items"], x, f"{path}[{i}]")]
    if isinstance(v, dict):
        out += [("missing", at(k)) for k in schema.get("required", []) if k not in v]
        for k, x in v.items():
            if k in schema.get("properties", {}):
                out += breaks(schema["properties"][k], x, at(k))
            elif schema.get("additionalProperties") is False:
                out.append(("additionalProperties", at(k)))
            elif "additionalProperties" in schema:
                out += breaks(schema["additionalProperties"], x, at(k))
    for sub in schema.get("allOf", []):
        out += breaks(sub, v, path)
    return out


ORDER = ["missing", *chat.CHECKED[1:]]


def told(schema, v):
    if not isinstance(v, dict):
        return "not an object"
    found = breaks(schema, v)
    if not found:
        return None
    first = min((k for k, _ in found), key=ORDER.index)
    return f"{first}: " + ", ".join(sorted({p for k, p in found if k == first}))


NESTED = {
    "type": "object", "required": ["q", "opt"], "additionalProperties": False, "maxProperties": 5,
    "properties": {
        "q": {"type": ["string", "null"], "minLength": 2, "maxLength": 4}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9}, "kind": {"enum": ["a", 1, None, {"x": [1]}]}, "c": {"const": 2}, "f": {"type": "number", "exclusiveMinimum": 0, "maximum": 1.5, "multipleOf": 0.25},
        "list": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "minItems": 1, "maxItems": 2}}}}, "opt": {"type": "object", "additionalProperties": {"type": "boolean"}, "minProperties": 1}, "both": {"allOf": [{"type": "integer"}, {"minimum": 3}]}, "any": True, "never": False,
    },
}


def test_nested_schemas_against_plain_python(spark):
    good = {"q": None, "opt": {"x": True}}
    cases = [good, {}, [], "x", None, {"q": "a", "opt": {}}, {"q": "abcde", "opt": {"x": 1}}, {"q": 5, "opt": []}, good | {"zz": 1, "q": "ab"}, good | {"n": 1.0}, good | {"n": 1.5}, good | {"n": 9}, good | {"n": 0}, good | {"n": 99999999999999999999}, good | {"kind": 1.0}, good | {"kind": {"x": [1]}}, good | {"kind": "b"}, good | {"kind": None}, good | {"kind": True}]
    cases += [good | {"c": 2}, good | {"c": 2.0}, good | {"c": "2"}, good | {"f": 0.75}, good | {"f": 0}, good | {"f": 1.75}, good | {"f": 0.3}, good | {"f": 1e30}, good | {"list": [{"id": 1, "tags": ["a"]}, {"tags": ["a", "a"]}, 4, {"id": "x", "tags": []}]}, good | {"list": []}, good | {"list": [{"id": 1, "tags": ["a", "b", "c"]}, {"id": 2, "tags": [1]}]}, good | {"both": 3}, good | {"both": 2}, good | {"both": "s"}, good | {"any": [1]}, good | {"never": 1}, good | {"a": 1, "b": 2, "c": 2, "f": 1}, good | {"q": "é😀"}]
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": NESTED}]}))] + [(1, i + 1, "assistant", calls({"id": f"i{i}", "name": "f", "arguments": a})) for i, a in enumerate(cases)]
    got = {r["call_id"]: (r["problem"], r["valid"]) for r in messages(spark, rows) if r["kind"] == "call"}
    want = {f"i{i}": told(NESTED, a) for i, a in enumerate(cases)}
    assert got == {k: (p, p is None) for k, p in want.items()}
    assert len({(p or "").split(":")[0] for p in want.values()}) > 12


def test_schemas_that_cannot_be_judged_say_so(spark):
    schema = {"properties": {"a": {"anyOf": [{"type": "string"}]}, "b": {"type": "integer"}, "d": {"type": "date"}}}
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": schema}, {"name": "free"}]})), (1, 1, "assistant", calls({"id": "1", "name": "f", "arguments": {"a": 1}}, {"id": "2", "name": "f", "arguments": {"a": 1, "b": "x"}}, {"id": "3", "name": "f", "arguments": {"b": 2}}, {"id": "4", "name": "f", "arguments": {"d": 2}}, {"id": "5", "name": "free", "arguments": {"d": 2}}))]
    got = {r["call_id"]: (r["problem"], r["valid"]) for r in messages(spark, rows) if r["kind"] == "call"}
    assert got == {"1": ("unsupported: a: anyOf", None), "2": ("type: b", False), "3": (None, True), "4": ("unsupported: d: type", None), "5": (None, True)}


def linked_by_hand(rows):
    """(conv, kind, call id, status, problem, turn, level) of all messages, by plain Python."""
    found, results, schemas, out = defaultdict(list), defaultdict(list), {}, []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[3] or "")):
        body = json.loads(text) if text and text.startswith("{") else None
        if role == "tool" and body and "tool_call_id" in body:
            results[conv, body["tool_call_id"]].append(turn)
            continue
        out.append((conv, "message", None, None, None, turn, -1))
        for tool in (body or {}).get("tools", []) if role == "system" else []:
            schemas.setdefault((conv, tool["name"]), tool["parameters"])
        for at, c in enumerate((body or {}).get("tool_calls", []) if role == "assistant" else []):
            found[conv, c["id"]].append((turn, at, c))
    needs = {k: {(k[0], d) for _, _, c in v for d in c.get("depends_on", []) if (k[0], d) in found} for k, v in found.items()}
    level = {}
    while ready := [k for k in found if k not in level and all(n in level for n in needs[k])]:
        level |= {k: max((level[n] + 1 for n in needs[k]), default=0) for k in ready}
    for k, v in found.items():
        first = min((t, a) for t, a, _ in v)
        for t, a, c in v:
            problem = told(schemas[k[0], c["name"]], c.get("arguments")) if (k[0], c["name"]) in schemas else "no schema"
            out.append((k[0], "call", k[1], "cycle" if k not in level else "linked" if results.get(k) and (t, a) == first else "unanswered", problem, t, level.get(k, chat.UNSETTLED)))
    for k, turns in results.items():
        out += [(k[0], "result", k[1], "linked" if k in found else "orphan", None, min((x, a) for x, a, _ in found[k])[0] if k in found else t, level.get(k, chat.UNSETTLED) if k in found else 0) for t in turns]
    return Counter(out)


@pytest.mark.parametrize("hot", [10**6, 3])
def test_generated_conversations_against_plain_python(spark, monkeypatch, hot):
    """Repeated turns and ids, orphans, cycles, chains, one conversation of most rows; also with hot keys joined apart."""
    from stockroom.llm import scratch

    monkeypatch.setattr(scratch, "HOT", hot)
    rnd, rows = random.Random(4), []
    small = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "o": {"properties": {"p": {"enum": [1, 2]}}}}}
    for conv in [1] * 25 + [2, 3, 4, 5] * 4:
        ids = [f"c{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 5))]
        made = [{"id": i, "name": rnd.choice("fg"), "arguments": rnd.choice([{"a": 1}, {"a": -1}, {}, {"a": "x"}, {"a": 2, "o": {"p": 3}}, [], {"a": 0, "o": {"p": 2}}]), "depends_on": [f"c{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 2))]} for i in dict.fromkeys(ids)]
        rows.append((conv, rnd.randrange(1, 12), "assistant", calls(*made)))
        rows += [(conv, rnd.randrange(5, 20), "tool", json.dumps({"tool_call_id": f"c{rnd.randrange(35)}", "content": i})) for i in range(3)]
    rows.append((5, 4, "assistant", calls(*({"id": i, "name": "f", "arguments": {"a": 1}, "depends_on": [n]} for i, n in (("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x4", "x1"))))))
    rows += [(c, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": small}]})) for c in range(1, 6)] + [(9, 1, "user", "hi"), (9, 2, "assistant", None)]
    got = Counter((r["conv_id"], r["kind"], r["call_id"], r["status"], r["problem"], r["order_turn"], r["order_level"]) for r in messages(spark, rows))
    want = linked_by_hand(rows)
    assert got == want, (got - want, want - got)
    assert {k[3] for k in want} == {None, "linked", "unanswered", "orphan", "cycle"}


def test_two_rows_of_one_turn_keep_their_own_verdicts(spark):
    rows = [(1, 0, "system", TOOLS), (1, 1, "assistant", calls({"id": "a", "name": "f", "arguments": {"a": 1}})), (1, 1, "assistant", calls({"id": "b", "name": "f", "arguments": {}}))]
    got = sorted((r["call_id"], r["valid"], r["problem"]) for r in messages(spark, rows) if r["kind"] == "call")
    assert got == [("a", True, None), ("b", False, "missing: a")]
