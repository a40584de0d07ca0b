"""Plain functions: canonical JSON, shell text, encodings, normalizers."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.functions import crypto, jcs, shell, ulid
from ledgerline.functions.normalize import LAST, agent_a, agent_b, rollout_format, rollout_meta
from ledgerline.plans import verify
from ledgerline.sinks import field_selection, safe_path, selection
from ledgerline.sources.captures import duration_ms
from ledgerline.sources.rulesets import parse_disclosable, parse_ruleset


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (1.0, "1"),
        (-0.0, "0"),
        (1e21, "1e+21"),
        (1e20, "100000000000000000000"),
        (333333333.33333329, "333333333.3333333"),
        (1e-7, "1e-7"),
        (0.000001, "0.000001"),
        (1.5e-10, "1.5e-10"),
        (123456.789, "123456.789"),
        (2**53 + 1, "9007199254740992"),
        (9007199254740991, "9007199254740991"),
        (5e-324, "5e-324"),
        (1.7976931348623157e308, "1.7976931348623157e+308"),
        (4.50, "4.5"),
        (-100, "-100"),
    ],
)
def test_numbers_as_ecmascript_prints_them(value, text):
    assert jcs.canonical(value) == text


def test_canonical_json_sorts_by_utf16_and_escapes_little():
    assert jcs.canonical({"10": 1, "2": 2, "b": None, "a": [True, False]}) == '{"10":1,"2":2,"a":[true,false],"b":null}'
    assert jcs.canonical("\u20ac$\u000f\nA'B\"\\\\\"/") == '"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"'
    assert list(json.loads(jcs.canonical({"\U0001f600": 1, "\ufb33": 2, "\u20ac": 3}))) == ["\u20ac", "\U0001f600", "\ufb33"]
    assert jcs.canonical_text('{"a": 1e2}') == '{"a":100}' and jcs.canonical_text("{") is None and jcs.canonical_text("NaN") is None


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@given(json_values)
@settings(max_examples=200, deadline=None)
def test_canonical_json_is_stable(value):
    text = jcs.canonical(value)
    assert jcs.canonical(json.loads(text)) == text


def argvs(text):
    return [c.argv for c in shell.expand_text(text)]


@pytest.mark.parametrize(
    ("text", "commands"),
    [
        ("a && b || c; d | e & f\ng", [["a"], ["b"], ["c"], ["d"], ["e"], ["f"], ["g"]]),
        ('sqlite3 -cmd "DELETE FROM mice; DELETE FROM rats"', [["sqlite3", "-cmd", "DELETE FROM mice; DELETE FROM rats"]]),
        ("echo 'a b' \"c d\" e\\ f", [["echo", "a b", "c d", "e f"]]),
        ("gzip -9 /srv/old.tar > /tmp/out 2>&1", [["gzip", "-9", "/srv/old.tar"]]),
        ("tee log.md <<'END'\nshred /not/this\nEND\ndate", [["tee", "log.md"], ["date"]]),
        ("cat <<-X\n\tone\n\tX\nls", [["cat"], ["ls"]]),
        ("{ rm -rf /x; } # rm -rf /y", [["rm", "-rf", "/x"]]),
        ("", []),
        ("  \n\t", []),
        ("echo ''", [["echo", ""]]),
        ("a &>log b", [["a", "b"]]),
        ("diff <(sort a) <(sort b)", [["sort", "a"], ["sort", "b"], ["diff", "<(sort a)", "<(sort b)"]]),
        ("echo $((1 + 2)) ${HOME}", [["echo", "$((1 + 2))", "${HOME}"]]),
        ("sudo rm -rf /t", [["rm", "-rf", "/t"]]),
        ("sudo -u mail -n shred -u /var/mbox", [["shred", "-u", "/var/mbox"]]),
        ("env -i -u LANG REGION=north mc rb store/heap", [["mc", "rb", "store/heap"]]),
        ("nice -n 10 rm -rf /x", [["rm", "-rf", "/x"]]),
        ("nice -n10 rm -rf /x", [["rm", "-rf", "/x"]]),
        ("timeout -s HUP 45 mkfs /dev/y", [["mkfs", "/dev/y"]]),
        ('ls -t "my files" | xargs -0 shred -u', [["ls", "-t", "my files"], ["shred", "-u"]]),
        ("command -v rm", [["command", "-v", "rm"]]),
        ("command rm -rf /x", [["rm", "-rf", "/x"]]),
        ('sudo bash -c "env Y=2 helm uninstall web"', [["helm", "uninstall", "web"]]),
        ('/bin/sh -lc "rm -rf /x; echo ok"', [["rm", "-rf", "/x"], ["echo", "ok"]]),
        ("bash deploy.sh --force", [["bash", "deploy.sh", "--force"]]),
    ],
)
def test_simple_commands(text, commands):
    assert argvs(text) == commands


def test_nested_commands_come_first():
    found = shell.split("(cd /prod && rm -rf .) && echo $(terraform destroy -auto-approve) `ls`")
    assert [(c.origin, c.argv) for c in found] == [
        ("subshell", ["cd", "/prod"]),
        ("subshell", ["rm", "-rf", "."]),
        ("substitution", ["terraform", "destroy", "-auto-approve"]),
        ("substitution", ["ls"]),
        ("top", ["echo", "$(terraform destroy -auto-approve)", "`ls`"]),
    ]


def test_wrappers_are_told():
    (c,) = shell.expand_text("AWS_PROFILE=prod TF_VAR_x=1 terraform destroy")
    assert (c.argv, c.wrappers) == (["terraform", "destroy"], ["AWS_PROFILE=", "TF_VAR_x="])
    two = shell.expand_argv(["bash", "-c", "du -sh /data && rm -rf /data/x"])
    assert [(c.idx, c.argv, c.wrappers) for c in two] == [(0, ["du", "-sh", "/data"], ["bash"]), (1, ["rm", "-rf", "/data/x"], ["bash"])]
    (one,) = shell.expand_argv(["sudo", "rm", "-rf", "/x"])
    assert (one.raw_argv, one.argv) == (["sudo", "rm", "-rf", "/x"], ["rm", "-rf", "/x"])


@given(st.text(alphabet="ab \"'\\`$(){};|&<>#\n=-/", max_size=40))
@settings(max_examples=400, deadline=None)
def test_the_splitter_ends_on_any_text(text):
    for c in shell.expand_text(text):
        assert all(isinstance(w, str) for w in c.argv)
    shell.stages(text)
    shell.correlator_words(text)


def test_tokenizers_differ():
    assert shell.stages("echo 'a | b' | grep \"x y\" && c\\ d; e") == [["echo", "a | b"], ["grep", "x y"], ["c d"], ["e"]]
    assert shell.stages("a & b") == [["a", "&", "b"]]
    assert shell.correlator_words("a 'b c'd \"e\" f\\ g") == ["a", "b cd", "e", "f\\", "g"]
    assert shell.quoted(["a", "b c", "it's"]) == "a 'b c' 'it'\\''s'"
    assert shell.without_global_options(["git", "-C", "/r", "push", "-f"]) == ["git", "push", "-f"]
    assert shell.without_global_options(["terraform", "-chdir=x", "destroy"]) == ["terraform", "destroy"]


def test_ulids():
    assert ulid.encode(0, bytes(10)) == "0" * 26
    assert ulid.encode((1 << 48) - 1, b"\xff" * 10) == "7" + "Z" * 25


def test_agent_a_lines():
    kinds = lambda x: [(d.type, d.parent) for d in agent_a(json.dumps(x))]
    assert kinds({"type": "Human", "content": "hi"}) == [("prompt", LAST)]
    assert kinds({"type": "assistant", "content": "x", "tool_calls": [{"tool_name": "Bash", "input": {"command": "ls"}}]}) == [("assistant_message", LAST), ("tool_call_intent", 0)]
    assert kinds({"type": "command", "input": "ls"}) == [("shell_command_pre", LAST), ("shell_command_post", 0)]
    assert kinds({"type": "telemetry"}) == [("gap", LAST)]
    (bad,) = agent_a("{no json")
    assert bad.payload["reason"] == "jsonl_line_unparseable" and bad.payload["detail"] == "{no json"
    (tool,) = agent_a('{"type": "tool", "output": {"a": 1}}')
    assert tool.payload == {"toolName": "unknown", "output": '{"a":1}', "exitCode": None}
    (error,) = agent_a('{"type": "error", "message": "broke"}')
    assert error.payload["message"] == "broke"


def test_agent_a_nested_lines():
    user = {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [1], "is_error": True}, {"type": "text", "text": " "}, {"type": "text", "text": "go"}]}}
    a, b = agent_a(json.dumps(user))
    assert (a.type, a.payload) == ("tool_result", {"toolName": "unknown", "output": "[1]", "exitCode": 1, "error": "Tool returned an error", "toolUseId": "t1"})
    assert (b.type, b.mono) == ("prompt", 2)
    said = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {}}]}}
    out = agent_a(json.dumps(said))
    assert [(d.type, d.parent, d.mono) for d in out] == [("assistant_message", LAST, 0), ("assistant_message", 0, 1), ("tool_call_intent", 1, 2)]
    assert out[0].payload["metadata"] == {"variant": "thinking"} and out[1].payload["content"] == "ab"
    (other,) = agent_a(json.dumps({"type": "x", "message": {"role": "system", "content": []}}))
    assert other.payload["reason"] == "unknown_jsonl_line_type"


def test_agent_b_lines():
    line = lambda p: json.dumps({"timestamp": "2025-01-01T00:00:00Z", "type": "response_item", "payload": p})
    assert [d.type for d in agent_b(line({"type": "function_call", "name": "shell", "arguments": '{"command":["bash","-lc","ls"],"workdir":"/w"}', "call_id": "c"}), "v2")] == ["tool_call_intent", "shell_command_pre"]
    (raw,) = agent_b(line({"type": "function_call", "name": "x", "arguments": "{no"}), "v2")
    assert raw.payload["toolInput"] == {"raw": "{no"}
    (out,) = agent_b(line({"type": "function_call_output", "call_id": "c", "output": '{"output":"done","metadata":{"exit_code":2}}'}), "v2")
    assert out.payload == {"toolName": "unknown", "output": "done", "exitCode": 2, "toolUseId": "c"}
    assert agent_b(line({"type": "reasoning"}), "v2") == [] and agent_b('{"type":"event_msg","payload":{}}', "v2") == []
    assert agent_b("nope", "v2")[0].type == "gap"
    assert rollout_format({"type": "x", "payload": {}}) == "v2" and rollout_format({"role": "user"}) == "v1" and rollout_format([]) is None
    assert rollout_meta({"type": "session_meta", "payload": {"session_id": "s", "cwd": "/w"}}, "v2")["session"] == "s"


def test_consistency_proofs_for_all_small_trees():
    hashes = [hashlib.sha256(bytes([0, i])).digest() for i in range(40)]
    for n in range(1, 41):
        for m in range(1, n + 1):
            proof = verify.consistency_proof(hashes[:n], m)
            assert verify.consistent(verify.root_of(hashes[:m]), m, verify.root_of(hashes[:n]), n, proof)
            if proof:
                assert not verify.consistent(verify.root_of(hashes[:m]), m, verify.root_of(hashes[:n]), n, proof[:-1])
                assert not verify.consistent(bytes(32), m, verify.root_of(hashes[:n]), n, proof)


def test_selections():
    ids = ["A", "B", "C", "D"]
    assert selection("all", ids) == [0, 1, 2, 3] and selection("C,0,1-2", ids) == [0, 1, 2]
    for bad in ("4", "2-1", "x"):
        with pytest.raises(ValueError):
            selection(bad, ids)
    assert field_selection("all") == "all" and field_selection("/a,/b") == {"/a", "/b"}
    for bad in ("", "a", "/a/b"):
        with pytest.raises(ValueError):
            field_selection(bad)


def test_paths_durations_rules():
    assert safe_path("a/b.txt") == "a/b.txt"
    for bad in ("", "/a", "../a", "a/../b", "./a", "a//b", "C:x", "a\\b"):
        with pytest.raises(ValueError):
            safe_path(bad)
    assert duration_ms("30d") == 30 * 86_400_000
    with pytest.raises(ValueError):
        duration_ms("3w")
    found = parse_ruleset("version: 1\nrules:\n- {id: a, severity: odd, matcher: {argvHead: [rm]}}\n- {id: b, severity: high}\n- {severity: low, matcher: {}}\n")
    assert found["rules"] == [("a", "medium", ["rm"], None, None, None)] and parse_ruleset(None)["rules"] == []
    assert parse_disclosable(["prompt.text"]) == {"prompt": {"text"}}
    with pytest.raises(ValueError):
        parse_disclosable(["gap.reason"])


def test_encodings():
    assert crypto.base58(b"\0\0hello") == "11Cn8eVZg"
    assert crypto.cbor({"b": 1, "a": [True, None, -1, b"x", 1000]}) == bytes.fromhex("a2616185f5f6204178" + "1903e8" + "616201")
    with pytest.raises(ValueError):
        crypto.der(b"\x30\x85\0\0\0\0\0")
    with pytest.raises((ValueError, IndexError, StopIteration)):
        crypto.timestamp_info(b"\x30\x03\x02\x01\x00")
