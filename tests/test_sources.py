"""Sources, scope and the merged timeline on small written inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import ulid
from ledgerline.operators import rules, scope, timeline
from ledgerline.pipeline import load_and_merge
from ledgerline.plans import exports
from ledgerline.plans.merge import commands_of
from ledgerline.sources import captures, history
from ledgerline.sources.files import lines, read_bytes, read_files
from ledgerline.sources.logs import agent_a_sessions, agent_b_sessions, scan_agent_a, scan_agent_b

T0 = "2025-03-01T10:00:%02d.000Z"


def at(second, **more):
    return {"timestamp": T0 % second, **more}


LOG = [
    at(0, type="user", content="clean up", session_id="s1", cwd="/w"),
    at(1, type="assistant", content="ok", tool_calls=[{"tool_name": "Bash", "input": {"command": "rm -rf /data", "cwd": "/w"}}]),
    at(2, type="tool_result", tool_name="Bash", output="done", exit_code=0),
    at(3, type="file_edit", path="a.txt", diff="+x"),
    at(4, type="telemetry"),
    "{broken",
    at(40, type="tool", tool_name="Other", output="", exit_code=1),
]
ROLLOUT = [
    {"timestamp": T0 % 0, "type": "session_meta", "payload": {"id": "r1", "cwd": "/r", "cli_version": "9"}},
    {"timestamp": T0 % 1, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}},
    {"timestamp": T0 % 1, "type": "event_msg", "payload": {"type": "user_message", "message": "go"}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command":["bash","-lc","git push --force"]}', "call_id": "c1"}},
    {"timestamp": T0 % 3, "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "pushed"}},
    {"timestamp": T0 % 4, "type": "response_item", "payload": {"type": "message", "role": "system", "content": "no"}},
]


def name(second, n=0):
    return ulid.encode(1740823200000 + second * 1000, bytes([0] * 9 + [n]))


def record(second, **more):
    return {"captureSchemaVersion": 3, "capturedAt": T0 % second, "capturedAtSource": "recorded", "sessionId": "s1", "monoNs": "1", **more}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    text = lambda rows: "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"
    (root / "log.jsonl").write_text(text(LOG))
    (root / "rollout.jsonl").write_text(text(ROLLOUT))
    (root / "bash.txt").write_text("#1740823201\nls -l | wc\n1740823202 echo 'a b'\n: 1740823203:0;rm -rf /x && ls\nplain\n")
    (root / "fish.txt").write_text("- cmd: echo one\\ntwo\n  when: 1740823204\n  paths:\n    - /a\n- cmd: a && rm -rf x\n")
    (root / "reflog.txt").write_text("abc1234 (HEAD -> main) commit: Fix typo 2025-03-01 10:00:05 +0000\nabc1234 commit: short\nabc1234 (HEAD) merge feature-x: Fast-forward\nnothing here\n")
    store = root / "store"
    store.mkdir()
    files = {
        name(1): record(1, argv=["bash", "-c", "rm -rf /data"], cwd="/w", source="claude-pretooluse", inputHash="h1", fileArgs=[{"path": "/w/a", "preSha256": "p1"}], parentProcessTree=[{"pid": 10, "ppid": 1, "exe": "sh", "argv0": "sh"}], envSubset={"HOME": "/h"}),
        name(2): record(2, kind="effect", toolName="Bash", inputHash="h1", intentEventId=name(1), files=[{"path": "/w/a", "preSha256": "p1", "postSha256": "q1", "change": "modified"}, {"path": 3}]),
        name(6): record(6, argv=["ls"], cwd="/w", source="claude-pretooluse", inputHash="h2", fileArgs=[{"path": "/w/a", "preSha256": "zz"}]),
        name(7): record(7, kind="effect", toolName="Bash", inputHash="h9"),
        name(8): record(5, kind="execve", pid=11, ppid=10, ancestry=[10, 1, None], argv=["rm"], exe="/bin/rm", comm="rm"),
        name(50): record(50, kind="execve", pid=99, ppid=98, ancestry=[], argv=[], exe="/bin/x", comm="x"),
        name(9): record(9, kind="capture_failed", phase="write", errorClass="E", message="disk", toolName="Bash"),
        name(10): record(10, argv=["other"], cwd="/", source="shell-shim") | {"sessionId": "zz"},
        name(11): record(11, argv=["free"], cwd="/", source="shell-shim") | {"sessionId": None},
        name(12): {"argv": ["old"], "cwd": "/", "source": "shell-shim"},
        name(13): {"nothing": 1},
        "badname": record(14, argv=["x"]),
    }
    for own, body in files.items():
        (store / f"{own}.json").write_text(json.dumps(body))
        os.utime(store / f"{own}.json", (1740823215, 1740823215))
    (store / "capture-failed.log").write_text(json.dumps({"ulid": name(15), "payload": record(15, kind="capture_failed", phase="read", errorClass="X", message="m")}) + "\n")
    return root


def test_lines_keep_their_numbers(spark, inputs):
    rows = lines(read_files(spark, f"{inputs}/fish.txt")).collect()
    assert [r.line_no for r in rows] == list(range(5))
    (one,) = read_bytes(spark, f"{inputs}/bash.txt").collect()
    assert one.bytes == (inputs / "bash.txt").stat().st_size


def test_agent_a_scan(spark, inputs):
    files = read_files(spark, f"{inputs}/log.jsonl")
    (s,) = agent_a_sessions(files).collect()
    assert (s.agent_session, s.started, s.cwds) == ("s1", T0 % 0, ["/w"])
    events = scan_agent_a(files).orderBy("line_no", "ordinal").collect()
    assert [e.type for e in events] == ["prompt", "assistant_message", "tool_call_intent", "tool_result", "file_diff", "gap", "gap", "tool_result"]
    ids = [e.id for e in events]
    assert [e.parent for e in events] == [None, ids[0], ids[1], ids[2], ids[3], ids[4], ids[5], ids[6]]
    assert len(set(ids)) == len(ids) and [e.mono for e in events] == [0, 1, 2, 2, 3, 4, 5, 6]
    assert events[6].wall_ts == T0 % 0 and json.loads(events[6].payload)["reason"] == "jsonl_line_unparseable"
    assert [e.id for e in scan_agent_a(files.repartition(3)).orderBy("line_no", "ordinal").collect()] == ids


def test_agent_b_scan(spark, inputs):
    files = read_files(spark, f"{inputs}/rollout.jsonl")
    (s,) = agent_b_sessions(files).collect()
    assert (s.form, s.agent_session, s.cwd, s.version, s.started) == ("v2", "r1", "/r", "9", T0 % 0)
    events = scan_agent_b(files).orderBy("line_no", "ordinal").collect()
    assert [(e.type, e.wall_ts) for e in events] == [("prompt", T0 % 1), ("tool_call_intent", T0 % 1), ("shell_command_pre", T0 % 1), ("tool_result", T0 % 3)]
    assert [e.parent for e in events] == [None, events[0].id, events[1].id, events[0].id]
    assert json.loads(events[2].payload)["argv"] == ["bash", "-lc", "git push --force"]


def test_histories(spark, inputs):
    bash = history.scan_history(read_files(spark, f"{inputs}/bash.txt")).orderBy("line_no", "stage").collect()
    assert [(r.at_ms, r.argv) for r in bash] == [(1740823201000, ["ls", "-l"]), (1740823201000, ["wc"]), (1740823202000, ["echo", "a b"]), (1740823203000, ["rm", "-rf", "/x"]), (1740823203000, ["ls"]), (None, ["plain"])]
    assert bash[2].command == "echo 'a b'"
    fish = history.scan_history(read_files(spark, f"{inputs}/fish.txt")).orderBy("line_no", "stage").collect()
    assert [(r.at_ms, r.argv) for r in fish] == [(1740823204000, ["echo", "one", "two"]), (None, ["a"]), (None, ["rm", "-rf", "x"])]


def test_reflog(spark, inputs):
    rows = history.scan_reflog(read_files(spark, f"{inputs}/reflog.txt")).orderBy("line_no").collect()
    assert [(r.commit, r.ref, r.action, r.description) for r in rows] == [("abc1234", "HEAD -> main", "commit", "Fix typo"), ("abc1234", None, "commit", "short"), ("abc1234", "HEAD", "merge feature-x", "Fast-forward"), (None, None, None, None)]
    assert rows[0].at_ms == 1740823205000
    events = history.reflog_events(history.scan_reflog(read_files(spark, f"{inputs}/reflog.txt")), F.lit(T0 % 0))
    assert {r["type"]: r["count"] for r in events.groupBy("type").count().collect()} == {"process_spawn": 3, "gap": 4}


def test_store(spark, inputs):
    files = read_files(spark, f"{inputs}/store")
    rows = {r.id: r for r in captures.scan_store(files).collect()}
    kinds = {k: r.record_kind for k, r in rows.items()}
    assert kinds[name(1)] == "command" and kinds[name(2)] == "effect" and kinds[name(8)] == "execve" and kinds[name(9)] == kinds[name(15)] == "capture_failed"
    assert kinds[name(13)] == kinds["badname"] == "malformed"
    assert [f.path for f in rows[name(2)].r.files] == ["/w/a"] and rows[name(8)].r.ancestry == [10, 1]
    assert (rows[name(12)].captured_source, rows[name(12)].captured_ms) == ("derived-from-mtime", 1740823215000)
    low, high = F.lit(1740823200000 - 60_000), F.lit(1740823200000 + 60_000)
    for opted, want in ((False, "unattributed"), (True, "include")):
        decided = {r.id: r.decision for r in captures.scoped(captures.scan_store(files), F.lit("s1"), F.lit(opted), low, high).collect()}
        assert decided[name(1)] == "include" and decided[name(10)] == "other-session" and decided[name(11)] == want and decided[name(13)] == "malformed"
    stats = captures.store_stats(files).first()
    assert stats.records == 13 and not stats.warn
    assert captures.prunable(files, 1740823215000 + 10_000, 5_000).count() >= 12


def test_merge_links_and_gaps(spark, inputs):
    got = load_and_merge(spark, "s1", agent_a=f"{inputs}/log.jsonl", store=f"{inputs}/store")
    events = got["events"].cache()
    assert {r.decision: r.n for r in got["exclusions"].collect()} == {"other-session": 1, "unattributed": 2, "malformed": 2}
    by = {r.id: r for r in events.collect()}
    reasons = sorted((json.loads(r.payload)["reason"]) for r in by.values() if r.type == "gap")
    assert reasons == sorted(["jsonl_line_unparseable", "unknown_jsonl_line_type", "capture_failed", "capture_failed", "tool_result_without_pre_capture", "pre_capture_without_tool_result", "intent_without_effect", "effect_without_intent", "unwitnessed_file_change", "kernel_execve_without_hook"])
    assert by[name(1)].linked_effect == name(2) and by[name(2)].linked_intent == name(1)
    assert by[name(8)].linked_pre == name(1)
    spawn = json.loads(by[name(8)].payload)
    assert spawn["matchedIntentEventId"] == by[name(8)].linked_pre
    again = load_and_merge(spark, "s1", agent_a=f"{inputs}/log.jsonl", store=f"{inputs}/store")["events"]
    assert sorted(r.id for r in again.select("id").collect()) == sorted(by)
    found = rules.matches(rules.event_commands(commands_of(events)), rules.rule_table(spark))
    assert {r.rule_id for r in found.collect()} == {"rm-rf"} and rules.destructive_index(found).count() == 2
    text = exports.markdown(events, "s1")
    assert text.count("## 2025-03-01 10:00") == 1 and "**GAP intent_without_effect" in text
    assert "<script" not in exports.html(events, "<s1>")
    assert "destructive operations 2" in exports.text_report(events, rules.destructive_index(found))


def test_scope_environment_and_messages(spark):
    row = spark.createDataFrame([({"GH_HOST": "/b", "AWS_SECRET_KEY": "x", "FOO": "1"}, "bad /home/u/x\tz\nmore", "/home/u")], "env map<string,string>, message string, home string")
    got = row.select(scope.redacted_env(F.col("env")).alias("env"), scope.sanitized(F.col("message"), F.col("home")).alias("m")).first()
    assert set(got.env) == {"GH_HOST", "AWS_SECRET_KEY"} and got.env["AWS_SECRET_KEY"].startswith("sha256:") and got.m == "bad ~/x z"


def test_rules_positive_and_negative(spark):
    table = rules.rule_table(spark, [*rules.DEFAULT_RULES, ("broken", "low", None, None, "(", None), ("empty", "low", None, None, None, None)])
    cases = {
        1: ("terraform -chdir=infra destroy", {"terraform-destroy"}),
        2: ("terraform plan", set()),
        3: ("git -C /r push origin main --force", {"git-push-force"}),
        4: ("git push origin my-feature", {"git-push-force"}),  # -f is looked for inside words
        5: ('psql -c "drop  table users"', {"sql-drop"}),
        6: ("rm -r x", set()),
        7: ("ls && sudo rm -rf /", {"rm-rf"}),
        8: ("GIT reset --hard", {"git-reset-hard"}),
        9: ("gh api graphql -f query='mutation { volumeDelete(id: 1) }'", {"railway-volume-delete"}),
    }
    events = spark.createDataFrame([(i, "tool_call_intent", "bash", text, None) for i, (text, _) in cases.items()], "event_id long, type string, tool_name string, command string, argv array<string>")
    found = {}
    for r in rules.matches(rules.event_commands(events), table).collect():
        found.setdefault(r.event_id, set()).add(r.rule_id)
    assert found == {i: want for i, (_, want) in cases.items() if want}
    exact = rules.matches(rules.event_commands(events), table, exact=True)
    assert not exact.where("event_id = 4").count()


def test_hour_sections_are_runs(spark):
    rows = [("s", i, f"2025-01-01T{h}:00:00") for i, h in enumerate(["10", "10", "11", "10"])]
    got = timeline.hour_sections(spark.createDataFrame(rows, "session string, seq long, wall_ts string"), ["session"], ["seq"], "wall_ts").orderBy("section").collect()
    assert [(r.section, r.hour[-2:], r.n) for r in got] == [(1, "10", 2), (2, "11", 1), (3, "10", 1)]


def test_hook_inputs(spark):
    from ledgerline.sources import hooks

    rows = [
        (1, '{"tool_name": "Bash", "tool_input": {"command": "rm -rf ./a /b; ls"}, "cwd": "/w", "session_id": "s", "tool_response": {"status": 3}}'),
        (2, '{"tool_name": "Write", "tool_input": {"file_path": "/f", "n": 1.0}}'),
        (3, '{"tool_name": "Read"}'),
        (4, "{}"),
        (5, "no json"),
    ]
    got = {r.id: r for r in hooks.parse(spark.createDataFrame(rows, "id int, raw string")).collect()}
    assert (got[1].argv, got[1].should_hash, got[1].paths, got[1].exit_code) == (["bash", "-c", "rm -rf ./a /b; ls"], True, ["./a", "/b"], 3)
    import hashlib

    assert got[2].input_hash == hashlib.sha256(b'{"toolInput":{"file_path":"/f","n":1},"toolName":"Write"}').hexdigest()
    assert (got[2].argv, got[2].should_hash) == (["write", "/f"], True) and not got[3].should_hash
    assert [got[i].failed for i in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
    env = spark.createDataFrame([({"GH_TOKEN": "x", "B": "2"},)], "env map<string,string>")
    (e,) = hooks.with_environment(env).collect()
    assert set(e.env_subset) == {"GH_TOKEN"} and e.env_hash == hashlib.sha256(b"B=2\nGH_TOKEN=x").hexdigest()
