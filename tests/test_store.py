import pytest
from pyspark.sql import functions as F

from keepsake.store import Context, MemoryStore, Refused


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = MemoryStore(spark, f"file://{tmp_path_factory.mktemp('store')}", context=Context({"p"}, {"a": "p"}, "reject"), clock=lambda: 1.7e9)
    rows = [(i, "a", "", "", "", text, None, "{}", f"2023-11-1{i}T10:00:00Z") for i, text in enumerate(["apples and pears in the orchard", "raspberry pi with a camera", "the orchard needs water", "apples and pears in the orchard", " "])]
    got = s.store_many(spark.createDataFrame(rows, "seq long, agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string, timestamp string"))
    assert {r.seq: r.result for r in got.collect()} == {0: "stored", 1: "stored", 2: "stored", 3: "skipped", 4: "rejected"}
    return s


def test_store_and_recall(store):
    assert store.store("a", {"content": "note on figs", "source": {"type": "assistant", "id": "x"}}, project_id="@auto") == "stored"
    assert store.store("a", {"content": "note on figs"}, project_id="p") == "skipped"
    with pytest.raises(Refused):
        store.store("a", {"content": "x y z"}, project_id="unknown")
    best = store.recall("a", "orchard apples", limit=3).orderBy(F.desc("place")).first()
    assert best.content == "apples and pears in the orchard" and best.ref.startswith("mem:")
    assert store.recall("b", "orchard apples").count() == 0
    assert store.recall("a", "", limit=2).count() == 2
    sure = store.recall("a", "orchard apples", limit=2, use_confidence=True)
    assert 0 < sure.orderBy(F.desc("place")).first().confidence <= 1
    assert store.table("memory").agg(F.sum("recall_count")).first()[0] >= 1


def test_recall_of_short_words_and_blank_queries(store):
    """Words too short for the index are found literally; a blank query gives the newest rows whatever the pool."""
    found = store.recall("a", "pi", limit=3)
    assert found.where("content like 'raspberry pi%'").count() == 1
    assert store.recall("a", " ", limit=2).select("ref").distinct().count() == 2


def test_two_writers(spark, tmp_path):
    """Appends of two writers both stay; a whole version made from rows that changed since is refused."""
    from keepsake.store import SCHEMAS, Conflict

    one, two = (MemoryStore(spark, f"file://{tmp_path}") for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, "a", "", "u", "x", "t")][:1], "id long, agent_id string, more string, user_id string, content string, updated_at string")
    one.append("profile", row(1))
    since = one.version("profile")
    two.append("profile", row(2))
    with pytest.raises(Conflict):
        one.replace("profile", row(3), since)
    assert sorted(r.id for r in two.table("profile").collect()) == [1, 2]
    one.compact("profile")
    one.append("profile", row(4))
    one.compact("profile")
    assert one.vacuum("profile", 1) > 0 and sorted(r.id for r in two.table("profile").collect()) == [1, 2, 4]
    assert "id long" in SCHEMAS["profile"]


def test_transfer_of_all_kinds(spark, tmp_path):
    """Memories with vectors, counters and locks, episodes and profiles survive an export and an import, and merge."""
    old, new = MemoryStore(spark, f"file://{tmp_path}/old", clock=lambda: 1.7e9), MemoryStore(spark, f"file://{tmp_path}/new", clock=lambda: 1.8e9, io_root=f"file://{tmp_path}/old/io")
    old.store("a", {"content": "figs and dates", "timestamp": "2023-11-01T00:00:00Z"})
    old.store("a", {"content": "quinces"})
    old.lock_memory("a", old.table("memory").where("content = 'quinces'").first().id)
    old.archive_episode("a", "a talk on fruit", keywords="fruit")
    old.update_profile("a", "likes figs")
    old.recall("a", "figs and dates", use_confidence=True)
    old.export_memories("out", "a")
    assert new.import_memories("out") == {"stored": 2, "episodes_stored": 1, "profiles_updated": 1}
    assert new.table("memory").count() == 0
    new.import_memories("out", dry_run=False)
    pick = lambda s: sorted((r.content, r.created_at, r.locked, r.recall_count, r.last_recalled, tuple(r.embedding)) for r in s.table("memory").collect())
    assert pick(new) == pick(old) and any(r[3] == 1 for r in pick(new))
    assert new.table("episode").first().keywords == "fruit" and new.get_profile("a") == "likes figs"
    assert new.import_memories("out", dry_run=False) == {"skipped": 2, "episodes_skipped": 1, "profiles_updated": 1}
    assert new.merge_memories("a", "b", move=True, dry_run=False) == {"moved": 2, "episodes_moved": 1, "profiles_moved": 1}
    assert new.list_episodes("a").count() == 0 and new.get_profile("b") == "likes figs"
    old.update_profile("b", "other")
    assert old.merge_memories("a", "b", move=True, dry_run=False) == {"moved": 2, "episodes_moved": 1, "profiles_left_at_source": 1}
    assert old.get_profile("a") == "likes figs"


def test_repairs(spark, tmp_path):
    from keepsake.store import SCHEMAS

    s = MemoryStore(spark, f"file://{tmp_path}", clock=lambda: 1.7e9)
    rows = [
        (1, "a", "", "", "m", "x" * 17_000, '"user"', "{}", "2023-01-01T00:00:00+09:00", "2023-01-01 00:00:00", [1.0], 0, None, False),
        (2, "a", "", "", "m", "[Memory from Bob] kept text", "{bad", "{bad", "odd", "2023-01-02 00:00:00", None, 0, None, False),
        (3, "a", "", "", "", "  ", "{}", "{}", "", "2023-01-03 00:00:00", None, 0, None, False),
        (4, "a", "", "c", "", "kept text", "{}", "{}", "", "2023-01-04 00:00:00", None, 0, None, False),
        (5, "a", "", "", "", "  ", "{bad", "{}", "", "2023-01-05 00:00:00", [1.0], 0, None, True),
    ]
    s.append("memory", spark.createDataFrame(rows, SCHEMAS["memory"]))
    s.append("episode", spark.createDataFrame([(1, "a", "", "", "sum", "k", None, None, None, False, "2023-01-01 00:00:00")], SCHEMAS["episode"]))
    s.append("task", spark.createDataFrame([(1, "t", "a", "", "{}", 0, "2020-01-01 00:00:00")], SCHEMAS["task"]))
    before = {r.check: r.n for r in s.check_health().collect()}
    assert before["oversized_content"] == before["duplicate_content"] == before["stale_pending_tasks"] == 1 and before["embedding_dimension"] == 2
    after = {r.check: (r.severity, r.n) for r in s.check_health(fix=True).collect()}
    assert [r.check for r in s.check_health().collect()][:2] == ["memory_annotation", "discord_mention"]
    left = {k: n for k, (_, n) in after.items() if n}
    assert left == {"empty_content": 1, "invalid_json_source": 1, "null_embedding": 1, "missing_profile": 1, "anonymous_source": 2}
    got = {r.id: r for r in s.table("memory").collect()}
    assert sorted(got) == [1, 2, 5] and len(got[1].content) == 16_000 and got[1].msg_id == "" and got[1].timestamp == "2022-12-31T15:00:00+00:00"
    assert got[2].content == "kept text" and got[2].timestamp == "2023-01-02T00:00:00+00:00" and len(got[2].embedding) == 64
    assert s.table("episode").first().start_time == "2023-01-01T00:00:00+00:00"


def test_context_that_cannot_be_read(spark, tmp_path):
    bad = Context.parse("{not json")
    s = MemoryStore(spark, f"file://{tmp_path}", context=bad)
    found = {r.check: r.n for r in s.check_health().collect()}
    assert bad.error and found["operating_context_parse"] == 1 and found["operating_context_size"] == 0
    assert Context.parse('{"projects": ["p"], "mode": "warn"}').project("q", "a", True) == "q"


def test_locks_and_deletes(store):
    first = store.table("memory").where("content like 'raspberry%'").first().id
    store.lock_memory("a", first)
    with pytest.raises(Refused):
        store.delete_memory("a", first)
    with pytest.raises(Refused):
        store.update_memory("b", first, "x")
    store.unlock_memory("a", first)
    store.update_memory("a", first, "blueberry pie")
    assert store.get_contents("a", [f"mem:{first}", "mem:0"]).orderBy("pos").collect()[0].content == "blueberry pie"
    store.delete_memory("a", first)
    assert store.list_memories("a").where(F.col("id") == first).count() == 0


def test_pause(store):
    before = store.table("memory").count()
    store.pause_persistence(60)
    assert store.store("a", {"content": "not kept"}) == "paused"
    store.resume_persistence()
    assert store.table("memory").count() == before


def test_episodes_and_profiles(store):
    store.archive_episode("a", "talked about orchards", [{"timestamp": "2023-11-10T10:00:00Z"}, {"timestamp": "2023-11-09T10:00:00Z"}])
    row = store.list_episodes("a").first()
    assert (row.start_time, row.end_time) == ("2023-11-09T10:00:00Z", "2023-11-10T10:00:00Z")
    store.update_profile("a", "likes figs")
    store.update_profile("a", "  ")
    assert store.get_profile("a") == "likes figs"
    with pytest.raises(Refused):
        store.archive_episode("a", " ")


def test_transfer(store):
    path = store.export_memories("out", "a")
    assert path.endswith("/out")
    n = store.table("memory").count()
    assert store.import_memories("out", "b")["stored"] == n
    assert store.import_memories("out", "b", dry_run=False)["stored"] == n
    assert store.import_memories("out", "b")["skipped"] == n
    assert store.merge_memories("b", "a")["skipped"] == n
    with pytest.raises(Refused):
        store.export_memories("../x")
    counts = store.delete_agent_data("b")
    assert counts["memory"] == n and store.table("memory").where("agent_id = 'b'").count() == 0


def test_health(store):
    found = {r.check: r.n for r in store.check_health("a", fix=True).collect()}
    assert found["empty_content"] == 0 and found["duplicate_content"] == 0
    assert store.status("a") in ("healthy", "degraded", "critical")
    assert store.deep_check("a")["short"] == 0


def test_calibration(spark, tmp_path):
    s = MemoryStore(spark, f"file://{tmp_path}", clock=lambda: 1.7e9)
    rows = [(i, "cal", "", "", "", f"sample text number {i}", None, "{}", f"2023-11-01T10:00:{i:02d}Z") for i in range(30)]
    s.store_many(spark.createDataFrame(rows, "seq long, agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string, timestamp string"))
    for method in ("percentile", "zscore", "separation"):
        assert 0.05 <= s.calibrate_threshold("cal", method=method) <= 1.5
    s.set_recall_precision("cal", "strict")
    assert s.get_recall_precision("cal") == "strict" and not s.calibration_stale("cal")
    assert MemoryStore(spark, f"file://{tmp_path}").settings["precision"] == {"cal": "strict"}
    with pytest.raises(Refused):
        s.calibrate_threshold("nobody")


def test_checkup(spark, tmp_path, capsys):
    from keepsake import checkup

    s = MemoryStore(spark, f"file://{tmp_path}")
    s.store("a", {"content": "quinces"})
    s.update_profile("a", "likes quinces")
    assert checkup.main([f"file://{tmp_path}", "--agent", "a"]) == 0
    assert capsys.readouterr().out.strip().endswith("healthy")
