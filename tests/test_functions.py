import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from keepsake.functions import scoring, text
from keepsake.functions.isolation import project_visible, read_axis, visible, written_axis
from keepsake.operators import calibrate, fusion, lexical, retrieval, writes
from keepsake.sources import evalset, jsonl


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_isolation(spark):
    rows = [("a", "", ""), ("a", "p", "c"), ("b", "p", ""), ("a", "q", "d")]
    df = spark.createDataFrame(rows, "agent_id string, project_id string, channel string")
    count = lambda c: df.where(c).count()
    assert [count(visible()), count(visible("a")), count(visible("")), count(visible("a", "p")), count(visible("a", "")), count(visible("a", None, "c"))] == [4, 3, 0, 2, 1, 2]
    assert count(visible("a", None, "")) == 3 and count(project_visible("")) == 1
    assert written_axis(3) == "" and read_axis(3) is None


def test_ascii_lower_only(spark):
    assert values(spark, "c string", [("ÀBc",)], text.lower_ascii(F.col("c"))) == ["Àbc"]


def test_phrases():
    assert text.phrases("CVE-2024-3094 in a のパン のパン") == ["CVE-2024-3094", "のパン"]
    assert text.phrases("パン ab") == []
    assert text.phrases("日本語文") == ["日本語", "本語文"]


def test_overlapping_occurrences(spark):
    assert values(spark, "c string", [("aaaa",), ("a.c abc",)], text.occurrences(F.col("c"), "aaa")) == [2, 0]
    assert values(spark, "c string", [("a.c abc",)], text.occurrences(F.col("c"), "a.c")) == [1]


def test_excluded(spark):
    long = "x" * 40
    rows = [("hello",), ("Hello there",), (long + " tail",), ("x" * 33,), ("",)]
    assert values(spark, "c string", rows, text.excluded(F.col("c"), [" HELLO ", long, ""])) == [True, False, True, True, False]


@pytest.mark.parametrize("raw, seconds", [("1970-01-02", 86400.0), ("1970-01-01 00:00:10", 10.0), ("1970-01-01T09:00:00+09:00", 0.0), ("1970-01-01T00:01Z", 60.0), ("", None), ("x", None), ("2024-01", None), ("12:30", None)])
def test_instant(spark, raw, seconds):
    assert values(spark, "c string", [(raw,)], text.instant(F.col("c"))) == [seconds]


SOURCES = [
    ('{"type":"User","id":"u","name":"n"}', ("User", "u", "n", False)),
    ('{"type":"assistant","id":"a"}', ("Agent", "a", None, True)),
    ('{"type":"session"}', ("System", None, None, True)),
    ('{"User":"u1"}', ("User", "u1", "u1", True)),
    ('{"System":"ep"}', ("System", "ep", "", True)),
    ('{"Agent":{"id":"a","name":"A"}}', ("Agent", "a", "A", True)),
    ('"user"', ("User", "", "", True)),
    ('"some-tool"', (None, None, None, False)),
    ("{}", (None, None, None, False)),
    ("null", (None, None, None, False)),
    ('{"type":"migration"}', (None, None, None, False)),
    ('{"User":"a","Agent":"b"}', (None, None, None, False)),
    ('{"User":[1]}', (None, None, None, False)),
]


def test_normalised_source(spark):
    got = values(spark, "c string", [(s,) for s, _ in SOURCES], text.normalised_source(F.col("c")))
    assert [tuple(r) for r in got] == [want for _, want in SOURCES]


def test_sanitised(spark):
    assert values(spark, "c string", [("[Memory from 2024] 　hi <@!12> ",)], text.sanitised(F.col("c"))) == ["hi"]


def test_adaptive_least(spark):
    got = values(spark, "n long", [(0,), (499,), (10**6,)], scoring.adaptive_least(F.col("n")))
    assert got == [0.5, 0.2, 0.2]


def test_confidence(spark):
    df = spark.createDataFrame([(0.475, 100.0, 3, 10.0, False), (None, 100.0, 0, None, True)], "c double, age double, n long, since double, done boolean")
    got = [r[0] for r in df.select(scoring.confidence(F.col("c"), F.col("age"), F.lit(336.0), F.col("n"), F.col("since"), F.col("done"))).collect()]
    decay = max(min(0.5, 0.3 + math.log(4) * 0.02 / 1.02), 1 / (1 + 100 * 0.0025))
    assert got == [round(math.sqrt(0.5 * decay), 4), round(math.sqrt(1 / 1.25) * 0.3, 4)]


TEXTS = [(1, "Apples and pears in the orchard"), (2, "raspberry pi and apples, apples"), (3, "のパンを食べる"), (4, "CVE-2024-3094 was found"), (5, "an orchard of aaaa trees")]


@pytest.mark.parametrize("search", ["apples", "apples orchard", "のパン", "CVE-2024-3094", "aaa", "and the"])
def test_bm25_like_sqlite(spark, search):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", TEXTS)
    terms = " OR ".join(f'"{t}"' for t in text.phrases(search))
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (terms,))}
    rows = spark.createDataFrame(TEXTS, "id long, content string")
    got = {r.id: r.bm25 for r in retrieval.matching(rows, search).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in got)


@pytest.mark.parametrize("search", ["apples", "apples orchard", "のパン", "CVE-2024-3094", "aaa", "and the", "Apples apples"])
def test_batch_scores_like_single_ones(spark, search):
    """One pass for all phrases gives the scores of a query on its own, over several columns and whatever else is asked."""
    rows = spark.createDataFrame(TEXTS, "id long, content string").withColumn("more", F.reverse("content"))
    got = {r.id: r.bm25 for r in lexical.matching_batch(rows, [lexical.Query(1, search), lexical.Query(2, "trees"), lexical.Query(3, "ab")], 9, None, ("content", "more")).where("qid = 1").collect()}
    assert got == {r.id: r.bm25 for r in retrieval.matching(rows, search, None, None, ("content", "more")).collect()}


def test_literal_fallback(spark):
    rows = spark.createDataFrame([(i, t, f"2024-01-0{i}") for i, t in TEXTS], "id long, content string, created_at string")
    asked = [lexical.Query(1, "PI"), lexical.Query(2, "apples"), lexical.Query(3, "zz"), lexical.Query(4, "an o")]
    got = lexical.keywords_batch(rows, asked, 2, F.col("id") != 1)
    assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == [(1, 2, 1), (2, 2, 1), (4, 5, 1)]


def test_first_row_fits_any_budget(spark):
    rows = spark.createDataFrame([(1, "a" * 30, "t3"), (2, "b" * 8, "t2"), (3, "c" * 30, "t1")], "id long, content string, created_at string").withColumn("qid", F.lit(0))
    got = fusion.degraded(rows, "mem", ("content",), 10, [F.desc("created_at")], 5).orderBy("id").collect()
    assert [(len(r.content), r.content_len, r.content_truncated, r.ref) for r in got] == [(30, None, False, None), (5, 8, True, "mem:2"), (5, 30, True, "mem:3")]
    told = spark.createDataFrame([(0, p, None if p == 2 else f"mem:{p}", "x" * 20) for p in (1, 2, 3)], "qid int, place int, ref string, content string")
    assert [(r.place, len(r.content)) for r in fusion.full_contents(told, 15, 5).orderBy("place").collect()] == [(1, 5), (2, 20), (3, 20)]


def test_gate_refused_rows_are_not_cut(spark):
    rows = spark.createDataFrame([(1, "mem", i, c, True, i) for i, c in enumerate((0.19, 0.1, 0.01))], "qid int, kind string, id long, cosine double, backfilled boolean, ord int")
    assert fusion.autocut(fusion.rescued(fusion.gate(rows, F.lit(10)), rows)).count() == 3


def test_adjacent_rows_meet_across_bins(spark):
    rows = [("a", 1, 1799.0, [1.0, 0.0]), ("a", 2, 1801.0, [1.0, 0.0]), ("a", 3, 3700.0, [0.0, 1.0]), ("b", 4, 1802.0, [0.0, 1.0]), ("a", 5, 3700.0, [0.0, 1.0])]
    got = calibrate.adjacent(spark.createDataFrame(rows, "agent_id string, id long, seconds double, embedding array<float>"))
    assert {r.id: r.sim for r in got.collect()} == {2: 1.0, 5: 1.0}


def test_orphaned_episodes(spark):
    from keepsake.operators import health

    memories = [("a", "2024-01-01T00:00:00Z"), ("a", "2024-03-05T12:00:00Z"), ("b", "2024-02-01T00:00:00Z")]
    episodes = [(1, "a", "2024-01-01 00:00:00", "2024-01-01 00:00:01"), (2, "a", "2024-01-01 00:00:01", "2024-03-05 11:59:59"), (3, "a", "2024-01-01 00:00:01", "9999-12-31 00:00:00"), (4, "b", "2024-03-01 00:00:00", "2024-03-02 00:00:00"), (5, "c", "2024-01-01 00:00:00", "2024-12-01 00:00:00"), (6, "a", "2024-03-05 11:00:00", "2024-03-05 13:00:00")]
    got = health.orphaned(spark.createDataFrame(episodes, "id long, agent_id string, start_time string, end_time string"), spark.createDataFrame(memories, "agent_id string, timestamp string"))
    assert sorted(r.id for r in got.collect()) == [2, 4, 5]


def test_index_drift_names_only_what_differs(spark):
    from keepsake.operators import health

    rows = spark.createDataFrame(TEXTS, "id long, content string")
    index = retrieval.postings(rows.where("id <> 3"), "mem", "content")
    changed = index.withColumn("tri", F.when((F.col("id") == 1) & (F.col("pos") == 0), "zzz").otherwise(F.col("tri")))
    assert health.index_drift(retrieval.postings(rows, "mem", "content"), rows, "mem", "content").first().n == 0
    assert health.index_drift(changed, rows, "mem", "content").first().n == 2 + len(TEXTS[2][1]) - 2


def test_remote_index(spark, tmp_path):
    from keepsake.sources import remote

    def post(action, space, items):
        if space.endswith(":bad"):
            raise OSError("down")
        with (tmp_path / f"{action}-{space.replace(':', '-')}").open("a") as f:
            f.write(f"{len(items)}\n")

    rows = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "a", "text" if i else " ") for i in range(400)], "id long, agent_id string, content string").coalesce(1)
    assert {r.agent_id: (r.sent, r.failed) for r in remote.upsert(rows, "mem", post).collect()} == {"a": (300, 0), "bad": (0, 99)}
    assert (tmp_path / "index-memories-a").read_text().split() == ["128", "128", "44"]
    assert remote.remove(rows.where("agent_id = 'a'"), "mem", post).first().sent == 300


def test_embedding_cache():
    from keepsake.functions.embedding import Cached

    calls, now = [], [0.0]
    cached = Cached(lambda texts: calls.append(list(texts)) or [[float(len(t))] for t in texts], 2, 10, lambda: now[0])
    assert cached(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and cached(["bb"]) == [[2.0]]
    now[0] = 11
    assert cached(["a", "ccc"]) == [[1.0], [3.0]] and calls == [["a", "bb"], ["a", "ccc"]]


def test_local_time(spark):
    assert values(spark, "s double", [(0.0,)], text.local_text(F.col("s"), "Asia/Tokyo")) == ["1970-01-01 09:00:00"]


def test_postings_find_phrases(spark):
    rows = spark.createDataFrame(TEXTS, "id long, content string")
    found = {r.id: r.f for r in retrieval.phrase_hits(retrieval.postings(rows, "mem", "content"), "apples").collect()}
    assert found == {1: 1, 2: 2}


def test_batch_topk_gives_newest_first(spark):
    """Equal similarities are ordered newest first, then by id; a query table gives the same as a list."""
    rows = spark.createDataFrame([(i, [1.0, 0.0], f"2024-01-0{1 + i % 3}") for i in range(9)], "id long, embedding array<float>, created_at string").repartition(3)
    told = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>")
    for queries in ([retrieval.Query(1, "", (1.0, 0.0))], told):
        got = retrieval.similar_batch(rows, queries, 4, 0.1)
        assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (5, 2), (8, 3), (1, 4)]


def test_batch_topk_without_times_goes_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)], "id long, embedding array<float>")
    got = retrieval.similar_batch(rows, [retrieval.Query(1, "", (1.0, 0.0)), retrieval.Query(2, "", (0.0, 1.0))], 3, 0.1)
    assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == [(1, 1, 1), (1, 3, 2), (1, 5, 3), (2, 0, 1), (2, 2, 2), (2, 4, 3)]


def naive_rrf(lists):
    scores, first = {}, {}
    for n, rows in enumerate(lists):
        for pos, key in enumerate(rows):
            scores[key] = scores.get(key, 0) + 1 / (61 + pos)
            first.setdefault(key, (n, pos))
    return sorted(scores, key=lambda k: (-scores[k], first[k]))


def test_rrf_like_naive(spark):
    import random

    rng = random.Random(3)
    lists = [rng.sample(range(12), 8) for _ in range(3)]
    frames = [fusion.listed(spark.createDataFrame([(1, "mem", i, float(-p)) for p, i in enumerate(x)], "qid long, kind string, id long, s double"), n, [F.desc("s")], "s") for n, x in enumerate(lists)]
    got = [r.id for r in fusion.rrf(frames).orderBy("ord").collect()]
    assert got == naive_rrf(lists)


def test_penalised_sums_are_told_apart_to_nine_places(spark):
    """1/65 halved and 1/130 are one number, but not 0.015384615 halved and 0.007692308: the later row comes first."""
    from keepsake.operators.lexical import Query
    from keepsake.plans import recall as plan

    start = 1_704_067_200.0
    memory = spark.createDataFrame([(i, "a", "", "", "", [1.0, float(i)], start - (4e6 if i == 5 else 0), "2024-01-01 00:00:00", "2024-01-01T00:00:00Z", 0, None) for i in range(1, 71)], "id long, agent_id string, project_id string, channel string, content string, embedding array<float>, seconds double, created_at string, timestamp string, recall_count long, last_recalled double")
    episode = spark.createDataFrame([(1, "a", "", "", "", "", None, None, None, False, "2024-01-01 00:00:00")], "id long, agent_id string, project_id string, channel string, summary string, keywords string, embedding array<float>, start_time string, end_time string, resolved boolean, created_at string")
    o = plan.Options(agent="a", limit=70, least=-1.0, scan=None)
    queries = [Query(1, "zz", (1.0, 0.0))]  # cosines fall with the id: row n has place n
    rows = plan.scored(plan.fused(memory, episode, queries, o), memory, episode, queries, o)[0].collect()
    order = [r.id for r in sorted(rows, key=lambda r: r.ord)]
    assert order.index(70) < order.index(5)


def test_excluded_rows_use_up_places(spark):
    df = spark.createDataFrame([(1, "mem", 1, 0.9, True), (1, "mem", 2, 0.8, None)], "qid long, kind string, id long, s double, excluded boolean")
    rows = fusion.rrf([fusion.listed(df, 0, [F.desc("s")], "s")]).collect()
    assert [(r.id, r.rrf) for r in rows] == [(2, 1 / 62)]


def test_separation_of_equal_similarities(spark):
    same = spark.createDataFrame([(0.02,)] * 4, "sim double")
    assert tuple(calibrate.by_separation(same, same).first()) == (0.05, 0.0)


def test_store_in_batch_and_target(spark):
    schema = "agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string"
    target = spark.createDataFrame([("a", "", "", "m1", "old", "{}", "{}")], schema)
    rows = [(1, "a", "p", "", "", "old", None, None), (2, "a", "p", "", "", "new", None, None), (3, "a", "p", "", "", "new", None, None), (4, "a", "p", "", "m1", "x", None, None), (5, "a", "p", "", "", "  ", None, None), (6, "a", "p", "", "", "y", "{}" + " " * 9000, None)]
    got = writes.store(target, spark.createDataFrame(rows, "seq long, " + schema))
    assert {r.seq: r.result for r in got.collect()} == {1: "skipped", 2: "stored", 3: "skipped", 4: "skipped", 5: "rejected", 6: "rejected"}
    exact = writes.imported(target, spark.createDataFrame(rows, "seq long, " + schema))
    assert {r.seq: r.result for r in exact.collect()} == {1: "stored", 2: "stored", 3: "skipped", 4: "stored", 5: "rejected", 6: "rejected"}


def test_store_compares_as_the_target_keeps(spark):
    """Texts beyond the cap: in a table of whole texts the whole text decides, in one of cut texts the cut one."""
    schema = "agent_id string, project_id string, channel string, msg_id string, content string, source string, metadata string"
    long = "x" * 16_000
    rows = spark.createDataFrame([(i, "a", "", "", "", c, None, None) for i, c in enumerate((long + "old", long + "new", long + "new", "  "))], "seq long, " + schema)
    whole = spark.createDataFrame([("a", "", "", "", long + "old", "{}", "{}")], schema)
    assert {r.seq: r.result for r in writes.store(whole, rows, cap=None).collect()} == {0: "skipped", 1: "stored", 2: "skipped", 3: "rejected"}
    cut = spark.createDataFrame([("a", "", "", "", long, "{}", "{}")], schema)
    assert {r.seq: r.result for r in writes.store(cut, rows).collect()} == {0: "skipped", 1: "skipped", 2: "skipped", 3: "rejected"}


def test_jsonl_round_trip(spark, tmp_path):
    memory = spark.createDataFrame([(1, "a", "m", "hé\n", "{}", "t", "{}", "c", "", "", True, 2, 5.0, [1.5, -2.0])], "id long, agent_id string, msg_id string, content string, source string, timestamp string, metadata string, created_at string, project_id string, channel string, locked boolean, recall_count long, last_recalled double, embedding array<float>")
    episode = spark.createDataFrame([], "id long, agent_id string, summary string, keywords string, start_time string, end_time string, created_at string, resolved boolean, project_id string, channel string")
    profile = spark.createDataFrame([("a", "", "p", "u", "")], "agent_id string, user_id string, content string, updated_at string, project_id string")
    path = str(tmp_path / "out")
    jsonl.export(path, memory, episode, profile)
    rows = jsonl.load(spark, path)
    assert jsonl.problems(rows).count() == 0
    first = rows.where("_type = 'memory'").withColumn("vector", jsonl.decode_embedding()).first()
    assert (first.content, first.last_recalled, first.vector) == ("hé\n", 5.0, [1.5, -2.0])
    spark.createDataFrame([("not json",), ('{"_type":"odd"}',)], "value string").coalesce(1).write.mode("append").text(path)
    assert {r.problem: r.n for r in jsonl.problems(jsonl.load(spark, path)).collect()} == {"bad_json": 1, "unknown_type": 1}


def test_embeddings_in_base64(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "embedding array<float>").select(jsonl.encode_embedding().alias("embedding_b64"))
    assert [r[0] for r in df.select(jsonl.decode_embedding()).collect()] == [[1.5, -2.0], None]


def test_judgements(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q1\td1\t1\nq1\td2\t0\n")
    assert [tuple(r) for r in evalset.qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 1), ("q1", "d2", 0)]


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"id":"d1","title":"t","text":"x"}\n{"id":"d2","text":"y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"id":"q1","text":"x?"}\n')
    (tmp_path / "candidates.jsonl").write_text('{"scene_id":"s","candidate_doc_ids":["d1","d2"]}\n')
    assert [tuple(r) for r in evalset.corpus(spark, str(tmp_path / "corpus.jsonl")).collect()] == [("d1", "t", "x"), ("d2", None, "y")]
    assert evalset.queries(spark, str(tmp_path / "queries.jsonl")).first().text == "x?"
    assert evalset.candidates(spark, str(tmp_path / "candidates.jsonl")).first().candidate_doc_ids == ["d1", "d2"]


def test_samples(spark):
    """Without a seed the lowest ids, with one always the same others; only rows of the most frequent width."""
    rows = spark.createDataFrame([(i, [1.0] * (3 if i % 10 == 0 else 2)) for i in range(100)], "id long, embedding array<float>")
    ids = lambda n, seed=None: [r.id for r in calibrate.sample(rows, n, seed).collect()]
    assert ids(3) == [1, 2, 3] and len(ids(500)) == 90
    assert ids(5, 7) == ids(5, 7) != ids(5) and all(i % 10 for i in ids(5, 7))
