"""Documents with fields of the wrong type, the price join, and the shared folder."""

import json
import re

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import accounting, embedding, inputs, similarity
from trafficlens.session import shared_dir
from trafficlens.sources import documents
from trafficlens.sources.driver_views import base, view
from trafficlens.sources.tables import pricing_df

GOOD = {"model": "m", "messages": [{"role": "user", "content": "x"}]}
CASES = [
    (GOOD, None),
    ({"model": "m", "messages": []}, None),
    (GOOD | {"temperature": "0.5", "max_tokens": 5.0, "top_p": 1, "user": "u"}, None),
    (GOOD | {"max_tokens": "7", "temperature": True, "user": None}, None),
    (GOOD | {"model": 5}, "bad model"),
    (GOOD | {"model": None}, "model missing"),
    ({"model": "m"}, "messages missing"),
    (GOOD | {"messages": "x"}, "messages missing"),
    (GOOD | {"messages": [{"role": "tool", "content": "x"}]}, "bad role"),
    (GOOD | {"messages": ["x"]}, "bad role"),
    (GOOD | {"messages": [{"role": "user"}]}, "content missing"),
    (GOOD | {"messages": [{"role": "user", "content": ["a", {"b": 1}]}]}, "bad content"),
    (GOOD | {"messages": [{"role": "user", "content": 12}]}, "bad content"),
    (GOOD | {"max_tokens": 5.5}, "bad number"),
    (GOOD | {"temperature": "warm"}, "bad number"),
    (GOOD | {"temperature": [1]}, "bad number"),
    (GOOD | {"user": 3}, "bad user"),
    ([GOOD], "malformed"),
]


def test_request_types(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(CASES)] + [(100, "{"), (101, None)]
    good, bad = documents.parse_requests(spark.createDataFrame(rows, "id int, body string"))
    assert {r["id"]: r["problem"] for r in bad.collect()} == {i: p for i, (_, p) in enumerate(CASES) if p} | {100: "malformed", 101: "malformed"}
    found = {r["id"]: r for r in good.collect()}
    assert sorted(found) == [i for i, (_, p) in enumerate(CASES) if not p]
    assert (found[2]["temperature"], found[2]["max_tokens"], found[2]["top_p"], found[2]["user"]) == (0.5, 5, 1.0, "u")
    assert (found[3]["temperature"], found[3]["max_tokens"], found[3]["user"]) == (1.0, 7, None)


def test_a_document_is_parsed_once(spark, sf):
    for side in documents.parse_requests(view(spark, sf, "request_docs")):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("parse_?json", plan, re.IGNORECASE)) == 1 and "from_json" not in plan


def test_input_types(spark):
    texts = ['"a"', '["a","b"]', "[]", '["a",5]', '["a",null]', '["a",{"x":1}]', "42", "{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, input string")
    good, bad = inputs.explode_inputs(df)
    assert sorted((r["id"], r["pos"], r["text"]) for r in good.collect()) == [(0, 0, "a"), (1, 0, "a"), (1, 1, "b")]
    assert {r["id"]: r["problem"] for r in bad.collect()} == {2: "input empty"} | {i: "malformed" for i in range(3, 9)}


def test_prices_are_joined_without_moving_the_log(spark, sf):
    usage = view(spark, sf, "usage_logs").drop("cost_usd")
    plan = accounting.with_cost(usage, pricing_df(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_every_conversation_is_asked_for(spark):
    sf = "/root/testdata/sf0.1"
    used = view(spark, sf, "requests_flat").select("conv_id").distinct().count()
    assert used == base(spark, sf, "conversations").select("conv_id").distinct().count()


@pytest.mark.parametrize("parts", [1, 8])
def test_the_first_failing_chunk_names_the_error(spark, parts):
    def factory():
        def embed(texts, model):
            for t in texts:
                if t.startswith("bad"):
                    raise ValueError(f"refused {t}")
            return [[1.0, 2.0]] * len(texts)

        return embed

    rows = [(j, p, f"bad{p}" if j == 1 and p in (70, 95) else f"text {p}") for j in (1, 2) for p in range(130)]
    texts = spark.createDataFrame(rows, "job_id long, pos int, text string").orderBy(F.desc("pos")).repartition(parts, "text")
    jobs = spark.createDataFrame([(1, "gemini", "m"), (2, "openai", "m")], "job_id long, provider string, model string")
    results, vectors = embedding.run_embedding_jobs(jobs, texts, factory)
    found = {r["job_id"]: (r["status"], r["count"], r["error"]) for r in results.collect()}
    assert found == {1: ("failed", None, "refused bad70"), 2: ("succeeded", 130, None)}
    assert vectors.count() == 130


def test_vectors_of_different_length_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        similarity.to_matrix(pa.array([[1.0] * 64, [1.0] * 128]))


def test_shared_folder_is_no_local_temporary_one(spark):
    class Conf:
        def getConf(self):
            return self

        get = staticmethod(lambda *a: None)
        getCheckpointDir = staticmethod(lambda: None)
        setCheckpointDir = staticmethod(lambda x: None)

    class Session:
        sparkContext = Conf()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: "/shared/warehouse" if k == "spark.sql.warehouse.dir" else d)})

    assert shared_dir(Session()) == "/shared/warehouse/_scratch"


def test_retention_drops_whole_day_folders(spark, sf, tmp_path):
    from trafficlens.operators import usage
    from trafficlens.sources import tables

    path, out = str(tmp_path / "usage"), str(tmp_path / "rollup")
    log = view(spark, sf, "usage_logs")
    tables.append_usage(log, path)
    days = sorted(p.name for p in (tmp_path / "usage").glob("dt=*"))
    gone = tables.drop_days(spark, path, "2024-01-20 12:00:00", days=10)
    assert gone == [d for d in days if d < "dt=2024-01-10"] and gone
    left = tables.load_usage(spark, path)
    assert left.count() == log.filter("created_at >= '2024-01-10'").count()
    changed = tables.load_days(spark, path, "2024-01-15", "2024-01-16")
    assert "PartitionFilters: [isnotnull(dt" in changed._jdf.queryExecution().executedPlan().toString()
    usage.write_rollup(changed, out)
    assert sorted(p.name for p in (tmp_path / "rollup").glob("day=*")) == ["day=2024-01-15", "day=2024-01-16"]


def test_only_questions_with_vectors_are_stored(spark):
    from trafficlens.operators import stores

    rows = [(1, "h1", "user", "a", [1.0]), (2, "h1", "user", "a", [1.0]), (3, "h2", "system", "b", [1.0]), (4, "h3", "user", "", [1.0]), (5, "h4", "user", "c", None)]
    data = [(i, h, "m", [(r, t)], ((1, 2),), e) for i, h, r, t, e in rows]
    schema = """id long, request_hash string, model string, messages array<struct<role:string,content:string>>,
      response struct<usage:struct<prompt_tokens:int,completion_tokens:int>>, embedding array<float>"""
    incoming = spark.createDataFrame(data, schema).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    old = spark.createDataFrame([("h2",)], "request_hash string")
    responses, entries = stores.rows_to_store(old, incoming)
    assert sorted(r["request_hash"] for r in responses.collect()) == ["h1", "h3", "h4"]
    assert sorted(r["id"] for r in entries.collect()) == [1, 2]


def test_a_chain_of_near_prompts_takes_few_rounds(spark, monkeypatch):
    """Each vector is near the one before it only; a loop over single fills would need 500 rounds."""
    import numpy as np

    from trafficlens.operators import semantic_cache as sc

    angle = np.arange(1000) * 0.1 % 6.2 + (np.arange(1000) // 62) * 1e-3
    rows = [("g", i, i, [float(np.cos(a)), float(np.sin(a)), float(i // 62)]) for i, a in enumerate(angle)]
    items = spark.createDataFrame(rows, "grp string, id long, ms long, vec array<float>")
    rounds = []
    kept = sc.keep
    monkeypatch.setattr(sc, "keep", lambda df, *a: rounds.append(1) or kept(df, *a))
    found = {r["id"] for r in sc.semantic_fills(items, 0.006, small=400, first_batch=300, block=256, pivots=None).collect()}
    whole = {r["id"] for r in sc.semantic_fills(items, 0.006, small=5000).collect()}
    assert found == whole and len(rounds) <= 60  # five tables a round


def test_a_hot_hash_is_followed_island_by_island(spark):
    from trafficlens.operators import exact_cache

    ms = [d * 86_400_000 + m * 61_000 for d in range(40) for m in range(30)]
    rows = spark.createDataFrame([("h", t, i) for i, t in enumerate(ms)], "key string, ms long, id long")
    cells = rows.withColumn("cell", F.floor(F.col("ms") / 60_000))
    assert exact_cache.islands(cells, 3_600_000).select("island").distinct().count() == 40
    want, due = [], -1
    for i, t in enumerate(ms):
        if t >= due:
            want.append(i)
            due = t + 600_000
    got = exact_cache.fill_chain(rows, 600, hot_rows=100).collect()
    assert sorted(r["id"] for r in got) == want
