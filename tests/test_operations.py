import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from royaltide.functions.columns import first_rule
from royaltide.operators import evaluation as E
from royaltide.operators import guardrails as G
from royaltide.operators import monitoring as M
from royaltide.streaming import ingest as I
from royaltide.streaming import live as V
from tests.conftest import rows

T = datetime.datetime


def _payload(spark, items):
    data = [(i, T(2024, 1, 30, 12), ms, text) for i, (ms, text) in enumerate(items)]
    return spark.createDataFrame(data, "request_id int, request_time timestamp, execution_time_ms long, request string")


def test_latency_bucket_edges(spark):
    payload = _payload(spark, [(ms, "") for ms in (499, 500, 1000, 2000, 5000)])
    got = [(r[0], r[1], r[2]) for r in M.latency_buckets(payload, "2024-01-31").collect()]
    assert got == [("< 500ms", 1, 20.0), ("500ms - 1s", 1, 20.0), ("1s - 2s", 1, 20.0),
                   ("2s - 5s", 1, 20.0), ("> 5s", 1, 20.0)]


def test_percentiles_of_a_single_request(spark):
    row = M.latency_percentiles(_payload(spark, [(700, "")]), "2024-01-31").first()
    assert row["p50_latency_ms"] == row["p99_latency_ms"] == row["max_latency_ms"] == 700


def test_rule_order_and_exclusions(spark):
    texts = ["royalty split", "royalties for x", "find songs", "find a poem", "top ten songs", "catalog streaming", "hm"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kinds = [r[0] for r in df.select(first_rule("t", M.REQUEST_RULES, "Other")).collect()]
    assert kinds == ["Royalty Split", "Royalty Lookup", "Song Search", "Song Search", "Top Songs", "Catalog Overview", "Other"]
    tools = [r[0] for r in df.select(first_rule("t", M.TOOL_RULES, "unknown")).collect()]
    assert tools[3] == "unknown" and tools[2] == "search_song_catalog"


def test_pii_patterns(spark):
    cases = {
        "mail a.b@c.org": {"email"}, "call 555-123-4567": {"phone"}, "call 555.123.4567": {"phone"},
        "call 5551234567": {"phone"}, "ssn 123-45-6789": {"ssn"}, "IPI 12345678901": {"ipi_number"},
        "number 12345678901": set(), "recipient 123456789": set(), "nothing": set(),
    }
    df = spark.createDataFrame([(k, k) for k in cases], "doc_id string, text string")
    got = {k: set() for k in cases}
    for r in G.detect_pii(df, "text").collect():
        got[r["doc_id"]].add(r["pii_type"])
    assert got == cases
    redacted = {r["doc_id"]: r for r in G.apply_pii_policy(df, "text", action="REDACT").collect()}
    assert redacted["mail a.b@c.org"]["text"] == "mail [EMAIL]" and redacted["nothing"]["reason"] is None
    blocked = {r["doc_id"]: r for r in G.apply_pii_policy(df, "text").collect()}
    assert blocked["ssn 123-45-6789"]["text"] is None and blocked["ssn 123-45-6789"]["reason"] == "ssn"
    assert blocked["nothing"]["text"] == "nothing" and not blocked["nothing"]["blocked"]


def test_blocked_keywords(spark):
    df = spark.createDataFrame([("Please WRITE ME a poem",), ("royalties",), (None,)], "t string")
    assert [r["matched_keyword"] for r in G.block_keywords(df, "t").collect()] == ["write me a poem", None, None]


def _requests(spark):
    start = T(2024, 1, 1, 10, 0, 0)
    data = [(i, start + datetime.timedelta(seconds=7 * i), f"u{i % 2}", "e") for i in range(40)]
    return spark.createDataFrame(
        data, "client_request_id int, request_time timestamp, requester string, served_entity_id string")


def test_rate_limit_against_a_plain_count(spark):
    limits = (G.RateLimit("user", 3, "requester", "MINUTE"), G.RateLimit("all", 5, "served_entity_id", "MINUTE"))
    got = {r["client_request_id"]: r for r in G.rate_limit(_requests(spark), limits).collect()}
    seen = {}
    for i in range(40):
        minute = 7 * i // 60
        for name, key, calls in (("user", i % 2, 3), ("all", "e", 5)):
            seen[name, key, minute] = seen.get((name, key, minute), 0) + 1
            assert got[i][name] == (seen[name, key, minute] <= calls)
        assert got[i]["admitted"] == (got[i]["user"] and got[i]["all"])


def test_a_large_limit_cuts_by_salt_first(spark, monkeypatch):
    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(seconds=i % 50, milliseconds=i % 7), "busy" if i % 3 else "b", "e") for i in range(4000)]
    frame = spark.createDataFrame(data, "client_request_id int, request_time timestamp, requester string, served_entity_id string")
    limits = (G.RateLimit("user", 1500, "requester", "MINUTE"), G.RateLimit("all", 2100, "served_entity_id", "HOUR"))
    got = rows(G.rate_limit(frame, limits).select("client_request_id", "user", "all"))
    order = sorted(data, key=lambda r: (r[1], r[0]))
    rank, seen = {}, {}
    for n, r in enumerate(order):
        seen[r[2]] = seen.get(r[2], 0) + 1
        rank[r[0]] = (r[0], seen[r[2]] <= 1500, n < 2100)
    assert got == sorted(rank.values(), key=repr)
    monkeypatch.setattr(G, "GROUP_LIMIT", 5000)
    assert rows(G.rate_limit(frame, limits).select("client_request_id", "user", "all")) == got


def test_split_traffic_is_stable(spark):
    df = spark.range(5000).select(F.col("id"), F.lit(200).alias("status_code"), F.lit(1.0).alias("execution_time_ms"))
    got = {r["arm"]: r["requests"] for r in G.split_traffic(df, "id", {"a": 90, "b": 10}).collect()}
    assert got["a"] + got["b"] == 5000 and 400 < got["b"] < 600
    with pytest.raises(ValueError):
        G.assign_arm("id", {"a": 50})


def test_clean_args(spark):
    texts = ['{"g": "NULL", "n": 3}', '{"g": "null"}', '{"g": null, "n": "x"}', '{"g": "it\'s", "n": "7"}', "bad", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = [(r["g"], r["n"], r["args_ok"]) for r in E.clean_args(df, "a", {"g": "string", "n": "int"}).orderBy("i").collect()]
    assert got == [(None, 3, True), (None, None, True), (None, None, True), ("it's", 7, True), (None, None, False), (None, None, False)]


def test_score_tools(spark):
    cases = [("NONE", []), ("NONE", ["a"]), ("a, b", ["b", "a"]), ("a,b", ["a"]), ("a", ["c"]), ("a", None)]
    df = spark.createDataFrame([(i, e, c) for i, (e, c) in enumerate(cases)], "i int, expected_tool string, called_tools array<string>")
    got = [(r[0], r[1], r[2]) for r in E.score_tools(df).orderBy("i").select("tool_exact", "tool_precision", "tool_recall").collect()]
    assert got == [(True, 1.0, 1.0), (False, 0.0, 1.0), (True, 1.0, 1.0), (False, 1.0, 0.5), (False, 0.0, 0.0), (False, 0.0, 0.0)]


def test_score_answers(spark):
    data = [(1, "what is paid", "paid 5.00 twice twice", "paid twice", "5.00 and 7"), (2, "q", "mail a@b.io", "none", ""), (3, "", "", "", None)]
    df = spark.createDataFrame(data, "id int, question string, answer string, expected string, evidence string")
    got = {r["id"]: r for r in E.score_answers(df, ["id"]).collect()}
    assert abs(got[1]["correctness"] - 2 * 2 / 7) < 1e-12 and got[1]["groundedness"] == 1.0
    assert abs(got[1]["relevance"] - 1 / 3) < 1e-12 and got[2]["safety"] == 0.0 and got[1]["safety"] == 1.0
    assert got[3]["correctness"] == 0.0 and got[3]["relevance"] == 0.0


def test_flatten_and_summarise(spark):
    ratings = [["YES"], ["no"], ["True"], ["0.5"], ["maybe"], []]
    data = [(i, "t", [("j", x) for x in r]) for i, r in enumerate(ratings)]
    df = spark.createDataFrame(data, "i int, query_type string, assessments array<struct<name:string,rating:string>>")
    flat = E.flatten_assessments(df, ["j"])
    assert [r["j"] for r in flat.orderBy("i").collect()] == [1.0, 0.0, 1.0, 0.5, None, None]
    assert sorted(tuple(r) for r in E.score_summary(flat, "query_type", ["j"]).collect()) == [("ALL", 0.63), ("t", 0.63)]


# --- streams ------------------------------------------------------------------------


def _csv(path, name, header, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join([header, *lines]) + "\n")


def test_csv_files_are_read_once(spark, tmp_path):
    inbox = tmp_path / "in"
    _csv(inbox, "a.csv", "id,v", "1,1.5", "2,2.5")
    paths = [str(tmp_path / p) for p in ("schema", "table", "offsets")]

    def run():
        I.drain_to_table(I.with_audit(I.csv_stream(spark, str(inbox), paths[0])), paths[1], paths[2])
        return spark.read.parquet(paths[1])

    assert run().count() == 2 == run().count()
    _csv(inbox, "b.csv", "id,v", "3,3.5")
    table = run()
    assert rows(table.select("id", "v")) == [(1, 1.5), (2, 2.5), (3, 3.5)]
    assert table.where("_source_file LIKE '%b.csv'").count() == 1


def test_schema_evolution_by_name(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "t")
    sides = [str(tmp_path / "s"), str(tmp_path / "o")]
    _csv(inbox, "a.csv", "id,x,y", "1,10,a")
    I.ingest_evolving(spark, str(inbox), table, *sides)
    _csv(inbox, "b.csv", "z,y,id,x", "2.5,b,2,20")
    _csv(inbox, "c.csv", "id,y", "3,c")
    _csv(inbox, "d.csv", "id,x,y", "4,oops,d")
    for _ in range(2):
        I.ingest_evolving(spark, str(inbox), table, *sides)
    got = I.read_evolving(spark, table)
    assert rows(got.select("id", "x", "y", "z")) == [(1, 10, "a", None), (2, 20, "b", 2.5), (3, None, "c", None), (4, None, "d", None)]
    kept = got.where("_rescued IS NOT NULL").select("id", "_rescued").collect()
    assert [(r[0], r[1][0]["text"]) for r in kept] == [(4, "oops")]


SCHEMA = "client_request_id int, request_time timestamp, requester string, status_code int"


def _drain(spark, stream, tmp_path, name):
    I.drain_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-offsets"))
    return spark.read.parquet(str(tmp_path / name))


def test_live_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "src")
    base = T(2024, 1, 1, 10)

    def load(*items):
        data = [(i, base + datetime.timedelta(minutes=m), "u", code) for i, m, code in items]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        return _drain(spark, V.live_usage(spark.readStream.schema(SCHEMA).parquet(source)), tmp_path, "live")

    load((1, 5, 200), (2, 10, 500), (3, 200, 200))
    first = run()
    load((4, 15, 200), (5, 400, 200))  # request 4 is behind the watermark
    second = run()
    assert rows(first.select("total_requests", "error_count", "error_rate_pct")) == [(2, 1, 50.0)]
    assert rows(second.select("total_requests", "error_count")) == [(1, 0), (2, 1)]


def test_stream_limit_equals_batch_limit(spark, tmp_path):
    requests = _requests(spark).drop("served_entity_id").withColumn("status_code", F.lit(200))
    source = str(tmp_path / "src")
    limit = G.RateLimit("user", 3, "requester", "MINUTE")
    for low, high in ((0, 20), (20, 40)):
        part = requests.where(F.col("client_request_id").between(low, high - 1))
        part.repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        out = _drain(spark, V.rate_limit_stream(stream, limit), tmp_path, "limited")
    want = G.rate_limit(requests, [limit]).select("client_request_id", "admitted")
    assert rows(out.select("client_request_id", "admitted")) == rows(want)


def test_only_windows_over_a_limit_give_cutoffs(spark, monkeypatch):
    sent, join = [], G.spread_join
    monkeypatch.setattr(G, "spread_join", lambda facts, keyed, *a, **k: sent.append(keyed) or join(facts, keyed, *a, **k))
    start = datetime.datetime(2024, 1, 1)
    times = [(i, start + datetime.timedelta(minutes=m), user) for i, (m, user) in enumerate([(0, "a"), (1, "a"), (2, None), (2, None), (3, "b")])]
    frame = spark.createDataFrame(times, "client_request_id int, request_time timestamp, requester string")
    got = rows(G.rate_limit(frame, [G.RateLimit("user", 1, "requester", "MINUTE")]).select("client_request_id", "user"))
    assert got == [(0, True), (1, True), (2, True), (3, False), (4, True)]
    assert sent[0].count() == 1


def test_a_group_of_the_stream_limit_writes_its_state_once():
    class Handle:
        calls, state = 0, None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.state

        def update(self, value):
            self.calls, self.state = self.calls + 1, value

        def registerTimer(self, time):
            self.calls += 1

    start = pd.Timestamp("2024-01-01")
    batch = pd.DataFrame({
        "client_request_id": range(200), "requester": [i % 100 for i in range(200)], "request_time": start, "part_number": 0,
        "key_text": [str(i % 100) for i in range(200)], "window_number": 7, "hour_number": 7, "group_number": 0})
    handle = Handle()
    step = V._Admit(1, "request_time", "client_request_id", True)
    step.init(handle)
    out = pd.concat(step.handleInputRows((7, 0, 0), iter([batch[:150], batch[150:]]), None)).sort_values("client_request_id")
    assert out["admitted"].tolist() == [i < 100 for i in range(200)]
    assert handle.calls == 2 and sum(handle.state[2]) == 100
    assert not pd.concat(step.handleInputRows((7, 0, 0), iter([batch]), None))["admitted"].any()
