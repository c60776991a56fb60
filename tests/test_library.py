"""Operators, sources, sinks, control plane and streaming on small hand-made inputs."""

import json
import math
import struct
import threading
import zlib
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.control import ControlStore, Settings, checksum, retry
from tarnlake.errors import LakeError, NonRetryableError, QualityError, RetryableError, SchemaError
from tarnlake.functions import expressions as fx
from tarnlake.operators import aggregate, joins, project, quality, scd, star, windows
from tarnlake.plans import catalogue_io
from tarnlake.plans.pipelines import Step, Workflow, batch, incremental, land, stream_alerts
from tarnlake.sinks import VersionedTable, quarantine, write_zone, zone_path
from tarnlake.sources import files
from tarnlake.sources.rest import ApiClient, RatesSource
from tarnlake.sources.tables import Tables, extract_by_id, extract_by_timestamp
from tarnlake.streaming import events as ev
from tarnlake.streaming import fraud

TXN = "transaction_id string, account_id string, amount double, currency string, status string, fraud_flag int, transaction_timestamp timestamp, updated_at timestamp"


def at(day, hour=0):
    return datetime(2025, 1, day, hour)


@pytest.fixture
def sample(spark):
    rows = [("T1", "A1", 100.0, "USD", "POSTED", 0, at(1), at(1)), ("T2", "A2", -5.0, "EUR", "POSTED", 0, at(2), at(2)), ("T2", "A2", 50.0, "EUR", "REVERSED", 0, at(3), at(3)), ("T3", None, 20.0, "GBP", "POSTED", 1, at(4), at(4))]
    return spark.createDataFrame(rows, TXN)


def test_projections(spark, sample):
    assert [r["transaction_id"] for r in project.filter_valid(sample).collect()] == ["T1"]
    with pytest.raises(KeyError):
        project.select_columns(sample, ["nope"])
    d = spark.createDataFrame([("10.5", "2025-01-01"), ("oops", "nope")], "amount string, ts string")
    got = project.cast_types(d, {"amount": "decimal", "ts": "timestamp"}).collect()
    assert float(got[0]["amount"]) == 10.5 and got[1]["amount"] is None and got[0]["ts"] == at(1) and got[1]["ts"] is None
    n = spark.createDataFrame([((1, ("x",)), [1, 2])], "a struct<b:int,c:struct<d:string>>, e array<int>")
    assert project.flatten(n).columns == ["a.b", "a.c.d", "e"] and project.flatten(n).first()["e"] == "[1,2]"
    with pytest.raises(ValueError):
        fx.check_identifier("a; drop table b")


def test_dedup_and_daily(sample):
    kept = {r["transaction_id"]: r["status"] for r in windows.deduplicate(sample, ["transaction_id"], "updated_at").collect()}
    assert kept == {"T1": "POSTED", "T2": "REVERSED", "T3": "POSTED"}
    daily = aggregate.daily_summary(sample).collect()
    assert sum(r["txn_count"] for r in daily) == 4 and len(daily) == 4


def test_percentiles_equal_global_windows(spark):
    from pyspark.sql import Window

    d = spark.range(300).select("id", F.when(F.col("id") % 31 != 0, (F.col("id") * 7 % 40).cast("double")).alias("v"))
    for rows in (d, d.limit(3), d.limit(1), d.where("v is null")):
        w, strict = Window.orderBy(F.asc_nulls_last("v")), Window.orderBy(F.asc_nulls_last("v"), "id")
        want = rows.select("id", F.percent_rank().over(w).alias("p"), F.ntile(4).over(strict).alias("q"))
        got = windows.percentiles(rows, "v", "id", ranges=8).select("id", F.col("pct_rank").alias("p"), F.col("quartile").alias("q"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert windows.percentiles(d.limit(0), "v", "id").count() == 0


def test_joins(spark):
    left, right = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["A1", "A2", "A9", None], ["A1", "A2", "A2", None]))
    assert [r["k"] for r in joins.anti_join(left.dropna(), right, "k").collect()] == ["A9"]
    assert sorted(r["k"] for r in joins.semi_join(left, right, "k").collect()) == ["A1", "A2"]
    assert joins.join(left, right, "k", null_safe=True).count() == 4
    assert joins.join(left, right, "k", "outer", null_safe=True).count() == 5
    with pytest.raises(ValueError):
        joins.join(left, right, "k", "sideways")


CUST = "customer_id string, city string, country string, updated_at timestamp"


def test_scd(spark):
    base = spark.createDataFrame([("C1", "London", "GB", at(1)), ("C2", "Paris", "FR", at(1)), ("C3", "Tokyo", "JP", at(1))], CUST)
    new = spark.createDataFrame([("C1", "Berlin", "DE", at(20)), ("C9", "Rome", "IT", at(20))], CUST)
    one = {r["customer_id"]: r["city"] for r in scd.scd_type_1(base, new, "customer_id", ["city"]).collect()}
    assert one == {"C1": "Berlin", "C2": "Paris", "C3": "Tokyo", "C9": "Rome"}
    first = scd.scd_type_2(None, base, "customer_id", ["city", "country"])
    assert first.where("is_current").count() == 3 and first.select("surrogate_key").distinct().count() == 3
    moved = scd.scd_type_2(first, new.where("customer_id = 'C1'"), "customer_id", ["city", "country"])
    rows = moved.where("customer_id = 'C1'").orderBy("effective_from").collect()
    assert moved.count() == 4 and moved.where("is_current").count() == 3
    assert rows[0]["effective_to"] == rows[1]["effective_from"] == at(20) and rows[1]["effective_to"].year == 9999
    again = scd.scd_type_2(moved, new.where("customer_id = 'C1'"), "customer_id", ["city", "country"])
    assert sorted(map(str, again.collect())) == sorted(map(str, moved.collect()))
    stale = spark.createDataFrame([("C1", "Oslo", "NO", at(2))], CUST)
    assert scd.scd_type_2(moved, stale, "customer_id", ["city", "country"], strict=True).count() == 4
    nulled = spark.createDataFrame([("C2", None, "FR", at(9))], CUST)
    assert scd.scd_type_2(moved, nulled, "customer_id", ["city", "country"]).where("customer_id = 'C2'").count() == 2
    closed = scd.scd_type_2(moved, base.where("customer_id <> 'C3'"), "customer_id", ["country"], as_of=F.lit("2025-02-01").cast("timestamp"), close_missing=True)
    assert not closed.where("customer_id = 'C3' and is_current").count()
    hist = spark.createDataFrame([("C1", "a", "x", at(1)), ("C1", "a", "x", at(2)), ("C1", "b", "x", at(3)), ("C1", "a", "x", at(4))], CUST)
    h = scd.scd_type_2_history(hist, "customer_id", ["city", "country"], "updated_at").orderBy("effective_from").collect()
    assert [(r["city"], r["is_current"]) for r in h] == [("a", False), ("b", False), ("a", True)] and h[0]["effective_to"] == at(3)


def test_replay_and_upsert(spark):
    snap = spark.createDataFrame([("B1", "x"), ("B2", "y"), ("B3", "z")], "branch_id string, city string")
    log = spark.createDataFrame([("UPDATE", "B1", ("B1", "new"), at(1), 1), ("INSERT", "B4", ("B4", "w"), at(2), 2), ("INSERT", "B5", ("B5", "v"), at(2), 3), ("DELETE", "B2", None, at(3), 4), ("UPDATE", "B5", ("B5", "last"), at(2), 5)], "operation string, primary_key string, after_image struct<branch_id:string,city:string>, timestamp timestamp, seq int")
    state = {r["branch_id"]: r["city"] for r in scd.replay(snap, log, "branch_id", ["seq"]).collect()}
    assert state == {"B1": "new", "B3": "z", "B4": "w", "B5": "last"}
    src = spark.createDataFrame([("B1", "q"), ("B9", "r")], "branch_id string, city string")
    up = scd.upsert(snap, src, ["branch_id"])
    assert {r["branch_id"]: r["city"] for r in up.collect()} == {"B1": "q", "B2": "y", "B3": "z", "B9": "r"}
    assert sorted(map(tuple, scd.upsert(up, src, ["branch_id"]).collect())) == sorted(map(tuple, up.collect()))


def test_quality(spark, sample):
    now = F.lit("2026-01-01").cast("timestamp")
    rows = [("T1", "A1", 5.0, "USD", "POSTED", 0, at(1), at(1)), ("T2", None, -5.0, "XXX", "ODD", 0, datetime(2027, 2, 4), at(1)), ("T2", "A3", 1.0, "EUR", "POSTED", 0, at(1), at(1)), (None, "A3", None, None, None, 0, None, at(1))]
    d = spark.createDataFrame(rows, TXN)
    rules = quality.transaction_rules(now)
    report = quality.evaluate(d, rules)
    assert not report.passed and {o.name for o in report.outcomes if not o.passed} == {r.name for r in rules}
    good, bad = quality.split(d, rules)
    assert good.count() + bad.count() == 4 and sorted(r["transaction_id"] for r in good.collect()) == ["T1", "T2"]
    assert bad.where("transaction_id = 'T2'").first()["_dq_reason"] == "account_id_not_null;amount_non_negative;currency_valid;timestamp_not_future;status_valid"
    with pytest.raises(QualityError):
        report.raise_if_failed()
    own = quality.Expectation("few", table=lambda df: df.count() < 3)
    assert not quality.evaluate(d, [own]).passed and json.loads(quality.evaluate(d, [own]).to_json())["checks"][0]["name"] == "few"
    assert quality.evaluate(good.where("transaction_id = 'T1'"), rules).passed
    assert quality.split(d, rules, ["critical"])[0].count() == 2
    with pytest.raises(ValueError):
        quality.Expectation("none")
    p = {r["column_name"]: r for r in aggregate.profile(d, ["amount", "currency"]).collect()}
    assert (p["amount"]["null_count"], p["amount"]["min_value"], p["currency"]["min_value"]) == (1, -5.0, None)


def test_star(spark, sample):
    acc = star.dimension(spark.createDataFrame([("A1", "C1")], "account_id string, customer_id string"), "account")
    mer = star.dimension(spark.createDataFrame([("M1", "n")], "merchant_id string, merchant_name string"), "merchant")
    fact = star.transaction_fact(sample.withColumn("merchant_id", F.lit("M1")), acc, mer).collect()
    assert len(fact) == 4 and sum(r["account_sk"] is None for r in fact) == 3 and {r["date_sk"] for r in fact} == {20250101, 20250102, 20250103, 20250104}
    assert star.date_dimension(sample).count() == 4 and star.date_dimension(sample.limit(0)).count() == 0


def test_sinks(spark, sample, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        zone_path(root, "platinum", "x")
    d = project.with_date_parts(sample, "transaction_timestamp")
    for _ in range(2):
        path = write_zone(d, root, "silver", "t", ["year", "month"])
    assert spark.read.parquet(path).count() == 4
    write_zone(d.limit(1).withColumn("month", F.lit(7)), root, "silver", "t", ["year", "month"])
    assert spark.read.parquet(path).count() == 5
    assert spark.read.parquet(quarantine(sample, root, "t")).first()["_dq_reason"] == "unspecified"
    v = VersionedTable(spark, f"{root}/versions")
    assert v.read() is None
    v.replace(sample)
    v.replace(v.read().unionByName(sample))
    assert v.read().count() == 8 and v.current().startswith("version-2-") and v.vacuum() == 1 and v.read().count() == 8


def avro(rows, codec):
    zig = lambda n: (n << 1) ^ (n >> 63)

    def long(n):
        n, out = zig(n), b""
        while n >= 0x80:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    text = lambda s: long(len(s.encode())) + s.encode()
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "x", "type": "double"}]}
    body = b"".join(long(i) + (long(0) if n is None else long(1) + text(n)) + struct.pack("<d", x) for i, n, x in rows)
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    sync = b"s" * 16
    return b"Obj\x01" + long(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + long(0) + sync + long(len(rows)) + long(len(body)) + body + sync


def test_files(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "lake")
    inbox.mkdir()
    (inbox / "a.csv").write_text("branch_id,city\nB1,x\nB2,y\n")
    (inbox / "b.csv").write_text("city\nx\n")
    (inbox / "c.csv").write_text("")
    (inbox / "d.txt").write_text("?")
    store = ControlStore()
    ing = files.FileIngestor(spark, root, "branches", ["branch_id"], store)
    sweep = ing.ingest_dir(str(inbox))
    assert sweep.counts == {"PROCESSED": 1, "QUARANTINED": 3} and "branch_id" in sweep.results[1].reason
    assert ing.ingest_file(str(inbox / "a.csv")).status == "SKIPPED_DUPLICATE"
    assert ing.ingest_file(str(inbox / "zz.csv")).status == "QUARANTINED"
    landed = spark.read.parquet(zone_path(root, "bronze", "branches"))
    assert landed.count() == 2 and landed.first()["_ingested_checksum"] == checksum(inbox / "a.csv")
    (inbox / "n.csv").write_text("branch_id,city\nB3,z\n")
    box = files.InboxIngestor(str(inbox), str(tmp_path / "archive"), ing)
    assert box.ingest().counts["PROCESSED"] == 1 and (tmp_path / "archive" / "n.csv").exists() and (inbox / "n.csv").exists()

    (inbox / "e.json").write_text(json.dumps({"meta": 1, "events": [{"event_id": "E1", "payload": {"amount": 1.5, "tags": [1]}}, {"event_id": "E2", "payload": {"amount": 2.5, "tags": []}}]}))
    e = files.read_file(spark, str(inbox / "e.json"))
    assert e.columns == ["event_id", "payload.amount", "payload.tags"] and e.count() == 2
    (inbox / "f.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_file(spark, str(inbox / "f.json")).count() == 2
    (inbox / "g.json").write_text('{"a": 1, "b": {"c": 2}}')
    assert files.read_file(spark, str(inbox / "g.json")).columns == ["a", "b.c"]
    (inbox / "bad.json").write_text("{")
    with pytest.raises(SchemaError):
        files.read_file(spark, str(inbox / "bad.json")).collect()
    (inbox / "m.xml").write_text('<merchants><merchant id="1"><name>x</name></merchant><merchant id="2"><name>y</name></merchant></merchants>')
    x = files.read_file(spark, str(inbox / "m.xml"))
    assert sorted(x.columns) == ["id", "name"] and x.count() == 2
    (inbox / "bad.xml").write_text("<a><b>")
    with pytest.raises(SchemaError):
        files.read_file(spark, str(inbox / "bad.xml")).collect()
    for codec in ("null", "deflate"):
        (inbox / f"{codec}.avro").write_bytes(avro([(1, "é", 0.5), (-70000, None, 2.0)], codec))
        assert sorted(map(tuple, files.read_file(spark, str(inbox / f"{codec}.avro")).collect())) == [(-70000, None, 2.0), (1, "é", 0.5)]
    with pytest.raises(NonRetryableError):
        files.read_file(spark, str(inbox / "d.txt"))


def test_nested_avro(spark, tmp_path):
    zig = lambda n: bytes([n << 1]) if n >= 0 else bytes([(-n << 1) - 1])
    text = lambda s: zig(len(s)) + s.encode()
    point = {"type": "record", "name": "point", "fields": [{"name": "x", "type": "int"}, {"name": "tag", "type": ["null", "string"]}]}
    fields = [("at", point), ("more", {"type": "array", "items": "point"}), ("counts", {"type": "map", "values": "long"}), ("kind", {"type": "enum", "name": "k", "symbols": ["A", "B"]}), ("raw", {"type": "fixed", "name": "f", "size": 2}), ("day", ["null", {"type": "int", "logicalType": "date"}])]
    schema = {"type": "record", "name": "r", "fields": [{"name": n, "type": k} for n, k in fields]}
    one = zig(1) + zig(0)  # a point without a tag
    row = zig(7) + zig(1) + text("t") + zig(-2) + zig(4) + one + one + zig(0) + zig(1) + text("n") + zig(5) + zig(0) + zig(1) + b"ab" + zig(1) + zig(9)
    sync = b"s" * 16
    (tmp_path / "n.avro").write_bytes(b"Obj\x01" + zig(1) + text("avro.schema") + _long_text(json.dumps(schema)) + zig(0) + sync + zig(1) + _long(len(row)) + row + sync)
    r = files.read_file(spark, str(tmp_path / "n.avro")).first().asDict(recursive=True)
    assert r == {"at": {"x": 7, "tag": "t"}, "more": [{"x": 1, "tag": None}] * 2, "counts": {"n": 5}, "kind": "B", "raw": b"ab", "day": 9}


def _long(n):
    n, out = n << 1, b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _long_text(s):
    return _long(len(s)) + s.encode()


def test_settings_by_environment(tmp_path, monkeypatch):
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": 2}, "l": [1]}')
    (tmp_path / "prod.json").write_text('{"a": {"b": 9}, "l": []}')
    s = Settings.for_environment(tmp_path, "prod")
    assert s.get("a.b") == 9 and s.get("a.c") == 2 and s.get("l") == [] and Settings.for_environment(tmp_path, "prod") is s
    monkeypatch.setenv("TARNLAKE_ENV", "prod")
    assert Settings.for_environment(tmp_path).get("a.b") == 9
    with pytest.raises(LakeError):
        Settings.for_environment(tmp_path, "nope")


class Api(BaseHTTPRequestHandler):
    calls = 0

    def log_message(self, *a):
        pass

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        Api.calls += 1
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if self.headers["Authorization"] != "Bearer good":
            return self.answer(401, {})
        if Api.calls == 2:
            return self.answer(503, {})
        rows = [{"id": i, "base": "USD", "quote": "EUR", "rate": 1 + i / 100, "updated_at": f"2025-01-{1 + i // 24:02d}T{i % 24:02d}:00:00"} for i in range(80)]
        rows = [r for r in rows if r["updated_at"] > q.get("updated_since", "")]
        page, size = int(q["page"]), int(q["page_size"])
        part = rows[(page - 1) * size : page * size]
        self.answer(200, {"data": part, "pagination": {"page": page, "page_size": size, "total": len(rows), "has_next": page * size < len(rows)}})

    def do_POST(self):
        self.answer(200, {"ok": json.loads(self.rfile.read(int(self.headers["Content-Length"])))})

    def answer(self, code, body):
        raw = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)


def test_rest(spark):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    client = ApiClient(url, "good", page_size=20, base_delay=0)
    assert len(client.all()) == 80 and len(client.all("2025-01-03T00:00:00")) == 31 and client.post_log({"a": 1}) == {"ok": {"a": 1}}
    with pytest.raises(NonRetryableError):
        ApiClient(url, "bad").all()
    spark.dataSource.register(RatesSource)
    d = spark.read.format("rates").options(url=url, token="good", pageSize="20", baseDelay="0").load()
    assert d.count() == 80 and d.rdd.getNumPartitions() == 4 and d.select("id").distinct().count() == 80
    server.shutdown()


class Uncounted(Api):
    """Serves pages that say whether there are more, but not how many."""

    def answer(self, code, body):
        if "pagination" in body:
            body["pagination"].pop("total")
        super().answer(code, body)


class Growing(Api):
    """Counts fewer rows than it serves, as when rows come in meanwhile."""

    def answer(self, code, body):
        if "pagination" in body:
            body["pagination"]["total"] -= 25
        super().answer(code, body)


@pytest.mark.parametrize("server, tasks", [(Uncounted, 1), (Growing, 3)])
def test_rest_loses_no_page(spark, server, tasks):
    server = HTTPServer(("127.0.0.1", 0), server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RatesSource)
    d = spark.read.format("rates").options(url=f"http://127.0.0.1:{server.server_port}", token="good", pageSize="20", baseDelay="0").load()
    assert sorted(r["id"] for r in d.collect()) == list(range(80)) and d.rdd.getNumPartitions() == tasks
    server.shutdown()


def test_versions_survive_a_crash(spark, tmp_path, monkeypatch):
    v = VersionedTable(spark, f"{tmp_path}/t")
    crash = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(RuntimeError):
            v.replace(spark.range(3))
    assert v.read() is None
    first = v.replace(spark.range(3))
    # Between the writing of a version and its commit readers keep the one before.
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(RuntimeError):
            v.replace(spark.range(9))
    assert v.current() == first and v.read().count() == 3
    assert v.replace(v.read().union(v.read())).startswith("version-2-") and v.read().count() == 6
    # Of two writers of the same version one is told.
    with pytest.raises(LakeError):
        v._commit(2, "version-2-other")
    assert v.read().count() == 6 and v.vacuum() == 3 and v.read().count() == 6
    for f in (tmp_path / "t").glob("commit-*"):
        f.unlink()
    with pytest.raises(LakeError):
        v.read()


def one_at_a_time(events, config):
    """The rules of fraud.py event by event."""
    recent, place, newest, out = [], None, None, []
    for i, (t, amount, city) in enumerate(events):
        late = newest is not None and t < newest
        newest = t if newest is None else max(t, newest)
        rules = ["HIGH_VALUE"] * (amount >= config.high_value)
        recent.append(t)
        while recent[0] < t - config.window_seconds:
            recent.pop(0)
        rules += ["VELOCITY"] * (len(recent) > config.max_events)
        if place and place[1] in fraud.CITIES and city in fraud.CITIES and t != place[0]:
            (a, b, _), (c, d, _) = (fraud.CITIES[x] for x in (place[1], city))
            a, b, c, d = map(math.radians, (a, b, c, d))
            km = 2 * fraud.EARTH_RADIUS_KM * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))
            rules += ["IMPOSSIBLE_TRAVEL"] * (km / (abs(t - place[0]) / 3600) > config.max_speed_kmh)
        if place is None or t >= place[0]:
            place = (t, city)
        out.append((late, rules))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.sampled_from([1.0, 6000.0]), st.sampled_from([*list(fraud.CITIES)[:3], "Nowhere", None])), max_size=25), st.integers(0, 25))
def test_fraud_batches_equal_single_events(events, cut):
    config = fraud.FraudConfig()
    state, got = fraud.CustomerState([]), []
    for part in (events[:cut], events[cut:]):
        late, alerts = state.score_batch(np.array([e[0] for e in part], float), np.array([e[1] for e in part], float), np.array([e[2] for e in part], object), config)
        got += [(bool(x), [a[1] for a in alerts if a[0] == i]) for i, x in enumerate(late)]
    assert got == one_at_a_time(events, config)


@pytest.mark.parametrize("turn", [1, -1])
def test_late_events_that_arrive_at_once(spark, turn):
    rows = [("u", 30, 1), ("u", 20, 2), ("u", 50, 3), ("u", 40, 3), ("u", 45, 4), ("v", 10, 3), ("v", 5, 3)][::turn]
    got = fraud.late_events(spark.createDataFrame(rows, "k string, ts int, at int").coalesce(1), "k", "ts", "at")
    assert sorted((r["k"], r["ts"]) for r in got.collect()) == [("u", 20), ("u", 45)]


def test_stream_summary(spark):
    events = spark.createDataFrame([(i,) for i in "aabcdda"], "transaction_id string")
    found = spark.createDataFrame([("a", "VELOCITY", False), ("b", None, True), ("c", "HIGH_VALUE", True), ("c", "VELOCITY", True)], "transaction_id string, rule string, is_late boolean")
    assert fraud.summary(events, found).first().asDict() == {"processed": 4, "duplicates": 3, "late": 2, "alerts": 3, "high_value": 1, "velocity": 2, "impossible_travel": 0}
    assert fraud.summary(events, found, events.where("transaction_id = 'a'")).first()["duplicates"] == 4


def test_stream_of_several_files_a_part(spark, sf, monkeypatch):
    want = sorted(tuple(r) for r in catalogue_io.stream_fraud_alerts(spark, sf).collect())
    monkeypatch.setattr(catalogue_io, "_FILE_ROWS", 60)
    d, folder, files = catalogue_io._stream_events(spark, sf)
    parts = [spark.read.json(f"{folder[:-1]}batch-{k}") for k in range(4)]
    assert files > 2 and [len(p.inputFiles()) for p in parts] == [files] * 4
    spans = [p.agg(F.min("seq"), F.max("seq")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(p.count() for p in parts) == d.count()
    assert sorted(tuple(r) for r in catalogue_io.stream_fraud_alerts(spark, sf).collect()) == want and want


def test_lookup_broadcasts_by_bytes(spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "id * 2 as v").write.parquet(f"{tmp_path}/d")
    d, facts = spark.read.parquet(f"{tmp_path}/d"), spark.range(5000).selectExpr("id as k")
    hinted = lambda x: "strategy=broadcast" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(joins.lookup(facts, d, "k", "v")) and not hinted(joins.lookup(facts, d, "k", "v", small=100))
    assert joins.lookup(facts, d, "k", "v").where("v is not null").count() == 1000


def test_control(tmp_path):
    s = ControlStore(tmp_path / "c" / "control.db")
    assert s.register("p") == s.register("p", "x")
    with s.run("p") as r:
        r.read_rows = 3
    assert s.get_run(r.id)["status"] == "SUCCESS" and s.get_run(r.id)["read_rows"] == 3
    with pytest.raises(RuntimeError), s.run("p") as r:
        raise RuntimeError("boom")
    assert s.get_run(r.id)["status"] == "FAILED" and "boom" in s.get_run(r.id)["error"]
    s.begin_watermark("p", "t", at(3))
    assert s.watermark("p", "t") is None
    s.commit_watermark("p", "t")
    assert s.watermark("p", "t") == at(3)
    assert s.claim_event("e") and not s.claim_event("e")
    tries = []

    @retry(attempts=3, sleep=lambda _: None)
    def flaky(kind):
        tries.append(1)
        if len(tries) < 3:
            raise kind("no")
        return "yes"

    assert flaky(RetryableError) == "yes" and len(tries) == 3
    tries.clear()
    with pytest.raises(NonRetryableError):
        flaky(NonRetryableError)
    assert len(tries) == 1
    (tmp_path / "s.json").write_text('{"a": {"b": 1}}')
    c = Settings.load(tmp_path / "s.json")
    assert c.get("a.b") == 1 and c.get("a.c", 5) == 5
    with pytest.raises(KeyError):
        c.require("a.c")
    seen = []
    flow = Workflow([Step("b", lambda: seen.append("b"), ("a",)), Step("a", lambda: seen.append("a"))])
    flow.execute()
    assert seen == ["a", "b"]


@pytest.fixture
def bank(spark, tmp_path):
    """Five source tables: 40 clean transactions, four faulty ones and a repeated one."""
    src = tmp_path / "src"
    txn = [(f"T{i:03d}", f"A{i % 8}", f"M{i % 3}", 10.0 + i, "USD", "CARD", "POSTED", 0, at(1 + i % 28), at(1 + i % 28, 1)) for i in range(40)]
    txn += [("X1", None, "M1", 1.0, "USD", "CARD", "POSTED", 0, at(1), at(1)), ("X2", "A1", "M1", -1.0, "USD", "CARD", "POSTED", 0, at(1), at(1)), ("X3", "A1", "M1", 1.0, "XXX", "CARD", "POSTED", 0, at(1), at(1)), ("X4", "A1", "M1", 1.0, "USD", "CARD", "POSTED", 0, datetime(2030, 1, 1), at(1)), ("T001", "A1", "M1", 99.0, "USD", "CARD", "POSTED", 1, at(5), at(28, 5))]
    tables = {
        "transactions": (txn, "transaction_id string, account_id string, merchant_id string, amount double, currency string, channel string, status string, fraud_flag int, transaction_timestamp timestamp, updated_at timestamp"),
        "customers": ([(f"C{i}", "n", "RETAIL") for i in range(5)], "customer_id string, first_name string, segment string"),
        "accounts": ([(f"A{i}", f"C{i % 5}", "CHECKING") for i in range(8)], "account_id string, customer_id string, account_type string"),
        "merchants": ([(f"M{i}", "m") for i in range(3)], "merchant_id string, merchant_name string"),
        "cards": ([("K1", "A1", "DEBIT")], "card_id string, account_id string, card_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}.parquet")
    return Tables(spark, str(src))


def test_batch_pipeline(spark, bank, tmp_path):
    store = ControlStore()
    counts = batch(spark, bank, str(tmp_path / "lake"), store, F.lit("2026-01-01").cast("timestamp"))
    assert counts["bronze_transactions"] == 45 and counts["quarantine_transactions"] == 4
    assert counts["silver_transactions"] == counts["gold_fact_transaction"] == 40 and counts["gold_dim_customer"] == 5
    silver = spark.read.parquet(zone_path(str(tmp_path / "lake"), "silver", "transactions"))
    assert float(silver.where("transaction_id = 'T001'").first()["amount"]) == 99.0
    with pytest.raises(QualityError):
        batch(spark, bank, str(tmp_path / "lake2"), store, F.lit("2026-01-01").cast("timestamp"), stop_on_failure=True)
    assert land(bank.read("cards"), str(tmp_path / "lake3"), "cards", store) == 1


def test_incremental_pipeline(spark, bank, tmp_path):
    store = ControlStore()
    assert incremental(spark, bank, str(tmp_path), store) == 43
    assert incremental(spark, bank, str(tmp_path), store) == 0
    late = bank.read("transactions").where("transaction_id = 'T002'").withColumns({"amount": F.lit(7.0), "account_id": F.lit("A7"), "updated_at": F.lit("2025-03-01").cast("timestamp")})
    late.write.mode("append").parquet(f"{bank.path}/transactions.parquet")
    assert incremental(spark, bank, str(tmp_path), store) == 1
    t = VersionedTable(spark, zone_path(str(tmp_path), "silver", "transactions_current")).read()
    row = t.where("transaction_id = 'T002'").first()
    assert t.count() == 43 and float(row["amount"]) == 7.0 and row["account_id"] == "A2"
    rows, mark = extract_by_id(bank, "customers", "customer_id", "ids", store)
    assert rows.count() == 5 and mark == "C4"
    store.commit_watermark("ids", "customers")
    assert extract_by_id(bank, "customers", "customer_id", "ids", store)[0].count() == 0
    assert extract_by_timestamp(bank, "transactions", "other", store)[0].count() == 46


def test_streaming_fraud(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = ev.ShardedLog()
    rows = ev.generate(60)
    assert ev.produce(rows, log) == 69 and len(log.read_all()) == 69 and log.read_shard(0, 10**9) == []
    ev.drop_files(log, str(tmp_path / "in"), 30)
    stream = ev.file_stream(spark, str(tmp_path / "in"))
    q = stream_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    by_rule = {}
    for r in got:
        by_rule[r["rule"]] = by_rule.get(r["rule"], 0) + 1
    # The rules, one event at a time, in arrival order.
    seen, states, want, late = set(), {}, {}, 0
    for e in rows:
        if e["transaction_id"] in seen:
            continue
        seen.add(e["transaction_id"])
        s = states.setdefault(e["customer_id"], fraud.CustomerState([]))
        is_late, alerts = s.score({"at": datetime.fromisoformat(e["timestamp"]).timestamp(), "amount": e["amount"], "city": e["city"]}, fraud.FraudConfig())
        late += is_late
        for a in alerts:
            want[a[0]] = want.get(a[0], 0) + 1
    assert {k: v for k, v in by_rule.items() if k} == want and want["HIGH_VALUE"] == 1 and want["VELOCITY"] == 1 and want["IMPOSSIBLE_TRAVEL"] == 2
    assert len({r["transaction_id"] for r in got if r["is_late"]}) == late == 1
    w = fraud.windowed_counts(stream, "timestamp", "1 hour", "30 minutes").writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("windows").count() > 0
    a = ev.archive_stream(stream, str(tmp_path / "archive"), str(tmp_path / "cp2"), trigger={"availableNow": True})
    a.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 69
