"""Rules, relations, versioned records, units, and pages of many lines, against plain Python."""

import datetime as dt
import hashlib
import random
import re
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from specloom.functions import units
from specloom.operators import audit, extract, history, relations, rules, shared, trace
from specloom.streaming import ordered
from specloom.streaming import pages as stream


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "e"), ("g", "missing"), ("h", "h")], "id string, needed string")
    assert {r.id: r.level for r in relations.levels(nodes, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": 0, "h": None}
    assert relations.levels(nodes.limit(0), needs).collect() == []


def test_paths_hold_while_all_edges_do(spark):
    random.seed(3)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    edges = [(a, b, day(f), day(f + n) if n else None) for a, b, f, n in ((random.choice("abcde"), random.choice("abcde"), random.randrange(40), random.choice([0, 5, 30])) for _ in range(14))]
    end = dt.date(9999, 12, 31)
    steps = {(a, b, f, t or end) for a, b, f, t in edges if a != b}
    known, found = set(steps), set(steps)
    while found:
        found = {(a, y, max(f, g), min(t, u)) for a, b, f, t in found for x, y, g, u in steps if x == b and y != a and max(f, g) < min(t, u)} - known
        known |= found
    got = relations.closure(spark.createDataFrame(edges, "source string, target string, valid_from date, valid_to date")).collect()
    assert {(r.source, r.target, r.valid_from, r.valid_to or end) for r in got} == known and len(got) == len(known)


def test_rules_of_missing_facts_and_many_conditions(spark, monkeypatch):
    known = spark.createDataFrame([("a", 1, "active", "g", 2, "A"), ("b", 1, "active", "g", 1, "B"), ("none", 1, "active", "g", 3, "N")], "rule_id string, version int, status string, rule_group string, priority int, action string")
    conditions = spark.createDataFrame([("a", 1, "x", ">", 1.0, None), ("a", 1, "y", "<>", None, "no"), ("b", 1, "x", "<", 5.0, None), ("b", 1, "z", "=", 1.0, None)], "rule_id string, version int, fact string, op string, number double, text string")
    data = spark.createDataFrame([(1, 2.0, "yes", 1), (2, None, "yes", 1), (3, 9.0, "no", None), (None, 2.0, None, 1)], "id int, x double, y string, z int")
    want = {(1, "a"): ("overruled", []), (1, "b"): ("executed", []), (1, "none"): ("overruled", []), (2, "a"): ("skipped", ["x > 1.0"]), (2, "b"): ("skipped", ["x < 5.0"]), (2, "none"): ("executed", []), (3, "a"): ("skipped", ["y <> no"]), (3, "b"): ("skipped", ["x < 5.0", "z = 1.0"]), (3, "none"): ("executed", []), (None, "a"): ("skipped", ["y <> no"]), (None, "b"): ("executed", []), (None, "none"): ("overruled", [])}
    for most in (shared.BROADCAST_BYTES, 0):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
        made, refused = rules.conditions_of(rules.in_force(known), conditions)
        got = rules.evaluate(rules.facts(data, ["id"], ["x", "y", "z"]), ["id"], known, made).collect()
        assert {(r.id, r.rule_id): (r.outcome, r.failed) for r in got} == want and refused.isEmpty()


def test_refused_rules(spark):
    known = spark.createDataFrame([(c, 1, "active", "g", 1, "A") for c in "abcd"], "rule_id string, version int, status string, rule_group string, priority int, action string")
    needs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone")], "rule_id string, needed string")
    none = spark.createDataFrame([], "rule_id string, version int, fact string, op string, number double, text string")
    made, refused = rules.conditions_of(known, none, needs)
    assert {(r.rule_id, r.reason) for r in refused.collect()} == {("a", "cycle"), ("b", "cycle"), ("c", "needs a rule not in force")} and {r.rule_id for r in made.collect()} == {"d"}


def test_lookup_at_a_time(spark):
    random.seed(5)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    versions = [(random.choice(["a", "a", "b", None]), day(random.randrange(900)), v, random.choice([None, f"p{v}"])) for v in range(120)]
    asked = [(random.choice(["a", "b", "c", None]), day(random.randrange(-20, 1000)), i) for i in range(200)]
    got = history.at_time(spark.createDataFrame(asked, "k string, at date, i int").repartition(3), spark.createDataFrame(versions, "k string, since date, v int, price string").repartition(3), ["k"], "at", "since", "v", F.year("_time") * 12 + F.month("_time"), ["v", "price"]).collect()
    want = {}
    for k, at, i in asked:
        best = max(((since, v, price) for key, since, v, price in versions if key == k and since <= at), default=(None, None, None), key=lambda x: x[:2])
        want[i] = (k, at, best[1], best[2])
    assert {r.i: (r.k, r["at"], r.v, r.price) for r in got} == want and len(got) == 200


def test_differences_of_cells(spark):
    ddl = "k int, n double, s string"
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, None), (3, None, "c"), (4, 1.0, "d"), (5, 1.0, "e"), (5, 1.0, "e"), (None, 1.0, "f")], ddl)
    new = spark.createDataFrame([(1, 1.05, "a"), (2, 1.2, "b"), (3, 2.0, "c"), (6, 1.0, "d"), (5, 1.0, "e"), (None, 1.0, "g")], ddl)
    got = {(r.k, r.column, r.old, r.new, r.kind) for r in history.differences(old, new, ["k"], 0.1).collect()}
    assert got == {(2, "n", "1.0", "1.2", "changed"), (2, "s", None, "b", "changed"), (3, "n", None, "2.0", "changed"), (4, None, None, None, "removed"), (6, None, None, None, "added"), (5, None, "2", "1", "duplicate"), (None, "s", "f", "g", "changed")}


def test_alternatives_by_brute_force(spark):
    random.seed(6)
    rows = [(i, random.choice(["x", "y", None]), random.choice([None, *range(-9, 12)]), random.uniform(0, 30), round(random.random(), 1)) for i in range(80)]
    got = {(r.id, r.place): r.alternative for r in relations.alternatives(spark.createDataFrame(rows, "id int, kind string, size int, weight double, cost double"), "id", ["kind"], {"size": 3, "weight": 8.0}, "cost", 4).collect()}
    want = {}
    for i, kind, size, weight, _ in rows:
        fits = sorted((c, j) for j, k, s, w, c in rows if j != i and kind is not None and k == kind and None not in (s, size) and abs(s - size) <= 3 and abs(w - weight) <= 8)
        want |= {(i, n + 1): j for n, (_, j) in enumerate(fits[:4])}
    assert got == want


def test_units_refuse_what_does_not_fit(spark):
    rows = [(1.0, "inch", "cm"), (1.0, "bar", "kPa"), (1.0, "bar", "mm"), (1.0, "ell", "mm"), (None, "mm", "mm"), (1.0, "mm", None)]
    df = spark.createDataFrame(rows, "v double, unit string, to string")
    got = [tuple(r.t) for r in df.select(units.told(units.quantity(F.col("v"), F.col("unit")), F.col("to")).alias("t")).collect()]
    assert got[0][1] is None and abs(got[0][0] - 2.54) < 1e-12 and got[1] == (100.0, None)
    assert [g[1] for g in got[2:]] == ["isn't measured in mm", "unknown unit ell", "no value", "unknown unit null"] and all(g[0] is None for g in got[2:])
    none = df.limit(1).select(units.told(units.flow_velocity(units.quantity(F.lit(1.0), F.lit("litre/min")), units.quantity(F.lit(0.0), F.lit("mm"))), F.lit("m/s")).alias("t")).first().t
    assert none.error == "division by zero"


def plain_source(lines, hit, value):
    return next((x for x in lines if hit.lower() in x.lower()), value)


def test_first_lines_of_hits(spark):
    """A hit's line may be one where it only stands within a longer word."""
    random.seed(2)
    parts = ["15 bar", "5 bar", "115,5 bar", "5,5 BAR", "DN125", "DN 12", "xDN12", "dn12", "QRS", "qr", "k=800", "K = 80", "168 °C", "68 °C", "68°c", "5\nbar", "result", "UL", "FM", "nfpa13", "NFPA 13", "plain"]
    texts = ["\n".join(" ".join(random.choices(parts, k=random.randint(0, 4))) for _ in range(12)) for _ in range(25)]
    pages = extract.normalize_pages(spark.createDataFrame([(i, 0, 1, t) for i, t in enumerate(texts)], "doc_id int, page_ord int, page_number int, text string"))
    cleaned = {r.doc_id: r.text for r in pages.collect()}
    got = extract.requirements(pages).collect()
    assert {r.type for r in got} == {"standard", "pressure", "property", "dimension"}
    patterns = {"pressure": [r"\b\d{1,3}(?:[,.]\d+)?\s*bar\b"], "property": [r"\bQR\b", r"\bK\s*=\s*(?:80|115)\b", r"\b\d{2,3}\s*°\s*C\b"], "dimension": [r"\bDN\s?\d{2,3}\b"]}
    want = set()
    for i, text in cleaned.items():
        rows, seen = [x.strip() for x in text.split("\n") if x.strip()], set()
        for kind, of_kind in patterns.items():
            for pattern in of_kind:
                for hit in re.findall(pattern, text, re.I):
                    value = re.sub(r"DN\s+", "DN", re.sub(r"\s+", " ", hit), flags=re.I)
                    key = (kind, re.sub(r"^-|-$", "", re.sub("[^a-z0-9]+", "-", value.lower())))
                    if key not in seen:
                        seen.add(key)
                        want.add((i, kind, value, plain_source(rows, hit, value)))
    assert {(r.doc_id, r.type, r.value, r.source_text) for r in got if r.type != "standard"} == want


def test_a_page_of_many_lines(spark):
    text = "\n".join(f"Line {i} pipe DN{10 + i % 990} at {i % 1000},{i % 7} bar NFPA 13 K=80 {i % 99 + 20} °C" for i in range(20_000))
    pages = extract.normalize_pages(spark.createDataFrame([("a", 0, 1, text)], "doc_id string, page_ord int, page_number int, text string"))
    began = time.time()
    assert len(extract.requirements(pages).collect()) == 8091 and len(extract.standards(pages).collect()) == 1
    assert time.time() - began < 60  # seconds; it took minutes when every hit looked through all lines


def test_audit_log(spark, tmp_path):
    """Chains against plain Python, then each kind of break; a batch is never written over."""
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = [(i, "é" if i % 3 else None, None if i % 5 == 0 else f"p{i}") for i in range(40)]
    events = spark.createDataFrame(rows, "id long, tenant string, payload string").repartition(4)
    audit.append(events, str(tmp_path), ["tenant"], ["id"], "id", 0, per=8)
    audit.append(events.limit(0), str(tmp_path), ["tenant"], ["id"], "id", 1, per=8)
    with pytest.raises(AnalysisException):
        audit.append(events, str(tmp_path), ["tenant"], ["id"], "id", 0, per=8)
    log, known = spark.read.parquet(f"{tmp_path}/log"), spark.read.parquet(f"{tmp_path}/heads")
    got, want = log.collect(), {}
    for tenant in ("é", None):
        own = [r for r in rows if r[1] == tenant]
        for cut in range(slices := -(-len(own) // 8)):
            before = sha(*map(field, (0, tenant, cut)))
            for place, r in enumerate(r for r in own if r[0] % slices == cut):
                want[r] = (cut, place, before, before := sha(before, sha(*map(field, r))))
    assert {(r.id, r.tenant, r.payload): (r.slice, r.place, r.before, r.hash) for r in got} == want and len(got) == 40
    found = lambda df: sorted((r.tenant or "", r.slice, r.place, r.kind) for r in audit.broken(df, known, ["tenant"]).collect())
    where = {r.id: (r.tenant or "", r.slice, r.place) for r in got}
    assert found(log) == []
    assert found(log.filter("id != 1")) == [(*where[1][:2], where[1][2] + 1, "gap")]
    last = max((r for r in got if r.tenant and r.slice == 0), key=lambda r: r.place)
    assert found(log.filter(F.col("id") != last.id)) == [("é", 0, last.place, "ended")]
    assert found(log.filter("not (tenant <=> 'é' and slice = 0)")) == [("é", 0, 0, "ended")]
    assert found(log.withColumn("payload", F.expr("if(id = 1, null, payload)"))) == [(*where[1], "altered")]
    assert found(log.union(log.filter("id = 1"))) == [(*where[1], "repeated")]
    forged = F.sha2(F.concat("before", audit.digest(["id", "tenant", "payload"])), 256)
    assert found(log.withColumn("payload", F.expr("if(id = 1, 'x', payload)")).withColumn("hash", forged)) == [(*where[1][:2], where[1][2] + 1, "unlinked")]
    assert audit.broken(log.limit(0), known.limit(0), ["tenant"]).collect() == []


def test_traces(spark, tmp_path, monkeypatch):
    """Walks over random links, some in circles, against plain Python; hot rows joined apart give the same."""
    random.seed(11)
    rows = [(random.choice("ab"), random.choice("xyz"), str(random.randrange(6)), random.choice("xyz"), str(random.randrange(6))) for _ in range(40)]
    found = spark.createDataFrame([(r[0], "s", *r[1:]) for r in rows * 2], "run string, stage string, made string, made_id string, used string, used_id string").distinct()
    start = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("b", "y", "2"), ("b", "z", "77"), (None, "x", "1")], "run string, name string, id string")

    def walk(run, name, key, back=True):
        seen, front, hops = {(name, key): 0}, {(name, key)}, 0
        while front:
            hops += 1
            front = {b for r, *ends in rows if r == run for a, b in [(tuple(ends[:2]), tuple(ends[2:]))[:: 1 if back else -1]] if a in front} - seen.keys()
            seen |= dict.fromkeys(front, hops)
        return {(name, key, run, *k, h) for k, h in seen.items() if h}

    for heavy in (trace.HEAVY, 2):
        monkeypatch.setattr(trace, "HEAVY", heavy)
        for go, back in ((trace.backward, True), (trace.forward, False)):
            got = [tuple(r[c] for c in ("start", "start_id", "run", "name", "id", "hops")) for r in go(found, start).collect()]
            assert len(got) == len(set(got)) and set(got) == walk("a", "x", "1", back) | walk("b", "y", "2", back) | walk("b", "z", "77", back)
    made = {(r[0], r[1], r[2]) for r in rows}
    assert {(r.run, r.used, r.used_id) for r in trace.unfounded(found, spark.createDataFrame([("x", "0")], "name string, id string")).collect()} == {(r[0], r[3], r[4]) for r in rows if r[3:] != ("x", "0") and (r[0], r[3], r[4]) not in made}
    assert trace.backward(found.limit(0), start).isEmpty()
    run = spark.createDataFrame([("a", "v2", "me")], "run string, rule_version string, user string")
    trace.record(run, found, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/links").count() == found.filter("run = 'a'").count() and spark.read.parquet(f"{tmp_path}/runs").first().rule_version == "v2"
    with pytest.raises(AnalysisException):
        trace.record(run, found, str(tmp_path))


def test_events_in_order(spark, tmp_path):
    """Three deliveries: out of order, repeated, late, tied; each event once and in place, by what the watermark has passed."""
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    batches = [
        [("e3", "u", "c", at(30)), ("e1", "u", "a", at(10)), ("e1", "u", "a", at(10)), ("f1", "v", None, at(5)), (None, "u", "n", at(1)), ("e9", None, "n", at(1)), ("e8", "u", "n", None)],
        [("e2", "u", "b", at(20)), ("e3", "u", "c", at(30)), ("f2", "v", "y", at(200)), ("f0", "v", "x", at(5))],
        [("late", "u", "z", at(15)), ("e1", "u", "a", at(10)), ("e4", "u", "d", at(210)), ("f3", "v", "w", at(400))],
        [("e5", "u", "e", at(500))],
    ]
    schema = "event_id string, user_id string, event_type string, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        flow = stream.read(spark, f"{tmp_path}/in/*", spark.createDataFrame(rows, schema).schema)
        told = ordered.in_order(flow).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        told.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.key, r.place, r.event_id, r.event_type, r.before) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("u", 1, "e1", "a", None), ("u", 2, "e2", "b", "a"), ("u", 3, "e3", "c", "b"), ("u", 4, "e4", "d", "c"), ("v", 1, "f0", "x", None), ("v", 2, "f1", None, "x"), ("v", 3, "f2", "y", None), ("v", 4, "f3", "w", "y")]


def test_keys_share_buckets_and_keep_their_order(spark, tmp_path):
    """Many keys to a bucket, five deliveries: as told key by key, and the store holds buckets, not keys."""
    random.seed(7)
    start, hour, known, seen, want, passed = dt.datetime(2024, 1, 1), 3600, {}, {}, {}, None
    schema = "event_id string, user_id string, event_type string, ts timestamp"
    for i in range(5):
        fresh = [(f"e{i}-{n}", f"u{random.randrange(40)}", random.choice(["a", "b", "ö", None]), 7200 * i + random.randrange(0, 9000, 600)) for n in range(150)]
        rows = fresh + random.sample(fresh, 30) + random.sample(list(known.values()), 30 if known else 0)
        rows += [(f"late{i}-{n}", f"u{n * 7}", "late", max(0, 7200 * (i - 1) - n)) for n in range(8)] if i != 1 else []
        random.shuffle(rows)
        for row in rows:
            known[row[:2]] = row
            if passed is None or row[3] > passed:
                seen.setdefault(row[1], {})[row[3], row[0]] = row[2]
        passed = max(r[3] for r in known.values()) - hour
        frame = spark.createDataFrame([(*r[:3], start + dt.timedelta(seconds=r[3])) for r in rows], schema)
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        flow = stream.read(spark, f"{tmp_path}/in/*", frame.schema)
        run = ordered.in_order(flow, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        assert max(o.numRowsTotal for p in run.recentProgress for o in p.stateOperators) <= 3 * 3  # what waits, what was told and a timer
    for user, events in seen.items():
        told = [(at, event, kind) for (at, event), kind in sorted(events.items()) if at <= passed]
        want[user] = [(user, n + 1, event, kind, told[n - 1][2] if n else None) for n, (at, event, kind) in enumerate(told)]
    got = sorted(((r.key, r.place, r.event_id, r.event_type, r.before) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[:2])
    assert got == sorted((r for rows in want.values() for r in rows), key=lambda r: r[:2]) and len(got) > 400
