"""Ledgers, diagnosis, sidecars, trees, whole commands and streams."""

import datetime as dt
import hashlib
import itertools
import json
import os

import pytest
from conftest import compare
from pyspark.sql import functions as F

from stratalog.functions import formats, hashing
from stratalog.operators import doctor, ledger, sidecars
from stratalog.plans import commands, execute, ingest, progress, registry, verify
from stratalog.sources import ledger as ledger_files
from stratalog.sources import store as stores
from stratalog.sources import tree as trees
from stratalog.streaming import events as streams
from stratalog.streaming import log as event_log
from stratalog.streaming import state

JPEG = b"\xff\xd8\xff\xe0rest of "


def test_fold_equals_loop(spark):
    kinds = ("copy", "duplicate", "skip", "error", "odd")
    rows, want = [], {}
    for n in (1, 2, 3, 4):
        for k, combo in enumerate(itertools.product(kinds, repeat=n)):
            path, state = f"{n}-{k}", None
            for s in combo:
                rows.append((path, len(rows), s))
                if not (state in ("copy", "duplicate") and s == "skip"):
                    state = s
            want[path] = state
    got = {r["path"]: r["status"] for r in ledger.folded(spark.createDataFrame(rows, "path string, seq bigint, status string")).collect()}
    assert got == want


def test_ledger_file(spark, tmp_path):
    path = str(tmp_path / ".ledger")
    with ledger_files.LedgerWriter(path, {"version": 4, "run_id": "r1", "algorithm": "sha256", "recursive": True}) as w:
        w.write({"path": "<a>.jpg", "status": "copy", "checksum": "c", "reason": None, "sidecars": [".xmp"]})
    with open(path, "a") as f:
        f.write("\n{broken\n")
    with ledger_files.LedgerWriter(path, {"version": 4, "run_id": "r2"}) as w:
        w.write({"path": "b.txt", "status": "skip", "reason": "unsupported format: .txt"})
    text = open(path).read()
    assert '"<a>.jpg"' in text and "reason" not in text.split("\n")[1]
    lines = ledger.with_runs(ledger_files.read_ledger(spark, path)).orderBy("seq").collect()
    assert [(r["run_seq"], r["run_id"], r["path"]) for r in lines] == [(1, "r1", None), (1, None, "<a>.jpg"), (2, "r2", None), (2, None, "b.txt")]
    assert [r["path"] for r in ledger.latest_entries(ledger.with_runs(ledger_files.read_ledger(spark, path))).collect()] == ["b.txt"]
    assert ledger_files.read_ledger(spark, str(tmp_path / "none")) is None
    with open(path, "a") as f:
        f.write("x" * (ledger_files.MOST_LINE + 1))
    with pytest.raises(ledger_files.LineTooLong):
        ledger_files.read_ledger(spark, path)
    told = []
    bad = ledger_files.LedgerWriter(str(tmp_path / "no" / "folder"), {}, told.append)
    bad.write({"path": "x"})
    assert len(told) == 1


def test_manifest(spark, tmp_path):
    doc = {"version": 1, "source": "/s", "destination": "/d", "algorithm": "sha1", "started_at": "2026-01-01T10:00:00Z", "workers": 2, "files": [{"source": "/s/a", "destination": "/d/2021/a.jpg", "checksum": "c", "status": "complete", "verified_at": "2026-01-01T10:00:00Z"}, {"source": "/s/b", "destination": "/d/duplicates/b.jpg", "status": "complete"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    now = dt.datetime(2026, 5, 5)
    run, files = stores.imported_manifest(ledger_files.read_manifest(spark, str(tmp_path / "m.json")), "m", now)
    got = files.orderBy("id").collect()
    assert [(r["dest_rel"], r["is_duplicate"], r["verified_at"]) for r in got] == [("2021/a.jpg", False, now), ("duplicates/b.jpg", True, None)]
    assert run.collect()[0]["status"] == "completed"


def test_every_rule(spark):
    rows = [(f"p{k}", s, f"X {p.upper()} y") for k, r in enumerate(doctor.RULES) for s, p in [(r.statuses[0], r.patterns[0] or "strange")]]
    rows += [("o", "skip", "orphan sidecar: no matching media file"), ("d", "duplicate", None), ("c", "copy", None), ("n", "failed", None), ("m", "failed", "verify: copy: checksum")]
    df = spark.createDataFrame(rows, "path string, status string, message string")
    got = {}
    for r in doctor.report(df).orderBy("path").collect():
        got.setdefault(r["rule_order"], []).append(r["path"])
    assert sorted(got) == list(range(1, 15)) and got[14] == ["n", "p13"] and got[4] == ["m", "p3"]
    assert {r["rule_order"]: r["files"] for r in doctor.report_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert doctor.duplicate_count(df).collect()[0]["duplicates"] == 1


def test_sidecars_on_ingest(spark):
    media = spark.createDataFrame([("d", n, f"d/{n}", k) for k, n in enumerate(["IMG_1234.HEIC", "IMG_1234.JPG", "A.jpg"])], "dir string, name string, path string, seq bigint")
    side = spark.createDataFrame([("d", n, f"d/{n}") for n in ("img_1234.xmp", "IMG_1234.JPG.xmp", "A.XMP", "z.xmp")] + [("e", "A.xmp", "e/A.xmp")], "dir string, name string, path string")
    got = {r["name"] + r["dir"]: r["media_path"] for r in sidecars.attached_on_ingest(media, side).collect()}
    assert got == {"img_1234.xmpd": "d/IMG_1234.HEIC", "IMG_1234.JPG.xmpd": "d/IMG_1234.JPG", "A.XMPd": None, "z.xmpd": None, "A.xmpe": None}
    assert sidecars.orphans(sidecars.attached_on_ingest(media, side)).count() == 3


def test_sidecars_in_archive(spark):
    media = spark.createDataFrame([("", n, n, k) for k, n in enumerate(["x.arw", "x.jpg"])], "dir string, name string, path string, seq bigint")
    side = spark.createDataFrame([("", n, n) for n in ("x.arw.xmp", "x.jpg.AAE", "orphan.xmp", "X.arw.xmp")], "dir string, name string, path string")
    got = {r["name"]: r["media_path"] for r in sidecars.attached_in_archive(media, side).collect()}
    assert got == {"x.arw.xmp": "x.arw", "x.jpg.AAE": "x.jpg", "orphan.xmp": None, "X.arw.xmp": None}
    assert [tuple(r) for r in sidecars.extensions_by_media(sidecars.attached_in_archive(media, side)).orderBy("media_path").collect()] == [("x.arw", [".xmp"]), ("x.jpg", [".aae"])]


@pytest.fixture
def card(tmp_path):
    root = tmp_path / "card"
    for name, data in {"b.jpg": JPEG + b"one", "a.jpg": JPEG + b"one", "sub/c.jpg": JPEG + b"two", "notes.txt": b"hi", "empty.jpg": b"", ".hidden.jpg": JPEG, "b.xmp": b"<x/>", "lone.xmp": b"<x/>", ".dot/d.jpg": JPEG, "skip.tmp": JPEG, "cache/e.jpg": JPEG}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "cache" / commands.IGNORE).write_text("")
    (root / commands.IGNORE).write_text("cache/\n")
    os.symlink(root / "a.jpg", root / "link.jpg")
    return root


def test_tree(spark, card):
    rows = trees.classified(trees.read_tree(spark, str(card), scopefile=commands.IGNORE), ignore=["*.tmp"], always=(commands.IGNORE,))
    got = {r["rel_path"]: r["reason"] for r in rows.collect()}
    assert got == {
        "a.jpg": None, "b.jpg": None, "sub/c.jpg": None, "b.xmp": None, "lone.xmp": None, "link.jpg": "symlink", ".hidden.jpg": "dotfile", "empty.jpg": "detection error: EOF", "notes.txt": "unsupported format: .txt",
    }
    assert trees.read_tree(spark, str(card), recursive=False).where("rel_path like '%/%'").count() == 0
    assert trees.read_tree(spark, str(card), dotdirs=True).where("rel_path = '.dot/d.jpg'").count() == 1


def test_ingest_verify_status_doctor_clean(spark, card, tmp_path):
    archive, store = str(tmp_path / "archive"), stores.Store(spark, str(tmp_path / "catalog"))
    options = commands.IngestOptions(ignore=["*.tmp"], owner="me")
    dry = commands.run_ingest(spark, store, str(card), archive, commands.IngestOptions(ignore=["*.tmp"], dry_run=True))
    assert dry["processed"] == 3 and not os.path.exists(archive) and store.files.count() == 0
    out = commands.run_ingest(spark, store, str(card), archive, options)
    assert (out["processed"], out["duplicates"], out["skipped"], out["errors"]) == (3, 1, 5, 0)
    files = {os.path.relpath(r["source_path"], card): r for r in store.files.collect()}
    assert files["a.jpg"]["is_duplicate"] is False and files["b.jpg"]["is_duplicate"] and files["b.jpg"]["dest_rel"].startswith("duplicates/") and files["b.jpg"]["carried_sidecars"] == [".xmp"]
    assert os.path.exists(os.path.join(archive, files["sub/c.jpg"]["dest_rel"] + ".xmp"))
    checked = commands.run_verify(spark, archive)
    assert {tuple(r) for r in verify.counters(checked).collect()} == {(3, 0, 0)}
    status = {r["path"]: r["bucket"] for r in commands.run_status(spark, str(card), ignore=["*.tmp"]).collect()}
    assert (status["a.jpg"], status["b.jpg"], status["notes.txt"]) == ("SORTED", "DUPLICATE", "UNRECOGNIZED")
    assert {r["category"] for r in commands.run_doctor(spark, source=str(card)).collect()} == {"Unsupported format", "Symbolic link", "Hidden file", "Detection error"}

    again = commands.run_ingest(spark, store, str(card), archive, options)
    assert (again["processed"], again["skipped"]) == (0, 8)
    assert commands.run_doctor(spark, store).where("category = 'Previously imported'").collect()[0]["files"] == 3
    open(os.path.join(archive, "x" + execute.TEMPORARY), "w").close()
    cleaned = commands.run_clean(spark, archive, store)
    assert cleaned["temporary"]["removed"] == 1 and cleaned["compacted"]
    stats = commands.run_stats(store)
    assert stats["stats"].collect()[0]["runs"] == 2
    envelope = json.loads(commands.as_json("files", archive, store.files.select("source_path")))
    assert envelope["summary"]["count"] == len(envelope["results"])
    assert commands.as_table(spark.createDataFrame([("é", None)], "a string, bb string")).split("\n") == ["a   bb", "é"]


def test_copy_is_checked(tmp_path):
    source = tmp_path / "s"
    source.write_bytes(b"data")
    status, error, _ = execute.copy_file(str(source), str(tmp_path / "d" / "x"), "0" * 40, "sha1")
    assert status == "mismatch" and error.startswith("verify:") and os.listdir(tmp_path / "d") == []
    assert execute.copy_file(str(tmp_path / "none"), str(tmp_path / "d" / "x"), "", "sha1")[0] == "failed"
    good = execute.file_hash(str(source), "sha1")
    assert execute.copy_file(str(source), str(tmp_path / "d" / "x"), good, "sha1") == ("complete", None, 4)
    assert {execute.file_hash(str(source), a)[:4] for a in ("md5", "blake3", "xxhash")}


def test_next_copies_take_over(spark):
    """Firsts fail once, twice in a row and always; a checksum that the catalogue holds has no first here."""
    fails = {1, 4, 5, 8, 9, 12}
    sums = {"a": (1, 2, 3), "b": (4, 5, 6, 7), "c": (8, 9), "d": (10, 11), "e": (12, 13)}
    rows = [(k, f"/s/{k}", ".jpg", c, dt.datetime(2021, 1, k), None) for c, ids in sums.items() for k in ids]
    candidates = spark.createDataFrame(rows, "id bigint, source_path string, ext string, checksum string, capture_date timestamp_ntz, error string")
    files = spark.createDataFrame([(900, "/old", "e", "complete", "kept/e.jpg")], "id bigint, source_path string, checksum string, status string, dest_rel string")
    attempts = []

    def attempt(part):
        ids = sorted(r["id"] for r in part.where("dest_rel is not null").collect())
        attempts.append(ids)
        return part.where("dest_rel is not null").select("id", F.when(F.col("id").isin(*fails), "failed").otherwise("complete").alias("status"), F.col("dest_rel").alias("went_to"))

    written = {}

    def table(name, df):
        written[name] = spark.createDataFrame(df.collect(), df.schema)
        return written[name]

    for skip in (False, True):
        attempts.clear()
        plan, done = ingest.settled(ingest.planned(candidates, files, "R", skip_duplicates=skip), attempt, table)
        got = {r["id"]: r for r in plan.collect()}
        place = {k: r["place"] for k, r in got.items()}
        assert attempts[:4] == [[1, 4, 8, 10], [2, 5, 9], [6], attempts[-1]] and attempts[-1] == ([] if skip else [3, 7, 11, 12, 13])
        assert sorted(k for k, r in got.items() if r["is_duplicate"]) == sorted(k for k, r in got.items() if r["outcome"] == "duplicate") == [3, 7, 11, 12, 13]
        assert {k: got[k]["matches"] for k in (3, 7, 11, 12, 13)} == {3: place[2], 7: place[6], 11: place[10], 12: "kept/e.jpg", 13: "kept/e.jpg"}
        assert all(got[k]["dest_rel"] == place[k] and got[k]["matches"] is None for k in (1, 2, 4, 5, 6, 8, 9, 10))
        assert {r["id"]: r["status"] for r in done.collect()} == {k: "failed" if k in fails else "complete" for k in (range(1, 14) if not skip else (1, 2, 4, 5, 6, 8, 9, 10))}


def test_ingest_replaces_a_copy_that_fails(spark, tmp_path, monkeypatch):
    """The first two of four equal files can't be read any more when they are copied; what was observed is what the catalogue says."""
    source, archive, store = tmp_path / "card", str(tmp_path / "archive"), stores.Store(spark, str(tmp_path / "catalog"))
    source.mkdir()
    for name in ("a.jpg", "b.jpg", "c.jpg", "d.jpg", "e.jpg"):
        (source / name).write_bytes(JPEG + (b"same" if name != "e.jpg" else b"other"))
    planned = ingest.planned

    def lose(*args, **options):
        plan = planned(*args, **options)
        return plan.withColumn("source_path", F.when(F.col("name").isin("a.jpg", "b.jpg"), F.concat("source_path", F.lit(".gone"))).otherwise(F.col("source_path")))

    monkeypatch.setattr(ingest, "planned", lose)
    out = commands.run_ingest(spark, store, str(source), archive, commands.IngestOptions(ledger=False))
    rows = {r["id"]: r for r in store.files.collect()}
    assert [(r["status"], r["is_duplicate"]) for _, r in sorted(rows.items())] == [("failed", False), ("failed", False), ("complete", False), ("complete", True), ("complete", False)]
    assert rows[3]["dest_rel"].startswith("duplicates/") is False and rows[4]["dest_rel"].startswith("duplicates/")
    assert os.path.exists(rows[3]["dest_path"]) and os.path.exists(rows[4]["dest_path"])
    size = sum(os.path.getsize(r["dest_path"]) for r in rows.values() if r["status"] == "complete")
    assert (out["files_observed"], out["bytes_observed"], out["failed_observed"], out["errors"], out["duplicates"]) == (5, size, 2, 2, 1)


def test_formats_bring_their_own_digest_and_tags(spark, tmp_path):
    """Two files that differ in their tags alone are copies; one format keeps tags inside, one beside, one nowhere."""

    def digest(path, algorithm):
        with open(path, "rb") as f:
            return hashlib.sha1(f.read().split(b"#")[0]).hexdigest()

    def embed(path, rights, owner):
        with open(path, "ab") as f:
            f.write(f"#{rights}|{owner}".encode())

    registry = formats.Registry()
    registry.register(formats.Format("OWN", (".own",), ((0, b"OWN"),), tags="embed", write_tags=embed, digest=digest))
    registry.register(formats.Format("PLAIN", (".pla",), ((0, b"PLA"),), tags="none"))
    source, archive, store = tmp_path / "card", str(tmp_path / "archive"), stores.Store(spark, str(tmp_path / "catalog"))
    source.mkdir()
    for name, body in (("a.own", b"OWN x#old tags"), ("b.own", b"OWN x#other tags"), ("c.pla", b"PLA y"), ("d.jpg", JPEG)):
        (source / name).write_bytes(body)
    out = commands.run_ingest(spark, store, str(source), archive, commands.IngestOptions(ledger=False, owner="me", registry=registry))
    rows = {os.path.basename(r["source_path"]): r for r in store.files.collect()}
    assert (out["processed"], out["duplicates"], out["errors"]) == (4, 1, 0) and rows["b.own"]["is_duplicate"] and rows["a.own"]["checksum"] == hashlib.sha1(b"OWN x").hexdigest()
    assert open(rows["a.own"]["dest_path"], "rb").read() == b"OWN x#old tags#|me" and open(rows["c.pla"]["dest_path"], "rb").read() == b"PLA y"
    assert {n: os.path.exists(r["dest_path"] + ".xmp") for n, r in rows.items()} == {"a.own": False, "b.own": False, "c.pla": False, "d.jpg": True}


def test_ingest_tells_of_every_file(spark, card, tmp_path):
    """The log's events equal what the catalogue says; streams follow it, and a second ingest is read from where the first ended."""
    archive, log, store = str(tmp_path / "archive"), str(tmp_path / "log"), stores.Store(spark, str(tmp_path / "catalog"))
    count = lambda: state.into_table(event_log.follow(spark, log), str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(60)
    out = commands.run_ingest(spark, store, str(card), archive, commands.IngestOptions(ignore=["*.tmp"], ledger=False, events=log))
    count()
    seen = spark.read.parquet(str(tmp_path / "t"))
    kinds = {r["kind"]: r["events"] for r in streams.counters(seen).collect()}
    assert kinds == {"hash": 3, "copy": 3, "complete": 2, "duplicate": 1} and seen.select("event_id").distinct().count() == 9
    assert {r["path"]: r["bytes_done"] for r in seen.where("kind = 'copy'").collect()} == {os.path.relpath(r["source_path"], card): r["file_size"] for r in store.files.collect()}
    assert streams.worker_states(seen.withColumn("worker_id", F.floor(F.col("event_id") / event_log.STAGES))).count() == 0 and out["bytes_observed"] == seen.where("kind = 'copy'").agg(F.sum("bytes_done")).collect()[0][0]
    commands.run_ingest(spark, store, str(card), archive, commands.IngestOptions(ignore=["*.tmp"], ledger=False, events=log))
    count()
    assert spark.read.parquet(str(tmp_path / "t")).where("kind = 'skip' and message = 'previously imported'").count() == 3
    assert len(list(event_log.lines(spark, log))) == 15
    commands.run_ingest(spark, store, str(card), archive, commands.IngestOptions(dry_run=True, events=log))
    assert event_log.read(spark, log).count() == 15


def test_observed_counters(spark, tmp_path):
    told = []
    seen = progress.Observed(lambda stage, counters: told.append((stage, counters)))
    for k in range(3):
        seen.watch("s", spark.range(10 * k + 1), {"n": F.count("*"), "sum": F.sum("id")}).write.parquet(str(tmp_path / str(k)))
    assert seen.totals("s") == {"n": 33, "sum": sum(sum(range(10 * k + 1)) for k in range(3))} and len(told) == 3 and seen.totals("other") == {}


def test_plan_order_of_decisions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "/a", ".jpg", "c", at, "broken"), (2, "/b", ".jpg", "c", at.replace(year=2000), None), (3, "/c", ".jpg", "c", at, None), (4, "/d", ".jpg", "c", at, None), (5, "/e", ".jpg", "k", at, None), (6, "/f", ".jpg", "i", at, None)]
    new = spark.createDataFrame(rows, "id bigint, source_path string, ext string, checksum string, capture_date timestamp_ntz, error string")
    known = spark.createDataFrame([(90, "/z", "k", "complete", "there.jpg"), (91, "/f", "i", "complete", None)], "id bigint, source_path string, checksum string, status string, dest_rel string")
    got = {r["id"]: (r["outcome"], r["matches"]) for r in ingest.planned(new, known, "s", since=dt.date(2020, 1, 1)).collect()}
    assert got == {1: ("error", None), 2: ("skip", None), 3: ("copy", None), 4: ("duplicate", "2024/01-Jan/20240101_000000-1-c.jpg"), 5: ("duplicate", "there.jpg"), 6: ("skip", None)}


def fed(spark, source, schema, *batches):
    """Appends files to a folder and reads it as a stream, a file per micro-batch."""
    for rows in batches:
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_first_seen_survives_restart(spark, tmp_path):
    table, checkpoint, kind = str(tmp_path / "table"), str(tmp_path / "state"), "event_id bigint, checksum string"
    go = lambda stream: state.into_table(state.first_seen(stream), table, checkpoint).trigger(availableNow=True).start().awaitTermination(60)
    found = lambda: sorted((r["event_id"], r["checksum"]) for r in spark.read.parquet(table).collect())
    go(fed(spark, tmp_path / "in", kind, [(2, "a"), (1, "a"), (3, "b")]))
    assert found() == [(1, "a"), (3, "b")]
    go(fed(spark, tmp_path / "in", kind, [(4, "b"), (5, "c"), (6, None)], [(0, "a"), (7, "c"), (8, "d")]))
    assert found() == [(1, "a"), (3, "b"), (5, "c"), (8, "d")]
    # What is written a second time, after a failure, replaces the first try; no other batch is touched.
    before = {r["f"] for r in spark.read.parquet(table).where("batch < 2").select(F.input_file_name().alias("f")).collect()}
    batch = spark.createDataFrame([(8, "d")], kind).withColumn("batch", F.lit(2).cast("bigint"))
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
    assert found() == [(1, "a"), (3, "b"), (5, "c"), (8, "d")] and before == {r["f"] for r in spark.read.parquet(table).where("batch < 2").select(F.input_file_name().alias("f")).collect()}


def test_first_seen_without_python(spark, tmp_path):
    """Keys are told apart in the JVM; the other columns are those of the first row, one without an order comes last."""
    kind = "event_id bigint, checksum string, tags map<string, int>, path string"
    batches = [[(None, "a", None, "n"), (5, "a", {"x": 1}, None), (7, "a", {"x": 2}, "late"), (None, "b", {"y": 1}, "only"), (1, None, None, "none")], [(1, "a", None, "again"), (2, "b", None, "again"), (3, "c", {}, "c")]]
    new = state.first_seen(fed(spark, tmp_path / "in", kind, *batches))
    assert new.columns == ["event_id", "checksum", "tags", "path"] and "pandas" not in new._jdf.queryExecution().analyzed().toString().lower()
    state.into_table(new, str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r["checksum"], r["event_id"], r["tags"], r["path"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [("a", 5, {"x": 1}, None, 0), ("b", None, {"y": 1}, "only", 0), ("c", 3, {}, "c", 1)]


def test_first_seen_forgets(spark, tmp_path):
    """A key that comes again within the time it is kept for is kept on; one that was silent for longer is new."""
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    stream = fed(spark, tmp_path / "in", "event_id bigint, ts timestamp_ntz, checksum string", [(1, at(0), "a"), (2, at(0), "a"), (3, at(0), "b")], [(4, at(8), "b")], [(5, at(15), "c")], [(6, at(16), "b"), (7, at(16), "a")])
    state.into_table(state.first_seen(stream, keep_for="10 seconds", late="1 second"), str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r["event_id"], r["checksum"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (3, "b"), (5, "c"), (7, "a")]


def test_worker_changes(spark, tmp_path):
    """Terminal events end a worker's state, late ones change nothing, and silence expires by event time."""
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    kind = "event_id bigint, ts timestamp_ntz, kind string, worker_id bigint, path string"
    batches = [
        [(1, at(0), "hash", 1, "a"), (2, at(1), "copy", 1, "a"), (3, at(1), "hash", 2, "b"), (9, at(2), "hash", 3, None)],
        [(4, at(2), "complete", 1, "a"), (0, at(0), "hash", 2, "old"), (5, at(50), "hash", 4, "d")],
        [(6, at(100), "copy", 4, "d"), (7, at(101), "hash", 1, "e")],
        [(8, at(103), "copy", 1, "e")],
    ]
    stream = fed(spark, tmp_path / "in", kind, *batches)
    state.into_table(state.worker_changes(stream, "60 seconds", "1 second"), str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "t"))
    got = sorted((r["worker_id"], r["batch"], r["kind"], r["change"]) for r in rows.collect())
    assert [(w, k, c) for w, _, k, c in got] == [
        (1, "copy", "working"), (1, "complete", "ended"), (1, "hash", "working"), (1, "copy", "working"), (2, "hash", "working"), (2, "hash", "expired"),
        (3, "hash", "working"), (3, "hash", "expired"), (4, "hash", "working"), (4, "copy", "working"),
    ]
    assert sorted(tuple(r) for r in state.current_workers(rows).collect()) == [(1, "copy", "e", at(103)), (4, "copy", "d", at(100))]


def test_worker_changes_of_late_events(spark, tmp_path):
    """The latest event of all comes first: later ones count though they are older, and silence expires though no watermark moves."""
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    kind = "event_id bigint, ts timestamp_ntz, kind string, worker_id bigint, path string"
    batches = [
        [(1, at(100), "hash", 1, "a"), (2, at(10), "hash", 2, "b"), (3, at(0), "hash", 3, "c"), (4, at(80), "hash", 5, "e"), (5, at(1), "hash", 7, "g"), (6, at(39), "hash", 6, "f")],
        [(7, at(20), "hash", 2, "b"), (8, at(1), "hash", 3, "c"), (9, None, "complete", 2, "b"), (10, at(38) + dt.timedelta(microseconds=999900), "hash", 8, "h")],
        [(11, at(90), "copy", 2, "b"), (12, at(95), "hash", 4, "d"), (13, at(85), "complete", 5, "e"), (14, at(39) + dt.timedelta(microseconds=1), "hash", 9, "i")],
    ]
    stream = fed(spark, tmp_path / "in", kind, *batches)
    state.into_table(state.worker_changes(stream, "60 seconds", "1 second"), str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "t"))
    last = {r["worker_id"]: r["change"] for r in rows.orderBy("batch").collect()}
    assert {w: c for w, c in last.items() if w != 6} == {1: "working", 2: "working", 3: "expired", 4: "working", 5: "ended", 7: "expired", 8: "expired", 9: "working"}
    # Worker 6 is silent for exactly as long, within the millisecond of the watermark.
    want = [(1, "hash", "a", at(100)), (2, "copy", "b", at(90)), (4, "hash", "d", at(95)), (9, "hash", "i", at(39) + dt.timedelta(microseconds=1))]
    assert sorted(tuple(r) for r in state.current_workers(rows, "60 seconds", "1 second").collect()) == want


def test_workers_streamed_on_more_events(spark):
    sf_dir = "/root/testdata/sf0.01"
    got, want = compare(registry.QUERIES["worker_states_streamed"](spark, sf_dir), registry.ORACLE_SQL["worker_states_streamed"], sf_dir)
    assert got == want and len(want) > 50


def test_worker_states_and_progress(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, at, "hash", 1, "x", None, 10, 100, None), (2, at.replace(second=1), "copy", 1, "x", None, 100, 100, None), (3, at, "hash", 2, "y", None, None, None, None), (4, at.replace(second=2), "complete", 2, "y", None, None, None, "done")]
    e = spark.createDataFrame(rows, streams.EVENT)
    assert [(r["worker_id"], r["kind"]) for r in streams.worker_states(e).collect()] == [(1, "copy")]
    assert [(r["bytes_done"], r["final"]) for r in streams.byte_progress(e).orderBy("start").collect()] == [(10, False), (100, True)]
    assert streams.plain_lines(e).orderBy("line").collect()[-1]["line"].endswith("COMPLETE   y: done")
    assert streams.first_of_checksum(e).count() == 0


def test_verify_asks_for_formats(spark, tmp_path):
    """A right checksum in a name doesn't make a file a known one; sidecars without their media file count."""
    body, other = JPEG + b"x", b"plain text"
    name = lambda data, ext, algorithm="sha1", n=1: f"20211225_062223-{n}-{_hex(data, algorithm)}{ext}"
    for n, data in {name(body, ".jpg"): body, name(other, ".txt"): other, name(other, ".jpg"): other, "orphan.xmp": b"<x/>", "photo.jpg": body, name(b"z", ".jpg"): body, name(body, ".jpg", "blake3", 3): body, name(body, ".jpg", "xxhash", 4): body, name(body, ".jpg") + ".XMP": b"<x/>", ".hidden": body}.items():
        (tmp_path / n).write_bytes(data)
    got = {r["name"]: (r["status"], r["sidecars"]) for r in commands.run_verify(spark, str(tmp_path)).collect()}
    assert got == {
        name(body, ".jpg"): ("verified", " [+xmp]"), name(other, ".txt"): ("unrecognised", ""), name(other, ".jpg"): ("unrecognised", ""), "orphan.xmp": ("unrecognised", ""), "photo.jpg": ("unrecognised", ""),
        name(b"z", ".jpg"): ("mismatch", ""), name(body, ".jpg", "blake3", 3): ("verified", ""), name(body, ".jpg", "xxhash", 4): ("verified", ""),
    }
    assert tuple(verify.counters(commands.run_verify(spark, str(tmp_path))).collect()[0]) == (3, 1, 4)


def _hex(data, algorithm):
    h = hashing.hasher(algorithm)
    h.update(data)
    return h.hexdigest()


def test_ignore_files_hide_files(spark, tmp_path):
    files = ["a.jpg", "b.jpg", "keep.txt", "sub/b.jpg", "sub/c.jpg", "sub/deep/c.jpg", "sub/deep/d.jpg", "gone/x.jpg", "tree/y.jpg", "tree/in/z.jpg", "other/c.jpg", "sub/gone2/q.jpg"]
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(JPEG)
    (tmp_path / commands.IGNORE).write_text("  b.jpg  \n\n  # not a pattern\ngone/\ntree/**\n")
    (tmp_path / "sub" / commands.IGNORE).write_text("c.jpg\ngone2/\ndeep/d.*\n[broken\n")
    found = lambda **o: {r["rel_path"] for r in trees.read_tree(spark, str(tmp_path), scopefile=commands.IGNORE, **o).collect()} - {commands.IGNORE, f"sub/{commands.IGNORE}"}
    assert found() == {"a.jpg", "keep.txt", "other/c.jpg"} == found(files=1)
    assert found(recursive=False) == {"a.jpg", "keep.txt"} and found(prune=["*.txt", "other/"]) == {"a.jpg"}


def test_walk_by_levels_equals_the_reader(spark, tmp_path):
    """Ignore files at three levels, hidden folders, links, empty and unreadable files, folders without files."""
    for k in range(6):
        folder = tmp_path.joinpath(*("abcdef"[:k]))
        folder.mkdir(exist_ok=True)
        for n in range(7):
            (folder / f"{n}.jpg").write_bytes(JPEG + bytes([n]) if n else b"")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.jpg").write_bytes(JPEG)
    (tmp_path / "empty" / "folder").mkdir(parents=True)
    (tmp_path / "gone" / "deep").mkdir(parents=True)
    (tmp_path / "gone" / "deep" / "y.jpg").write_bytes(JPEG)
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "broken")
    (tmp_path / commands.IGNORE).write_text("1.jpg\ngone/\n")
    (tmp_path / "a" / "b" / commands.IGNORE).write_text("c/2.jpg\n3.*\n")
    for options in ({}, {"recursive": False}, {"dotdirs": True}, {"prune": ["e/**", "6.jpg"]}, {"scopefile": commands.IGNORE}, {"scopefile": commands.IGNORE, "content": True, "files": 5}):
        want = sorted(map(str, trees.read_tree(spark, str(tmp_path), **options).collect()))
        got = trees.walk_tree(spark, str(tmp_path), **options)
        assert sorted(map(str, got.collect())) == want and want


def test_spans_cover_a_tree(spark, tmp_path):
    names = [f"{d}/{k:03d}.jpg" for d in ("a", "b", "b/c") for k in range(25)] + ["z.jpg"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    reader = trees.TreeReader({"path": str(tmp_path), "files": "10"})
    parts = reader.partitions()
    assert len(parts) >= 8 and sorted(row[1] for p in parts for row in reader.read(p)) == sorted(names)
    assert all(sum(1 for _ in reader.read(p)) <= 10 for p in parts)


def test_retry_takes_failed_files_that_are_there(spark, card, tmp_path):
    archive, store = str(tmp_path / "archive"), stores.Store(spark, str(tmp_path / "catalog"))
    os.chmod(card / "a.jpg", 0o644)
    first = commands.run_ingest(spark, store, str(card), archive, commands.IngestOptions(ignore=["*.tmp"], algorithm="sha256", ledger=False))
    broken = F.when(F.col("source_path").rlike("/(a|sub/c)[.]jpg$"), "failed").otherwise(F.col("status"))
    store.replace("files", store.files.withColumn("status", broken).withColumn("checksum", F.when(broken == "failed", None).otherwise(F.col("checksum"))))
    os.remove(card / "sub" / "c.jpg")
    out = commands.run_retry(spark, store, archive)
    assert (out["processed"], out["errors"]) == (1, 0) and out["run_id"] != first["run_id"]
    new = store.files.where(F.col("run_id") == out["run_id"]).collect()
    assert [(os.path.basename(r["source_path"]), r["status"], r["algorithm"]) for r in new] == [("a.jpg", "complete", "sha256")]


def test_resume_interrupts_the_old_run(spark, card, tmp_path):
    archive, store = str(tmp_path / "archive"), stores.Store(spark, str(tmp_path / "catalog"))
    with pytest.raises(LookupError):
        commands.run_resume(spark, store)
    at = dt.datetime(2026, 1, 1)
    store.append("runs", spark.createDataFrame([("old", "1", str(card), archive, "md5", 0, False, at, None, "running")], store.runs.schema))
    out = commands.run_resume(spark, store, commands.IngestOptions(ledger=False))
    assert {r["id"]: (r["status"], r["algorithm"], r["recursive"]) for r in store.runs.collect()} == {"old": ("interrupted", "md5", False), out["run_id"]: ("completed", "md5", False)}
    assert out["processed"] == 3 and not store.files.where("source_path like '%/sub/%'").count()
    assert out["run_id"] != "old" and store.runs.where("status = 'running'").count() == 0


def test_clean_summary():
    none = {"temporary": {"removed": 0, "errors": 0}, "orphans": {"removed": 0, "errors": 0}, "compacted": False}
    assert commands.clean_summary(none) == "No orphaned files found"
    some = {"temporary": {"removed": 1, "errors": 1}, "orphans": {"removed": 2, "errors": 0}, "compacted": True, "size_before": 9, "size_after": 4}
    assert commands.clean_summary(some) == "Cleaned 1 temp file, 2 orphaned sidecars | 1 removal error | Reclaimed 5 B from the catalogue"


def test_catalogue_location(spark, tmp_path):
    archive, mounts = tmp_path / "a b", tmp_path / "mounts"
    archive.mkdir()
    point = str(archive).replace(" ", "\\040")
    mounts.write_text(f"/dev/sda / ext4 rw 0 0\nserver:/x {point} nfs4 rw 0 0\n/dev/sdb {point}/local xfs rw 0 0\n")
    assert stores.on_network_mount(str(archive / "x"), str(mounts)) and not stores.on_network_mount(str(archive / "local" / "y"), str(mounts))
    assert not stores.on_network_mount(str(tmp_path), str(mounts)) and not stores.on_network_mount("/", str(tmp_path / "none"))
    assert stores.locate(spark, str(archive), on_network=False) == str(archive / ".stratalog" / "catalog")
    far = stores.locate(spark, str(archive), on_network=True, home="/home/u", write_marker=True)
    assert far.startswith("/home/u/.stratalog/ab-") and stores.locate(spark, str(archive)) == far
    assert stores.locate(spark, str(archive), "/else/where", write_marker=True) == "/else/where" == stores.locate(spark, str(archive))
    files = spark.createDataFrame([(1, [".xmp", ".aae"]), (2, []), (3, None)], "id bigint, carried_sidecars array<string>")
    assert [r["carried_sidecars"] for r in stores.exported(files).orderBy("id").collect()] == ['[".xmp",".aae"]', None, None]
