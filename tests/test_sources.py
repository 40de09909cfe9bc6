"""Files in and out, and the scheduled refresh."""
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from colloquy import schemas, vocab
from colloquy.plans import build
from colloquy.operators import assemble
from colloquy.sources import buckets, comments, landed, publication, tables
from colloquy.streaming import refresh, versions


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(folder, name, payload):
    import os

    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mode = "wb" if isinstance(payload, bytes) else "w"
    with open(path, mode, **({} if mode == "wb" else {"encoding": "utf-8"})) as out:
        out.write(payload if isinstance(payload, (str, bytes)) else json.dumps(payload, indent=2))
    return path


def test_landed_comments_text_and_stages(spark, folder):
    write(folder, "comments/C-1.json", {
        "regulations_gov_comment_id": "C-1", "last_modified_date": "d1", "fetched_at": "f",
        "attributes": {"comment": "see attached", "withdrawn": False, "firstName": "hidden"},
        "attachments": [{"id": "a", "file_url": "u", "downloaded": True}],
    })
    write(folder, "comments/C-2.json", {"regulations_gov_comment_id": "C-2", "attributes": {"comment": None}})
    write(folder, "text/C-1.txt", "line one\nline two")
    write(folder, "text/C-1.meta.json", {"comment_id": "C-1", "usable": True, "content_hash": "h"})
    raw = comments.raw_comments(spark, f"{folder}/comments")
    assert "firstName" not in raw.schema["attributes"].dataType.fieldNames()
    got = {r.comment_id: r for r in comments.with_text(
        raw, comments.raw_text(spark, f"{folder}/text"), comments.text_meta(spark, f"{folder}/text")).collect()}
    assert got["C-1"].text == "line one\nline two" and got["C-1"].usable
    assert got["C-2"].text == "" and not got["C-2"].usable
    write(folder, "analysis/C-1.json", {
        "comment_id": "C-1", "input_hash": "h", "positions": [{"segment_id": "seg-001", "question_ids": ["q1"], "position": "support"}],
    })
    rows = comments.stage_rows(comments.stage(spark, f"{folder}/analysis", schemas.ANALYSIS_STAGE)).collect()
    assert [(r.comment_id, r.segment_id, r.position) for r in rows] == [("C-1", "seg-001", "support")]


def test_a_truncated_comment_fails_the_read(spark, folder):
    write(folder, "C-1.json", b'{"regulations_gov_comment_id": "C-1", "attri')
    with pytest.raises(Exception, match="(?i)malformed"):
        comments.raw_comments(spark, folder).collect()


def test_only_attachments_are_listed(spark):
    formats = "array(named_struct('format', 'pdf', 'size', 1L, 'fileUrl', 'u/f.pdf'))"
    items = [f"named_struct('type', '{t}', 'id', '{t}', 'title', '', 'fileFormats', {formats})" for t in ("attachments", "users")]
    given = spark.range(1).select(F.lit("C-1").alias("comment_id"), F.expr(f"array({', '.join(items)})").alias("included"))
    assert [r.attachment_id for r in comments.attachment_rows(given).collect()] == ["attachments"]


def test_attachments_are_decoded_or_reported(spark, folder):
    write(folder, "C-1/a.txt", "café".encode("utf-16"))
    write(folder, "C-1/b.TXT", "café!".encode("latin-1"))
    write(folder, "C-2/c.txt", b"  \n ")
    write(folder, "C-2/d.pdf", b"%PDF")
    files = comments.extract_text(comments.read_attachments(spark, folder)).collect()
    got = {(r.comment_id, r.attachment_id): (r.status, r.text) for r in files}
    assert got == {("C-1", "a"): ("ok", "café"), ("C-1", "b"): ("ok", "café!"), ("C-2", "c"): ("error", ""), ("C-2", "d"): ("unsupported", "")}


def test_only_listed_attributes_are_kept(spark):
    df = spark.createDataFrame([(("t", "body", "x"),)], "attributes struct<title:string,comment:string,lastName:string>")
    assert comments.kept_attributes(df).schema["attributes"].dataType.fieldNames() == ["title", "comment"]


def test_an_empty_build_leaves_outputs_alone(spark, folder):
    some = spark.createDataFrame([("p1",)], "position_id string")
    publication.publish({"positions": some}, folder, "b1", "t1")
    for nothing in (some.limit(0), some.filter("position_id = 'x'")):
        with pytest.raises(tables.NothingToPublish):
            publication.publish({"positions": nothing, "other": some}, folder, "b2", "t2")
    assert publication.read_table(spark, folder, "positions").count() == 1
    assert publication.current(spark, folder).build_id == "b1" and publication.current(spark, folder, "b2") is None


def test_readers_see_a_build_whole(spark, folder):
    """A write that dies between two tables changes nothing for readers; the next one does, and by name."""
    def tables_of(value):
        one = spark.createDataFrame([(value,)], "v int")
        return {"positions": one, "a": one, "z": one}

    first = publication.publish(tables_of(1), folder, "b1", "t1")
    broken = tables_of(2)
    broken["z"] = broken["z"].select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        publication.publish(broken, folder, "b2", "t2")
    held = publication.read_table(spark, folder, "a")
    assert [publication.read_table(spark, folder, n).first().v for n in ("positions", "a", "z")] == [1, 1, 1]
    second = publication.publish(tables_of(3), folder, "b2", "t2")
    assert [publication.read_table(spark, folder, n).first().v for n in ("positions", "a", "z")] == [3, 3, 3]
    assert held.first().v == 1 and publication.read_table(spark, folder, "a", "b1").first().v == 1
    assert (first.ordinal, second.ordinal) == (1, 2) and second.manifest["tables"]["a"] == {"rows": 1}
    assert publication.before(spark, folder, "b1") is None and publication.before(spark, folder, "b2") == first
    publication.publish(tables_of(4), folder, "b3", "t3")
    again = publication.publish(tables_of(5), folder, "b2", "t4")
    assert publication.before(spark, folder, "b2") == first and publication.current(spark, folder) == again
    with pytest.raises(LookupError):
        publication.read_table(spark, folder, "a", "b9")


def test_only_changed_buckets_are_replaced(spark, folder):
    import os

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{folder}/rows") for f in fs if f.endswith(".parquet")}

    def rows(changed=(), gone=()):
        return spark.createDataFrame([(f"c{i}", i * 2 if i in changed else i, [str(i)]) for i in range(40) if i not in gone], "comment_id string, v int, ids array<string>")

    made = {"created_at": F.lit("t1")}
    first = buckets.replace_changed(rows(), folder, "comment_id", made, buckets=8)
    before = files()
    assert len(first["written"]) == 8 and buckets.stored(spark, folder).count() == 40
    assert buckets.replace_changed(rows().orderBy(F.desc("v")), folder, "comment_id", {"created_at": F.lit("t2")}, buckets=8) == {"written": [], "removed": []}
    assert files() == before
    one = rows().filter("v = 7").select(buckets.bucket_of("comment_id", 8).alias("b")).first().b
    assert buckets.replace_changed(rows(changed=[7]), folder, "comment_id", made, buckets=8) == {"written": [one], "removed": []}
    kept = {f: t for f, t in before.items() if f"bucket={one}/" not in f}
    assert kept.items() <= files().items() and buckets.stored(spark, folder).filter("comment_id = 'c7'").first().v == 14
    held = [r.comment_id for r in rows().filter(buckets.bucket_of("comment_id", 8) == one).collect()]
    emptied = rows().filter(~F.col("comment_id").isin(held))
    assert buckets.replace_changed(emptied, folder, "comment_id", made, buckets=8) == {"written": [], "removed": [one]}
    assert not any(f"bucket={one}/" in f for f in files()) and buckets.stored(spark, folder).count() == 40 - len(held)
    buckets.replace_changed(rows().limit(0), folder, "comment_id", made, buckets=8)
    assert buckets.stored(spark, folder) is None


def test_stage_batches_survive_and_replace(spark, folder):
    def records(value):
        return spark.createDataFrame([("c1", value, f"t{value}")], "comment_id string, v int, created_at string")

    tables.save_stage(records(1), folder, "1")
    tables.save_stage(records(2), folder, "2")
    tables.save_stage(records(2), folder, "2")
    assert [r.v for r in tables.load_stage(spark, folder).collect()] == [2]
    tables.save_stage(records(3).drop("created_at"), f"{folder}/stamped", "1", "1.1", "2026.2", "m")
    got = tables.load_stage(spark, f"{folder}/stamped").first()
    assert (got.v, got.prompt_version, got.processing_version, got.model) == (3, "1.1", "2026.2", "m") and got.created_at[4] == "-"


LANDED = "comment_id string, last_modified_date string, body string"


def test_refresh_keeps_the_newest_version_and_survives_replay(spark, folder):
    landed, log = f"{folder}/landed", f"{folder}/log"
    write(landed, "1.json", '{"comment_id":"a","last_modified_date":"1","body":"old"}\n{"comment_id":"b","last_modified_date":"1","body":"b"}\n')
    seen = []

    def run(checkpoint):
        refresh.refresh_comments(spark, landed, LANDED, log, f"{folder}/{checkpoint}",
                                 on_batch=lambda rows, batch_id: seen.append((batch_id, rows.count())))

    run("first")
    write(landed, "2.json", '{"comment_id":"a","last_modified_date":"2","body":"new"}\n{"comment_id":"b","last_modified_date":"0","body":"late"}\n')
    run("first")
    current = {r.comment_id: r.body for r in versions.current(spark, log).collect()}
    assert current == {"a": "new", "b": "b"} and seen == [(0, 2), (1, 1)]
    # A lost checkpoint replays both files as batch 0: the same newest versions.
    run("second")
    assert {r.comment_id: r.body for r in versions.current(spark, log).collect()} == current
    versions.compact(spark, log, f"{folder}/compact")
    assert versions.log(spark, f"{folder}/compact").count() == 2


def test_a_batch_reads_only_its_buckets(spark, folder):
    folder = f"{folder}/log"
    many = spark.range(500).select(F.concat(F.lit("k"), "id").alias("comment_id"), F.lit("1").alias("last_modified_date"), F.lit("x").alias("body"))
    versions.append(many, 0, folder, buckets=16)
    few = many.filter("comment_id IN ('k7', 'k300')").withColumn("last_modified_date", F.lit("2"))
    new, touched = versions.append(few.unionByName(many.filter("comment_id IN ('k7', 'k8')")), 1, folder, buckets=16)
    assert sorted(r.comment_id for r in new.collect()) == ["k300", "k7"] and 1 <= len(touched) <= 3
    plan = versions.log(spark, folder, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {r.f.split("bucket=")[1].split("/")[0] for r in versions.log(spark, folder, touched).select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {str(b) for b in touched}
    assert versions.current(spark, folder).filter("last_modified_date = '2'").count() == 2 and versions.current(spark, folder).count() == 500


ANALYSES = (
    "comment_id string, last_modified_date string, commenter_id string, stakeholder_type string, "
    "positions array<struct<segment_id:string, question_ids:array<string>, response_type:string, primary_issue:string>>"
)


def test_the_stream_carries_analyses_to_snapshots_and_survives_replay(spark, folder):
    asked = vocab.questions_frame(spark).withColumn("has_tension_block", F.lit(False))
    landed_at, log, snapshots, queue = (f"{folder}/{n}" for n in ("landed", "log", "snapshots", "queue"))

    def analysis(cid, date, group, *positions):
        return json.dumps({"comment_id": cid, "last_modified_date": date, "commenter_id": f"c-{cid}", "stakeholder_type": group, "positions": [
            {"segment_id": f"s{i}", "question_ids": qs, "response_type": kind, "primary_issue": "pccp"} for i, (qs, kind) in enumerate(positions)]})

    def run(checkpoint):
        refresh.refresh_analyses(spark, landed_at, ANALYSES, log, snapshots, queue, asked, f"{folder}/{checkpoint}", buckets=4)

    def state():
        rows = spark.read.parquet(snapshots).collect()
        return sorted((r.batch, r.question_id, r.distinct_commenters, tuple(r.combos)) for r in rows), sorted(
            (r.batch, r.question_id, tuple(x.reason for x in r.reasons)) for r in spark.read.parquet(queue).collect())

    write(landed_at, "1.json", "\n".join([
        analysis("a", "1", "individual", (["q2", "q5"], "concern")), analysis("b", "1", "other", (["q5"], "concern")), analysis("x", "1", "other", (["q9"], "concern"))]))
    run("first")
    # a leaves q2 for q7, b stays as it was, d is new on q5.
    write(landed_at, "2.json", "\n".join([
        analysis("a", "2", "individual", (["q7"], "concern")), analysis("b", "0", "other", (["q9"], "concern")), analysis("d", "1", "other", (["q5"], "recommendation"))]))
    run("first")
    snaps, queued = state()
    assert [(b, q, n) for b, q, n, _ in snaps] == [(0, "q2", 1), (0, "q5", 2), (0, "q9", 1), (1, "q2", 0), (1, "q5", 2), (1, "q7", 1)]
    assert queued == [(1, "q5", ("new_substantive_position",))]
    # Each batch once more, the first after the second: nothing changes.
    for number in (1, 0):
        again = spark.read.schema(ANALYSES).json(f"{landed_at}/{number + 1}.json")
        refresh.apply_analyses(again, number, log, snapshots, queue, asked, buckets=4)
        assert state() == (snaps, queued)


def test_snapshots_follow_the_touched_questions(spark, folder):
    asked = vocab.questions_frame(spark).withColumn("has_tension_block", F.lit(False))
    schema = "question_id string, position_id string, commenter_id string, stakeholder_type string, response_type string, primary_issue string"
    first = [("q1", "p1", "c1", "individual", "concern", "pccp"), ("q2", "p2", "c1", "individual", "concern", "pccp")]
    more = first + [("q1", "p3", "c2", "other", "concern", "cybersecurity")]
    touched = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    snapshots, queue = f"{folder}/snapshots", f"{folder}/queue"
    refresh.update_snapshots(spark.createDataFrame(first, schema), asked, touched, 0, snapshots, queue)
    for _ in range(2):
        refresh.update_snapshots(spark.createDataFrame(more, schema), asked, touched.filter("question_id = 'q1'"), 1, snapshots, queue)
    rows = spark.read.parquet(queue).collect()
    assert [(r.question_id, [x.reason for x in r.reasons]) for r in rows] == [("q1", ["new_stakeholder_group", "new_substantive_position"])]
    assert spark.read.parquet(snapshots).filter("batch = 1").count() == 1


def test_a_whole_build_from_stage_rows(spark, folder):
    candidates = spark.createDataFrame([
        ("C-1", False, True, True, True, "Acme", "", "device_manufacturer"), ("C-2", False, True, True, True, "", "Solo", "individual"),
        ("C-3", True, True, True, True, "Gone", "", "other"), ("C-4", False, True, True, True, "Quiet", "", "other"),
    ], "comment_id string, withdrawn boolean, usable boolean, identified boolean, analyzed boolean, organization string, "
       "display_name string, stakeholder_type string").withColumns({
        "received_date": F.lit("2026-01-02T03:04:05Z"), "posted_date": F.lit("2026-01-03"), "source_url": F.lit("u"),
        "attachment_urls": F.array(F.lit("x")),
    })
    text = "The agency should require ninety days of notice before any material version change of a model in use."
    schema = ("comment_id string, segment_id string, question_ids array<string>, position string, confidence string, primary_issue string, "
              "secondary_issue string, response_type string, stakeholder_concern string, requested_fda_action string, gap_tags array<string>, "
              "gap_explanations map<string,string>, public_summary string, source_passage string")

    def position(cid, seg, qids, stance="support", conf="high", told="Wants notice.", passage=text):
        return (cid, seg, qids, stance, conf, "pccp", None, "recommendation", "", "", ["operational_harm"], {"operational_harm": "w"}, told, passage)

    analysis = spark.createDataFrame([
        position("C-1", "seg-001", ["q1"]), position("C-1", "seg-002", ["q1", "q5"], passage="First. " + text, conf="low"),
        position("C-2", "seg-001", ["q1"]), position("C-3", "seg-001", ["q1"]), position("C-4", "seg-001", ["q1"], "unclear", "low"),
    ], schema)
    asked = vocab.questions_frame(spark).withColumns({
        "short_title": F.col("question_id"), "tags": F.array(F.lit("t")), "has_tension_block": F.lit(False),
        "source_url": F.lit("u"), "question_text": F.lit("text"),
    })
    built = build.build(candidates, analysis, asked, generated_at="2026-01-04T00:00:00Z", versions={"processing": "1"})
    published = built.publish(folder)
    positions = publication.read_table(spark, folder, "positions").collect()
    assert {p.position_id: p.question_ids for p in positions} == {"p-c-1-seg-001": ["q1", "q5"], "p-c-2-seg-001": ["q1"]}
    assert "model_confidence" not in positions[0].asDict()
    assert publication.read_table(spark, folder, "submissions").count() == 3
    counts = {r.reason: r.n for r in built.exclusions().collect()}
    assert published.manifest["exclusions"] == counts
    assert counts == {"withdrawn": 1, "unclear_low_confidence_positions": 1, "near_duplicate_positions_consolidated": 1,
                      "submissions_without_published_positions": 1}
    assert built.violations().count() == 0
    assert assemble.excluded(candidates).first().reason == "withdrawn"


def land(folder, ids, broken=(), withdrawn=(), stance=None):
    passage = "We ask that every change of a deployed model be announced in writing before it takes effect, number "
    for i in ids:
        write(folder, f"comments/{i}.json", b"{" if i in broken else {
            "regulations_gov_comment_id": i, "source_url": f"u/{i}", "last_modified_date": "d", "fetched_at": "f",
            "attributes": {"withdrawn": i in withdrawn, "receiveDate": "2026-02-03T00:00:00Z", "postedDate": "2026-02-04"}, "attachments": [{"id": "a", "file_url": "x"}]})
        write(folder, f"text/{i}.meta.json", {"comment_id": i, "usable": True, "extracted_at": "t"})
        write(folder, f"commenters/{i}.json", {"comment_id": i, "organization": f"Org {i}", "stakeholder_type": "other", "created_at": "t"})
        write(folder, f"analysis/{i}.json", {
            "comment_id": i, "input_hash": "h", "prompt_version": "1", "processing_version": "9", "created_at": "t", "positions": [
                {"segment_id": "seg-001", "question_ids": ["q4"], "position": (stance or {}).get(i, "support"), "primary_issue": "pccp", "confidence": "high",
                 "stakeholder_concern": "", "requested_fda_action": "", "gap_tags": [], "gap_explanations": {}, "public_summary": f"{i} wants notice.", "source_passage": passage + i}]})


def label(spark, folder, ids):
    hashes = {r.comment_id: r.h for r in landed.read_landing(spark, folder).analysis.select("comment_id", landed.analysis_hash().alias("h")).collect()}
    for i in ids:
        write(folder, f"response_types/{i}.json", {
            "comment_id": i, "input_hash": hashes[i], "prompt_version": "1", "processing_version": "9", "created_at": "t", "response_types": {"seg-001": "concern"}})


def test_from_landed_files_to_published_builds(spark, folder):
    """One broken file of each kind, a second build that changes two questions, and either build again."""
    files, out = f"{folder}/files", f"{folder}/out"
    land(files, [f"C-{i}" for i in range(1, 8)], broken=["C-5"], withdrawn=["C-6"])
    label(spark, files, ["C-1", "C-2", "C-3", "C-6"])
    write(files, "analysis/C-7.json", b'{"comment_id": "C-7", "positions": [{"segment_id"')
    write(files, "commenters/X.json", {"organization": "nobody"})
    write(files, "response_types/C-3.json", {"comment_id": "C-3", "input_hash": "of another analysis", "prompt_version": "1", "processing_version": "9", "response_types": {"seg-001": "concern"}})
    asked = vocab.questions_frame(spark).withColumns({
        "short_title": F.col("question_id"), "tags": F.array(F.lit("t")), "has_tension_block": F.lit(False), "source_url": F.lit("u"), "question_text": F.lit("text")})

    def published(build_id, when):
        made = build.Build.from_landing(spark, files, asked, when, {"processing": "9"}, "1", "9", build_id=build_id)
        return made.publish(out), made

    def read(name, build_id):
        return publication.read_table(spark, out, name, build_id)

    first, made = published("b1", "2026-03-01T00:00:00Z")
    assert {r.position_id: r.response_type for r in read("positions", "b1").collect()} == {"p-c-1-seg-001": "concern", "p-c-2-seg-001": "concern", "p-c-3-seg-001": None, "p-c-4-seg-001": None}
    assert {(r.source, r.file) for r in read("quarantine", "b1").collect()} == {("comments", "C-5.json"), ("analysis", "C-7.json"), ("commenters", "X.json")}
    m = first.manifest
    assert m["quarantine"] == {"comments": 1, "commenters": 1, "analysis": 1} and m["exclusions"] == {"withdrawn": 1, "not_yet_classified": 1}
    assert m["response_types"] == {"submissions_without_fresh_response_types": 2} and m["review_queue"] == {"flagged_questions": [], "baseline": True, "compared_against": None}
    assert m["question_analyses"] == {"generated": 0, "stale": 0, "pending": 26} and m["tables"]["question_state"] == 26 and m["counts"]["positions_identified"] == 4
    assert {r.comment_id for r in read("without_response_types", "b1").collect()} == {"C-3", "C-4"} and made.violations().count() == 0

    land(files, ["C-5"])
    land(files, ["C-8"])
    label(spark, files, ["C-5", "C-8"])
    write(files, "commenters/C-8.json", {"comment_id": "C-8", "organization": "", "stakeholder_type": "individual", "created_at": "t"})
    queues, states = [], []
    for when in ("2026-03-02T00:00:00Z", "2026-03-05T00:00:00Z"):
        second, _ = published("b2", when)
        assert second.manifest["review_queue"] == {"flagged_questions": ["q4"], "baseline": False, "compared_against": "2026-03-01T00:00:00Z"}
        queues.append(sorted(map(str, read("review_queue", "b2").collect())))
        states.append(sorted(map(str, read("question_state", "b2").collect())))
    assert queues[0] == queues[1] and states[0] == states[1]
    assert [[x.reason for x in r.reasons] for r in read("review_queue", "b2").collect()] == [["new_stakeholder_group"]]
    again, _ = published("b1", "2026-03-06T00:00:00Z")
    assert again.manifest["review_queue"]["baseline"] and publication.before(spark, out, "b2").build_id == "b1"


def test_a_manifest_reads_no_table_again(spark, folder):
    land(folder, ["C-1", "C-2"])
    asked = vocab.questions_frame(spark).withColumns({
        "short_title": F.col("question_id"), "tags": F.array(F.lit("t")), "has_tension_block": F.lit(False), "source_url": F.lit("u"), "question_text": F.lit("text")})
    made = build.Build.from_landing(spark, folder, asked, "t1", {}, "1", "9")
    seen = {}
    original = made._manifest

    def watched(given, prior):
        context = spark.sparkContext
        context.setJobGroup("manifest", "")
        try:
            return original(given, prior)
        finally:
            seen["jobs"] = list(context.statusTracker().getJobIdsForGroup("manifest"))
            context.setLocalProperty("spark.jobGroup.id", None)

    made._manifest = watched
    result = made.publish(f"{folder}/out")
    assert seen["jobs"] == [] and result.manifest["tables"]["positions"] == 2


def test_provenance_names_rule_and_analysis(spark, folder):
    land(folder, ["C-1", "C-2"])
    same = json.load(open(f"{folder}/analysis/C-1.json"))
    same["positions"].append({**same["positions"][0], "segment_id": "seg-002", "question_ids": ["q4", "q6"]})
    write(folder, "analysis/C-1.json", same)
    asked = vocab.questions_frame(spark).withColumns({
        "short_title": F.col("question_id"), "tags": F.array(F.lit("t")), "has_tension_block": F.lit(False), "source_url": F.lit("u"), "question_text": F.lit("text")})
    for when in ("t1", "t2"):
        build.Build.from_landing(spark, folder, asked, when, {}, "1", "9", build_id=when).publish(f"{folder}/out")
    [row] = buckets.stored(spark, f"{folder}/out/provenance").collect()
    assert (row.comment_id, row.first_segment_id, row.second_segment_id, row.rule_version, row.created_at) == ("C-1", "seg-001", "seg-002", "1.0.0", "t1")
    assert row.kept_segment_id in ("seg-001", "seg-002") and len(row.analysis_hash) == 16 and row.shared_question_ids == ["q4"]
