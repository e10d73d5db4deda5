"""Files, versioned tables and streaming jobs."""

import datetime as dt
import time
import json

from pyspark.sql import functions as F

from annalist.operators import ingest as ig
from annalist.sources import files, versions
from annalist.streaming import buckets, jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_json_lines_round_trip_and_required_fields(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "1", "url": "u"}\n\n{"id": "2", "url": ""}\n{"id": "3"}\n')
    df = files.read_lines(spark, str(tmp_path / "in.jsonl"), "id string, url string", ["id", "url"])
    assert rows(df, "id") == [("1",)]
    files.write_lines(spark.createDataFrame([("x", 1)], "z string, a int").coalesce(1), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*.json")).read_text()
    assert list(json.loads(line)) == ["a", "z"]


def test_nested_document_to_parent_and_child(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"id": "e1", "date": "2001-01-01", "entities": [{"entity_id": "P", "role": "absorbed"}, {"entity_id": "Q", "role": "absorber"}]}], indent=1))
    parent, child = files.read_nested(spark, str(tmp_path / "e.json"), "id string, date date, entities array<struct<entity_id:string,role:string>>", "entities")
    assert rows(parent, "id", "date") == [("e1", dt.date(2001, 1, 1))] and rows(child, "parent_id", "entity_id") == [("e1", "P"), ("e1", "Q")]


def test_warnings_csv_quotes_and_joins(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', ["a", "b"])], "m string, l array<string>").coalesce(1)
    files.write_warnings(df, str(tmp_path / "w"), ["l"])
    assert next((tmp_path / "w").glob("part-*.csv")).read_text() == '"m","l"\n"say ""hi""","a; b"\n'
    files.write_report(df.select("m"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 1


def test_charset_from_header_meta_and_default(spark):
    word = "ședință"
    bodies = [(1, "text/html; charset=utf-8", word.encode()), (2, None, b'<meta charset="iso-8859-2">' + "şedinţă".encode("iso-8859-2")), (3, None, "şedinţă".encode("iso-8859-2")), (5, None, b" " * 9000 + b'<meta charset="utf-8">' + word.encode()), (4, "x; charset=nope", b"abc")]
    df = spark.createDataFrame(bodies, "id int, header string, body binary").withColumn("cs", files.charset_of(F.col("header"), F.col("body")))
    got = dict(rows(files.decode_bytes(df, "body", "cs"), "id", "html"))
    assert got[1] == word and got[2].endswith("şedinţă") and got[3] == "şedinţă" and got[5].endswith(word) and got[4] == "abc"


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    versions.publish(root, {"a": spark.range(3), "b": spark.range(1)})
    before = versions.read(spark, root, "a")
    versions.publish(root, {"a": before.union(spark.range(2)), "b": spark.range(4)})
    assert versions.read(spark, root, "a").count() == 5 and versions.read(spark, root, "b").count() == 4 and before.count() == 3


DISC = "id long, source_url string, official_id string, chamber string, kind string, status string, failure_count int, first_seen date, last_seen date"


def batches_of(spark, tmp_path, schema, *parts):
    """A stream that gives each part as a batch of its own."""
    folder = tmp_path / "in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(job):
    job.trigger(availableNow=True).start().awaitTermination()


def files_of(root):
    """The data files of each partition."""
    found = {}
    for path in sorted(root.rglob("*.parquet")):
        found.setdefault(str(path.parent.relative_to(root)), []).append(path.name)
    return found


def test_discoveries_merge_per_batch(spark, tmp_path):
    root = tmp_path / "t"
    day, new = dt.date(2000, 1, 1), dt.date(2001, 1, 1)
    stored = spark.createDataFrame([(1, "u1", "L1", "s", "bill", "pending", 2, day, day), (2, "u2", None, "s", "vote", "pending", 0, day, day)], DISC)
    buckets.create(stored, str(root), ["id"], 8)
    before = files_of(root)
    incoming = [("u1", None, "s", "bill", "imported", new), ("u1b", "L1", "s", "bill", None, dt.date(2000, 6, 1)), ("u9", None, "d", "vote", "pending", new)]
    schema = "source_url string, official_id string, chamber string, kind string, status string, seen_on date"
    drained(jobs.merge_discoveries(batches_of(spark, tmp_path, schema, incoming), str(root), str(tmp_path / "cp"), 8))
    got = rows(buckets.stored(spark, str(root)), "source_url", "official_id", "status", "failure_count", "first_seen", "last_seen")
    assert got == sorted([("u1", "L1", "imported", 2, day, new), ("u2", None, "pending", 0, day, day), ("u9", None, "pending", 0, new, new)], key=repr)
    own = spark.range(1, 3).select("id", buckets.bucket_of(["id"], 8).alias("b")).collect()
    second = next(f"bucket={r.b}" for r in own if r.id == 2)
    assert len({r.b for r in own}) == 2 and files_of(root)[second] == before[second]


def test_only_touched_keys_are_rebuilt(spark, tmp_path):
    root = tmp_path / "t"
    buckets.create(spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "k int, n int"), str(root), ["k"], 16)
    before = files_of(root)
    rebuild = lambda keys: keys.where("k <> 4").withColumn("n", F.col("k") * 100)
    stream = batches_of(spark, tmp_path, "k int", [(2,), (3,)], [(4,), (3,)])
    drained(jobs.refresh_touched(stream, "k", str(root), rebuild, str(tmp_path / "cp"), 16))
    assert rows(buckets.stored(spark, str(root)), "k", "n") == [(1, 10), (2, 200), (3, 300)]
    own = {r.k: r.b for r in spark.range(1, 5).select(F.col("id").cast("int").alias("k")).select("k", buckets.bucket_of(["k"], 16).alias("b")).collect()}
    untouched = f"bucket={own[1]}"
    assert own[1] not in (own[2], own[3], own[4]) and files_of(root)[untouched] == before[untouched]


def test_seen_keys_are_in_the_table_and_not_in_the_stream(spark, tmp_path):
    schema = "entity_type string, entity_id int, reaction string, visitor string, at string"
    stream = batches_of(spark, tmp_path, schema, [("v", 1, "hot", "a", "1"), ("v", 1, "hot", "a", "2"), ("v", 1, "hot", "b", "3")], [("v", 1, "hot", "a", "4"), ("v", 2, "hot", "a", "5")], [("v", 2, "hot", "a", "6")])
    job = jobs.keep_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4)
    drained(job)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "entity_id", "visitor", "batch") == [(1, "a", 0), (1, "b", 0), (2, "a", 1)]
    assert not (tmp_path / "cp" / "state").exists()


def test_late_rows_count_and_settled_days_are_few(spark, tmp_path):
    at = lambda *days: [(f"2001-{m:02d}-{d:02d}", key) for m, d, key in days]
    parts = [at((1, 5, "x"), (1, 5, "x"), (1, 6, "y"), (2, 1, "z")), at((1, 5, "y"), (1, 6, "y")), at((1, 5, "x"), (3, 1, "x"))]
    stream = batches_of(spark, tmp_path, "created_at string, entity string", *parts).withColumn("created_at", F.to_timestamp("created_at"))
    root = tmp_path / "t"
    drained(jobs.keep_monthly_top(stream, "created_at", ["entity"], str(root), str(tmp_path / "cp"), k=1))
    top = spark.read.schema("entity string, count long, month string").parquet(str(root / "top"))
    assert rows(top, "month", "entity", "count") == [("2001-01", "x", 3), ("2001-02", "z", 1), ("2001-03", "x", 1)]
    daily = spark.read.schema("day date, entity string, n long, batch long, month string").parquet(str(root / "daily"))
    assert daily.where("month = '2001-01'").groupBy("batch").count().count() == 2
    assert rows(daily.groupBy("month").agg(F.sum("n").alias("n")), "month", "n") == [("2001-01", 6), ("2001-02", 1), ("2001-03", 1)]


def test_purge_and_cascade(spark):
    assets = spark.createDataFrame([(1, "photo", "L1", 10, "stored", "/a"), (2, "photo", "L2", 10, "stored", "/b")], "id int, asset_type string, legislature_id string, byte_size int, fetch_status string, storage_path string")
    assert rows(ig.purge(assets, "photo", "L1"), "id", "fetch_status", "storage_path") == [(1, "pending", None), (2, "stored", "/b")]
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "pid int, v string")
    left, kept, counts = ig.cascade(parents, parents.where("id = 1"), {"c": (children, "pid")})
    assert rows(left, "id") == [(2,)] and rows(kept["c"], "v") == [("z",)] and rows(counts, "child", "deleted") == [("c", 2), ("parents", 1)]
