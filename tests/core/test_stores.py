"""Tables that change in place, retention, and the product index."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlark.operators import catalogue, documents, ocr
from ledgerlark.sources import files, landing
from ledgerlark.sources.versioned import VersionedTable
from ledgerlark.streaming import jobs

from .test_rules import SCHEMA, invoice


def at(spark, rows, schema, *times):
    df = spark.createDataFrame(rows, schema)
    for t in times:
        df = df.withColumn(t, F.col(t).cast("timestamp"))
    return df


def batches(spark):
    uploads = at(spark, [("a", 1, "a.pdf", "h1", "2026-01-01"), ("b", 2, "b.pdf", "h2", "2026-01-02"), ("c", 3, "c.pdf", "h3", "2010-01-01")], "id string, seq long, filename string, file_hash string, created_at string", "created_at")
    texts = spark.createDataFrame([("a", 10, "text a", "ocr"), ("b", 11, None, "digital_pdf"), ("b", 9, "old", "ocr"), (None, 12, "x", "ocr"), ("c", None, "x", "ocr")], "id string, seq long, raw_ocr_text string, source_type string")
    status = spark.createDataFrame([("a", 20, "COMPLETED"), ("b", 5, "FAILED"), ("a", 15, "AI_PROCESSING")], "id string, seq long, status string")
    gone = at(spark, [("c", 30, "2026-02-01")], "id string, seq long, deleted_at string", "deleted_at")
    return [
        lambda t: documents.store_uploads(t, uploads, "1"),
        lambda t: documents.store_extraction(t, texts, "2"),
        lambda t: documents.set_status(t, status, "3"),
        lambda t: t.delete(gone, "4"),
    ]


FINAL = {("a", "a.pdf", "ocr", "COMPLETED", "text a"), ("b", "b.pdf", "digital_pdf", "OCR_COMPLETED", None)}


def state(table, **options):
    return {tuple(r[c] for c in ("id", "filename", "source_type", "status", "raw_ocr_text")) for r in table.read(**options).collect()}


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 0, 3, 1, 2)])
def test_batches_in_any_order_give_one_state(spark, tmp_path, order):
    """Also where batches are repeated, and compacted in between."""
    table = documents.documents_table(spark, str(tmp_path / "documents"))
    assert table.read().count() == 0 and table.compact() is None
    writes = batches(spark)
    for k, n in enumerate(order):
        writes[n](table)
        if k == 1:
            assert table.compact() == 1
    assert state(table) == FINAL
    assert {r[0] for r in state(table, deleted=True)} == {"a", "b", "c"}
    assert table.compact() == 2 and table.compact() is None
    assert state(table) == FINAL
    table.vacuum()
    assert state(table) == FINAL


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), {"id": "long"}, {"name": "string", "at": "timestamp"}, 8)
    rows = spark.range(400).select("id", F.lit(1).alias("seq"), F.concat(F.lit("n"), "id").alias("name"), F.timestamp_seconds(F.col("id") * 86400 * 30).alias("at"))
    table.append(rows, "1", ["name", "at"])
    table.compact()
    before = table.files()
    assert len(before) == 8
    table.append(spark.createDataFrame([(7, 2, "new")], "id long, seq long, name string"), "2", ["name"])
    table.compact()
    after = table.files()
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["name"] for r in table.read().where("id in (7, 8)").collect()} == {"new", "n8"}
    table.delete(spark.createDataFrame([(7, 3)], "id long, seq long").withColumn("deleted_at", F.lit("2000-01-01").cast("timestamp")), "3")
    assert table.read().count() == 399
    before = table.files()
    old = {f for b in table.files().values() for f in b}
    table.purge(lambda row: documents.expired({"deleted_at": row["deleted_at"], "created_at": row["at"]}, F.lit("1980-01-01").cast("date")))
    gone = {r["id"] for r in rows.where("at < timestamp'1973-01-01'").select("id").collect()} - {7}  # kept from its deletion on
    assert {r["id"] for r in table.read(deleted=True).collect()} == set(range(400)) - gone
    assert table.purge(lambda row: row["name"] == "nobody") is None
    removed = table.vacuum()
    assert any("changes/batch=1" in p for p in removed)
    assert table.read().count() == 400 - len(gone) - 1
    kept = {f for b in table.files().values() for f in b}
    assert old - kept  # rewritten buckets have new files


def test_a_half_written_compaction_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), {"id": "long"}, {"name": "string"})
    table.append(spark.createDataFrame([(1, 1, "a")], "id long, seq long, name string"), "1", ["name"])
    table.compact()
    spark.createDataFrame([(1, [(0, 9)], ["1"])], "buckets int, places array<struct<bucket:int,version:int>>, batches array<string>").coalesce(1).write.parquet(str(tmp_path / "t/manifest/v=2"))
    (tmp_path / "t/manifest/v=2/_SUCCESS").unlink()
    assert [r["name"] for r in table.read().collect()] == ["a"]
    with pytest.raises(ValueError, match="no such columns"):
        table.append(spark.createDataFrame([(1, 1)], "id long, seq long"), "2", ["nme"])
    with pytest.raises(ValueError, match="power of two"):
        VersionedTable(spark, str(tmp_path / "u"), {"id": "long"}, {}, 3)


def product_data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    base = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.5
    base[0:900] = centres[0] + rng.normal(size=(900, 24)) * 0.4  # a third in one place
    items = [(k, (base[k % 3000] + rng.normal(size=24) * rng.uniform(0.05, 0.5)).tolist()) for k in range(1200)]
    return base, items


def brute(base, items, least):
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    out = {}
    for n, v in items:
        cosine = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 9)
        if n < len(cosine):
            cosine[n] = -2  # the product with the item's own id
        if cosine.max() >= least:
            out[n] = int(cosine.argmax())
    return out


def test_products_by_index_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "PRODUCT_BLOCK", 200)
    monkeypatch.setattr(catalogue, "ITEM_BLOCK", 150)
    base, items = product_data()
    odd = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0] * 3), (9005, [None] * 24)]
    schema = lambda k: f"{k} long, v array<double>"
    products = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)] + odd, schema("product_id"))
    wanted = spark.createDataFrame(items + odd, schema("item_id"))
    catalogue.build_index(products, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index/lists"))
    assert index.agg(F.sum("n")).first()[0] == 3000 and 40 <= index.count() <= 55
    expected = brute(base, items, 0.92)
    assert 500 < len(expected) < 1200
    sure = {r["item_id"]: r["product_id"] for r in catalogue.match_items(wanted, str(tmp_path / "index")).collect()}
    assert sure == expected
    few = catalogue.match_items(wanted, str(tmp_path / "index"), probes=6)
    found = {r["item_id"]: r["product_id"] for r in few.collect()}
    hit = sum(found.get(k) == p for k, p in expected.items()) / len(expected)
    assert hit >= 0.9 and set(found) <= set(expected)
    missing = {r["item_id"] for r in catalogue.unmatched_items(wanted, few).collect()}
    assert missing == {k for k, _ in itertools.chain(items, odd)} - set(found)


def test_index_of_no_products(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "product_id long, v array<double>")
    catalogue.build_index(none, str(tmp_path / "index"))
    items = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, v array<double>")
    assert catalogue.match_items(items, str(tmp_path / "index")).count() == 0


def test_equal_products_and_own_id(spark, tmp_path):
    products = spark.createDataFrame([("p2", [1.0, 0.0]), ("p1", [2.0, 0.0]), ("i1", [1.0, 0.0])], "product_id string, v array<float>")
    catalogue.build_index(products, str(tmp_path / "index"), lists=2)
    items = spark.createDataFrame([("i1", [1.0, 0.0]), ("i2", [0.0, 1.0])], "item_id string, v array<float>")
    assert [tuple(r) for r in catalogue.match_items(items, str(tmp_path / "index")).collect()] == [("i1", "p1", 1.0)]


def shuffled(spark):
    """Bytes that the stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_matching_shuffles_no_more_than_the_input_grows(spark, tmp_path):
    """Each vector is shuffled once, however many lists are within reach."""
    rng, moved = np.random.default_rng(5), []
    for n in (1500, 6000):
        path, v = str(tmp_path / f"v{n}"), rng.normal(size=(n, 32))
        spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "item_id long, v array<double>").write.parquet(path)
        items, before = spark.read.parquet(path), shuffled(spark)
        catalogue.build_index(items.select((-F.col("item_id") - 1).alias("product_id"), "v"), f"{path}-index")
        assert catalogue.match_items(items, f"{path}-index").where("product_id = -item_id - 1").count() == n
        moved.append(shuffled(spark) - before)
        assert moved[-1] < 4 * v.nbytes
    assert moved[1] < 4.5 * moved[0]


@pytest.mark.parametrize("name", ["sku_match_rate", "unmatched_items"])
def test_queries_of_the_index_shuffle_vectors_once(spark, tmp_path, name):
    v = np.random.default_rng(6).normal(size=(2400, 64))
    spark.createDataFrame([(k, x, k % 3) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    assert entry.queries()[name](spark, str(tmp_path)).collect()
    assert shuffled(spark) - before < 4 * v.nbytes


def moved(spark):
    """Bytes that the stages so far have shuffled, spilled and written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))


@pytest.mark.parametrize("name", ["sku_match_rate", "unmatched_items"])
def test_queries_of_the_index_move_in_proportion_to_the_input(spark, tmp_path, name):
    """A third of the vectors are copies of one; results are those of SQL."""
    rng, bytes_ = np.random.default_rng(7), []
    for n in (800, 3200):
        v = rng.normal(size=(n, 64))
        v[::3] = v[0]
        path = f"{tmp_path}/{n}/embeddings.parquet"
        spark.createDataFrame([(k, x, k % 3) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
        before = moved(spark)
        got = entry.queries()[name](spark, f"{tmp_path}/{n}")
        rows = sorted(map(tuple, got.collect()))
        bytes_.append(moved(spark) - before)
        if n == 800:
            con = duckdb.connect()
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
            assert rows == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert bytes_[1] < 4.5 * bytes_[0]


def test_copies_in_many_blocks_and_matches_at_the_limit(spark, tmp_path, monkeypatch):
    """Equal products fill several blocks of one list: the smallest other id wins. A cosine that rounds to the limit counts."""
    monkeypatch.setattr(catalogue, "PRODUCT_BLOCK", 64)
    monkeypatch.setattr(catalogue, "ITEM_BLOCK", 50)
    products = spark.createDataFrame([(k, [3.0, 4.0]) for k in range(500)] + [(900, [0.0, -1.0])], "product_id long, v array<double>").repartition(4)
    edge = [float(0.92 - 4e-10), float(np.sqrt(1 - (0.92 - 4e-10) ** 2))]
    items = spark.createDataFrame([(k, [6.0, 8.0]) for k in range(300)] + [(901, [edge[1], -edge[0]]), (902, [1.0, 0.0])], "item_id long, v array<double>")
    catalogue.build_index(products, str(tmp_path / "index"), lists=2)
    found = {r["item_id"]: (r["product_id"], r["cosine"]) for r in catalogue.match_items(items, str(tmp_path / "index")).collect()}
    assert found == {0: (1, 1.0), **{k: (0, 1.0) for k in range(1, 300)}, 901: (900, 0.92)}


def landed(rows, *names):
    return sorted(tuple(bytes(r[c]) if c == "content" else r[c] for c in names) for r in rows)


def test_landing_source_in_batch_and_as_a_stream(spark, tmp_path):
    """Both ways give equal rows; a stream reads a file once, over restarts too."""
    spark.dataSource.register(landing.LandingSource)
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    names = ("path", "length", "file_hash", "content")

    def read():
        return spark.read.format("landing").option("pattern", "*.pdf").option("filesPerPartition", 2).load(str(folder))

    assert read().count() == 0
    for run in range(3):
        for k in range(3):
            (folder / ("sub" if k else ".") / f"f{run}{k}.pdf").write_bytes(f"file {run} {k}".encode() * 100)
        (folder / "_half.pdf").write_bytes(b"x")
        (folder / ".hidden.pdf").write_bytes(b"x")
        (folder / "note.txt").write_bytes(b"x")
        stream = spark.readStream.format("landing").option("pattern", "*.pdf").option("filesPerPartition", 2).load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    batch = landed(read().collect(), *names)
    assert len(batch) == 9 and batch == landed(spark.read.parquet(str(tmp_path / "out")).collect(), *names)
    assert read().rdd.getNumPartitions() == 5
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "f*.pdf").load(str(folder)).withColumn("file_hash", F.sha2("content", 256))
    assert landed(files_.collect(), "length", "file_hash") == landed(read().collect(), "length", "file_hash")


def test_landing_source_of_annotations(spark, tmp_path):
    spark.dataSource.register(landing.LandingSource)
    text = '{"document_id": "d1", "annotations": [{"text": "Total é"}]}\nno json\n[1]\n{"document_id": "d2"}\n'
    (tmp_path / "a.json").write_text(text)
    rows = spark.read.format("landing").option("kind", "annotations").load(str(tmp_path))
    assert landed(rows.where("annotations is not null").collect(), "line", "document_id", "annotations") == [(0, "d1", '[{"text": "Total é"}]')]
    assert {r["document_id"] for r in rows.collect()} == {"d1", "d2"}
    found = ocr.ocr_results(rows).where("document_id = 'd1'").first()
    assert (found["text"], found["page_count"]) == ("Total é", 1)
    saved = files.annotations(spark, str(tmp_path / "a.json")).where("document_id is not null")
    assert sorted(r["document_id"] for r in saved.collect()) == ["d1", "d2"]
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("landing").option("kind", "mail").load(str(tmp_path)).collect()


def test_intake_keeps_vendors_in_a_table(spark, tmp_path):
    """Batches publish the vendors that they name; the table has all, also when a batch runs again."""
    gold, dimension = str(tmp_path / "gold"), jobs.vendors_table(spark, str(tmp_path / "vendors"))

    def land(k, name, phone):
        row = invoice(vendor={"name": name, "tax_id": None, "phone": phone}) | {"document_id": f"d{k}", "ord": k}
        spark.createDataFrame([row], SCHEMA).withColumn("file_hash", F.lit(f"h{k}")).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
        jobs.run_intake(jobs.landing(spark, str(tmp_path / "landing")), gold, str(tmp_path / "ck"), dimension=dimension, compact_every=2).awaitTermination(120)

    land(0, "Acme", None)
    land(1, "Beta", "9")
    first = {(r["name"], r["phone"]) for r in dimension.read().collect()}
    assert first == {("Acme", None), ("Beta", "9")}
    land(2, "Acme", "1")
    commits = sorted((tmp_path / "ck/commits").glob("[0-9]*"))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the last run had stopped before its commit
        p.unlink(missing_ok=True)
    land(3, "Acme", "2")
    published = [[(r["name"], r["created"], r["phone"]) for r in spark.read.parquet(f"{gold}/vendors/batch={k:012d}").collect()] for k in range(4)]
    assert published == [[("Acme", True, None)], [("Beta", True, "9")], [("Acme", False, "1")], [("Acme", False, "1")]]
    assert {(r["name"], r["phone"]) for r in dimension.read().collect()} == {("Acme", "1"), ("Beta", "9")}
