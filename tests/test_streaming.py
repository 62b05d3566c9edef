"""Streams end where the batch folds end."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.operators import beliefs as H
from quillgrain.operators import chunks as N
from quillgrain.operators import evidence as E
from quillgrain.operators import investigate as V
from quillgrain.operators import lifecycle as L
from quillgrain.operators.bank import upsert
from quillgrain.sources import adapters as A
from quillgrain.sources.buckets import BucketTable
from quillgrain.streaming import stateful as St

SF = "/root/testdata/sf0.001"


def as_stream(df, path, parts, by):
    """A file stream of `parts` micro-batches in the order of `by`; rows equal in it come together."""
    part = F.least(F.floor(F.percent_rank().over(Window.orderBy(by)) * parts), F.lit(parts - 1))
    dealt = df.withColumn("part", part).cache()
    for i in range(parts):  # one file after the other, as a stream takes them by their age
        dealt.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    dealt.unpersist()
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_belief_stream_is_the_batch_merge(spark, tmp_path):
    up = A.belief_updates(spark, SF).where("bank_id < 2")
    out = St.drain(St.belief_stream(as_stream(up, tmp_path / "in", 3, "turn")), "update", "beliefs", str(tmp_path / "cp"))
    cols = ["bank_id", "about", "kind", "claim", F.round("confidence", 6), "first_seen_turn", "last_updated_turn"]
    want, got = ({tuple(r) for r in x.select(*cols).collect()} for x in (H.merge(up), out))
    assert want and want < got  # what is put out last is the store, and earlier batches put out more


def test_evidence_stream_is_the_batch_fold(spark, tmp_path):
    obs = A.observations(spark, SF)
    out = St.drain(St.evidence_stream(as_stream(obs, tmp_path / "in", 3, "seq")), "update", "evidence", str(tmp_path / "cp"))
    want = {(r.hypothesis_id, r.confidence, r.status, r.n_supports, r.n_contradicts) for r in E.confidence(obs).collect()}
    assert want <= {tuple(r) for r in out.collect()} and out.count() > len(want)


def test_window_stream_is_the_batch_replay(spark, tmp_path):
    rows = A.conversation_rows(spark, SF)
    out = St.drain(St.window_stream(as_stream(rows.select("bank_id", "turn_idx"), tmp_path / "in", 3, "turn_idx")), "append", "windows", str(tmp_path / "cp"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in L.windows(rows).select("bank_id", "end_turn").collect()}


def test_stall_stream_is_the_batch_count(spark, tmp_path):
    e = A.experiments(spark, SF).withColumns({"progress": F.col("id") % 3 > 1, "n": F.row_number().over(Window.partitionBy("hypothesis_id").orderBy("ts", "id"))})
    want = {(r.hypothesis_id, r.n, r.stalls) for r in V.stalls(e, "hypothesis_id", ["ts", "id"], "event_type", "progress").collect()}
    rows = e.select(F.col("hypothesis_id").alias("run"), F.col("n").cast("long").alias("seq"), F.col("event_type").alias("step"), "progress")
    out = St.drain(St.stall_stream(as_stream(rows, tmp_path / "in", 3, "seq")), "append", "stalls", str(tmp_path / "cp"))
    assert {(r.run, r.seq, r.stalls) for r in out.collect()} == want


def bytes_below(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_upsert_stream_keeps_one_row_a_key(spark, tmp_path):
    rows = A.conversation_rows(spark, SF).select("bank_id", "event_key", "id", "content")
    newer = rows.where("id % 5 = 0").withColumn("content", F.lit("newer"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(newer.withColumn("copy", F.lit(1)))
    stream = as_stream(both, tmp_path / "in", 2, "copy")
    St.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["bank_id", "event_key"], "copy", 8).trigger(availableNow=True).start().awaitTermination()
    got = BucketTable(spark, str(tmp_path / "out"), ["bank_id", "event_key"], stream.schema, 8).read()
    want = rows.withColumn("content", F.when(F.col("id") % 5 == 0, "newer").otherwise(F.col("content")))
    assert got.count() == rows.count() == got.select("bank_id", "event_key").distinct().count()
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_a_change_writes_the_buckets_it_touches_and_a_replay_nothing(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("n"))
    t = BucketTable(spark, str(tmp_path), ["k"], rows.schema, 32)
    put = lambda number, batch: t.change(number, batch, lambda old: upsert(old, batch, ["k"], "n"))
    assert put(0, rows) and bytes_below(tmp_path / "data" / "0") > 0
    few = rows.where("k in (17, 18)").withColumns({"v": F.lit("new"), "n": F.lit(1)}).unionByName(spark.createDataFrame([(9999, "added", 1)], rows.schema))
    assert put(1, few)
    assert bytes_below(tmp_path / "data" / "1") < 0.25 * bytes_below(tmp_path / "data" / "0")
    before = bytes_below(tmp_path)
    assert not put(1, rows.limit(5)) and bytes_below(tmp_path) == before
    assert t.read().count() == 4001 and t.read().where("n = 1").count() == 3
    assert put(2, rows.limit(0)) and t.read().count() == 4001  # an empty batch commits, too
    gone = rows.where("k = 17")
    assert t.change(3, gone, lambda old: old.join(gone.select("k"), "k", "left_anti")) and t.read().count() == 4000
    assert t.vacuum(1) > 0 and t.read().count() == 4000 and not put(1, rows)


def test_a_change_that_failed_leaves_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a") for i in range(50)], "k long, v string")
    t = BucketTable(spark, str(tmp_path), ["k"], rows.schema, 4)
    t.change(0, rows, lambda old: rows)
    one = rows.where("k = 1")
    with pytest.raises(ValueError):
        t.change(1, one, lambda old: rows.withColumn("v", F.lit("b")))
    assert t.numbers() == [0] and t.read().where("v = 'b'").count() == 0
    assert t.change(1, one, lambda old: old.withColumn("v", F.lit("c"))) and 0 < t.read().where("v = 'c'").count() < 50


def test_belief_store_is_read_from_the_state(spark, tmp_path):
    up = A.belief_updates(spark, SF).where("bank_id < 2")
    St.drain(St.belief_stream(as_stream(up, tmp_path / "in", 3, "turn")), "update", "beliefs_state", str(tmp_path / "cp"))
    cols = ["bank_id", "about", "kind", "claim", F.round("confidence", 6), "first_seen_turn", "last_updated_turn"]
    want, got = (sorted(map(tuple, x.select(*cols).collect())) for x in (H.merge(up), St.belief_store(spark, str(tmp_path / "cp"))))
    assert want and got == want


def test_reindex_stream_follows_the_folder(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    write = lambda name, text: (folder / name).write_text(text)
    for i in range(12):
        write(f"kept{i}.md", f"# Kept {i}\n\n" + "word " * 60)
    write("a.md", "# One\n\n" + "word " * 60)
    write("b.md", "# Two\n\n" + "text " * 60)
    schema = spark.read.format("binaryFile").load(str(folder)).schema
    ticks = lambda: spark.readStream.format("binaryFile").schema(schema).load(str(folder))
    run = lambda: St.reindex_stream(ticks(), str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=16).trigger(availableNow=True).start().awaitTermination()
    run()
    titles = lambda: {r.path.rsplit("/", 1)[-1]: r.title for r in St.index_table(spark, str(tmp_path / "out"), 16).read().collect()}
    first = titles()
    assert len(first) == 14 and first["b.md"] == "Two"
    (folder / "b.md").unlink()
    write("a.md", "# Anew, and longer\n\n" + "other " * 70)
    write("c.md", "# Three\n\n" + "more " * 60)
    run()
    assert titles() == {k: v for k, v in first.items() if k != "b.md"} | {"a.md": "Anew, and longer", "c.md": "Three"}
    table = St.index_table(spark, str(tmp_path / "out"), 16)
    assert table.numbers() == [0, 1] and 0 < sum(v == 1 for v in table.manifest().values()) <= 3 < sum(v == 0 for v in table.manifest().values())


def test_reindexed_chunks_are_those_of_the_sources_there_are(spark):
    from quillgrain.plans.corpus import _relisted

    old, now = _relisted(spark, SF)
    found = N.listing_difference(old, now)
    got, want = N.reindex(N.chunk(old), found, now), N.chunk(now)
    assert {r[0] for r in found.select("change").distinct().collect()} == {"new", "changed", "vanished", "same"}
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()
