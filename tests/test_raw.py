"""The source of raw files, in batches and as a stream, and chat history as keyed state."""

import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import constants as K
from quillspark.functions import prompts as P
from quillspark.sources import files, raw
from quillspark.streaming import history


def write(folder, names):
    folder.mkdir(exist_ok=True)
    for n, data in names.items():
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(data)


def rows(df):
    return sorted((r.path.removeprefix("file://").removeprefix("file:"), r.source_file, r.file_extension, r.part, r.page_content or "", str(sorted((r.attrs or {}).items())), bool(r.error)) for r in df.collect())


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")


NAMES = {"a.txt": "xin chào".encode(), "sub/b.md": b"# t\nx", "c.csv": b"a;b\n1;2\n", "d.html": b"<p>hi <script>x</script>you</p>", "bad.docx": b"no zip", "other.bin": b"\x00", "empty.txt": b"", "latin.txt": b"caf\xe9", ".hidden.txt": b"x"}


def test_source_gives_the_rows_of_load(spark, tmp_path):
    write(tmp_path / "in", NAMES)
    docx(tmp_path / "in" / "e.docx")
    raw.register(spark)
    want = [r for r in rows(files.load(spark, str(tmp_path / "in"))) if not r[1].startswith(".")]
    assert len(want) > 6
    for options in ({}, {"partitionBytes": "1"}):
        got = spark.read.format("quill_files").options(**options).load(str(tmp_path / "in"))
        assert rows(got) == want
    assert got.rdd.getNumPartitions() > 5
    assert rows(spark.read.format("quill_files").load(str(tmp_path / "in" / "a.txt"))) == [r for r in want if r[1] == "a.txt"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("quill_files").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound|missing"):
        spark.read.format("quill_files").load(str(tmp_path / "missing")).count()


def test_files_are_dealt_by_size():
    found = [(0, f"f{i}", size) for i, size in enumerate([100, 90, 10, 10, 10, 10, 5])]
    parts = raw.parted(found, 100)
    assert sorted(p for part in parts for p, _ in part.entries) == [f[1] for f in found]
    assert len(parts) == 3 and raw.parted([], 100) == []


def test_stream_takes_each_file_once(spark, tmp_path):
    """Over restarts from the checkpoint, in micro-batches of two files."""
    raw.register(spark)
    batches = []

    def run():
        stream = spark.readStream.format("quill_files").option("maxFilesPerTrigger", "2").load(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda df, n: batches.append((n, [r.source_file for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    write(tmp_path / "in", {f"{i}.txt": b"x" for i in range(5)})
    run()
    write(tmp_path / "in", {"new.txt": b"y", "more.md": b"z"})
    run()
    taken = [f for _, b in batches for f in b]
    assert sorted(taken) == sorted([*(f"{i}.txt" for i in range(5)), "new.txt", "more.md"])
    assert all(len(b) <= 2 for _, b in batches)


def test_history_of_a_stream_is_that_of_the_table(spark, tmp_path):
    """Messages in random batches, some of them twice: the last state of each conversation is the history over all of its messages."""
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    some, rnd, found = messages.collect(), random.Random(4), {}
    rnd.shuffle(some)
    for part in (some[: len(some) // 2], some[len(some) // 3 :]):
        spark.createDataFrame(part, messages.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
        told = history.histories(stream, expires_ms=None).writeStream.foreachBatch(lambda df, n: found.update({r.conv_id: r.history for r in df.collect()}))
        assert told.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = {r.conv_id: r.history for r in P.history(messages, 6, K.HISTORY_ROLES).collect()}
    assert {k: v for k, v in found.items() if v is not None} == want
    assert set(found) == {r.conv_id for r in messages.select(F.col("conv_id")).distinct().collect()}


def test_silent_conversations_are_forgotten(spark, tmp_path):
    schema, told = "conv_id long, turn long, role string, text string", []

    def come(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    come([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (2, None, "user", "x")])
    stream = history.histories(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), expires_ms=1000)
    q = stream.writeStream.foreachBatch(lambda df, n: told.extend((r.conv_id, r.newest, r.history) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def wait(n):
        end = time.time() + 60
        while len(told) < n and time.time() < end:
            time.sleep(0.2)

    try:
        wait(2)
        assert sorted(told) == [(1, 1, f"{K.HISTORY_ROLES['user']}: a"), (2, 0, None)]
        time.sleep(4)
        come([(1, 2, "user", "c")])
        wait(3)
        assert told[2] == (1, 2, None)
    finally:
        q.stop()
