import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import feistel, training_order
from folium.llm.sharding import shard
from tests.llm import helpers


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation_matches_python_and_inverts(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel.permute(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    assert got == [feistel.permute_number(i, n, 3) for i in range(n)]
    assert [feistel.unpermute_number(p, n, 3) for p in got] == list(range(n))
    assert feistel.permute_array(np.arange(n), n, 3).tolist() == got


def test_keys_give_different_orders(spark):
    a, b = ([feistel.permute_number(i, 500, k) for i in range(500)] for k in (1, 2))
    assert a != b


def test_shards_are_even_and_gapless(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = shard(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shards_do_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(shard(docs)) == key(shard(docs.repartition(7)))


def test_shard_awkward_rows(spark):
    rows = shard(helpers.table(spark)).collect()
    assert len(rows) == len(helpers.AWKWARD)
    assert {r["size"] for r in rows if r.doc_id == 2} == {1}
    assert sorted(8 * r.slot + r.shard for r in rows) == list(range(len(rows)))
    assert shard(helpers.empty(spark)).collect() == []


def test_shards_of_a_row_that_repeats(spark, monkeypatch):
    """A third of the rows are one row; every place is taken once."""
    from folium.llm import numbering

    monkeypatch.setattr(numbering.number_rows, "__defaults__", ("_row", 7))
    rows = [(5, "the same", "en", "a")] * 50 + [(None, f"x{i}", "en", "a") for i in range(50)] + [(i, f"y{i}", "en", "a") for i in range(50)]
    got = shard(helpers.table(spark, rows)).collect()
    assert sorted(8 * r.slot + r.shard for r in got) == list(range(150))
    assert sum(r.doc_id == 5 and r["size"] == 9 for r in got) == 50


def test_training_order_round_trip(spark, tmp_path):
    docs = helpers.table(spark).select("doc_id", "text").repartition(3)
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    codec = training_order.TokenIds(spark)
    out, total = training_order.materialise(docs, codec, str(tmp_path / "shards"), shard_rows=16)
    index = training_order.read_index(spark, out, 16).collect()
    assert sorted(r.slot for r in index) == list(range(total))
    encoder = codec.encoder()
    want = {}
    for r in docs.collect():
        ids = np.frombuffer(encoder.encode_batch([r.text])[0], dtype="<u4")
        for k in range(-(-len(ids) // training_order.LENGTH)):
            part = ids[k * training_order.LENGTH : (k + 1) * training_order.LENGTH]
            padded = np.full(training_order.LENGTH, training_order.PAD, dtype="<u2")
            padded[: len(part)] = part
            want.setdefault((r.doc_id, k, len(part), zlib.crc32(padded.tobytes())), []).append(1)
    got = {}
    for r in index:
        got.setdefault((r.doc_id, r.seq_no, r.n_tokens, r.ids_crc32), []).append(1)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    # A reader seeks a slot by arithmetic.
    r = index[len(index) // 2]
    [file] = (tmp_path / "shards" / f"shard={r.shard}").glob("*.txt")
    with open(file, "rb") as f:
        f.seek(r.byte_offset)
        record = np.frombuffer(f.read(training_order.STRIDE), dtype=training_order.RECORD)[0]
    assert zlib.crc32(record["ids"].tobytes()) == r.ids_crc32 and record["end"] == 10


def test_training_order_numbers_by_file_and_row(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    encoder = training_order.TokenIds(spark).encoder()
    rows = sorted((r.f, r.k, r.doc_id, r.text) for r in docs.select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("k")).collect())
    sequences = []
    for _, _, i, text in rows:
        sequences += [(i, k) for k in range(len(training_order.records(i, encoder.encode_batch([text])[0])))]
    n = len(sequences)
    want = {(i, k, feistel.permute_number(g, n, training_order.KEY)) for g, (i, k) in enumerate(sequences)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64m", "60k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            again = spark.read.parquet(f"{data}/documents.parquet")
            got = {(r.doc_id, r.seq_no, r.slot) for r in training_order.training_order(again).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want


def test_training_order_of_a_table_that_is_no_scan(spark):
    docs = helpers.table(spark)  # with clashing columns
    index = training_order.training_order(docs).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    assert {r.doc_id for r in index} == {1, 4, 5, None, 7, 8, 9}


def test_training_order_refuses_wide_ids():
    with pytest.raises(ValueError):
        training_order.records(1, np.array([1, 70_000], dtype="<u4").tobytes())


def test_training_order_empty(spark):
    assert training_order.training_order(helpers.empty(spark)).collect() == []


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    from folium.llm.bpe import default_vocabulary

    library = Tokenizer.from_file(default_vocabulary())
    texts = ["", "hello  world\n\n I'll x", "é日本😀 12³", "x" * 3000, " \t\n a"]
    texts += [f"a{training_order.NEVER}b", training_order.NEVER]
    rnd = random.Random(1)
    pool = ["a", "é", " ", "\n", "日本", "\t", "12", ".", "'s", "word", "\u3000", "\xa0", "\x1c", "\x00", "B,", "(", " x"]
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    for t, got in zip(texts, training_order.TokenIds(spark).encoder().encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
