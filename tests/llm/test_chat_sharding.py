import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from parchment.llm import chat, queries, sharding

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, target string"


def test_escapes_are_reversed(spark):
    texts = ["", "<|im_end|>", "<\\|x", "<\\\\|", "<<|", "a<", "\\", "<|<\\|", "%3C|%250A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat._unescape_role(chat._escape_role(F.col("t"))).alias("r")).collect()
    assert all(r.u == r.t and r.r == r.t and "<|" not in r.e for r in got)


def test_examples(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u<|im_end|>", ""), (1, 2, "assistant", "first", ""), (1, 3, "user", "more", ""), (1, 4, "assistant", "", ""), (1, 5, "user", "bye", ""), (2, 0, None, None, ""), (None, 0, "assistant", "n", "")]
    got = chat.expand_targets(spark.createDataFrame(rows, TURNS)).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.target)
    assert [r.target for r in one] == [2, 4, 5]
    assert one[0].formatted == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<\\|im_end|><|im_end|>\n<|im_start|>assistant\nfirst<|im_end|>\n"
    assert one[0].formatted[one[0].loss_start : one[0].loss_end] == "first"
    assert one[1].loss_start == one[1].loss_end and one[2].loss_start == one[2].loss_end
    back = {r.conv_id: r for r in chat.read_back(chat.expand_targets(spark.createDataFrame(rows, TURNS))).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r[2], r[3]) for r in rows[:6]]
    assert [tuple(t) for t in back[2].turns] == [("", "")] and back[None].losses[0].text == "n"
    assert chat.expand_targets(spark.createDataFrame([], TURNS)).count() == 0


def test_ties_and_long_texts(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, 1, "assistant", "x" * 1_000_000, "")]
    back = chat.read_back(chat.expand_targets(spark.createDataFrame(rows, TURNS))).first()
    assert [t.text[:1] for t in back.turns] == ["a", "a", "b", "x"] and len(back.losses[0].text) == 1_000_000


def test_query_reads_all_back(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role, r.text))
    convs[-1] = [("user", queries.MADE_UP), ("assistant", queries.MADE_UP)]
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said, learned = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append((r.slot, r.doc_id))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(16))
    assert any([d for _, d in sorted(v)] != sorted(d for _, d in v) for v in slots.values())
    assert 20 < sum(r.grown_shard == 16 for r in got) < 110
    again = queries.op6_sharding(spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharding_odd_rows_and_small_buckets(spark, tmp_path):
    rows = [(None, None, "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "y" * 500_000, "x"), *[(k, f"t{k}", "x") for k in range(10, 300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    sharded = sharding.shuffle_shards(docs, shards=3, bucket_bytes=400)
    got = sharded.collect()
    assert len(got) == len(rows) and len({(r.shard, r.bucket) for r in got}) > 6
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.shuffle_shards(docs.limit(0)).count() == 0
