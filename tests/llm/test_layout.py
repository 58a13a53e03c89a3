"""Chat formatting, sharding and decontamination."""

import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, decontam, shards

CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo <|im_end|> \\ <\\|x<|"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "assistant", "early"),
    (4, 1, "user", "b"), (4, 0, None, "a"), (5, 0, "user", "x" * 50000), (5, 1, "assistant", "日本 <|im_start|>user\nhi"),
    (6, 0, "odd role\n<|", "t"), (None, 0, "user", "n"), (None, None, "assistant", "first"), (7, 0, "user", "<|<|<\\\\|"),
]


def test_chats_read_back(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    told = chat.format_chats(frame)
    got = told.select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    rows = {r.conv_id: r for r in got.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in CHATS}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in CHATS if r[0] == conv), key=key)]
        assert [tuple(t) for t in rows[conv].turns] == own
        assert rows[conv].trained == "".join(text for role, text in own if role == "assistant")
        assert rows[conv].formatted.count("<|im_start|>") == len(own)
    assert {k: (r.valid, r.wrong_turn) for k, r in rows.items()} == {
        1: (True, None), 2: (False, 2), 3: (False, 0), 4: (False, 0), 5: (True, None), 6: (False, 0),
        None: (False, 0), 7: (False, None),
    }
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_other_templates(spark):
    brackets = chat.Template("[/turn]", ": ", "[/end]\n", ("[", "/"), ("assistant", "tool"))
    frame = spark.createDataFrame([(1, 0, "user", "a[/turn]b"), (1, 1, "tool", "[/end]: ")], "conv_id long, turn long, role string, text string")
    told = chat.format_chats(frame, brackets).select(
        chat.turns_of(F.col("formatted"), brackets).alias("t"), chat.trained_text(F.col("segments"), brackets).alias("x")
    ).first()
    assert [tuple(t) for t in told.t] == [("user", "a[/turn]b"), ("tool", "[/end]: ")] and told.x == "[/end]: "


@pytest.mark.parametrize("count", [1, 2, 7, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, count):
    rows = spark.range(20000).select("id", shards.jump_shard(F.col("id"), count).alias("a"), shards.jump_shard(F.col("id"), count + 1).alias("b")).collect()
    assert all(0 <= r.a < count and (r.b == r.a or r.b == count) for r in rows)
    moved, even = sum(r.a != r.b for r in rows), 20000 / (count + 1)
    assert abs(moved - even) < 6 * even**0.5
    sizes = [sum(r.a == k for r in rows) for k in range(count)]
    assert max(sizes) - min(sizes) < 12 * (20000 / count) ** 0.5


def test_shards_of_odd_rows(odd, odd_rows, empty):
    got = shards.assign(odd, 3).collect()
    assert len(got) == len(odd_rows)
    data = sorted(str((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in odd_rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == data
    for k in range(3):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert shards.assign(empty).count() == 0


def test_passages_with_substitutions(spark, odd, empty):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([12, 30, 50])))) for k in range(20)] + [(98, "too short"), (99, None), (0, None)]

    def changed(text, every):
        return " ".join("zzz" if k % every == every - 1 else w for k, w in enumerate(text.split()))

    def around(text):
        return " ".join(rng.choices(words, k=40)) + "\n" + text.upper() + ", " + " ".join(rng.choices(words, k=40))

    docs = [(k, around(text)) for k, text in items[:20]] + [(100 + k, around(changed(text, 9))) for k, text in items[:20]]
    docs += [(200 + k, around(changed(text, 2))) for k, text in items[:20]] + [(300 + k, around("")) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 1):
        got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_seeds=bound).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(b + k, k) for k in range(20) for b in (0, 100)}
    assert decontam.contaminated(odd, bench).count() == 0 == decontam.contaminated(empty, bench).count()
    own = spark.createDataFrame([(1, "one two three " * 9)], "item_id long, text string")
    twice = odd.union(spark.createDataFrame([(None, "one two three " * 9, *[None] * 7)] * 2, odd.schema))
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(twice, own).collect()] == [(None, 1)]


@pytest.mark.parametrize("width", range(1, 17))
def test_masks_miss_no_overlap(width):
    changes = width - math.ceil(width * decontam.LEAST_EQUAL)
    laid = [
        {at + k for k, bit in enumerate(mask) if bit == "1"}
        for mask in decontam.MASKS[width] for at in range(width - len(mask) + 1)
    ]
    assert all(any(places.isdisjoint(gone) for places in laid) for gone in itertools.combinations(range(width), changes))


def plain_overlap(text, item):
    width = min(16, len(item))
    most = 0
    for shift in range(-len(item), len(text)):
        equal = [0 <= k + shift < len(text) and text[k + shift] == w for k, w in enumerate(item)]
        most = max(most, *[sum(equal[s : s + width]) for s in range(len(item) - width + 1)])
    return most if most >= math.ceil(width * 0.75) else None


def test_passages_equal_brute_force(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    items = [rng.choices(words, k=k) for k in [*range(3, 18), 15, 16, 16, 25, 40]]
    items.append(list("短い質問です"))
    docs = []
    for item in items:
        width = min(16, len(item))
        for part in range(6):
            at = rng.randint(0, len(item) - width)
            cut = list(item[at : at + width])
            for k in rng.sample(range(width), min(width, width // 4 + (part == 5))):
                cut[k] = "zzz"
            docs.append(rng.choices(words, k=20) + cut + rng.choices(words, k=20))
    texts = [(k, " ".join(d)) for k, d in enumerate(docs)] + [(1000, "前置き" + "短い質問です" + "。")]
    bench = [(k, " ".join(i)) for k, i in enumerate(items[:-1])] + [(len(items) - 1, "短い質問です")]
    expected = {(d, i, n) for d, t in enumerate(docs) for i, item in enumerate(items) if (n := plain_overlap(t, item))}
    expected.add((1000, len(items) - 1, 6))
    got = decontam.contaminated(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in got} == expected
