"""Near copies and repeated strings against brute force."""

import random
import tracemalloc
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash, suffixes
from shelfmark.llm.components import components


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_rows):
    for row in odd_rows:
        assert simhash.fingerprint_of((row[1] or "").encode()) == plain_print(row[1])


@pytest.mark.parametrize("bits", [0, 2, 4, 5])
def test_links_are_complete_and_single(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected


def test_an_index_is_neither_broadcast_nor_made_in_few_tasks(spark):
    # The fingerprints take 8 kB, their 192,000 entries far more.
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp")).distinct()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    found = simhash.links(prints)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan
    assert found.count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(400, 470)] + [(7, 7), (1, 2), (2, 1), (1, None)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    prints = [plain_print(r[1]) for r in odd_rows]
    group = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((r[0] for r, h in zip(odd_rows, group) if h == g and r[0] is not None), default=None) for g in group}
    expected = sorted(str((r[0], p - (1 << 64) if p >> 63 else p, least[g])) for r, p, g in zip(odd_rows, prints, group))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == expected
    kept = simhash.one_of_each(odd)
    wide = simhash.similar_documents(odd)
    assert wide.count() == len(odd_rows)
    assert kept.columns == odd.columns and kept.count() == wide.select("component_id").distinct().count() <= len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 == simhash.one_of_each(empty).count()


def plain_repeats(docs, length):
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = set()
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone.update(range(k, k + length))
            seen.add(window)
        runs = sum(1 for k in gone if k - 1 not in gone)
        out.append((doc_id, len(data), bytes(b for k, b in enumerate(data) if k not in gone), runs))
    return out


def flat(frame):
    return sorted(str((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans))) for r in frame.collect())


@pytest.mark.parametrize("case", ["few letters", "passages", "periods"])
def test_repeats_equal_brute_force(spark, case):
    rng = random.Random(case)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))

    def text():
        if case == "few letters":
            return "".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))
        if case == "periods":
            return rng.choice(["ab", "a", "abc", "é"]) * rng.randint(0, 60) + rng.choice("xyz")
        cut = rng.randint(0, 60)
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 50)))
        return own + passage[cut : cut + rng.randint(0, 90)] + own[::-1]

    docs = [(k, text()) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = flat(suffixes.without_repeats(frame, length=20, gram=7))
    assert got == sorted(str(x) for x in plain_repeats(docs, 20))


def test_a_common_passage_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_RUNS", 3)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    docs = [(k, "".join(rng.choice("abcdefgh ") for _ in range(30)) + passage + chr(97 + k % 7) * 3) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert flat(suffixes.without_repeats(frame, length=20, gram=7)) == sorted(str(x) for x in plain_repeats(docs, 20))


def test_the_order_of_units_holds_no_list_of_all_windows():
    rng = random.Random(8)
    texts = [rng.randbytes(168) for _ in range(2000)]
    pieces = [t for t in texts for _ in range(2)]
    n = np.arange(len(pieces))
    columns = n // 2, n, n * 0, n * 0, n * 0 + 68, n * 0 + 68
    suffixes.repeated_windows(*(c[:4] for c in columns), pieces[:4], 100)
    tracemalloc.start()
    unit, window = suffixes.repeated_windows(*columns, pieces, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(unit.tolist(), window.tolist())) == [(u, w) for u in n[1::2].tolist() for w in range(69)]
    assert peak < 25 * sum(map(len, pieces))


def test_runs_and_units_leave_in_small_batches():
    rng = random.Random(9)
    texts = [rng.randbytes(2000).hex() for _ in range(400)]
    docs = pa.RecordBatch.from_pydict({"doc": list(range(400)), "copy": [1] * 400, "text": texts})
    found = list(suffixes._find_runs(100, 32)(iter([docs])))
    assert sum(b.num_rows for b in found) > 3 * 8192 >= 3 * max(b.num_rows for b in found)
    one = {"key": 1, "gone": False, "lo": 0, "shape": 0, "hot": False}
    kind = pa.list_(pa.struct([("key", pa.int64()), ("gone", pa.bool_()), ("lo", pa.int64()), ("shape", pa.int64()), ("hot", pa.bool_())]))
    runs = pa.array([[one | {"key": k, "lo": k, "gone": k % 2 > 0} for k in range(100)] for _ in texts], kind)
    units = list(suffixes._find_units(100)(iter([docs.append_column("found", runs)])))
    assert sum(b.num_rows for b in units) >= 20_000 and max(b.num_rows for b in units) <= 8192


def test_repeats_of_odd_rows(odd, odd_rows, empty):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    ordered = [(r[0], r[1]) for r in sorted(odd_rows, key=key)]
    assert flat(suffixes.without_repeats(odd)) == sorted(str(x) for x in plain_repeats(ordered, 100))
    carried = suffixes.without_repeats(odd, carry=True, characters=True)
    assert carried.select("row.*").columns == [c for c in odd.columns if c != "text"]
    assert all(bytes(r.kept).decode() is not None for r in carried.collect())
    assert suffixes.without_repeats(empty).count() == 0


def test_characters_stay_whole(spark):
    shared = "ü" * 80
    docs = spark.createDataFrame([(1, "a" + shared), (2, "é" + shared[:-1] + "ö")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixes.without_repeats(docs, characters=True).collect()}
    assert kept[2].startswith("é") and kept[2].endswith("ö") and len(kept[2]) < 10


def test_the_texts_are_exchanged_once(odd):
    plan = suffixes.without_repeats(odd)
    plan.write.format("noop").mode("overwrite").save()
    text = suffixes.without_repeats(odd).select(F.count("*"))._jdf.queryExecution().explainString(
        odd.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def similar_groups(texts, percent=80):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE_EVERY", 2)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    frame = rng.choices(words, k=90)
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=300)
        for edits in rng.sample(range(4, 12), 2):
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = "changed" + str(rng.random())
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    # Texts that share a frame, most of them less of it than four fifths.
    texts += [" ".join(frame + rng.choices(words, k=rng.randint(10, 60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.first_id for r in simhash.similar_documents(docs).collect()}
    expected = similar_groups(texts)
    assert [got[k] for k in range(len(texts))] == expected
    assert 60 < len(set(expected)) < len(texts) - 40


def test_near_copies_are_proposed_by_simhash_words(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=300)
        for edits in (0, 0, 2, 8):
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = "changed" + str(rng.random())
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.first_id for r in simhash.near_copies(docs).collect()}
    expected = similar_groups(texts)
    # A pair near the bound may be missed; none beyond it is linked.
    assert all(got[k] >= expected[k] and expected[got[k]] == expected[k] for k in got)
    missed = sum(got[k] != expected[k] for k in got)
    assert missed <= 0.1 * (len(texts) - len(set(expected)))
    first = simhash.fingerprint_words(texts[0].encode(), 3, 4)
    assert first[0] == simhash.fingerprint_of(texts[0].encode()) and len(set(first)) == 3
    # Without words in common there are no candidates, whatever the sets share.
    monkeypatch.setattr(simhash, "ALL_BITS", -1)
    assert simhash.near_copies(docs).select("component_id").distinct().count() == len(set(texts))


def test_any_differing_bits_are_left_out_by_one_choice_of_segments():
    choices = simhash._hexads()
    assert all(sum(not set(five) & set(c) for c in choices) == 1 for five in combinations(range(12), 5))
    four = list(combinations_with_replacement(range(6), 4))
    assert all(any(sum(k in choice for k in bits) <= 1 for choice in simhash._TRIPLES) for bits in four)


@pytest.mark.parametrize("index", ["near copies", "links"])
def test_chance_gives_distinct_words_no_key_in_common(spark, index):
    rng = np.random.default_rng(4)
    rows = [(k, [int(w) for w in rng.integers(-(2**63), 2**63, 3)]) for k in range(12_000)]
    # Further words that differ from those of the first ten rows by five (or four) bits in one word.
    bits = 5 if index == "near copies" else 4
    for k in range(10):
        flips = rng.choice(64, bits, replace=False)
        rows.append((20_000 + k, [w ^ sum(simhash._signed(1 << int(b)) for b in flips) for w in rows[k][1]]))
    prints = spark.createDataFrame(rows, "node long, words array<long>")
    if index == "near copies":
        keys = simhash._index(prints, F.col("words"), simhash._masks(simhash._hexads(), 12), "node")
    else:
        masks = simhash._one_left_out(simhash._wide_masks(bits))
        keys = simhash._index(prints, F.slice("words", 1, 1), masks, "node")
    groups = keys.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") > 1)
    met = {tuple(r.nodes) for r in groups.select("nodes").distinct().collect()}
    wanted = {(k, 20_000 + k) for k in range(10)}
    # With 20 bits a key more than 10,000 would meet by chance.
    assert wanted <= met and len(met) < 60


def test_far_pairs_are_made_once(spark, monkeypatch):
    rng = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    frame = rng.choices(words, k=600)
    # Many are close by SimHash; none shares four fifths of its shingles with another.
    texts = []
    for _ in range(40):
        new = {at: "x" + str(rng.random()) for at in rng.sample(range(600), 9)}
        texts.append(" ".join(new.get(at, word) for at, word in enumerate(frame)))
    made, real = [], simhash._links_in_groups

    def run(sets, close, linked, *carried, once, **rest):
        return real(sets, close, lambda p: made.append([tuple(r) for r in p.collect()]) or linked(p), *carried, once=once, **rest)

    monkeypatch.setattr(simhash, "_links_in_groups", run)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.near_copies(docs).collect()
    print_ = {t: simhash.fingerprint_words(t.encode(), 3, 3) for t in texts}
    node = {xxhash.xxh64_intdigest(simhash.shingle_set(t.encode()).tobytes(), 42): t for t in texts}
    away = lambda a, b: [(x ^ y).bit_count() for x, y in zip(print_[node[a]], print_[node[b]])]
    close = {(a, b) for a in node for b in node if simhash._signed(a) < simhash._signed(b)
             and min(away(a, b)) <= simhash.WORD_BITS and sum(away(a, b)) <= simhash.ALL_BITS}
    tried = [(u & (2**64 - 1), v & (2**64 - 1)) for pairs in made for u, v in pairs]
    tried = {tuple(sorted(p, key=simhash._signed)) for p in tried}
    assert len(close) > 20 and tried == close and len({r.component_id for r in rows}) == 40


def test_a_dense_group_is_compared_with_its_smallest_member(spark, monkeypatch):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(3000)]
    base, texts = rng.choices(words, k=600), []
    for k in range(200):
        copy = list(base)
        copy[3 * k] = "changed"
        texts.append(" ".join(copy))
    compared, real = [], simhash.possible_pairs
    monkeypatch.setattr(simhash, "possible_pairs", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_of_each(docs, simhash.near_copies(docs)).count() == 1
    # All pairs would be 19,900.
    assert sum(compared) < 4000


def test_members_of_a_linked_group_are_compared_with_one_of_their_smallest(spark, monkeypatch):
    rng = random.Random(15)
    words = [f"w{k}" for k in range(3000)]
    base, texts = rng.choices(words, k=600), []
    for k in range(300):
        copy = list(base)
        for at in (2 * k, (2 * k + 100) % 600, (2 * k + 250) % 600, (2 * k + 400) % 600):
            copy[at] = "x" + str(rng.random())
        texts.append(" ".join(copy))
    compared, real = [], simhash.possible_pairs
    monkeypatch.setattr(simhash, "possible_pairs", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.first_id for r in simhash.near_copies(docs).collect()}
    # They are linked, and meet under keys whose smallest nodes differ: one comparison a member tells, not one for each of these.
    assert len(set(found.values())) < 20
    assert compared[0] < 300 and sum(compared) < 700, compared


def test_entries_left_open_are_described_by_one_join(spark, monkeypatch):
    plans, real = {}, simhash.pin

    def run(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(simhash, "pin", run)
    simhash.near_copies(spark.createDataFrame([(k, f"one two three four five {k}") for k in range(4)], "doc_id long, text string"))
    # Nothing is joined to the entries after they are found to be of several components.
    assert plans["open"].index("Window") < plans["open"].index("Join")


def test_texts_of_one_frame_stay_apart(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    frame = rng.choices(words, k=150)
    # Any two have 146 shingles of about 186 to 246 in common: under four fifths, and many by little.
    texts = [" ".join(frame + rng.choices(words, k=rng.randint(24, 50))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar_groups(texts) == list(range(120))
    assert simhash.one_of_each(docs).count() == 120


def test_sketches_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], []
    for k in range(60):
        base = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 900)), dtype=np.uint64))
        kept = base[rng.random(len(base)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        other = np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(rng.integers(0, 90)), dtype=np.uint64)]))
        for n, grams in ((2 * k, base), (2 * k + 1, other)):
            parts = np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=simhash.PARTS)
            rows.append((n, bytearray(parts.astype("<u2").tobytes())))
        both = len(np.intersect1d(base, other))
        pairs.append((2 * k, 2 * k + 1, 5 * both >= 4 * (len(base) + len(other) - both)))
    full = bytearray(np.full(simhash.PARTS, 65535, dtype="<u2").tobytes())
    rows += [(1000, full), (1001, full)]
    sketches = spark.createDataFrame(rows, "node long, sketch binary")
    table = spark.createDataFrame([p[:2] for p in pairs] + [(0, 3), (1000, 1001)], "u long, v long")
    left = {(r.u, r.v) for r in simhash.possible_pairs(table, sketches, 80).collect()}
    assert {p[:2] for p in pairs if p[2]} <= left and (1000, 1001) in left
    assert len(left) < len(pairs)
    assert simhash.possible_pairs(table.limit(0), sketches, 80).count() == 0
