"""Operators against brute force, with hot groups forced onto the sliced paths."""

import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import documents, gates, limits, picks, summaries, vectors
from shelfmark.operators.ordering import natural_key, ordered_prefix, rank_values


def test_ordered_prefix_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(9)) for i in range(3000)]
    rows += [(None, 5000 + i, 1) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(8)
    got = ordered_prefix(df, ["k"], [F.col("o")], number="n", total="t", sums={"s": F.col("v")})
    expected = {}
    groups = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append(v)
        expected[o] = (len(groups[k]), sum(groups[k]))
    seen = {r["o"]: (r["n"], r["s"], r["t"]) for r in got.collect()}
    assert seen == {o: (*expected[o], len(groups[k])) for k, o, _ in rows}


def test_rank_values_matches_sorting(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 3}", rng.choice([1.5, 1.5, rng.expovariate(0.01), -rng.random() * 50])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    out = {r["g"]: r for r in summaries.latency_percentiles(df, ["g"], "v").collect()}
    for g in ("g0", "g1", "g2"):
        values = sorted(v for k, v in rows if k == g)
        for name, p in summaries.PERCENTILES.items():
            index = max(0, -(-int(p * 100) * len(values) // 100) - 1)
            assert out[g][name] == values[index]
    median = summaries.true_median(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (4.0,)], "v double"), [], "v")
    assert median.first()["median"] == 3.0


def test_natural_order(spark):
    def tokens(s):
        import re

        return [(0, int(t), "") if t.isdigit() else (1, 0, t) for t in re.findall(r"\d+|\D+", s.lower())]

    names = ["page10", "Page2", "page2b", "page", "page 3", "a" + "9" * 25, "a" + "8" * 26, "a7", "10", "9", "x01y", "x1z"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(natural_key(F.col("n")), "n").collect()]

    def compare(a, b):
        for x, y in zip(tokens(a), tokens(b)):
            if x != y:
                return -1 if x < y else 1
        return len(tokens(a)) - len(tokens(b))

    assert got == sorted(sorted(names), key=cmp_to_key(compare))


def test_pick_covers_relaxes_each_filter_on_its_own(spark):
    entries = [
        ("plain", 1, "b/page10.jpg", 5), ("plain", 2, "b/page2.jpg", 5), ("plain", 3, "x/Cover.png", 5),
        ("plain", 4, "credits.jpg", 5), ("plain", 5, "page1.jp2", 5), ("plain", 6, "[a]1.jpg", 5),
        ("credits", 1, "credits2.jpg", 5), ("credits", 2, "logo.jp2", 5),
        ("exotic", 1, "p1.jp2", 5), ("exotic", 2, "credit.jpg", 5),
        ("junk", 1, "__MACOSX/a.jpg", 5), ("junk", 2, "big.jpg", 33 * 1024 * 1024), ("junk", 3, "zero.jpg", 0),
    ]
    df = spark.createDataFrame([(a, o, n, False, s) for a, o, n, s in entries], "archive_id string, ord bigint, name string, is_dir boolean, size bigint")
    got = {}
    for r in picks.pick_covers(df, 4).orderBy("rank").collect():
        got.setdefault(r["archive_id"], []).append(r["name"])
    assert got == {
        "plain": ["x/Cover.png", "b/page2.jpg", "b/page10.jpg", "[a]1.jpg"],
        "credits": ["credits2.jpg"], "exotic": ["p1.jp2"],
    }


def test_budget_skips_but_goes_on(spark):
    rng = random.Random(11)
    rows = [(a, r, r, f"n{r}", rng.randrange(1, 5) * 1024 * 1024) for a in range(60) for r in range(1, 5)]
    df = spark.createDataFrame(rows, "archive_id int, rank int, ord bigint, name string, size bigint")
    got = {(r["archive_id"], r["rank"]) for r in picks.budgeted_pick(df, 4).collect()}
    expected = set()
    for a in range(60):
        left = 8 * 1024 * 1024
        for _, rank, _, _, size in (r for r in rows if r[0] == a):
            if size <= left:
                left -= size
                expected.add((a, rank))
    assert got == expected
    assert picks.budgeted_pick(df.filter("rank = 1").withColumn("size", F.lit(2**40)), 1).count() == 60


def test_retain_recent(spark):
    puts = [("c", "a", 1, 300, True), ("c", "a", 9, 10, False), ("c", "b", 5, 200, False), ("c", "d", 4, 200, False), ("c", "e", 3, 1, False)]
    df = spark.createDataFrame(puts, "cache string, key string, at int, size bigint, is_full boolean")
    got = picks.retain_recent(df, "cache", max_bytes=400, max_entries=3).orderBy("position").collect()
    assert [(r["key"], r["running_bytes"]) for r in got] == [("b", 200), ("d", 400)]


def _serial_plan(requests, existing, first):
    taken = {p.lower() for p in existing} | {
        p.lower() for _, p, f, b in requests if f"{f}/{b}.{p.rsplit('.', 1)[1]}".lower() == p.lower()
    }
    out = {}
    for o, path, folder, base in requests:
        ext = path.rsplit(".", 1)[1]
        if f"{folder}/{base}.{ext}".lower() == path.lower():
            out[o] = path
            continue
        n = 0
        while True:
            name = f"{folder}/{base}.{ext}" if n == 0 else f"{folder}/{base} ({n - 1 + first}).{ext}"
            if name.lower() not in taken:
                break
            n += 1
        taken.add(name.lower())
        out[o] = name
    return out


def test_rename_plan_matches_serial_claims(spark):
    rng = random.Random(2)
    requests = [
        (i, f"/src/{i}.jpg", "/to", rng.choice(["hot", "hot", "Hot", f"b{rng.randrange(6)}"])) for i in range(200)
    ] + [(300, "/to/kept.jpg", "/to", "kept"), (301, "/src/z.jpg", "/to", "kept")]
    existing = ["/to/hot.jpg", "/to/hot (3).jpg", "/to/HOT (7).jpg", "/to/b1 (2).jpg", "/to/hot (02).jpg"]
    df = spark.createDataFrame(requests, "ord bigint, path string, folder string, base string").repartition(8)
    have = spark.createDataFrame([(p,) for p in existing], "path string")
    got = {r["ord"]: r["destination"] for r in picks.rename_plan(df, have).collect()}
    assert got == _serial_plan(requests, existing, 2)


def test_rename_plan_settles_names_that_look_numbered(spark):
    requests = [(1, "/s/1.jpg", "/t", "a"), (2, "/s/2.jpg", "/t", "a"), (3, "/s/3.jpg", "/t", "a (2)"), (4, "/s/4.jpg", "/t", "a (2)")]
    df = spark.createDataFrame(requests, "ord bigint, path string, folder string, base string")
    got = {r["ord"]: r["destination"] for r in picks.rename_plan(df).collect()}
    assert got == _serial_plan(requests, [], 2)
    assert len(set(got.values())) == 4


def test_neighbours_wrap(spark):
    names = ["p1.jpg", "p2.jpg", "p10.jpg", "p11.jpg", "p3.jpg"]
    df = spark.createDataFrame([("f", f"/f/{n}") for n in names] + [("g", "/g/only.jpg")], "folder string, path string")
    rows = {r["path"]: r for r in picks.neighbours(df, "folder", "path").collect()}
    order = ["/f/p1.jpg", "/f/p2.jpg", "/f/p3.jpg", "/f/p10.jpg", "/f/p11.jpg"]
    for i, path in enumerate(order):
        r = rows[path]
        assert (r["previous_path"], r["next_path"], r["ahead_2"], r["ahead_3"]) == tuple(order[(i + d) % 5] for d in (-1, 1, 2, 3))
    assert rows["/g/only.jpg"]["next_path"] == "/g/only.jpg"


def test_hit_to_page(spark):
    pages = spark.createDataFrame([(1, 0, "x" * 70000), (1, 1, None), (1, 2, "yé"), (2, 0, "")], "doc int, page int, text string")
    starts = documents.page_starts(pages, "doc", "page", "text")
    assert {(r["doc"], r["page"]): r["start"] for r in starts.collect()} == {(1, 0): 0, (1, 1): 70001, (1, 2): 70002, (2, 0): 0}
    hits = spark.createDataFrame([(1, 0), (1, 70000), (1, 70001), (1, 70002), (1, 70005), (1, 70006), (2, 0)], "doc int, offset bigint")
    got = {(r["doc"], r["offset"]): (r["page"], r["page_offset"]) for r in documents.hit_to_page(hits, starts, "doc", "page").collect()}
    assert got == {(1, 0): (0, 0), (1, 70000): (0, 70000), (1, 70001): (1, 0), (1, 70002): (2, 0), (1, 70005): (2, 3), (2, 0): (0, 0)}


def test_doc_search_wraps(spark):
    docs = spark.createDataFrame([(1, "ab AB xab"), (2, "none")], "d int, t string")
    rows = documents.doc_search(docs, "d", "t", ["ab", ""]).orderBy("rank").collect()
    assert [(r["label"], r["offset"], r["next_offset"], r["previous_offset"]) for r in rows] == [("1/3", 0, 3, 7), ("2/3", 3, 7, 0), ("3/3", 7, 0, 3)]
    many = documents.doc_search(docs, "d", "t", [f"q{n}" for n in range(1500)] + ["none"]).collect()
    assert [(r["d"], r["term"]) for r in many] == [(2, "none")]


def test_gates_pass_and_fail(spark):
    keys = lambda *v: spark.createDataFrame([(k,) for k in v], "key string")
    assert gates.regression_diff(keys("a"), keys("a"), keys("a"), "key").count() == 0
    got = gates.regression_diff(keys("a", "b", "c"), keys("a", "b", "d"), keys("a", "d", "d"), "key").collect()
    assert {(r["key"], r["status"]) for r in got} == {("b", "regressed"), ("c", "missing"), ("d", "new")}

    timed = lambda *v: spark.createDataFrame(v, "name string, ms double")
    now = timed(("slow", 200.0), ("small", 20.0), ("near", 60.0), ("ratio", 100.0), ("fresh", 1.0))
    was = timed(("slow", 50.0), ("small", 0.0), ("near", 30.0), ("ratio", 50.0))
    assert {(r["name"], r["verdict"]) for r in gates.self_gate(now, was).collect()} == {("slow", "suspect"), ("fresh", "unseen")}

    rows = spark.createDataFrame(
        [("dds", "tiny", 15.3, 2.7), ("dds", "large", 75.6, 19.1), ("avif", "a", 100.0, 20.0), ("jpg", "j", 50.0, None)],
        "ext string, name string, ms double, peer_ms double",
    )
    allowed = spark.createDataFrame([("avif", 6.0)], "ext string, max_ratio double")
    # The exempt tiny sample has the higher ratio and must not hide the large one.
    assert [(r["ext"], r["name"], r["ratio"]) for r in gates.peer_gate(rows, allowed).collect()] == [("dds", "large", 3.96)]


def test_expected_and_compare(spark):
    expected = spark.createDataFrame([("exact", [1, 2, 3]), ("eight", [10, 10, 10]), ("nine", [10, 10, 10]), ("gone", [0, 0, 0])], "name string, want array<int>")
    samples = spark.createDataFrame([("exact", [1, 2, 3, 255]), ("eight", [18, 2, 10]), ("nine", [19, 10, 10])], "name string, got array<int>")
    got = {r["name"]: r["verdict"] for r in gates.expected_values(expected, samples).collect()}
    assert got == {"exact": "ok", "eight": "ok", "nine": "wrong", "gone": "missing"}
    schema = "name string, ok boolean, samples array<double>"
    old = spark.createDataFrame([("s", True, [1.0]), ("c", True, [1.0]), ("l", True, [1.0]), ("g", False, None), ("n", False, None), ("e", True, [1.0])], schema)
    new = spark.createDataFrame([("s", True, [2.9]), ("c", True, [3.0]), ("g", True, [1.0]), ("n", False, None), ("e", True, [1.0, 2.0])], schema)
    got = {r["name"]: r["status"] for r in gates.build_compare(old, new).collect()}
    assert got == {"s": "SAME", "c": "CHANGED", "l": "LOST", "g": "GAINED", "e": "ERROR"}


def test_key_parity(spark):
    rows = [("en", "a", 0, "{n} x"), ("en", "b", 1, "y"), ("de", "a", 0, "x"), ("de", "a", 1, "{n}"), ("de", "z", 2, ""), ("fr", "a", 0, "y {n}"), ("fr", "b", 1, "")]
    got = {r["locale"]: tuple(r)[1:] for r in gates.key_parity(spark.createDataFrame(rows, "locale string, key string, ord int, value string"), "en").collect()}
    assert got == {"de": (1, 1, 1, 1), "fr": (0, 0, 0, 0), "en": (0, 0, 0, 0)}
    again = gates.key_parity(spark.createDataFrame(rows + [("en", "a", 9, "{n}")], "locale string, key string, ord int, value string"), "en")
    assert {r["locale"]: r["duplicates"] for r in again.collect()}["en"] == 1


def test_manifest_and_backlog(spark):
    schema = "path string, bytes bigint, sha256 string"
    a = spark.createDataFrame([("same", 1, "x"), ("size", 1, "x"), ("hash", 1, "x"), ("gone", 1, "x")], schema)
    b = spark.createDataFrame([("same", 1, "x"), ("size", 2, "y"), ("hash", 1, "y"), ("more", 1, "x")], schema)
    got = {(r["path"], r["status"]) for r in gates.manifest_diff(a, b).collect()}
    assert got == {("size", "changed:bytes"), ("hash", "changed:sha256"), ("gone", "missing"), ("more", "extra")}
    attempts = [("b", "built"), ("b", "already"), ("a", "already"), ("p", "built"), ("p", "failed"), ("f", "failed")]
    verdicts = gates.backlog_verdict(spark.createDataFrame(attempts, "path string, outcome string")).collect()
    assert {(r["path"], r["verdict"]) for r in verdicts} == {("b", "built"), ("a", "already"), ("p", "partial"), ("f", "failed")}


def test_render_verdict(spark):
    grey = [float(i) for i in range(60)] + [128.0] * 20
    samples = spark.createDataFrame(
        [("cut", grey), ("dark", grey[:60] + [5.0] * 20), ("flat", [7.0] * 10), ("alone", [7.0] * 10), ("ok", [7.0] * 10), ("listed", grey)],
        "name string, samples array<double>",
    )
    peers = spark.createDataFrame([("flat", 30.0), ("ok", 3.0), ("cut", 1.0)], "name string, peer_sd double")
    allowed = spark.createDataFrame([("listed",)], "name string")
    got = {r["name"]: r["verdict"] for r in vectors.render_verdict(samples, peers, allowed).collect()}
    assert got == {"cut": "TRUNCATED", "flat": "FEATURELESS", "alone": "UNJUDGED"}


def test_reports(spark):
    runs = spark.createDataFrame([("a", 3.0), ("a", None), ("a", 2.0), ("b", None)], "name string, ms double")
    got = {r["name"]: (r["ms"], r["attempts"], r["status"]) for r in summaries.best_of_n(runs).collect()}
    assert got == {"a": (2.0, 3, "ok"), "b": (None, 1, "FAIL")}
    docs = spark.createDataFrame([(1, "has 327 formats, 300+ formats and 331 file types. 12 formats\n999.\nformats")], "d int, t string")
    assert [r["claimed"] for r in summaries.stale_counts(docs, "d", "t", 331).collect()] == [327]
    tiers = limits.tier_order(spark.createDataFrame([("zzz",), ("single",), ("small",), ("large",)], "t string"), "t")
    assert [r["t"] for r in tiers.collect()] == ["small", "large", "single", "zzz"]
    top = limits.first_n_of_m(spark.range(10).toDF("i"), ["i"], 3).collect()
    assert [(r["i"], r["total"]) for r in top] == [(0, 10), (1, 10), (2, 10)]


def test_json_rules(spark):
    deep = lambda n: '{"k":' * n + '"AKIA' + "A" * 16 + '"' + "}" * n
    rows = [(1, deep(5)), (2, deep(6)), (3, "not json"), (4, '{"a":1}'), (5, '{"b":"x","arr":[[["ghp_' + "z" * 36 + '"]]]}')]
    found = documents.secrets_in_json(spark.createDataFrame(rows, "i int, j string"), "i", "j").collect()
    assert {(r["i"], r["top_key"], r["kind"]) for r in found} == {(1, "k", "cloud_key_id"), (5, "arr", "repo_token")}
    big = spark.createDataFrame([(1, '{"s":"x","big":"' + "y" * 70000 + '"}'), (2, '{"s":1}')], "i int, j string")
    over = documents.oversize_docs(big, "i", "j").collect()
    assert [(r["i"], r["largest_key"], r["largest_bytes"]) for r in over] == [(1, "big", 70002)]


def test_percentiles_keep_groups_without_values_and_spread_close_ones(spark):
    rows = [("a", 1000.0 + k % 1000 / 100, True) for k in range(900)] + [(None, 5.0, True), ("z", None, False), ("z", None, False)]
    df = spark.createDataFrame(rows, "k string, v double, ok boolean")
    got = {r["k"]: r for r in summaries.latency_percentiles(df, ["k"], "v", F.col("ok")).collect()}
    values = sorted(v for k, v, _ in rows if k == "a")
    assert got["a"]["p50"] == values[449] and got["a"]["p99"] == values[890] and got["a"]["n"] == 900
    assert got[None]["p90"] == 5.0 and (got["z"]["n"], got["z"]["failed"], got["z"]["p50"]) == (0, 2, None)


def test_self_gate_skips_exempt_rows(spark):
    now = spark.createDataFrame([("a", 100.0, True), ("b", 100.0, False), ("c", 200.0, False)], "name string, ms double, tiered boolean")
    was = spark.createDataFrame([("c", 10.0)], "name string, ms double")
    got = {(r["name"], r["verdict"]) for r in gates.self_gate(now, was, exempt=F.col("tiered")).collect()}
    assert got == {("b", "unseen"), ("c", "suspect")}


def test_secrets_that_end_a_sentence(spark):
    key, token = "AKIA" + "A1B2C3D4E5F6G7H8", "ghp_" + "a1" * 18
    web = "ey" + "a" * 10 + "." + "b" * 12 + "." + "c" * 8
    docs = spark.createDataFrame([(1, f"see {key}. Then {token}. And {web}.")], "d int, t string")
    got = {(r["token"], r["kind"]) for r in documents.secrets(docs, "d", "t").collect()}
    assert got == {(key, "cloud_key_id"), (token, "repo_token"), (web, "jwt")}


def test_oversize_scalar_documents(spark):
    import json

    docs = spark.createDataFrame([(1, json.dumps("x" * 70000)), (2, json.dumps({"a": "y" * 70000})), (3, "{}")], "d int, t string")
    got = {r["d"]: (r["bytes"], r["largest_key"]) for r in documents.oversize_docs(docs, "d", "t").collect()}
    assert got == {1: (70002, None), 2: (70008, "a")}


def test_fill_of_three_channels(spark):
    from shelfmark.operators import vectors

    grey, tint = [128.0, 129.0, 127.0], [136.0, 128.0, 122.0]
    rows = [(1, [[float(k), 0.0, 9.0] for k in range(6)] + [grey] * 4), (2, [[float(k), 0.0, 9.0] for k in range(6)] + [tint] * 4)]
    samples = spark.createDataFrame(rows, "name int, samples array<array<double>>")
    peers = spark.createDataFrame([], "name int, peer_sd double")
    got = vectors.render_verdict(samples, peers, peers).collect()
    assert [(r["name"], r["verdict"], r["tail"]) for r in got] == [(1, "TRUNCATED", 0.4)]


def test_page_starts_over_many_runs(spark):
    from pyspark.sql import functions as F

    rows = [(1, p, "x" * (p % 7)) for p in range(-5, 9000, 3)] + [(2, 5000, None), (2, 1, "ab"), (None, 3, "q"), (None, 9000, "r")]
    pages = spark.createDataFrame(rows, "doc int, page int, text string").repartition(5)
    got = {(r["doc"], r["page"]): (r["start"], r["next_start"]) for r in documents.page_starts(pages, "doc", "page", "text").collect()}
    named = documents.page_starts(pages.withColumn("page", F.format_string("%06d", F.col("page") + 10)), "doc", "page", "text").collect()
    assert got == {(r["doc"], int(r["page"]) - 10): (r["start"], r["next_start"]) for r in named}
    at = {}
    for doc, page, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        start = at.get(doc, 0)
        at[doc] = start + len(text or "") + 1
        assert got[doc, page] == (start, at[doc])


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_neighbours_across_slices(spark, parts):
    sizes = {"hot": 60, "two": 2, "one": 1, "three": 3, "five": 5, None: 4}
    rows = [(f, f"{f or 'none'}/p{k}.jpg") for f, n in sizes.items() for k in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = picks.neighbours(spark.createDataFrame(rows, "f string, p string"), "f", "p").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    want = {
        (f, k + 1, n, *(f"{f or 'none'}/p{(k + s) % n}.jpg" for s in (0, 1, 2, 3, -1)))
        for f, n in sizes.items() for k in range(n)
    }
    assert len(found) == len(rows) and {tuple(r) for r in found} == want


def test_routed_names_are_worked_out_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    @F.udf("string")
    def counted(base):
        with open(calls, "a") as file:
            file.write(".\n")
        return base

    asked = spark.range(60).select(
        F.col("id").alias("ord"), F.concat(F.lit("/in/"), "id", F.lit(".png")).alias("path"),
        F.when(F.col("id") % 10 != 9, "/out").alias("folder"), counted((F.col("id") % 7).cast("string")).alias("base"),
    )
    rows = documents.route_plan(asked).collect()
    assert len(rows) == 60 and len({r.destination for r in rows}) == 55
    assert len(open(calls).readlines()) == 60
