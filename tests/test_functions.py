"""Column functions on small inputs with known answers."""

import random
import string

from pyspark.sql import functions as F

from shelfmark.functions import encoding, html, markdown, media, paths, signatures, sizes, text


def test_human_size(evaluate):
    got = evaluate(sizes.human_size, [0, 1023, 1024, 1536, 1280, 5 * 1024**4], "v bigint")
    assert got == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.2 KB", "5.0 TB"]


def test_sizes_beyond_64_bits(spark, evaluate, tmp_path):
    from decimal import Decimal

    from shelfmark.plans import QUERIES

    assert evaluate(sizes.human_size, [Decimal(1023), Decimal(2**66)], "v decimal(38,0)") == ["1023 B", "67108864.0 TB"]
    spark.createDataFrame([(7, 2), (51_282, 120_000)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.size for r in QUERIES["f1_human_size"](spark, str(tmp_path)).collect()}
    assert got == {7: "688 B", 51_282: "%.1f TB" % (120_000 * (51_282**3 + 1) / 1024**4)}


def test_parse_size(evaluate):
    got = evaluate(sizes.parse_size, ["2MB", "1.5k", "700", "7b", "inf", "nan", "-3", "0", "1d", "x", ""])
    assert got == [2_000_000, 1500, 700, 7, None, None, None, None, None, None, None]


def test_resize_never_enlarges(evaluate):
    fit = lambda v: sizes.fit_dims(F.lit(4000), F.lit(3000), sizes.parse_resize(v))
    got = evaluate(fit, ["800x800", "9000x9000", "50%", "0%", "5000%", "junk"])
    assert [tuple(r) for r in got] == [(800, 600), (4000, 3000), (2000, 1500), (40, 30), (40000, 30000), (4000, 3000)]


def test_versions(evaluate):
    got = evaluate(sizes.parse_version, ["v2.7.1", "2.7.1-rc1", "3", "x.1", "V1.x"])
    assert [None if r is None else tuple(r) for r in got] == [(2, 7, 1), (2, 7, 1), (3, 0, 0), None, (1, 0, 0)]
    newer = evaluate(lambda v: sizes.is_newer(v, F.lit("1.9.0")), ["1.10.0", "1.9.0", "bad"])
    assert newer == [True, False, False]


def test_buckets(evaluate):
    got = evaluate(sizes.normalize_sizes, [[0, -1], [100, 90, 5000], []], "v array<int>")
    assert got == [[256], [96, 256, 2560], [256]]


def test_paths(evaluate):
    names = ["/a.b/c.JPG", "/a/.hidden", "x/y.tar.gz", "end.", "plain", r"c:\d\e.Mp3"]
    assert evaluate(paths.extension, names) == ["jpg", "", "gz", "", "", "mp3"]
    assert evaluate(paths.stem, names) == ["c", ".hidden", "y.tar", "end", "plain", "e"]
    assert evaluate(lambda v: paths.category(paths.extension(v)), names)[-1] == "Audio"


def test_format_table(spark):
    counts = {r["category"]: r["count"] for r in paths.format_table(spark).groupBy("category").count().collect()}
    # nef, dng and cr2 are camera files even where an archive accepts them as a cover.
    assert {k: counts[k] for k in ("Camera RAW", "Ebook", "Document", "Audio", "Video", "Archive")} == {
        "Camera RAW": 34, "Ebook": 12, "Document": 43, "Audio": 18, "Video": 22, "Archive": 3,
    }


def test_code_language(evaluate):
    names = ["a.PY", "Dockerfile", "x", "y.unknown"]
    got = evaluate(lambda v: paths.code_language(v, F.lit("#!/usr/bin/env node\n")), names)
    assert got == ["py", "sh", "js", "js"]
    assert evaluate(paths.language_from_fence, ["Golang", "c#", "tsx", "none"]) == ["go", "cs", "js", "plain"]


def test_emails(evaluate):
    good = ["k@l.io", "first.last+tag@mail-host.example.org", "UPPER@Case.NET"]
    bad = [
        "", "short", "two@@signs.com", "a@b@c.com", "no-dot@host", "dot@.lead.com", "dot@trail.com.",
        "gap@two..dots.com", "hy@-lead.com", "hy@trail-.com-", "sp ace@x.com", "tld@x.c0", "tld@x.c",
        "a" * 65 + "@x.com", "brace{@x.com", "new@line.com\n", "é@x.com", "a@" + "b" * 120 + ".com",
    ]
    assert evaluate(text.valid_email, good) == [True] * len(good)
    assert evaluate(text.valid_email, bad) == [False] * len(bad)


def test_secrets_need_their_full_length(evaluate):
    full = ["sk_live_" + "a" * 16, "sk-" + "b" * 20, "ghp_" + "c" * 36, "github_pat_" + "d" * 22,
            "xoxb-" + "e" * 10, "AKIA" + "F" * 16, "AIza" + "g" * 35, "ey" + "h" * 8 + "." + "i" * 10 + "." + "j" * 5]
    kinds = ["payment_key", "api_key", "repo_token", "repo_fine_token", "chat_token", "cloud_key_id", "maps_key", "jwt"]
    assert evaluate(text.secret_kind, full) == kinds
    assert evaluate(text.secret_kind, [v[:-1] for v in full]) == [None] * len(full)
    assert evaluate(text.secret_kind, ["x\n-----BEGIN EC PRIVATE KEY-----\ny"]) == ["private_key"]


def test_find_all_matches_plain_search(evaluate):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aAbÉ x") for _ in range(rng.randrange(0, 3000))) for _ in range(40)]
    needle = "ab"

    def plain(value):
        hay = value.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).encode()
        out, at = [], hay.find(needle.encode())
        while at >= 0:
            out.append(at)
            at = hay.find(needle.encode(), at + len(needle))
        return out

    assert evaluate(lambda v: text.find_all(v, F.lit("AB")), texts) == [plain(t) for t in texts]


def test_links(evaluate):
    cases = {
        "see http://one.test/a, then": [("http://one.test/a", "http://one.test/a")],
        "(www.two.test/x_(y)).": [("www.two.test/x_(y)", "https://www.two.test/x_(y)")],
        "midhttp://three.test": [],
        "http://nodot https://": [],
        "*https://four.test/*": [("https://four.test/", "https://four.test/")],
        "https://five.test。next": [("https://five.test", "https://five.test")],
        "https://six.test/a)b)": [("https://six.test/a)b", "https://six.test/a)b")],
    }
    got = evaluate(text.linkify, list(cases))
    assert [[tuple(r) for r in rows] for rows in got] == list(cases.values())


def test_entities_are_decoded_once(evaluate):
    got = evaluate(text.decode_entities, ["&amp;lt;", "&#38;lt; &#x41;", "a & b &nope; &", "&hellip;&nbsp;", "&#0055296;"])
    assert got == ["&lt;", "&lt; A", "a & b &nope; &", "…\u00a0", "&#0055296;"]


def test_names(evaluate):
    got = evaluate(text.safe_component, [' a<b>:"c. ', "nul", "NUL.txt", "...", "", "ok\u00a0", "x\ty"])
    assert got == ["a-b---c", "image", "image", "image", "image", "ok", "x-y"]


def test_template_values_are_not_expanded_again(evaluate):
    make = lambda v: text.template_path(text.expand_template(
        "$artist/$title\\$track-$album", artist=v, album=F.lit("Al"), title=F.lit("T"), track=F.lit(7), missing="?"))
    assert evaluate(make, ["$title", None, "  "]) == ["$title/T/07-Al", "-/T/07-Al", "T/07-Al"]


def test_clip_lines(evaluate):
    got = evaluate(lambda v: text.clip_lines(v, 3), ["abcd\r\nxy\n", "abc\r\nxy\n", ""])
    assert got == ["abc…\nxy", "abc\r\nxy\n", ""]


def test_small_text_rules(evaluate):
    assert evaluate(text.strip_ansi, ["a\x1b[1;31mb\x1b[0m\x1bc\x1b[12"]) == ["abc"]
    assert evaluate(text.fence_width, ["", "``", "x`````y"]) == [3, 3, 6]
    assert evaluate(text.md_escape, ["a|b\n[c]"]) == [r"a\|b \[c\]"]
    assert evaluate(text.percent_decode, ["%41+%zz%", "%C3%A9"]) == ["A+%zz%", "é"]


def test_script_score(evaluate):
    score = lambda v: text.script_score(text.script_profile(v))
    got = evaluate(score, ["plain", "ひらがなと漢字", "漢字", "한국어", "éàü", "漢é"])
    assert got[0] == 0 and got[1] > 1000 and got[2] == 2 and got[3] > 1000 and got[4] == 0 and got[5] == 0


def test_media(evaluate):
    got = evaluate(media.exif_time, ["2021:03:04 05:06:07", "2021/3/4 5.6.7.88", "0000:00:00 00:00:00", "2021:00:04 01:02:03", "x"])
    assert got == ["2021-03-04 05.06.07", "2021-3-4 5.6.7", None, None, None]
    utc = evaluate(lambda v: media.local_to_utc(v, "Asia/Tokyo").cast("string"), ["2021:03:04 05:06:07", "2021:13:04 05:06:07"])
    assert utc == ["2021-03-03 20:06:07", None]


def test_decode_text(evaluate):
    samples = {
        b"\xef\xbb\xbfok": "ok",
        "wide é".encode("utf-16"): "wide é",
        b"\xff\xfe\x00\x00" + "quad".encode("utf-32-le"): "quad",
        "no mark but wide".encode("utf-16-be"): "no mark but wide",
        "これはテストです".encode("cp932"): "これはテストです",
        "안녕하세요 여러분".encode("cp949"): "안녕하세요 여러분",
        "d\xe9j\xe0 vu".encode("latin-1"): "déjà vu",
        b"\xff\xfea\x00b": "a",
        b"": "",
    }
    got = evaluate(encoding.decode_text, [bytearray(k) for k in samples], "v binary")
    assert got == list(samples.values())


def test_signatures(evaluate):
    heads = [b"\x89PNG\r\n\x1a\nrest", b"RIFF____WEBPVP8", b"RIFF____AVI ", b"\x1f\x8b\x08", b"PK\x05\x06", b"\x89PN", b""]
    got = evaluate(signatures.magic_kind, [bytearray(h) for h in heads], "v binary")
    assert got == ["png", "webp", None, "gzip", "zip", None, None]
    psd = b"8BPS" + bytes(10) + (800).to_bytes(4, "big") + (4700).to_bytes(4, "big")
    dims = evaluate(signatures.header_dims, [bytearray(psd), bytearray(psd[:20])], "v binary")
    assert [None if d is None else tuple(d) for d in dims] == [(4700, 800), None]
    binary = evaluate(signatures.is_binary, [bytearray(b"a\0\0"), bytearray(b"\0a\0"), bytearray(b"x" * 16384 + b"\0\0")], "v binary")
    assert binary == [True, False, False]


def test_html(evaluate):
    page = (
        "<!doctype html><title>no</title><script>'</p>'</script><h2 id=x>A <i>b</i></h2><!-- <h1>c</h1> -->"
        "<p>x&l<b>t;</b> y<br>z</p><a name=q>none</a><a HREF='/u?a=1&amp;b=2'>t</a><img width=20% src=\"s.png\">"
    )
    assert evaluate(html.html_text, [page]) == ["A b\nx&lt; y\nz\nnonet"]
    shown = lambda f: (lambda v: f(html.drop_invisible(v)))
    assert [tuple(r) for r in evaluate(shown(html.headings), [page])[0]] == [(2, "A b")]
    assert [tuple(r) for r in evaluate(shown(html.links), [page])[0]] == [("/u?a=1&b=2", "t")]
    assert evaluate(shown(html.link_count), [page]) == [1]
    assert [tuple(r) for r in evaluate(shown(html.images), [page])[0]] == [("s.png", "", "20%")]


def test_markdown_blocks(evaluate):
    doc = "---\nno: close\n## Two ##\n* a\n    1) deep\n- [ ] t\n````\n```\nin\n````\n~~~ py\nopen"
    blocks = evaluate(markdown.md_blocks, [doc])[0]
    got = [(b["kind"], b["level"], b["text"], b["lang"], b["task"]) for b in blocks]
    assert got == [
        ("rule", None, "", None, None), ("para", None, "no: close", None, None), ("heading", 2, "Two", None, None),
        ("item", 1, "a", None, None), ("item", 3, "deep", None, None), ("item", 1, "t", None, False),
        ("code", None, "```\nin", "plain", None), ("code", None, "open", "py", None),
    ]
    cells = evaluate(markdown.table_row, [r"| a \| b | c |"])
    assert cells == [["a | b", "c"]]


def test_xmp(evaluate):
    raw = '<x:xmpmeta Iptc4xmpExt:DigitalSourceType="made &amp; born"><mwg-rs:PersonDisplayName>Zoé</mwg-rs:PersonDisplayName></x:xmpmeta>'
    got = evaluate(signatures.xmp_facts, [bytearray(b"\xff" + raw.encode() + b"\xff"), bytearray(b"<x:xmpmeta>")], "v binary")
    assert [[tuple(f) for f in facts] for facts in got] == [[("Digital source type", "made & born"), ("People", "Zoé")], []]


def test_bodies_end_at_their_own_tag_or_never(evaluate):
    from shelfmark.functions.html import html_text

    pages = [
        "a<svg><title>x</title><text>LEAK</text></svg>b", "a<style>p{} <b>LEAK", "a<!-- LEAK <p>", "a<! LEAK",
        "a<script>'</style>'</script>b", "a<SVG>x</svg >b<title>t</title>c",
    ]
    assert evaluate(html_text, pages) == ["ab", "a", "a", "a", "ab", "abc"]


def test_texts_are_decoded_to_the_end(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions.encoding import decode_text
    from shelfmark.functions.paths import DEFAULT_KNOWN

    df = spark.range(1).select(F.encode(F.repeat(F.lit("abcdef"), 1_000_001), "UTF-8").alias("b"))
    assert df.select(F.length(decode_text(F.col("b"))).alias("n")).first()["n"] == 6_000_006
    assert {"kra", "sgi", "pnm", "ai", "eps", "blend32"} <= DEFAULT_KNOWN


def test_markdown_tables_underlines_and_indented_code(evaluate):
    doc = "a | b\n---|:-:\n1 | x \\| y\n2 | z\n\nTitle\n=====\nUnder\n---\n\n    code\n    more\ntext\n    not code\n| no | table |"
    got = [(b["kind"], b["level"], b["text"], b["cells"]) for b in evaluate(markdown.md_blocks, [doc])[0]]
    assert got == [
        ("table", None, "a | b\n---|:-:\n1 | x \\| y\n2 | z", [["a", "b"], ["1", "x | y"], ["2", "z"]]),
        ("heading", 1, "Title", None), ("heading", 2, "Under", None), ("code", None, "code\nmore", None),
        ("para", None, "text", None), ("para", None, "not code", None), ("para", None, "| no | table |", None),
    ]


def test_utf16_with_and_without_surrogates(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions.encoding import decode_text

    texts = ["plain text of some length", "ünï 日本 text", "🙂 smile", "\ud7ff\ue000 edges", ""]
    rows = [(t, bytearray(mark + t.encode(codec))) for t in texts for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))]
    rows += [("odd", bytearray(b"\xff\xfe" + "odd".encode("utf-16-le") + b"x")), ("\ufffdx", bytearray(b"\xff\xfe\x00\xd8x\x00"))]
    got = spark.createDataFrame(rows, "want string, b binary").select("want", decode_text(F.col("b")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_encodings_are_told_a_bounded_number_of_times(spark):
    import codecs

    from shelfmark.functions.encoding import decode_text

    texts = ["plain words", "grüße", "日本語🙂 text", "xy" * 40]
    kinds = {"utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE, "utf-8": codecs.BOM_UTF8}
    rows = [(t, bytearray(mark + t.encode(c))) for t in texts for c, mark in kinds.items()] + [(None, None)]
    df = spark.createDataFrame(rows, "t string, c binary").select("t", decode_text(F.col("c")).alias("d"))
    assert all(r.t == r.d for r in df.collect())
    # Each time it tests for units of 4 KB in both orders.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?!00)..00") <= 80
