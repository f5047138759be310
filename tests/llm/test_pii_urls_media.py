import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import media, pii, tiff, url_rules

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base(text)).encode()).hexdigest()


TEXTS = [
    "a@b.cd-e_f@x.y", "x@y.z@w.v a.b@c.d..e@f.g", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "4111 1111-1111 1111 and 4111111111111112", "+1 (338) 555-7198) +12 ((((", "é@a.b ü1.2.3.4é 😀 mail me@x.org",
    None, "", "john [at] mail [dot] com", "a" * 100_000, "1" * 40_000, "1 " * 40_000, "+1" * 10_000, "a@b.c " * 2_000, "@@@@", "....", "+", "1.1.1.1@a.b",
]


def test_base_spans_against_plain_patterns(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("ab1. 23@+-()4é"), rng.integers(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.span_digests(df).collect()}
    for i, t in enumerate(texts):
        own, r = base(t), got[i]
        assert r.base_sha256 == digest(t), (i, t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in own) for k in PLAIN]
        assert {f"{k}:{a}:{b}" for a, _, b, k in own} <= set(r.spans.split(","))


def test_redaction(spark):
    rows = [(1, "Mail a.b@c.de or call +49 30 1234567890, from 10.0.0.1.", "x", 7), (2, "clean text 12", "y", 13), (3, None, "z", None), (4, "😀 4111 1111 1111 1111 ü", "w", 1)]
    df = spark.createDataFrame([(*r, "u", 5) for r in rows], "doc_id long, text string, base string, n_chars long, loose string, row int")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "Mail [EMAIL] or call [PHONE], from [IP]." and got[1].n_chars == len(got[1].text) and got[1].base == "x"
    assert got[2].text == "clean text 12" and got[2].n_chars == 13
    assert got[3].text is None and got[3].n_chars is None and got[4].text == "😀 [CARD] ü"
    assert pii.redact(df).columns == df.columns and pii.span_digests(df.limit(0)).count() == 0


def test_method_adds_what_the_base_format_loses(spark):
    rows = [(i, f"n +1 (20{i % 10}) 555-01{i % 90 + 10} now") for i in range(90)] + [(100 + i, f"x +1 (308) 555-33{i + 10} 4078918989542222 y") for i in range(5)] + [(200 + i, f'key "a{10**13 + i * 7}b"') for i in range(5)]
    got = {r.doc_id: r for r in pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].n_phone == 0 and "phone:2:19" in got[100 + i].spans.split(",") for i in range(5))
    assert all(got[200 + i].spans == "" for i in range(5))


def test_estimate_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    cells = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda p: (1 if true else -1) if rng.random() < p else (-1 if true else 1)  # noqa: E731, B023
        c = (0, vote(0.95), vote(0.9), vote(0.6))
        cells[c] = cells.get(c, 0) + 1
    post = pii.estimate({k: float(v) for k, v in cells.items()})
    assert post[0, 1, 1, 1] > 0.95 and post[0, -1, -1, -1] < 0.05 and post[0, 1, 1, -1] > 0.8


def test_classifier_follows_posteriors():
    cells = {(3, 1, 1, 1, 11, 1): 50.0, (3, 0, 1, 1, 10, 1): 40.0, (3, 0, -1, -1, 10, 1): 60.0}
    p = pii.fit_classifier(cells, {(3, 1, 1, 1): 0.99, (3, 0, 1, 1): 0.97, (3, 0, -1, -1): 0.01})
    assert p[3, 1, 1, 1, 11, 1] > 0.8 and p[3, 0, -1, -1, 10, 1] < 0.2
    assert pii.fit_classifier({}, {}) == {}


def plain_rule(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), verdict)
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return host, path, best and best[1], best[2] if best else default


URLS = [
    "http://example.org/es/x", "https://Blog.EXAMPLE.org/en/17?q=/es/", "http://example.org", "http://xexample.org/es/1", "http://a.b.example.org/en/2#x", "http://org/", "http://.org/x", "http://org./x",
    "http://foo.com/fr/", "http://foo.com/de/x?y#z", "http://com/fr/", None, "", "no scheme", "http://", "http:///es/", "ftp://é.example.org/es/ü", "http://example.org/es/://x/y", "http://com-x.org/a", "http://u:p@example.org:80/es/",
]


@pytest.mark.parametrize("rules", [url_rules.RULES, [], [("block", "org", "/"), ("allow", "example.org", "/"), ("block", "b.example.org", "/en/"), ("allow", "example.org", "/e"), ("block", "com", "")]])
def test_url_rules(spark, rules):
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(df, rules, splits=3).collect()}
    assert got == {i: plain_rule(u, rules) for i, u in enumerate(URLS * 2)}
    assert url_rules.apply_rules(df.limit(0), rules).count() == 0


def test_url_rules_are_native(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_rules.apply_rules(df, url_rules.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.sampled_from([1, 2]), st.sampled_from([None, (16, 16), (32, 48)]), st.sampled_from("<>"), st.integers(1, 40))
def test_tiff_round_trip(raw, compression, predictor, tile, order, wide):
    data = np.frombuffer(raw + b"\0", dtype=np.uint8)
    image = np.resize(data, (-(-len(data) // wide), wide))
    file = tiff.write([image, image[::-1]], compression, predictor, 5, tile, order)
    found = list(tiff.pages(file))
    assert len(found) == 2 and (found[0].data[:, :, 0] == image).all() and (found[1].data[:, :, 0] == image[::-1]).all()


def test_lzw_widths():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), bytes(20_000), (rng.integers(0, 3, 50_000, dtype=np.uint8)).tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_tiff_pages_rows_and_errors(spark):
    rgb = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    good = tiff.write([rgb, rgb[:, :, 0]], tiff.LZW)
    df = spark.createDataFrame([(1, bytearray(good), "p"), (2, bytearray(b"junk"), "p"), (3, None, "p"), (4, bytearray(good[:40]), "p"), (5, bytearray(b""), "p")], "id long, media binary, page string")
    got = media.tiff_pages(df, "media", ["id"]).orderBy("id", "page").collect()
    assert [(r.id, r.page, r.width, r.height, r.samples) for r in got if r.error is None] == [(1, 0, 5, 4, 3), (1, 1, 5, 4, 1)]
    assert bytes(got[0].pixels) == rgb.tobytes() and {r.id for r in got if r.error} == {2, 4, 5}


def test_text_digests(spark, odd_texts):
    texts = [*odd_texts, "b" * 575, "b" * 576, "b" * 577, "c" * (576 * 600)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pages int")
    got = {r.doc_id: r for r in media.text_digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert got[4][1:] == got[5][1:] and got[0][1:] == got[1][1:] and got[len(texts) - 1].pages > 1
    stored = media.text_media(df, ["doc_id"]).where("doc_id = 6").first()
    assert hashlib.sha256(stored.media).hexdigest() == got[6].media_sha256 and len(stored.media) == got[6].media_bytes
    assert media.text_digests(df.limit(0)).count() == 0


def test_running_and_apart_against_plain_loops(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gradeloom.functions import arrays

    monkeypatch.setattr(arrays, "RUN", 4)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        base_ = sorted({int(x) for x in rng.integers(0, 900, rng.integers(0, 90))})
        spans = [(a, a + int(rng.integers(1, 9))) for a in base_]
        loose = [(int(a), int(a + rng.integers(1, 12))) for a in rng.integers(0, 900, rng.integers(0, 30))]
        rows.append((i, [int(x) for x in rng.integers(0, 50, rng.integers(0, 200))], spans, loose))
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, n array<int>, b {span}, l {span}")
    got = df.select("i", arrays.running(F.col("n"), lambda a, b: a + b).alias("s"), arrays.running(F.col("n"), F.greatest).alias("m"), pii.apart(F.col("l"), F.col("b")).alias("free")).collect()
    for r in got:
        _, n, spans, loose = rows[r.i]
        assert r.s == [sum(n[:k]) for k in range(len(n))] and r.m == [max([0, *n[:k]]) for k in range(len(n))]
        assert [tuple(x) for x in r.free] == [(a, b) for a, b in loose if not any(c < b and a < d for c, d in spans)]


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    text = " ".join(f"ü{i} u{i}@mail{i % 7}.org, +1 (20{i % 10}) 555-01{i % 90 + 10}; 10.0.{i % 300}.1" for i in range(17_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = pii.span_digests(df).first()
    assert got.n_email + got.n_phone + got.n_ip > 45_000 and got.base_sha256 == digest(text)
    clean = pii.redact(df).first().text
    assert time.time() - start < 120  # a quadratic form takes hours
    out, at = [], 0
    for a, _, b, kind in base(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    assert clean == "".join(out) + text[at:]


def test_precision_and_recall_of_added_spans(spark):
    """Labelled texts: numbers that the base format drops, beside chains of digits that are no numbers of persons."""
    rng = np.random.default_rng(11)
    rows, true = [], set()
    for i in range(900):
        kind = i % 9
        number = f"+1 ({rng.integers(201, 990)}) 555-{rng.integers(1000, 9999)}"
        text = f"call {number} please"
        if kind == 0:  # the base format runs on into the digits that follow
            text = f"call {number} {rng.integers(10**15, 10**16)} x"
            true.add((i, f"phone:5:{5 + len(number)}"))
        elif kind == 1:
            text = f"order {rng.integers(10**13, 10**14)} was sent"
        elif kind == 2:
            text = f"serial {rng.integers(100, 999)}.{rng.integers(100, 999)}.{rng.integers(1000, 9999)} of the part"
        elif kind == 3:
            text = f'key "a{rng.integers(10**15, 10**16)}b" end'
        rows.append((i, text))
    spans = {(r.doc_id, s) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).selectExpr("doc_id", "spans", "base").collect() for s in {f"{pii.KINDS[x['rank']]}:{x['start']}:{x['end']}" for x in r.spans if x not in r.base}}
    hit = len(spans & true)
    assert hit / max(1, len(spans)) >= 0.95 and hit / len(true) >= 0.95, (hit, len(spans), len(true))


def test_url_rules_from_a_table_and_columns_of_any_name(spark):
    rules = [("block", "org", "/"), ("allow", "example.org", "/"), ("block", "b.example.org", "/en/"), ("allow", "example.org", "/e"), ("block", "com", ""), ("block", "foo.com", "/fr")]
    table = spark.createDataFrame([*rules, rules[0], ("block", None, "/")], "verdict string, host string, path string")
    df = spark.createDataFrame([(i, u, {"a b": i}) for i, u in enumerate(URLS)], "page_id long, url string, `my.col x` struct<`a b`:int>")
    out = url_rules.apply_rules(df, table, splits=3)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: plain_rule(u, rules) for i, u in enumerate(URLS)}
    assert out.columns[:3] == df.columns and url_rules.apply_rules(df, table.limit(0), splits=2).count() == len(URLS)


def test_fixed_bytes_of_the_format():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the example of the PackBits description
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example of TIFF 6.0, section 13
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


def test_sides_that_no_data_can_fill_are_an_error():
    import struct

    file = bytearray(tiff.write([np.zeros((4, 5), dtype=np.uint8)], tiff.DEFLATE))
    for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS_PER_STRIP):
        at = file.find(struct.pack("<HHI", tag, 4, 1)) if tag != tiff.ROWS_PER_STRIP else file.find(struct.pack("<H", tag))
        struct.pack_into("<I", file, at + 8, 2_000_000)
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(bytes(file)))


def test_every_stored_form_is_read_back(spark):
    texts = [f"text number {i} " * (1 + i % 90) for i in range(160)]
    stored = media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"])
    pages_ = media.tiff_pages(stored, "media", ["doc_id", "n_bytes"]).collect()
    assert {(p.compression, p.tiled) for p in pages_} >= {(tiff.LZW, False), (tiff.PACKBITS, True), (tiff.NONE, True), (tiff.DEFLATE, False), (tiff.DEFLATE, True)}
    whole = {}
    for p in sorted(pages_, key=lambda p: (p.doc_id, p.page)):
        whole[p.doc_id] = whole.get(p.doc_id, b"") + bytes(p.pixels)
    assert {i: b[: len(texts[i].encode())].decode() for i, b in whole.items()} == dict(enumerate(texts))


def test_strips_that_share_bytes_are_bounded_by_the_file(spark):
    raw = bytearray(tiff.write([np.zeros((4000, 1000), dtype=np.uint8)], tiff.DEFLATE, 1, 4))
    (at,) = struct.unpack_from("<I", raw, 4)
    fields, _ = tiff._fields(bytes(raw), at, "<")
    entry = {t: at + 2 + 12 * k for k in range(20) for t in [int.from_bytes(raw[at + 2 + 12 * k : at + 4 + 12 * k], "little")]}
    (place,) = struct.unpack_from("<I", raw, entry[tiff.STRIP_OFFSETS] + 8)
    for k in range(1000):  # every strip names the first one's bytes
        struct.pack_into("<I", raw, place + 4 * k, fields[tiff.STRIP_OFFSETS][0])
    with pytest.raises(tiff.TiffError, match="larger than its data"):
        list(tiff.pages(bytes(raw)))
    got = media.tiff_pages(spark.createDataFrame([(1, bytes(raw))], "id long, media binary"), "media", ["id"]).collect()
    assert [(r.page, r.pixels) for r in got] == [(0, None)] and "larger" in got[0].error
