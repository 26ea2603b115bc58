"""Operators on whole texts, one row at a time: licenses, token counts, media, PII, BPE."""

import datetime
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex

from tesselon.llm import bpe, jpeg, licenses, media, pii
from tesselon.llm.pretokens import GENERAL, pretokens
from tesselon.llm.queries import tokenizer_path

from .conftest import EDGES

LIBRARY = pytest.importorskip("tokenizers")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- licenses ----------------------------------------------------------------------------------------------
LICENSE_ROWS = EDGES + [
    (20, "Licensed under the Apache License, Version 2.0. Released under the MIT-License! apache license apache LICENSE"),
    (21, "mit mit license license gnu general public license version 3 gnu general public"),
    (22, "cc by cc-by-nc 4.0 CC BY SA 4 0"),
    (23, "license apache"),
    (24, "apachelicense éapache license apache licenseé"),
    (25, "gnu " * 3000 + "general public license " * 2000),
]


def test_licenses_match_a_join_without_the_index(spark, make):
    got = sorted(map(tuple, licenses.digest(make(LICENSE_ROWS)).collect()), key=repr)
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", LICENSE_ROWS)
    assert got == sorted(db.execute(licenses.oracle()).fetchall(), key=repr)


def test_licenses_of_nothing(none):
    assert licenses.digest(none).collect() == []


# --- pretokens and BPE -------------------------------------------------------------------------------------
TEXTS = [
    "", "a" * 50, "x<|endoftext|>y  <|endoftext|>", "日本語 テスト 　x ²³ 1½ é \x1c\x1d a\x85b", "don't I'll we'Ve\n\n  x\t\ty",
    "aaaaaaaa bbb   \r\n\n 12345 __init__ ___ a_b", "ªº²³¹¼½¾ × ÷ ſ ẞ", " leading", "trailing ", " nbsp  x", "😀😀 👍🏽",
]


def test_latin_and_general_patterns_agree():
    for t in TEXTS + ["naïve façade über-alles 3rd, (x)! it's", "a\n \n b"]:
        assert pretokens(t) == GENERAL.findall(t)


def test_encoding_matches_the_library(spark, make):
    tokenizer = LIBRARY.Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (99, None), (99, None)]
    got = sorted(map(tuple, bpe.encode_decode(make(rows), tokenizer_path()).collect()), key=repr)
    expected = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(back.encode())))
    assert got == sorted(expected, key=repr)


def test_encoding_keeps_ids_and_text(make):
    row = bpe.encode_decode(make([(1, "hello world")]), tokenizer_path(), keep=True).first()
    assert row.decoded == "hello world" and len(row.ids) == row.n_tokens


def test_counts_match_the_library(spark, edges):
    tokenizer = LIBRARY.Tokenizer.from_file(tokenizer_path())
    got = sorted(map(tuple, bpe.token_counts(edges, tokenizer_path()).collect()), key=repr)
    expected = []
    for i, t in EDGES:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(expected, key=repr)


def test_counts_of_special_strings_match_the_library(make):
    tokenizer = LIBRARY.Tokenizer.from_file(tokenizer_path())
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    texts = [f"a{s}b {s}{s} {s[:-1]} {s} " for s in special] + ["".join(special) * 3, special[0] if special else "", " ".join(special)]
    got = {r.doc_id: r.n_tokens for r in bpe.token_counts(make(list(enumerate(texts))), tokenizer_path()).collect()}
    assert special and got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_whole_tokens_are_single(spark):
    tokenizer = LIBRARY.Tokenizer.from_file(tokenizer_path())
    v = bpe.Vocabulary(tokenizer_path())
    for s in random.Random(3).sample(sorted(bpe.whole_tokens(v)), 300):
        assert len(tokenizer.model.tokenize("".join(bpe.byte_letters()[b] for b in s.encode()))) == 1


def test_bpe_of_nothing(none):
    assert bpe.encode_decode(none, tokenizer_path()).collect() == []
    assert bpe.token_counts(none, tokenizer_path()).collect() == []


# --- media -------------------------------------------------------------------------------------------------
def test_media_round_trip(edges):
    rows = media.columns(edges, keep=True).collect()
    assert len(rows) == len(EDGES)
    texts = sorted((t or "") for _, t in EDGES)
    assert sorted(r.payload_sha256 for r in rows) == sorted(sha(media.payload_of(t.encode())) for t in texts)
    for r in rows:
        back = jpeg.stored(jpeg.read(bytes(r.media)))
        assert sha(back) == r.payload_sha256 and zlib.crc32(back[-16:]) == r.tail_crc32 and len(back) == r.payload_bytes
        assert len(r.rgb) == r.height * r.width * 3 and sha(bytes(r.media)) == r.media_sha256
    same = {(r.payload_sha256, r.feature, r.media_sha256) for r in rows}
    assert len({x[0] for x in same}) == len(same)


def test_media_of_nothing(none):
    assert media.columns(none).collect() == []


@pytest.mark.parametrize("n", [1, 63, 378, 379, 5000])
def test_fast_and_general_scans_agree(n, monkeypatch):
    data = os.urandom(n)
    raw = jpeg.write(data)
    fast = jpeg.read(raw)
    monkeypatch.setattr(jpeg, "_constant_first", lambda *a: None)
    slow = jpeg.read(raw)
    assert jpeg.stored(fast) == data == jpeg.stored(slow)
    for a, b in zip(fast.components, slow.components):
        assert (a.coefficients == b.coefficients).all()


def test_inverse_transform_is_the_cosine_sum():
    rng = np.random.default_rng(1)
    c = jpeg.Component(1, 1, 1, 0, 1, 1, 1, 1, rng.integers(-200, 200, (1, 64)).astype(np.int32))
    got = jpeg.samples(c, np.ones(64, np.int64))
    f = c.coefficients.reshape(8, 8)
    k = np.array([np.sqrt(0.125)] + [0.5] * 7)
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * np.arange(8) * np.pi / 16) * k
    plain = basis @ f @ basis.T + 128
    assert np.abs(got - np.clip(plain, 0, 255)).max() <= 1


def test_large_payloads_keep_within_the_header():
    for n in (0, 1, 378 * 64, 99_100_000, 400_000_000, 2_000_000_000):
        across, down = jpeg.geometry(n)
        assert across * down * jpeg.MCU_BYTES >= n and max(across, down) * 16 <= 65535


def foreign_file(seed: int):
    """A progressive 4:4:4 file of 20 x 11 pixels as another writer would make it, and its coefficients."""
    rng = np.random.default_rng(seed)
    blocks = 3 * 2  # 24 x 16 pixels
    planes = [rng.integers(-60, 61, (blocks, 64)) * (rng.random((blocks, 64)) < 0.3) for _ in range(3)]
    planes[1][2] = planes[2][0] = 0

    def size(v):
        return int(abs(v)).bit_length()

    def bits(v):
        n = size(v)
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    symbols = [0x00, 0xF0, *(16 * r + k for r in range(16) for k in range(1, 8))]
    dc = {k: format(k, "04b") for k in range(9)}
    ac = {x: format(k, "08b") for k, x in enumerate(symbols)}

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def scan(components, ss, se, code):
        code += "1" * (-len(code) % 8)
        raw = bytes(int(code[i : i + 8], 2) for i in range(0, len(code), 8)).replace(b"\xff", b"\xff\x00")
        head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, 0])
        return segment(0xDA, head) + raw

    out = b"\xff\xd8" + segment(0xDB, bytes([0] + [2] * 64))
    out += segment(0xC2, bytes([8, 0, 11, 0, 20, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += segment(0xC4, bytes([0x00, 0, 0, 0, 9, *[0] * 12, *dc])) + segment(0xC4, bytes([0x10, *[0] * 7, len(ac), *[0] * 8, *ac]))
    code, last = "", [0, 0, 0]
    for b in range(blocks):
        for k in range(3):
            d = int(planes[k][b, 0]) - last[k]
            last[k] = int(planes[k][b, 0])
            code += dc[size(d)] + bits(d)
    out += scan([1, 2, 3], 0, 0, code)
    for k in range(3):
        for ss, se in ((1, 5), (6, 63)):
            code = ""
            for b in range(blocks):
                run = 0
                for i in range(ss, se + 1):
                    v = int(planes[k][b, jpeg.ZIGZAG[i]])
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        code, run = code + ac[0xF0], run - 16
                    code, run = code + ac[16 * run + size(v)] + bits(v), 0
                code += ac[0x00] if run else ""
            out += scan([k + 1], ss, se, code)
    return out + b"\xff\xd9", planes


@pytest.mark.parametrize("seed", range(4))
def test_files_of_another_writer_are_read(seed):
    raw, planes = foreign_file(seed)
    image = jpeg.read(raw)
    assert (image.width, image.height) == (20, 11)
    for c, p in zip(image.components, planes):
        assert (c.coefficients == p).all()
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x * np.pi / 16) * np.array([np.sqrt(0.125)] + [0.5] * 7)
    y, cb, cr = (np.clip(np.block([[basis @ (2.0 * p[3 * i + j].reshape(8, 8)) @ basis.T + 128 for j in range(3)] for i in range(2)]), 0, 255)[:11, :20] for p in planes)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    assert np.abs(jpeg.rgb(image).astype(float) - np.clip(rgb, 0, 255)).max() <= 4


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        jpeg.read(b"GIF89a")


# --- PII ---------------------------------------------------------------------------------------------------
def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


PRIVATE = {
    "card": ["4425414259157784", "4242 4242 4242 4242", "6011-0009-9013-9424"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ip": ["39.197.112.39", "255.255.255.255", "0.0.0.0"],
    "date": ["2020-02-29", "31/12/1999", "1999.01.31"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"],
    "phone": ["+1 (873) 555-4781", "873-555-4781", "+49 30 1234567"],
    "email": ["dikcoc.41@mail7.example.com"],
}
PLAIN = ["4425414259157785", "300.1.1.1", "2021-02-29", "666-12-1234", "000-12-1234", "GB82 WEST 1234 5698 7654 33", "version 2.0.", "1234", "a@b", "12345678901234567890123", "x1.2.3.4y"]


def test_values_become_valid_values_of_their_form(make):
    rows = [(i, f"before {v}, after") for i, v in enumerate(x for own in PRIVATE.values() for x in own)]
    kinds = [k for k, own in PRIVATE.items() for _ in own]
    got = {r.doc_id: r for r in pii.digest(make(rows)).collect()}
    for (i, text), kind in zip(rows, kinds):
        r, old = got[i], text[7:-7]
        new = r.text[7:-7]
        assert (r.kinds, r.n_found) == (kind, 1) and new != old
        if kind != "email" and kind != "ip":
            assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", old)
        if kind == "card":
            assert luhn(new)
        if kind == "iban":
            assert iban_ok(new)
    assert got[0].text == f"before {got[0].text[7:-7]}, after"


def test_invalid_values_stay(make):
    rows = [(i, v) for i, v in enumerate(PLAIN)]
    assert {r.doc_id: (r.text, r.n_found) for r in pii.digest(make(rows)).collect()} == {i: (v, 0) for i, v in rows}


def test_equal_values_stay_linked_and_other_keys_differ(make):
    d = make([(1, "4425414259157784 x 4425414259157784"), (2, "y 4425414259157784")])
    a = {r.doc_id: r.text for r in pii.pseudonymize(d).collect()}
    one = a[2].split()[1]
    assert a[1] == f"{one} x {one}"
    assert pii.pseudonymize(d, "other").where("doc_id = 2").first().text != a[2]


def plain_feistel(x, a, b, tweak, key):
    l, r = divmod(x, b)
    for k in range(1, pii.ROUNDS + 1):
        h = int(hashlib.sha256(f"{key}:{tweak}:{k}:{r if k % 2 else l}".encode()).hexdigest()[:15], 16)
        l, r = ((l + h) % a, r) if k % 2 else (l, (r + h) % b)
    return l * b + r


def plain_digits(d, tweak, key):
    half = len(d) // 2
    return str(plain_feistel(int(d), 10**half, 10 ** (len(d) - half), tweak, key)).zfill(len(d)) if d else ""


def refill(old, new, of=str.isdigit):
    it = iter(new)
    return "".join(next(it) if of(c) else c for c in old)


def plain_value(kind, m, key):
    """The pseudonym of one match in plain Python, or None."""
    d = "".join(c for c in m if c in "0123456789")
    if kind == "email":
        return "u" + hashlib.sha256((key + ":email:" + m.lower()).encode()).hexdigest()[:14] + "@" + m.rsplit("@", 1)[1]
    if kind == "card":
        if not luhn(m):
            return None
        body = plain_digits(d[:-1], "card", key)
        return refill(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "iban":
        s = m.replace(" ", "")
        own = "".join(c for c in s[4:] if c.isdigit())
        if not own or not iban_ok(m):
            return None
        new = refill(s[4:], plain_digits(own[:15], "iban", key) + plain_digits(own[15:], "iban", key))
        return refill(m, s[:2] + next(f"{k:02d}" for k in range(2, 99) if iban_ok(f"{s[:2]}{k:02d}{new}")) + new, lambda c: c != " ")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        p = plain_feistel(int.from_bytes(bytes(o), "big"), 65536, 65536, "ip", key)
        return ".".join(map(str, p.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        areas = [x for x in range(1, 900) if x != 666]
        p = plain_feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn", key)
        return f"{areas[p // 9999 // 99]:03d}-{p // 9999 % 99 + 1:02d}-{p % 9999 + 1:04d}"
    if kind == "phone":
        american = (len(d) == 10 or len(d) == 11 and d[0] == "1") and d[-10] in "23456789" and d[-7] in "23456789"
        if american:
            t = d[-10:]
            p = plain_feistel(((int(t[:3]) - 200) * 800 + int(t[3:6]) - 200) * 10000 + int(t[6:]), 80000, 80000, "phone", key)
            return refill(m, d[:-10] + f"{p // 10000 // 800 + 200}{p // 10000 % 800 + 200}{p % 10000:04d}")
        return refill(m, d[:3] + plain_digits(d[3:], "phone", key)) if m[0] == "+" and len(d) >= 8 else None
    a, b, c = re.split("[-/.]", m)
    mark = re.search("[-/.]", m)[0]
    year, other = (a, c) if len(a) == 4 else (c, a)
    y, p, q = int(year), int(other), int(b)

    def made(month, day):
        try:
            return datetime.date(y % 400 + 400, month, day)
        except ValueError:
            return None

    usual = made(q, p) is not None
    day = made(q, p) or made(p, q)
    if day is None or y < 1:
        return None
    new = datetime.date(400, 1, 1) + datetime.timedelta(plain_feistel((day - datetime.date(400, 1, 1)).days, 189, 773, "date", key))
    outer, middle = (new.day, new.month) if usual else (new.month, new.day)
    four = f"{new.year - 400 + y - y % 400:04d}"
    return f"{four}{mark}{middle:02d}{mark}{outer:02d}" if len(a) == 4 else f"{outer:02d}{mark}{middle:02d}{mark}{four}"


def plain_pseudonyms(text, key):
    found = []
    whole = regex.compile("|".join(f"(?P<k{i}>(?:{f}))" if kind != "date" else f"(?P<k{i}>{DATE})" for i, (kind, f) in enumerate(pii.FORMS.items())), regex.V0)

    def one(m):
        kind = pii.KINDS[int(m.lastgroup[1:])]
        new = plain_value(kind, m[0], key)
        if new is not None:
            found.append(kind)
        return m[0] if new is None else new

    return whole.sub(one, text), len(found), ",".join(sorted(set(found)))


#: The date form with its back references named, as its groups have other numbers inside a larger pattern.
DATE = pii.FORMS["date"].replace("(?:\\d{4}([-/.])", "(?:\\d{4}(?P<s>[-/.])").replace("\\1", "(?P=s)").replace("\\d{1,2}([-/.])", "\\d{1,2}(?P<t>[-/.])").replace("\\2", "(?P=t)")


def private_texts(n=150, seed=8):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    every = [x for own in PRIVATE.values() for x in own] + PLAIN

    def value():
        k = r.randrange(9)
        if k == 0:
            return f"{r.randint(1, 9999):04d}-{r.randint(0, 13)}-{r.randint(0, 32)}"
        if k == 1:
            return f"{r.randint(0, 32)}.{r.randint(0, 13)}.{r.randint(1, 2400):04d}"
        if k == 2:
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        if k == 3:
            body = digits(r.randint(12, 18))
            return body + next(c for c in "0123456789" if luhn(body + c))
        if k == 4:
            return ".".join(str(r.randint(0, 270)) for _ in range(4))
        if k == 5:
            return f"+{r.randint(1, 99)} {digits(3)} {digits(r.randint(2, 4))}-{digits(r.randint(2, 4))}"
        if k == 6:
            return f"{r.choice('abxy')}.{digits(2)}@{r.choice(['a', 'B-c'])}.example.org"
        return r.choice(every)

    return [r.choice(" ,;\n").join(r.choice([value(), "ünd", "word", ""]) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_pseudonyms_equal_those_of_plain_python(make):
    texts = private_texts()
    got = {r.doc_id: (r.text, r.n_found, r.kinds) for r in pii.digest(make(list(enumerate(texts))), "a key").collect()}
    assert got == {i: plain_pseudonyms(t, "a key") for i, t in enumerate(texts)}
    assert {k for _, _, own in got.values() for k in own.split(",")} >= set(pii.KINDS)


def test_very_long_values_do_not_end_the_task(make):
    """Patterns must not recurse with the length of a value."""
    parts = {"label": "x a@b" + ".c" * 50_000, "phone": "+1" + " 23" * 50_000, "iban": "GB82" + " WEST" * 50_000, "card": "1 " * 50_000, "dots": "1." * 50_000, "local": "a" * 200_000 + "@b"}
    got = {r.doc_id: r for r in pii.digest(make(list(enumerate(parts.values()))), "k").collect()}
    assert got[0].n_found == 1 and got[0].text.endswith(".c")
    assert all(len(got[i].text) >= len(t) - 100 for i, t in enumerate(parts.values()))


def test_a_key_is_made_for_the_session(spark, make):
    d = make([(1, "4425414259157784")])
    old = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.unset(pii.KEY_SETTING)
        one = pii.digest(d).first().text
        made = spark.conf.get(pii.KEY_SETTING)
        assert len(made) == 64 and pii.digest(d).first().text == one == pii.digest(d, made).first().text
    finally:
        spark.conf.set(pii.KEY_SETTING, old) if old else spark.conf.unset(pii.KEY_SETTING)


@pytest.mark.parametrize("a,b", [(7, 11), (10, 10), (3, 1)])
def test_feistel_is_a_permutation(spark, a, b):
    from pyspark.sql import functions as F

    d = spark.range(a * b).select(pii.feistel(F.col("id"), pii._long(a), pii._long(b), "t", "k").alias("x"))
    assert sorted(r.x for r in d.collect()) == list(range(a * b))


def test_pii_edges(edges, none):
    got = pii.pseudonymize(edges)
    assert got.columns[0] == "doc_id" and got.count() == len(EDGES)
    assert {r.text for r in got.where("doc_id = 1").collect()} == {None}
    assert pii.digest(none).collect() == []


def test_native_plans_have_no_python(spark, edges):
    for df in (licenses.digest(edges), pii.digest(edges)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
