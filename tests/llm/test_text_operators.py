import base64
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination as D
from tessella.llm import fingerprints as P
from tessella.llm import pii, secrets
from tessella.llm import sentence_pieces as S
from tessella.llm import token_store as T
from tessella.llm.chat_format import rendered
from tessella.llm.license_scan import scan_licenses

DOCS = "doc_id long, text string, id string, spans string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


# --- op3 -----------------------------------------------------------------------------------------------
def b64(raw):
    return base64.b64encode(raw).decode()


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA_OID, CURVE_OID = der(6, bytes.fromhex("2a864886f70d010101")), der(6, bytes.fromhex("2a8648ce3d030107"))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, RSA_OID, b"\5\0"), der(4, bytes(200)))
PKCS1 = der(0x30, der(2, b"\0"), *(der(2, bytes([1] * 40)) for _ in range(8)))
SEC1 = der(0x30, der(2, b"\1"), der(4, bytes(32)), der(0xA0, CURVE_OID))
ENCRYPTED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, b"\5\0")), der(4, bytes(64)))
PUBLIC = der(0x30, der(0x30, RSA_OID, b"\5\0"), der(3, bytes(100)))
CERTIFICATE = der(0x30, der(0x30, der(2, b"\1"), PUBLIC), der(0x30, RSA_OID), der(3, bytes(64)))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (SSH, bytes(64)))
PGP = bytes([0x95, 0, 40, 4]) + bytes(39)
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', bytes(32)))


def secret_kinds(text):
    return [(k, text[a:b]) for a, b, k in secrets.find_secrets(text)]


def test_secret_base_patterns():
    assert secret_kinds('é Password : "abcdefgh"') == [("assign", 'Password : "abcdefgh')]
    assert secret_kinds("token=short") == [] and secret_kinds("api_key=12345678")[0][0] == "assign"
    assert secret_kinds("to\u212aen=12345678") == []  # the Kelvin sign is no k
    assert secret_kinds("AKIA" + "A" * 11) == [] and secret_kinds("AKIA" + "A" * 12)[0][0] == "access"
    assert secret_kinds("a" * 31) == [] and secret_kinds("x" + "a1" * 16) == [("hex", "a1" * 16)]


def test_secret_structures():
    for key in (PKCS8, PKCS1, SEC1, ENCRYPTED, OPENSSH):
        assert secrets.is_key(key) and not secrets.is_key(key[:-1]) and not secrets.is_key(key + b"\0" if key is not OPENSSH else key[:40])
        assert ("encoded_key", b64(key)) in secret_kinds(f"x {b64(key)} y")
    for other in (PUBLIC, CERTIFICATE, SSH, b"\x30" + PKCS8[1:3] + bytes(len(PKCS8) - 3), bytes(range(60))):
        assert not secrets.is_key(other) and secret_kinds(f"x {b64(other)} y") == []
    assert "hex_key" in [k for k, _ in secret_kinds(PKCS8.hex())]
    safe = base64.urlsafe_b64encode(PKCS1.replace(b"\1\1\1\1", b"\xff\xef\xbe\xfb")).decode().rstrip("=")
    assert "_" in safe and ("encoded_key", safe) in secret_kinds(f"x {safe}; y")
    assert [k for k, _ in secret_kinds(f"bearer {JWT}")] == ["jwt"]
    assert secret_kinds(JWT.replace("eyJ", "eyK", 1)) == []


@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_and_armoured_keys(width):
    lines = "\n".join(re.findall(f".{{1,{width}}}", b64(PKCS1)))
    assert ("encoded_key", lines) in secret_kinds(f"key:\n{lines}\nend")
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert [x for x in secret_kinds(f"see {pem} there")] == [("private_key", pem)]
    escaped = pem.replace("\n", "\\n")
    assert ("private_key", escaped) in secret_kinds(json.dumps({"private_key": pem}))
    assert secret_kinds(pem.replace("RSA PRIVATE", "PUBLIC").replace(b64(PKCS1)[:8], "AAAAAAAA")) == []
    assert "private_key" not in [k for k, _ in secret_kinds(pem.replace(lines, "AAAA"))]
    assert "private_key" not in [k for k, _ in secret_kinds(pem.replace("END RSA", "END EC"))]
    block = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x 1.0\n\n{b64(PGP)}\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----"
    assert ("private_key", block) in secret_kinds(f"a {block} b")
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    locked = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{b64(bytes(range(64)))}\n-----END RSA PRIVATE KEY-----"
    assert ("private_key", locked) in secret_kinds(locked) and secret_kinds(locked.replace(b64(bytes(range(64))), b64(bytes(range(63))))) == []


def test_secrets_take_linear_time():
    def seconds(text):
        began = time.perf_counter()
        secrets.find_secrets(text)
        return time.perf_counter() - began

    for unit in ("-----BEGIN RSA PRIVATE KEY-----\n", "A" * 64 + "\n", "eyJ", "password", "-----END RSA PRIVATE KEY-----", "ab12_-"):
        short = min(seconds(unit * (40_000 // len(unit))) for _ in range(3))
        assert seconds(unit * (400_000 // len(unit))) < 40 * max(short, 0.005), unit


def test_secret_scan_rows(spark):
    got = secrets.scan_secrets(docs(spark, [None, "", "secret=abcdefghij", "a" * 200_000, "secret=abcdefghij"])).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in got] == [0, 0, 1, 1, 1]
    assert secrets.scan_secrets(docs(spark, []).limit(0)).count() == 0


# --- op9 -----------------------------------------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def base_pii(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_pii_against_the_plain_patterns():
    r = random.Random(4)
    parts = ["a@b.co", "@", "a", ".", "x_y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "12", " ", "-", "é", "@b.c", "9"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        assert [x[:3] for x in pii.find_pii(text) if x[0] in pii.KINDS[:4]] == base_pii(text), text


def test_pii_checksums_context_and_redaction():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert [x[0] for x in pii.find_pii("IBAN DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert [x[0] for x in pii.find_pii("ssn 123-45-6789")] == ["ssn"] and pii.find_pii("part 123-45-6789") == []
    plain, near = pii.find_pii("x 1.2.3.4")[0], pii.find_pii("server 1.2.3.4")[0]
    assert near[3] > plain[3] == pii.find_pii("recipe 1.2.3.4")[0][3] and pii.find_pii("hotel +1 555 010 9999")[0][3] < pii.find_pii("tel: +1 555 010 9999")[0][3]
    assert pii.redact("é a@b.co and 1.2.3.4!") == "é <EMAIL> and <IP>!" and pii.redact("nothing") == "nothing"


def test_ibans_end_where_their_country_says():
    spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    for iban in (spaced, plain):
        for after in (" BIC COBADEFFXXX", " I paid", " 2024-01-01", " 00", ", OK", "\nA1", "", f" {plain}", f" {spaced} X"):
            found = [f"before A1 {iban}{after}"[a:b] for kind, a, b, _ in pii.find_pii(f"before A1 {iban}{after}") if kind == "iban"]
            assert found == [iban] + [x for x in (plain, spaced) if x in after], after
    # the specimens of the registry
    for iban in ("NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S"):
        assert [x[0] for x in pii.find_pii(f"{iban} EUR 5") if x[0] == "iban"] == ["iban"], iban
        assert "iban" not in [x[0] for x in pii.find_pii(f"{iban}0")] and "iban" not in [x[0] for x in pii.find_pii(f"X{iban}")]
    assert pii.redact(f"to {spaced} BIC COBADEFFXXX") == "to <IBAN> BIC COBADEFFXXX"


def test_pii_linear_and_rows(spark):
    texts = [None, "", "1" * 100_000, "a" * 100_000 + "@", "a@b.co", "a@b.co", "1." * 50_000]
    got = pii.scan_pii(docs(spark, texts)).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in got] == [0, 0, 0, 0, 1, 1, 12_500]
    out = pii.redacted(docs(spark, texts)).orderBy("doc_id").collect()
    assert out[0]["text"] is None and out[4]["text"] == "<EMAIL>" and out[4]["spans"] == "clash"


# --- op8 -----------------------------------------------------------------------------------------------
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_decontamination_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    r = random.Random(5)
    bank = ["a", "B", "é", "d9", "x"]
    items = [(i, " ".join(r.choice(bank) for _ in range(r.choice([0, 2, 4, 10, 12])))) for i in range(6)] + [(7, None), (None, "q q q"), (8, "a b")]
    texts = [" - ".join(r.choice(bank) for _ in range(r.choice([0, 1, 5, 30, 80]))) for _ in range(40)] + [None, "q,q;q", "A\nb"]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in D.scan_contamination(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        words, hit, of = plain_words(t), set(), set()
        for item, s in items:
            w = plain_words(s)
            n = min(10, len(w))
            windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    of |= {item}
        assert got[i]["n_words"] == len(words)
        assert sum(x["end"] - x["first"] for x in got[i]["ranges"]) == len(hit)
        assert got[i]["items"] == sorted(str(x) for x in of if x is not None)


def test_decontamination_removes_documents_or_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    d = docs(spark, ["start ONE two three four five six seven eight nine, ten end", "clean é text", None])
    assert [r["doc_id"] for r in D.decontaminated(d, bench).orderBy("doc_id").collect()] == [1, 2]
    cut = D.decontaminated(d, bench, spans=True).orderBy("doc_id").collect()
    assert cut[0]["text"] == "start   end" and cut[1]["text"] == "clean é text" and cut[2]["text"] is None
    assert D.decontaminated(d, bench.limit(0)).count() == 3 and D.scan_contamination(d.limit(0), bench).count() == 0


def test_spans_of_several_blocks_are_those_of_one(spark, monkeypatch):
    r = random.Random(9)
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd".split()
    # items overlap, and d9 e9 stand apart in texts until the words between them are cut
    items = [(i, " ".join(words[2 * i : 2 * i + 10])) for i in range(11)] + [(20, "d9 e9")]
    texts = [" ".join(words), "x " + ", ".join(words).upper() + " é end", f"d9 {' '.join(words[:10])} e9", "d9 e9 z", None, "", *(" - ".join(r.choices(words, k=60)) for _ in range(20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    one = sorted(map(tuple, D.decontaminated(d, bench, spans=True).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert len(list(D.benchmark_blocks(bench, "item_id", "text", 10))) > 3
    several = D.decontaminated(d, bench, spans=True)
    assert several.columns == d.columns and sorted(map(tuple, several.collect())) == one
    assert one[0][1].split() == [] and one[2][1].split() == ["d9", "e9"] and one[3][1].split() == ["z"]
    assert {x["doc_id"] for x in D.decontaminated(d, bench).collect()}.isdisjoint(range(4))


def test_long_items_are_divided_without_loss(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 4000), ("PIECE_BYTES", 300)):
        monkeypatch.setattr(D, name, value)
    words = [f"w{i}" for i in range(2000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, " ".join(words[100:130]))], "item_id long, text string")
    texts = [*(" ".join(words[i : i + 10]) for i in range(1991)), "W5 w6 w7", "x A b", None]
    got = D.scan_contamination(docs(spark, texts), bench).orderBy("doc_id").collect()
    for i, r in enumerate(got[:1991]):
        assert r["items"] == ["1", *(["3"] if 100 <= i <= 120 else [])] and [tuple(x) for x in r["ranges"]] == [(0, 10)], i
    assert [r["items"] for r in got[1991:]] == [[], ["2"], []] and got[1991]["n_words"] == 3


# --- op5 -----------------------------------------------------------------------------------------------
def test_fingerprints_against_brute_force(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([0, 1, 4, 30, 700]))) for _ in range(40)] + [None, "é" * 31, "same text here", "same text here"]
    rows = sorted(enumerate(texts), reverse=True)
    got = {x["doc_id"]: x for x in P.fingerprint_edits(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        own, changed, following = P.sketches([t.encode(), edited.encode(), u.encode()])
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (P.to_text(own), P.to_text(changed))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (P.resemblance(own, changed), P.resemblance(own, following))


def test_sketches_estimate_and_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = P.sketches([a.encode(), b.encode()])
    assert P.resemblance(x, y) == pytest.approx(1 / 3, abs=0.13) and P.containment(x, y) == pytest.approx(0.5, abs=0.15)
    assert P.distinct(x) == pytest.approx(1996, rel=0.3) and P.distinct(P.sketches([b"a b c d e f"])[0]) == 2
    assert P.resemblance(x, x) == 1 and P.from_text(P.to_text(x)).tolist() == x.tolist()
    parts = spark.createDataFrame([("g", x.tolist()), ("g", y.tolist()), ("h", [])], "g string, sketch array<long>")
    merged = {r["g"]: r["sketch"] for r in P.merged_sketches(parts, ["g"]).collect()}
    assert merged["g"] == P.merge(x, y).tolist()
    one = docs(spark, ["just one"])
    assert P.fingerprint_edits(one).first()["near_next"] == 1.0 and P.fingerprint_edits(one.limit(0)).count() == 0
    assert [len(r["sketch"]) for r in P.sketch_table(docs(spark, [None, "a"])).orderBy("doc_id").collect()] == [0, 1]


# --- op6 -----------------------------------------------------------------------------------------------
def test_licenses(spark):
    notice = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = [None, "", "The MIT License. mit LICENSE! cc-by", f"so: {notice.replace('distribute', 'really distribute')}.", "MIT  licenses", "x " * 50_000 + "gnu general public license", "The MIT License. mit LICENSE! cc-by"]
    got = {r["doc_id"]: r for r in scan_licenses(docs(spark, texts)).collect()}
    assert len(got) == 7 and [got[i]["n_words"] for i in (0, 1, 2)] == [0, 0, 7]
    base = [[(p["label"], p["first"]) for p in got[i]["places"] if p["phrase"]] for i in range(7)]
    assert base[2] == base[6] == [("cc-by", 5), ("mit", 1), ("mit", 3)] and base[4] == [] and base[5] == [("gpl", 50_000)]
    assert "isc" in [p["label"] for p in got[3]["places"]]
    words = notice.lower().split()
    halves = " ".join(words[10:] + words[:10])  # all words of the notice, but not in its order
    pairs = "permission to use to use to use to use to use to use to use to use to use"  # two places vote again and again
    cut = " ".join(words[4:])  # begins within the notice: negative diagonals
    odd = {r["doc_id"]: {p["label"]: p["score"] for p in r["places"]} for r in scan_licenses(docs(spark, [halves, pairs, cut, notice])).collect()}
    assert odd[0] == {} and odd[1] == {} and odd[3] == {"isc": 1.0}
    assert abs(odd[2]["isc"] - 16 / 20) < 1e-9
    near = ["Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 1.1", "licensed under the GNU General Public License, version 2", "licensed under the GNU General Public License (GPL), version 3"]
    told = [{p["label"] for p in r["places"]} for r in scan_licenses(docs(spark, near)).orderBy("doc_id").collect()]
    assert told == [{"cc-by", "cc-by-nc-4.0"}, {"apache"}, {"gpl"}, {"gpl", "gpl-3.0"}]  # one word tells licenses apart
    twice = docs(spark, ["mit license"]).unionByName(docs(spark, ["mit license"]))
    assert [len(r["places"]) for r in scan_licenses(twice).collect()] == [1, 1]
    assert scan_licenses(docs(spark, []).limit(0)).count() == 0


# --- op4 -----------------------------------------------------------------------------------------------
def test_chat_snapshots_collapse(spark):
    turns = []
    for conv, texts in {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: [None], 7: ["a", None]}.items():
        turns += [(conv, 10 * n, "user" if n % 2 == 0 else "assistant", t, "clash") for n, t in enumerate(texts)]
    df = spark.createDataFrame([*turns, (None, 0, "user", "lost", "clash")], "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: r for r in rendered(df).collect()}
    assert sorted(got) == [2, 4, 5, 6, 7]
    assert got[4]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n" and got[2]["n_turns"] == 3
    assert rendered(df.limit(0)).count() == 0


# --- op7 -----------------------------------------------------------------------------------------------
TRICKY = [None, "", " ", "a  b", "a\n", "\na", "x<|endoftext|>y", "Don't. Stop, now\nor never", "日本 語 x", "word " * 5000, "a.b,c ,d. .e", "tab\tand\rreturn", "same", "same"]


def test_token_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    path = T.write_store(docs(spark, TRICKY), BYTE_BPE, f"file://{tmp_path}/store")
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in TRICKY]
    got = T.verify_store(spark, path).orderBy("id").collect()
    assert [(r["start"], r["n_tokens"]) for r in got] == [(sum(map(len, want[:i])), len(w)) for i, w in enumerate(want)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert [r["ids"] for r in T.read_documents(spark, path).orderBy("id").collect()] == want
    keys = [bytes(r["key"]) for r in T.read_chunks(spark, path).collect()]
    assert len(keys) == len(set(keys))


def test_token_store_sees_damage(spark, tmp_path):
    path = T.write_store(docs(spark, ["one two", "three"]), BYTE_BPE, f"file://{tmp_path}/store")
    T.read_chunks(spark, path).withColumn("data", F.lit(b"xx")).withColumn("kind", F.lit("chunk")).withColumn("id", F.lit(None).cast("long")).select("key", "id", "n", "data", "kind").write.mode("overwrite").partitionBy("kind").parquet(f"{tmp_path}/bad/store")
    T.read_manifest(spark, path).write.parquet(f"{tmp_path}/bad/manifest")
    spark.read.parquet(f"{path}/root").write.parquet(f"{tmp_path}/bad/root")
    with pytest.raises(Exception, match="damaged"):
        T.verify_store(spark, f"file://{tmp_path}/bad").collect()
    empty = T.write_store(docs(spark, []).limit(0), BYTE_BPE, f"file://{tmp_path}/none")
    assert T.verify_store(spark, empty).count() == 0


def test_token_store_misses_documents(spark, tmp_path):
    path = T.write_store(docs(spark, [f"text {i}" for i in range(20)]), BYTE_BPE, f"file://{tmp_path}/store")
    for name, lost in (("first", "start > 0"), ("last", "id < 19"), ("inner", "id <> 7"), ("all", "false")):
        T.read_chunks(spark, path).withColumns({"kind": F.lit("chunk"), "id": F.lit(None).cast("long")}).select("key", "id", "n", "data", "kind").write.partitionBy("kind").parquet(f"{tmp_path}/{name}/store")
        T.read_manifest(spark, path).filter(lost).write.parquet(f"{tmp_path}/{name}/manifest")
        spark.read.parquet(f"{path}/root").write.parquet(f"{tmp_path}/{name}/root")
        with pytest.raises(Exception, match="manifest"):
            T.verify_store(spark, f"file://{tmp_path}/{name}").collect()


def test_ids_must_fit_their_width(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        T.write_store(docs(spark, ["a"]), BYTE_BPE, f"file://{tmp_path}/wide", end_id=70_000)
    path = T.write_store(docs(spark, ["a"]), BYTE_BPE, f"file://{tmp_path}/four", end_id=70_000, width=4)
    assert T.verify_store(spark, path, 4).count() == 1 and T.read_documents(spark, path, 4).first()["ids"][-1] == 70_000


def test_words_encoded_apart_are_the_whole():
    from tokenizers import Tokenizer

    tokenizer, encode, r = Tokenizer.from_file(BYTE_BPE), T.encoder(BYTE_BPE), random.Random(7)
    parts = ["a", "the", " ", "\n", ".", ",", "'s", "é", "中", "1", "<|endoftext|>", "\t", " ", "!", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_of_equal_passages_are_equal():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype(np.uint32)
    moved = np.concatenate([ids[100:300], ids])
    cut = [list(x) for x in T.cuts(np.concatenate([ids, moved]), np.array([0, len(ids), len(ids) + len(moved)]))]
    chunks = [{s[a:b].tobytes() for a, b in zip([0, *c], c, strict=False)} for s, c in zip((ids, moved), cut, strict=True)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2
    assert max(b - a for a, b in zip([0, *cut[0]], cut[0], strict=False)) <= T.MOST


# --- op10 ----------------------------------------------------------------------------------------------
def test_sentence_pieces_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    model, v, r = SentencePieceProcessor(model_file=MODEL), S.vocabulary(MODEL), random.Random(8)
    parts = list("abcdehinost") + [" ", "  ", "\n", "é", "中", "😀", "ing", "the", "▁", "\t", "."]
    texts = ["", " ", "a" * 300, "ab" * 100 + " x", *("".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500))]
    got = [np.frombuffer(x, "<u2").tolist() for x in S.encode(v, texts)]
    assert got == model.encode(texts)
    assert [S.decode(v, x) for x in got] == model.decode(got)


def test_long_text_without_spaces_and_other_models(monkeypatch, tmp_path):
    from sentencepiece import SentencePieceProcessor

    model, v, r = SentencePieceProcessor(model_file=MODEL), S.vocabulary(MODEL), random.Random(3)
    text = "".join(r.choice("abcdehinosté中") for _ in range(5000))
    monkeypatch.setattr(S, "INDEXED", 101)
    v.cache.clear()
    assert np.frombuffer(S.encode(v, [text])[0], "<u2").tolist() == model.encode(text)
    raw = open(MODEL, "rb").read()
    for name, at in (("unigram", raw.index(b"tok_v0") + 7), ("normalised", raw.rindex(b"identity") + 8 + 2 + 2 + 1)):
        changed = bytearray(raw)
        assert (changed[at - 1 if name == "unigram" else at], name) is not None
        if name == "unigram":
            changed[at] = 1  # model_type
        else:
            changed[at] = 1  # remove_extra_whitespaces
        (tmp_path / name).write_bytes(changed)
        with pytest.raises(ValueError):
            S.check_model(str(tmp_path / name))


def test_sentence_piece_rows(spark):
    texts = [None, "", "a b", "a b", "é" * 5000, "line\nfeed  two"]
    rows = S.piece_digests(docs(spark, texts), MODEL).orderBy("doc_id").collect()
    assert [r["n_pieces"] > 0 for r in rows] == [False, False, True, True, True, True] and all(r["round_trip"] for r in rows)
    encoded = S.encoded_documents(docs(spark, texts), MODEL)
    assert [r["text"] for r in S.decoded_documents(encoded, MODEL).orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert S.encoded_documents(docs(spark, []).limit(0), MODEL).count() == 0


def test_edges_are_all_occurrences():
    v = S.vocabulary(MODEL)
    table = S.edge_table(v, "the the\0")
    known = {p: i for p, i in zip(v.pieces, v.ids.tolist(), strict=True)}
    for a in range(7):
        for b in range(a + 1, min(7, a + v.longest) + 1):
            assert table[a, b - a] == known.get("the the"[a:b], -1)
    assert json.dumps(table[7].tolist()) == json.dumps([-1] * (v.longest + 1))
