"""The registered queries over the smallest tables: against their SQL, or against brute force by other means."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessella.llm import catalog, quality
from tessella.llm.q_quality import quality_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r["doc_id"], r["text"] or "") for r in rows))


def result(spark, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(catalog.SQL[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).map(lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)).values.tolist()))
    assert plain(got) == plain(want)


def spans_of(text, patterns):
    return [(kind, m.start(), m.end()) for kind, pattern, ok in patterns for m in re.finditer(pattern, text) if ok(m)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op3_base_spans(spark, texts):
    patterns = [
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    got = result(spark, "op3_secrets")
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = spans_of(text, patterns)
        for kind in ("assign", "access", "hex"):
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        spans.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        assert got[i]["base_sha256"] == sha(spans)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= {*got[i]["spans"].split(",")}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_op9_base_spans(spark, texts):
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
    ]
    got = result(spark, "op9_pii")
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = spans_of(text, patterns)
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        assert got[i]["base_sha256"] == sha(spans)
        listed = [x for x in got[i]["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= {*listed} and len([x for x in got[i]["scores"].split(",") if x]) == len(listed)


def test_op5_edits_and_likeness(spark, texts):
    """Edited texts and lengths exactly; likeness within the error of a sketch of 128."""

    def shingles(text):
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got, ids = result(spark, "op5_fingerprints"), sorted(texts, reverse=True)
    off = []
    for n, i in enumerate(ids):
        text, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            off.append(abs(got[i][column] - alike(a, b)))
            if len(a | b) <= 128:
                assert off[-1] < 1e-9
        assert len(got[i]["fingerprint"]) == 10 * min(128, len(shingles(text)))
    assert max(off) < 0.2 and np.mean(off) < 0.02
    same = {}
    for i, text in texts.items():
        assert same.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_op7_ids(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, got, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), result(spark, "op7_token_store"), 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10_ids(spark, texts):
    from sentencepiece import SentencePieceProcessor

    model, got = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), result(spark, "op10_sentence_pieces")
    for i, text in texts.items():
        ids = model.encode(text)
        assert (got[i]["n_pieces"], got[i]["ids_crc32"], got[i]["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), model.decode(ids) == text)


def test_op2_scores_are_sums_of_bins(spark, texts):
    model, got = quality_model(spark, SF), result(spark, "op2_quality")
    x = quality.features([t.encode() for t in texts.values()])
    for row, i in zip(x, texts, strict=True):
        total = model.intercept
        for cuts, table, value in zip(model.cuts, model.tables, row, strict=True):
            total += table[sum(value >= c for c in cuts)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(row[a] >= c for c in model.pair_cuts[a]), sum(row[b] >= c for c in model.pair_cuts[b])]
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_pipeline_against_brute_force(spark, texts):
    """The first four stages and the ids, each by other means than the operator's (the scores are op2's, tested above)."""
    from sentencepiece import SentencePieceProcessor

    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    scores = model.scores(quality.features([t.encode() for t in texts.values()]))
    kept = {i: t for (i, t), s in zip(texts.items(), scores, strict=True) if s >= 0.7}

    def lowered(text, pattern):
        return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text))

    sets = {}
    for i, t in kept.items():
        w = lowered(t, "[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and top[i] != top[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((top[i], top[j]))
                top = {k: low if v == high else v for k, v in top.items()}
    kept = {i: t for i, t in kept.items() if top[i] == i}

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = lowered(r["text"] or "", word)
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = lowered(text, word)
        return not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == kept.keys() and 0 < len(kept) < len(texts)
    kinds = "EMAIL IP CARD PHONE IBAN SSN".split()
    private = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+[0-9][\x20().0-9-]+[0-9]")
    for i, text in kept.items():
        out = pieces.decode(got[i])
        assert got[i] == pieces.encode(out)
        if out != text:
            # what is left stands in the text in its order, and what went is named
            assert any(f"<{k}>" in out for k in kinds)
            at = 0
            for part in re.split("|".join(f"<{k}>" for k in kinds), out):
                at = text.index(part, at) + len(part)
        assert not any(m[0] for m in private.finditer(out) if "@" in m[0])
