"""Null and repeated ids, null texts and ties in each operator, and the quality model against plain computation."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import chat_format, decontamination, fingerprints, license_scan, pii, quality, secrets, sentence_pieces, token_store

ROWS = [(None, "token: abcdefgh1 and a@b.co"), (None, None), (3, ""), (3, "mit license"), (3, "mit license"), (7, "x " * 30_000), (7, "card 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in ROWS], "doc_id long, text string, spans string, id int, n_tokens string")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))


WANT = [None, None, 3, 3, 3, 7, 7]


def test_spans(odd):
    got = secrets.scan_secrets(odd).collect()
    assert ids(got) == WANT and sorted(len(r["spans"]) for r in got) == [0] * 6 + [1]
    got = pii.scan_pii(odd).collect()
    assert ids(got) == WANT and sorted(len(r["spans"]) for r in got) == [0] * 5 + [1, 1]


def test_fingerprints(odd):
    got = fingerprints.fingerprint_edits(odd).collect()
    assert ids(got) == WANT and sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in ROWS)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}


def test_licenses(odd):
    got = license_scan.scan_licenses(odd).collect()
    assert ids(got) == WANT and sorted(len(r["places"]) for r in got) == [0] * 5 + [1, 1]


def test_token_store(odd, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_store.verify_store(spark, token_store.write_store(odd, path)).collect()
    own = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert [r["id"] for r in sorted(got, key=lambda r: r["start"])] == WANT and sorted(r["n_tokens"] for r in got) == own
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]


def test_contamination_and_its_repeats(odd, spark):
    bench = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "and a b")], "item_id long, text string")
    got = decontamination.scan_contamination(odd, bench).collect()
    assert ids(got) == WANT and sorted(len(r["ranges"]) for r in got) == [0] * 4 + [1] * 3 and {tuple(r["items"]) for r in got if r["ranges"]} == {("1",), ()}
    assert ids(decontamination.decontaminated(odd, bench).collect()) == [None, 3, 7, 7]


def test_sentence_pieces(odd):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, got = SentencePieceProcessor(model_file=path), sentence_pieces.encoded_documents(odd, path).collect()
    assert ids(got) == WANT
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(tuple(model.encode(t or "")) for _, t in ROWS)


def test_chat_ties_repeats_and_long_turns(spark):
    long = "y" * 200_000
    turns = [(1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "assistant", "c"), (1, 5, "user", "a")]
    turns += [(2, 0, "assistant", "c"), (2, 1, "user", "a")]  # what 1 begins with, once its ties are in order
    turns += [(3, None, "user", long), (3, 1, None, None), (4, 1, "user", long)]
    frame = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, n_turns long")
    got = {r["conv_id"]: r for r in chat_format.rendered(frame).collect()}
    assert {i: r["n_turns"] for i, r in got.items()} == {1: 4, 3: 2}
    part = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1]["rendered"] == part("assistant", "c") + part("user", "a") * 2 + part("user", "b")
    assert got[3]["rendered"] == part("user", long) + part("user", "")


def plain_features(text):
    """The features of a text, one character at a time."""
    raw = text.encode()
    n, c = max(len(raw), 1), Counter(raw)
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    times = Counter(words)
    share = lambda keep: sum(v for b, v in c.items() if keep(b)) / n
    among = lambda chars: lambda b: b in chars.encode()
    lines = raw.split(b"\n")
    symbols = "#$%&*@^~"
    other = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in symbols + "|!.,"
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(v for b, v in c.items() if b > 32) / max(len(words), 1), max((len(w.encode()) for w in words), default=0),
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b > 127), share(among(" ")), share(among("\n")), share(among("|")), share(among(symbols)),
        share(among("!")), share(among(".")), share(among(",")), share(other),
        len(times) / len(words) if words else 0, max(times.values()) / len(words) if words else 0, len(set(lines)) / len(lines), n / (c[10] + 1), len(c),
    ]


def test_quality_features_one_by_one():
    texts = ["", "One two, two!\nTwo; Ünï | 42 #tag\n\nOne", "a" * 50, "x\ty\x0bz", "!!! ... ~~ (q)", "same\nsame\nsame"]
    got = quality.features([t.encode() for t in texts])
    assert np.allclose(got, [plain_features(t) for t in texts])


def test_trees_have_the_best_cut_and_the_fit_lowers_the_loss():
    r = np.random.default_rng(3)
    g, h = r.normal(size=9), r.random(9) + 0.1
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 9), key=lambda i: gain(0, i) + gain(i, 9))
    tree = quality._tree(g, h, 1)
    assert np.allclose(tree[:cut], g[:cut].sum() / (h[:cut].sum() + 1)) and np.allclose(tree[cut:], g[cut:].sum() / (h[cut:].sum() + 1))
    x = r.normal(size=(800, len(quality.FEATURES)))
    y = (x[:, 3] + 0.5 * x[:, 7] > 0.2).astype(float)
    fresh = r.normal(size=(400, len(quality.FEATURES)))
    p = quality.fit(x, y).scores(fresh)
    truth = fresh[:, 3] + 0.5 * fresh[:, 7] > 0.2
    loss = -np.mean(np.log(np.where(truth, p, 1 - p)))
    assert loss < 0.35 * -np.mean(np.log(np.where(truth, y.mean(), 1 - y.mean()))) and ((p > 0.5) == truth).mean() > 0.88


def test_one_text_has_one_fingerprint_wherever_it_stands(spark):
    docs = spark.createDataFrame([(i, "the same text of seven words here") for i in (1, 5, None)] + [(2, "other " * 9)], "doc_id long, text string")
    got = fingerprints.fingerprint_edits(docs).collect()
    same = {r["fingerprint"] for r in got if r["n_chars"] == 33}
    assert len(same) == 1 and all(hashlib.sha256(b"").hexdigest() != r["edited_sha256"] for r in got)
