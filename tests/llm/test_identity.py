"""Texts that hash alike under sums over their bytes: operators must tell them apart."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from moodloom.llm import common as c
from moodloom.llm import fingerprint, jaccard, packing, quality, suffix

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n: int, pair: str = "ab") -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)


PAIRS = [thue_morse(n, p) for n in (32, 64, 512, 1024, 4096) for p in ("ab", "'u", "+M")]


def test_ranges_hash_apart():
    for x, y in PAIRS:
        body = np.frombuffer((x + y + x).encode(), np.uint8)
        n = len(x)
        h = c.range_hash(body, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]


def test_short_ranges_hash_apart():
    """All byte strings of up to two bytes, and many of up to 64, also with zero bytes at the end."""
    texts = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    rng = np.random.default_rng(2)
    texts += [rng.integers(0, 3, n).astype(np.uint8).tobytes() for n in range(3, 65) for _ in range(300)] + [b"x" * n + b"\0" * k for n in range(20) for k in range(20)]
    texts = sorted(set(texts))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert len(np.unique(c.range_hash(np.frombuffer(b"".join(texts), np.uint8), at[:-1], at[1:]))) == len(texts)


def test_packing_keeps_ids(spark):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(TOKENS)
    texts = [t for pair in PAIRS for x in pair for t in (x, f"see {x} here, {x}. Then\n{x}")]
    rows = packing.packed_sums(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), TOKENS, length=1 << 20).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 1], "<u4")
        if len(got[i]) == 1:
            assert got[i] == [(0, zlib.crc32(ids.tobytes()))]


def test_distinct_compares_bytes(monkeypatch):
    """Even if all hashes were equal, different segments stay apart."""
    monkeypatch.setattr(c, "range_hash", lambda body, starts, ends, known=(): np.zeros(len(starts), np.uint64))
    words = [b"aa", b"ab", b"aa", b"x" * 40, b"x" * 39 + b"y", b"x" * 40, b"a" * 17, b"aa\0"]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    kinds, which = packing.distinct(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])
    assert all(words[kinds[w]] == words[i] for i, w in enumerate(which.tolist()))


@pytest.mark.parametrize("pair", PAIRS[3:6])
def test_jaccard_links_nothing(spark, pair):
    x, y = pair
    rows = [(1, f"{x} p q r s"), (2, f"{y} p q r s"), (3, f"{x} p q r s")]
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_quality_and_fingerprint(spark):
    x, y = thue_morse(1024)
    docs = spark.createDataFrame([(1, f"{x} b c {y} b c", "en", "s"), (2, f"{x} b c {x} b c", "en", "s")], "doc_id long, text string, lang string, source string")
    repeats = {r.doc_id: r.n_repeat_words for r in quality.verdicts(docs).collect()}
    assert repeats == {1: 0, 2: 6}
    a, b = (fingerprint.sketches([f"{t} a b c d".encode()], one_in=1)[0] for t in (x, y))
    assert a.shared(b) == 0


def test_suffix_removes_only_what_repeats(spark):
    for n in (512, 1024):
        x, y = thue_morse(n, "'u")
        texts = [x + "-" * 50, y + "=" * 50]
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix.removal_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        strings = [t[i:i + 400] for t in texts for i in range(len(t) - 399)]
        for i, t in enumerate(texts):
            gone = {j for k in range(len(t) - 399) if strings.count(t[k:k + 400]) > 1 for j in range(k, k + 400)}
            left = "".join(ch for j, ch in enumerate(t) if j not in gone)
            assert got[i] == (len(gone), hashlib.sha256(left.encode()).hexdigest())
