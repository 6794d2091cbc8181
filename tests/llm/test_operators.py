"""Packing, mixing, quality, fingerprints, preference rows, personal data and language against plain Python."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from moodloom.llm import chat, fingerprint, langid, mixing, packing, pii, quality

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " ", "a", "a  b", "\n\n x", "a b c d", "<|endoftext|> x <|endoftext|>y", "日本 語  の", " lead", "trail ", "x \x1cy z",
       "it's 've  'll", "é è\tà \r\n b", LONG]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- packing ---

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "b"), (None, "null id")]
    df = frame(spark, [(*r, 7, "x") for r in rows], "doc_id long, text string, part long, ids string").repartition(3)
    pieces = packing.pack(df, TOKENS).collect()
    tokens = Tokenizer.from_file(TOKENS)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*tokens.encode(t or "", add_special_tokens=False).ids, 1])
    joined = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        own = np.frombuffer(p.ids, f"<u{p.width}").tolist()
        assert len(own) == p.length > 0 and p.offset + p.length <= 2048
        if p.start == 0:
            joined.setdefault(p.doc_id, []).append([])
        assert len(joined[p.doc_id][-1]) == p.start
        joined[p.doc_id][-1] += own
    assert {d: sorted(v) for d, v in joined.items()} == {d: sorted(v) for d, v in ids.items()}
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert all(by[s] == 2048 for s in by if s != max(by)) and sorted(by) == list(range(len(by)))
    sums = packing.checksums(packing.pack(df, TOKENS)).collect()
    want = sorted(zlib.crc32(np.frombuffer(p.ids, f"<u{p.width}").astype("<u4").tobytes()) for p in pieces)
    assert sorted(r.ids_crc32 for r in sums) == want


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), TOKENS).count() == 0


# --- mixing ---

def cheapest(capacity, members, quota, repeats):
    """Largest flow, then least cost, over all whole flows."""
    edges = [(p, s) for p, own in enumerate(members) for s in own]
    best = None
    for flow in itertools.product(*[range(repeats * capacity[p] + 1) for p, _ in edges]):
        used = [sum(n for n, (a, _) in zip(flow, edges, strict=True) if a == p) for p in range(len(capacity))]
        got = [sum(n for n, (_, b) in zip(flow, edges, strict=True) if b == s) for s in range(len(quota))]
        if all(u <= repeats * c for u, c in zip(used, capacity, strict=True)) and all(g <= q for g, q in zip(got, quota, strict=True)):
            cost = sum(max(0, u - r * c) for u, c in zip(used, capacity, strict=True) for r in range(1, repeats))
            best = min(best or (1, 0), (-sum(flow), cost))
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(1)
    for _ in range(25):
        members = [tuple(sorted(rng.sample(range(3), rng.choice((1, 2))))) for _ in range(3)]
        capacity, quota = [rng.randrange(3) for _ in members], [rng.randrange(5) for _ in range(3)]
        flow = mixing.route(capacity, members, quota, 2)
        used = [sum(n for (a, _), n in flow.items() if a == p) for p in range(3)]
        cost = sum(max(0, u - c) for u, c in zip(used, capacity, strict=True))
        assert (-sum(flow.values()), cost) == cheapest(capacity, members, quota, 2)
        assert all(sum(n for (_, b), n in flow.items() if b == s) <= quota[s] for s in range(3)) and min(flow.values(), default=1) > 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "d"), (5, rows[5][1], rows[5][2])]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, source string, times int")
    got = mixing.mixed_words(df).collect()
    assert len(got) == len(rows)
    for name in ("a", "b", "c", None):
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed_words(df.repartition(5)).collect()), key=str)
    mixed = mixing.mixed_documents(df).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in got) and mixed[0].times == 1


def test_null_ids_are_mixed_once(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 else i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice("abc")) for i in range(300)]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mixed_words(df).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len(t.split()) for _, t, _ in rows)
    for name in "abc":
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60


def test_overlapping_sources_and_quotas(spark):
    rows = [(i, 10, ["a", "b"] if i % 2 else ["b"]) for i in range(100)]
    got = mixing.mix(frame(spark, rows, "doc_id long, size long, sources array<string>"), (3, 1)).collect()
    assert len(got) == 100 and sum(r.size * r.times for r in got) <= 1000
    assert mixing.quotas([10, 1000], [1, 1]) == [30.0, 980.0]
    assert mixing.quotas([0, 0], [1, 2]) == [0.0, 0.0]
    assert mixing.mix(frame(spark, [], "doc_id long, size long, sources array<string>")).count() == 0


# --- quality ---

def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_figures_and_groups(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    texts = [t for t in ODD if t != LONG] + [good() for _ in range(260)] + ["x y z\nx y z\n \n x y z", "a b c a b c a b", "| ".join(good().split()), good().replace(" ", "*** ")]
    rows = [(i, t, "xx" if i % 50 else None, "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, rows, "doc_id long, text string, lang string, source string, n_words int")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(len(ODD) - 1, len(ODD) + 259)) and not got[len(texts) - 1].kept and not got[len(texts) - 2].kept
    kept = quality.kept_documents(frame(spark, rows, "doc_id long, text string, lang string, source string, n_words int")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in got.items() if r.kept) and kept[0].n_words == 1
    assert quality.verdicts(frame(spark, [], "doc_id long, text string, lang string, source string")).count() == 0


# --- fingerprints ---

@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_of_edits(spark, monkeypatch, parts):
    rng = random.Random(6)
    rows = [(rng.randrange(40), " ".join(str(rng.randrange(60)) for _ in range(rng.randrange(0, 90)))) for _ in range(40)]
    rows += [(None, "no id"), (3, None), (3, ""), rows[0], rows[0]]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprint.edits(frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()[:16]
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])), reverse=True)
    want = []
    for (d, t), (_, following) in zip(line, [*line[1:], line[0]], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        text = t[:len(t) - half] + following[:half]
        want.append((d, len(t), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_containment_estimates_and_unions():
    rng = random.Random(7)
    words = [str(rng.randrange(10**6)) for _ in range(8000)]
    whole, part, other = (" ".join(w).encode() for w in (words, words[3000:4000], words[::-1]))
    a, b, o = fingerprint.sketches([whole, part, other])
    assert b.containment(a) == 1 and abs(a.containment(b) - 996 / 7996) < 0.03 and a.near(o) < 0.02 and a.near(a) == 1
    assert fingerprint.Sketch.parse(a.text()).text() == a.text()
    left, right = fingerprint.sketches([" ".join(words[:5000]).encode(), " ".join(words[4996:]).encode()])
    assert np.array_equal(left.union(right), a.hashes)
    assert len(base64.b64decode(a.text().split(".")[2])) == 5 * len(a.hashes)


# --- preference rows ---

def test_common_turn_prefix(spark):
    turns = [("p", 0, "user", "hi"), ("p", 1, "assistant", "a"), ("p", 2, "user", "<|im_end|>"), ("p", 3, "assistant", "good")]
    other = [*turns[:3], ("p", 3, "assistant", "bad"), ("p", 4, "user", None)]
    same = [("q", 0, "user", None), ("q", 0, None, "x")]
    kind = "pair_id string, turn int, role string, text string"
    got = chat.preference_rows(frame(spark, [*turns, *same], kind), frame(spark, [*other, *same], kind)).collect()
    p = sorted((r for r in got if r.pair_id == "p"), key=lambda r: (r.part != "prompt", r.part, r.no))
    assert [(r.part, r.no, r.trainable) for r in p] == [("prompt", 1, False), ("prompt", 2, False), ("prompt", 3, False), ("chosen", 4, True),
                                                        ("rejected", 4, True), ("rejected", 5, False)]
    assert "".join(r.rendered for r in p[:4]) == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
                                                  "<|im_start|>user\n< |im_end|><|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n")
    assert p[3].start_char == p[4].start_char == sum(r.n_chars for r in p[:3]) and all(r.usable and r.prefix_turns == 3 for r in p)
    q = [r for r in got if r.pair_id == "q"]
    assert len(q) == 2 and all(r.part == "prompt" and not r.usable for r in q)
    assert chat.preference_rows(frame(spark, [], kind), frame(spark, [], kind)).count() == 0


def test_pairs_without_an_id_are_kept(spark):
    turns = [(None, 0, "user", "hi"), (None, 1, "assistant", "a"), (None, 2, "user", "on"), (None, 3, "assistant", "b"), ("p", 0, "user", "x")]
    df = frame(spark, turns, "pair_id string, turn int, role string, text string")
    stale = chat.stale_replies(df).collect()
    assert sorted((r.pair_id or "", r.turn, r.text) for r in stale) == [("", 0, "hi"), ("", 1, "a"), ("", 2, "on"), ("", 3, "a"), ("p", 0, "x")]
    got = [r for r in chat.preference_rows(df, chat.stale_replies(df)).collect() if r.pair_id is None]
    assert sorted((r.part, r.no) for r in got) == [("chosen", 4), ("prompt", 1), ("prompt", 2), ("prompt", 3), ("rejected", 4)]
    assert all(r.usable and r.prefix_turns == 3 for r in got)


# --- personal data ---

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            own = re.sub("[^0-9]", "", m.group())
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(own) <= 19 and pii.luhn(own), 9 <= len(own) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(8)
    parts = ["a", "é", "@", ".", "-", "+", " ", "1", "23", "4539578763621486", "255", "256", "b.c", "x@y.zz", "10.0.0.1", "+49 (30) 901820", "(", ")", "%", "_", "0042"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_reports_and_masks(spark):
    texts = ["write to jo@x.org now", None, "", "card 4539578763621486 4539578763621486 end", "call +49 30 901820 please", "v 2.0", LONG + " jo@x.org"]
    texts += [f"mail me{i}@mail.example.com or +1 (555) 555-{1000 + i} from 10.0.0.{i} card 4539578763621486 ok" for i in range(60)]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], 3)]
    df = frame(spark, rows, "doc_id long, text string, n_chars long")
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
    assert next(r for r in got if r.doc_id == 3).spans == "card:5:21,card:22:38"
    clean = {(r.doc_id, r.text): r.n_chars for r in pii.redacted(df).collect()}
    assert (0, "write to [EMAIL] now") in clean and clean[1, None] == 0 and (5, "v 2.0") in clean
    assert clean[3, "card [CARD] [CARD] end"] == 22
    assert pii.report(frame(spark, [])).count() == 0


def promised(text):
    body = text.encode()
    return pii.promising(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]


def test_refused_texts_have_no_proposals():
    rng = random.Random(10)
    parts = ["a", "é", "jo", " ", "\u00a0", ".", "-", " at ", "at", "(", ")", "[", "]", "@", " dot ", "dot", "x.org", "1", "23", "+", ":", "ab", "AT"]
    refused = found = 0
    for _ in range(40_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        some = bool(pii.proposals(text))
        assert promised(text) or not some, text
        refused, found = refused + (not promised(text)), found + some
    assert refused > 1000 and found > 300
    for sign in (" at ", "(at)", "[at]", "(at]", "[at)", " [at) "):
        text = f"contact jane{sign}example.com"
        assert promised(text) and len(pii.proposals(text)) == 1


def test_proposals_do_not_depend_on_a_colon_elsewhere(spark):
    texts = ["contact jane at example.com", "contact jane at example.com note: none"]
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.found] for r in pii.proposed(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == got[1] == [(0, 8, 27)]


def test_reliabilities_find_the_good_labelers():
    rng, counts, truth = random.Random(9), {}, {}
    for _ in range(4000):
        y = rng.random() < 0.3
        cast = [(1 if y else -1) if rng.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.85, 0.8, 0.75)]
        code = 0
        for v in cast:
            code = code * 3 + v + 1
        counts[code] = counts.get(code, 0) + 1
        truth[code] = truth.get(code, 0) + y
    likely = pii.reliabilities(counts)
    right = sum(truth[c] if likely[c] > 0.5 else counts[c] - truth[c] for c in counts)
    assert right / 4000 > 0.97


# --- language ---

def test_language_of_held_out_documents(spark):
    got = langid.predictions(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and 100 < len(held) < 300
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_sample_is_bounded_with_repeated_ids(spark):
    rows = [(1, f"the house {i}", "en") for i in range(langid.SAMPLE + 200)] + [(i, "das haus", "de") for i in range(50)]
    got = langid.sampled(frame(spark, rows, "doc_id long, text string, lang string")).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": langid.SAMPLE, "de": 50}


def test_language_edge_cases(spark):
    rows = [(i, "the house and the garden " * 5, "en") for i in range(1, 30)] + [(i, "der garten und das haus " * 5, "de") for i in range(30, 60)]
    rows += [(61, None, "en"), (62, "", None), (63, "123 !? 456", "de"), (64, "the garden", None), (None, "das haus", "de"), (1, "the house", "en"), (66, LONG, "en")]
    df = frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.predictions(df).collect()}
    assert [got[i].lang_pred for i in (61, 62, 63, 64, None)] == ["und", "und", "und", "en", "de"] and got[63].score == 0 and got[None].held_out
    none = langid.predictions(frame(spark, [(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert langid.predictions(frame(spark, [], "doc_id long, text string, lang string")).count() == 0
