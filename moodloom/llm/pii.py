"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; their spans always stay. Looser
patterns propose further spans of the same kinds. Five labelers vote yes, no or nothing on every proposal (base spans among
them): strict form, shape, gazetteers, context words and borders. Votes are counted by kind and pattern over all
documents; expectation-maximisation on these counts, of which there are a fixed number, estimates how reliable each labeler
is and how likely each pattern of votes means personal data. With those likelihoods as soft labels a classifier over
votes, shape and neighbouring words is trained (naive Bayes; its sums are again counted over all documents). A proposal that
it finds likely enough and that overlaps no span becomes a span.

Null texts are empty. Spans are in code points, ends exclusive. Repeated rows count once each. An empty table gives no
rows. Any further columns are ignored (and kept by `redacted`).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KINDS = ("email", "ip", "card", "phone")
LEAST, FEATURES, ROUNDS = 0.9, 1024, 60

# --- base spans ----------------------------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that does not start an address cannot hold one that starts later in the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ leftwards as far as the local part goes, so that long runs without an address cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if valid_ip(m.group()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        own = digits_of(m.group())
        if 12 <= len(own) <= 19 and luhn(own):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- proposals and labelers ----------------------------------------------------------------------------------------
_LOOSE = (
    re.compile(r"[\w.+-]{1,64}(?:\s?[\[(]at[\])]\s?| at |\s@\s)[\w-]{1,63}(?:(?:\.|\s?[\[(]dot[\])]\s?| dot )[\w-]{1,63}){1,4}"),
    re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    re.compile(r"(?<![\w.])[0-9](?:[\x20-]?[0-9]){11,18}(?![\w.])"),
    re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![\w.])"),
)
# Gazetteers and context words: open lists of common values.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at us ca au".split())
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65")
CALLING_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "31", "32", "61", "81", "86", "91")
FOR = (
    frozenset("email e-mail mail contact write courriel correo kontakt".split()),
    frozenset("ip address host server adresse login dirección".split()),
    frozenset("card visa credit mastercard amex payment karte carte tarjeta".split()),
    frozenset("phone tel call mobile fax telephone telefon téléphone teléfono".split()),
)
AGAINST = frozenset("version license section chapter isbn order id token page figure key hash".split())
_BEFORE, _AFTER = re.compile(r"(\S+)\s*$"), re.compile(r"\s*(\S+)")
LABELERS = 5


def strict(span: str, kind: int) -> int:
    """Checks that a proposal passes (1) or fails (-1) on its own; 0 where its kind has none."""
    own = digits_of(span)
    if kind == 2:
        return 1 if 12 <= len(own) <= 19 and luhn(own) else -1
    if kind == 3:
        return (1 if 9 <= len(own) <= 15 else -1) if span[0] == "+" else 0
    return 0


def votes(text: str, kind: int, start: int, end: int, form: int) -> tuple[int, ...]:
    span, own = text[start:end], digits_of(text[start:end])
    around = re.findall(r"[\w-]+", text[max(0, start - 48):start].lower())[-6:]
    if kind == 0:
        shape = 1 if re.fullmatch(r"\S+", span) else 0
        known = 1 if re.split(r"\W+", span.lower().rstrip(")]"))[-1] in TOP_DOMAINS else -1
    elif kind == 1:
        shape = -1 if "." in span and len(own) <= 4 else 1
        known = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        shape = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        known = 1 if own.startswith(CARD_PREFIXES) else -1
    else:
        shape = 1 if re.search(r"[0-9]{3}[ .-][0-9]{3,4}", span) else 0
        known = (1 if own.removeprefix("00").startswith(CALLING_CODES) else -1) if span[0] == "+" or own.startswith("00") else 0
    context = 1 if FOR[kind] & set(around) else -1 if AGAINST & set(around) else 0
    border = [text[i] for i in (start - 1, end) if 0 <= i < len(text)]
    clean = -1 if any(ch.isalnum() or ch in "=_/\"" for ch in border) else 1
    return form, shape, known, context, clean


def features(text: str, kind: int, start: int, end: int, cast: tuple[int, ...]) -> list[int]:
    before, after = _BEFORE.search(text[max(0, start - 40):start]), _AFTER.match(text[end:end + 40])
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", text[start:end]))[:24]
    named = [f"{i}:{v}" for i, v in enumerate(cast)] + [
        f"shape:{shape}", f"length:{len(digits_of(text[start:end]))}", f"before:{before.group(1).lower() if before else ''}",
        f"after:{after.group(1).lower() if after else ''}"]
    return [zlib.crc32(f"{kind}|{n}".encode()) % FEATURES for n in named]


def proposals(text: str) -> list[dict]:
    """Base spans and loose matches that overlap no span of their kind, with votes and features."""
    base = base_spans(text)
    found = [(s, k, e, True) for s, k, e in base]
    for kind, pattern in enumerate(_LOOSE):
        own = [(s, e) for s, k, e in base]
        for m in pattern.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e in own):
                found.append((m.start(), kind, m.end(), False))
    out = []
    for s, k, e, is_base in sorted(found):
        cast = votes(text, k, s, e, 1 if is_base else strict(text[s:e], k))
        code = 0
        for v in cast:
            code = code * 3 + v + 1
        out.append({"kind": k, "start": s, "end": e, "base": is_base, "votes": code, "features": features(text, k, s, e, cast)})
    return out


# Every proposal holds one of these or four digits: an address has an @ or a spelled-out one as in _LOOSE, eight
# hexadecimal groups have colons, the other kinds have digits.
_MARKS = (b"@", b":", b" at ", b"(at)", b"[at]", b"(at]", b"[at)")


def promising(body: np.ndarray, at: np.ndarray) -> list[bool]:
    """Texts with four digits or one of _MARKS; `proposals` finds nothing in others."""
    digit = np.concatenate([[0], np.cumsum((body >= 48) & (body <= 57))])
    data = body.tobytes()
    return [bool(n >= 4) or any(w in data[a:b] for w in _MARKS) for a, b, n in zip(
        at[:-1].tolist(), at[1:].tolist(), (digit[at[1:]] - digit[at[:-1]]).tolist(), strict=True)]


FOUND = "array<struct<kind: int, start: long, end: long, base: boolean, votes: int, features: array<int>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                             ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def proposed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            texts = batch.column("text").to_pylist()
            found = [proposals(t) if ok else [] for t, ok in zip(texts, promising(body, at), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _FOUND)], ["doc_id", "found"])

    return c.as_documents(docs).mapInArrow(run, f"doc_id long, found {FOUND}")


# --- label model and classifier ------------------------------------------------------------------------------------

def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Expectation-maximisation for one kind: probability of personal data for each pattern of votes.

    Labelers are independent given the truth; each starts better than chance, with the weight of ten examples, the one
    of strict form (a check sum, a number of digits) with that of a few hundred.
    """
    codes = sorted(counts)
    cast = np.array([[code // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)] for code in codes])
    n = np.array([counts[code] for code in codes], float)
    yes = 1 / (1 + np.exp(-(cast - 1).sum(axis=1)))
    priors = [np.array([[1.0, 2.0, 7.0], [7.0, 2.0, 1.0]])] * LABELERS
    priors[0] = np.array([[1.0, 50.0, 249.0], [249.0, 50.0, 1.0]])
    for _ in range(rounds):
        chance = ((n * yes).sum() + 1) / (n.sum() + 2)
        score = np.full(len(codes), math.log(chance / (1 - chance)))
        for i in range(LABELERS):
            tables = []
            for side, weight in enumerate((n * yes, n * (1 - yes))):
                table = priors[i][side] + np.bincount(cast[:, i], weight, minlength=3)
                tables.append(table / table.sum())
            score += np.log(tables[0][cast[:, i]] / tables[1][cast[:, i]])
        yes = 1 / (1 + np.exp(-score.clip(-30, 30)))
    return dict(zip(codes, yes.tolist(), strict=True))


class Model:
    """Log-odds of each kind, and of each feature within it."""

    def __init__(self, weights: np.ndarray, bias: list[float]):
        self.weights, self.bias = weights, bias

    def likely(self, kind: int, marks: list[int]) -> float:
        score = self.bias[kind] + sum(float(self.weights[kind, m]) for m in marks)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))

    def spans(self, found: list[dict], least: float = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, as (start, kind, end)."""
        base = sorted((f["start"], f["kind"], f["end"]) for f in found if f["base"])
        out = list(base)
        rest = [(-self.likely(f["kind"], f["features"]), f["start"], f["kind"], f["end"]) for f in found if not f["base"]]
        for p, s, k, e in sorted(rest):
            if -p >= least and all(e <= a or s >= b for a, _, b in out):
                out.append((s, k, e))
        return base, sorted(out)


def fit(found: DataFrame) -> Model:
    """From the proposals of all documents."""
    each = found.select(F.explode("found").alias("f"))
    counts = each.groupBy("f.kind", "f.votes").count().collect()
    likely = {k: reliabilities({r["votes"]: r["count"] for r in counts if r["kind"] == k}) for k in range(len(KINDS)) if any(r["kind"] == k for r in counts)}
    rows = [(k, v, round(p * 1_000_000)) for k, own in likely.items() for v, p in own.items()]
    spark = found.sparkSession
    # At most kinds x 3^labelers rows.
    soft = F.broadcast(spark.createDataFrame(rows, "kind int, votes int, yes long"))
    marked = each.select("f.kind", "f.votes", F.explode("f.features").alias("feature")).join(soft, ["kind", "votes"])
    sums = marked.groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    weights, bias = np.zeros((len(KINDS), FEATURES)), []
    for k in range(len(KINDS)):
        own = [(r["count"], likely[k][r["votes"]]) for r in counts if r["kind"] == k]
        good, bad = sum(n * p for n, p in own) + 2, sum(n * (1 - p) for n, p in own) + 2
        bias.append(math.log(good / bad))
        for r in sums:
            if r["kind"] == k:
                yes = r["yes"] / 1e6
                weights[k, r["feature"]] = math.log((yes + 1) / good) - math.log((r["n"] - yes + 1) / bad)
    return Model(weights.clip(-4, 4), bias)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame, least: float = LEAST) -> DataFrame:
    found = c.settle(proposed(docs), "proposed")
    model = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [model.spans(f, least) for f in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([sum(k == i for _, k, _ in b) for b, _ in both], pa.int64()) for i in range(len(KINDS))),
                 pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b, _ in both], pa.string()), pa.array([spelled(a) for _, a in both], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, and what overlaps it, becomes its kind in brackets."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with personal data masked; n_chars follows where a text changes."""
    model = fit(c.settle(proposed(docs), "proposed"))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            texts, new = batch.column("text").to_pylist(), []
            for t, ok in zip(texts, promising(body, at), strict=True):
                new.append(masked(t, model.spans(proposals(t), least)[1]) if ok else t)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(b) if a != b else n for a, b, n in zip(texts, new, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)
