"""Personal data by candidate gradient boosting.

Four kinds have a fixed form and are always found: e-mail addresses, IPv4 addresses, card numbers that
pass Luhn, and international phone numbers. Beyond them generators of high recall propose spans, which may
overlap; boosted trees judge each by its format and by the words around it; probabilities are
calibrated on held-out samples, and each kind has the least threshold that kept its held-out
precision. Of overlapping accepted spans the likeliest stays, and none that overlaps a fixed one.

The trees are trained once a process on labelled samples made from templates by a seeded generator,
``SAMPLES`` of them; no corpus row is used. A text is read once, in one narrow pass.

Defined results: a null text counts as empty; null ids pass through; repeated rows give equal results;
an empty table gives an empty result; ``redact`` keeps all columns, the query ignores others.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches
from .boosting import Boosted, least_threshold, platt, sigmoid

SAMPLES = 6000
PRECISION = 0.98
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order of results.
ADDED_KINDS = ("hidden_email", "contact", "national_id", "iban", "birth_date", "document_no", "mac")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Necessary for a hidden address, in lower case: the at word, a label, then a dot and more, or the dot word.
_HIDDEN = re.compile(r"at[\])]? ?[^\s.]{1,128}(?:\.[^\s.]| ?[\[(]?dot)")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The generators' patterns, by kind.
GENERATORS = {
    "hidden_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}(?:(?:\.| ?[\[(]?\bdot\b[\])]? ?)[A-Za-z0-9_%+-]{1,64}){0,4} ?(?:\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[(]?\bdot\b[\])]? ?)[A-Za-z0-9-]{2,24}){1,4}", re.I),
    "contact": re.compile(r"(?<![A-Za-z0-9.+-])(?:(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ .-][0-9]{2,6}){0,4}|[0-9]{7,15})(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[0-9]{8}[A-Z]|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2})(?![A-Za-z0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "birth_date": re.compile(r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9])"),
    "document_no": re.compile(r"(?<![A-Za-z0-9-])[A-Z]{1,3}[ -]?[0-9]{6,9}[A-Z]?(?![A-Za-z0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"),
}

# Words of the context, by what they speak for.
CONTEXT = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "reach", "whatsapp", "telefon", "telefono", "teléfono", "téléphone", "handy", "dial", "text me"),
    "id": ("ssn", "social", "security", "insurance", "dni", "nif", "national", "identity", "taxpayer", "nino", "sécu"),
    "bank": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte", "wire", "swift"),
    "birth": ("born", "birth", "dob", "birthday", "geboren", "nacido", "nacida", "né le", "née le", "nacimiento", "geburtsdatum", "naissance"),
    "document": ("passport", "licence", "license no", "driver", "visa", "reisepass", "pasaporte", "passeport", "permit", "id card"),
    "mail": ("mail", "e-mail", "email", "write", "contact", "reach", "correo", "courriel"),
    "device": ("mac", "device", "address", "adapter", "wifi", "ethernet", "bluetooth"),
    "other": ("version", "order", "invoice", "page", "chapter", "isbn", "issn", "score", "figure", "table", "rfc", "section", "released", "published", "build", "part", "model", "serial", "price", "total", "ratio", "years", "season", "line", "sku", "article", "edition", "pp", "vol", "updated", "flight", "case", "volume", "route"),
    "money": ("$", "€", "£", "usd", "eur", "%"),
}
_CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over its local part: linear even in endless runs of letters."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", done)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = [*_emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):  # a chain of number groups; each four of them are a match
            if m[0].count(".") >= 3:
                at, groups = m.start(), m[0].split(".")
                for k in range(0, len(groups) - 3, 4):
                    four = groups[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                        out["ip"].append((at, end))
                    at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators; they may overlap."""
    out = []
    has_digit = bool(_DIGIT.search(text))
    for kind, pattern in GENERATORS.items():
        if kind == "hidden_email":
            if not _HIDDEN.search(text.lower()):
                continue
        elif not has_digit:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def _has(words: tuple[str, ...], text: str) -> bool:
    return any(w in text for w in words)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and words around it."""
    value = text[start:end]
    before = text[max(0, start - _CONTEXT_CHARS) : start].lower()
    after = text[end : end + _CONTEXT_CHARS // 2].lower()
    digits = _digits(value)
    groups = re.findall(r"[0-9]+", value)
    near = re.split(r"[.!?\n]\s", before)[-1]
    return [
        *(float(kind == k) for k in ADDED_KINDS),
        float(len(value)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(value.count(" ")), float(value.count("-")), float(value.count(".")), float(value.count("/")), float(value.startswith("(")),
        float(luhn(digits)) if digits else 0.0, float(digits[:1] == "0"), float(len(set(digits))),
        float("(at)" in value.lower() or "[at]" in value.lower()), float(" dot " in value.lower()),
        float(bool(re.match(r"(?:19|20)[0-9]{2}", value))), float(bool(re.search(r"(?:19|20)[0-9]{2}[./ -](?:19|20)[0-9]{2}$", value))),
        *(float(_has(words, near)) for words in CONTEXT.values()),
        *(float(_has(words, after)) for words in CONTEXT.values()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in (":", "#", "=")), float(after[:1] in ("%", "$", "€")),
    ]


def labelled_samples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of candidates in ``n`` sentences made from templates."""
    d = random.Random(seed)
    num = lambda k: "".join(d.choices("0123456789", k=k))
    low = lambda a, b: "".join(d.choices("abcdefghijklmnopqrstuvwxyz", k=d.randint(a, b)))
    up = lambda k: "".join(d.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=k))
    date = lambda a, b: d.choice(("{0}-{1:02}-{2:02}", "{2:02}/{1:02}/{0}", "{2:02}.{1:02}.{0}")).format(d.randint(a, b), d.randint(1, 12), d.randint(1, 28))
    local = lambda: d.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}-{num(4)}", num(10), f"0{num(d.randint(9, 11))}"))
    plain = lambda: " ".join(low(1, 9) for _ in range(d.randint(2, 8)))
    good = {
        "hidden_email": lambda: d.choice(("mail me: {}", "write to {}", "{}", "contact {}", "e-mail {}")).format(d.choice((f"{low(3, 8)} at {low(3, 8)} dot com", f"{low(3, 8)} (at) {low(3, 8)}.org", f"{low(3, 8)}[at]{low(3, 8)}.net", f"{low(3, 8)} at {low(3, 8)} [dot] org", f"{low(3, 8)} (At) {low(3, 8)}.org", f"{low(3, 8)} dot {low(3, 8)} at {low(3, 8)} dot org"))),
        "contact": lambda: d.choice(("phone {}", "call me at {}", "tel: {}", "Tel. {}", "mobile {}", "fax {}", "reach us on {}", "Telefon {}", "téléphone {}", "teléfono {}")).format(local()),
        "national_id": lambda: d.choice(("SSN {}", "SSN: {}", "social security number {}", "my social is {}", "taxpayer id {}")).format(f"{num(3)}-{num(2)}-{num(4)}") if d.random() < 0.7 else d.choice(("DNI {}", "NIF: {}", "national id {}")).format(num(8) + up(1)),
        "iban": lambda: d.choice(("IBAN {}", "account {}", "transfer to {}", "bank: {}", "{}")).format(d.choice(("DE", "FR", "ES", "GB", "NL")) + num(2) + "".join(d.choice(("", " ")) + num(4) for _ in range(d.randint(3, 5)))),
        "birth_date": lambda: d.choice(("born {}", "born on {}", "date of birth {}", "DOB: {}", "geboren am {}", "né le {}", "nacido el {}", "birthday {}")).format(date(1930, 2012)),
        "document_no": lambda: d.choice(("passport {}", "passport no. {}", "driver licence {}", "passeport {}", "Reisepass {}", "visa {}")).format(up(d.randint(1, 2)) + num(d.randint(6, 8))),
        "mac": lambda: d.choice(("mac {}", "MAC address {}", "device {}", "{}", "wifi adapter {}")).format(":".join(d.choice("0123456789abcdef") + d.choice("0123456789abcdef") for _ in range(6))),
    }
    bad = {
        "hidden_email": lambda: d.choice((f"we met at {low(3, 8)} dot {low(2, 5)}", f"look at {low(3, 8)}.{low(2, 4)} dot", f"{low(3, 8)} at {low(3, 8)}.{low(2, 4)}", f"read more at www.{low(3, 8)}.com")),
        "contact": lambda: d.choice(("order {}", "invoice {}", "page {}", "version {}", "score {}", "figure {}", "pp {}", "part {}", "serial {}", "model {}", "in {}", "{}", "total {}", "years {}", "ratio {}")).format(d.choice((f"{num(3)}-{num(3)}", f"{d.randint(1900, 2030)}-{d.randint(1900, 2030)}", f"{num(2)}.{num(2)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(4)}", f"{num(4)} {num(4)}", num(d.randint(7, 15)), local()))),
        "national_id": lambda: d.choice(("part {}", "order {}", "serial {}", "model {}", "sku {}", "case {}")).format(d.choice((f"{num(3)}-{num(2)}-{num(4)}", num(8) + up(1)))),
        "iban": lambda: d.choice(("model {}", "part {}", "serial {}", "sku {}")).format(up(2) + num(2) + " " + " ".join(up(4) for _ in range(3))),
        "birth_date": lambda: d.choice(("released {}", "published {}", "version {}", "updated {}", "on {}", "{}", "invoice {}", "since {}", "until {}", "build {}")).format(date(1990, 2030)),
        "document_no": lambda: d.choice(("order {}", "part {}", "model {}", "sku {}", "flight {}", "route {}", "RFC {}", "{}", "invoice {}", "article {}")).format(up(d.randint(1, 3)) + d.choice(("", "-", " ")) + num(d.randint(6, 9))),
        "mac": lambda: d.choice(("ratio {}", "score {}", "version {}", "times {}")).format(":".join(num(2) for _ in range(6))),
    }
    out = []
    for i in range(n):
        kind, label = ADDED_KINDS[i % len(ADDED_KINDS)], i // len(ADDED_KINDS) % 2
        text = f"{plain()}{d.choice(('. ', ', ', ' ', chr(10)))}{(good if label else bad)[kind]()}{d.choice((' ', '. ', ', ', chr(10)))}{plain()}"
        out += [(text, k, s, e, int(label and k == kind)) for k, s, e in candidates(text)]
    return out


@lru_cache(maxsize=2)
def train(n: int = SAMPLES, seed: int = 5) -> tuple[Boosted, tuple[float, float], dict[str, float]]:
    """Trees, calibration and the thresholds of the kinds, each from candidates that the others don't see:
    one half fits the trees, a quarter the calibration, a quarter the thresholds."""
    samples = labelled_samples(n, seed)
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in samples])
    y = np.array([label for *_, label in samples], float)
    part = np.arange(len(y)) % 4
    trees = Boosted().fit(x[part < 2], y[part < 2])
    scale = platt(trees.score(x[part == 2]), y[part == 2])
    last = part == 3
    p = sigmoid(scale[0] * trees.score(x[last]) + scale[1])
    kinds = np.array([k for _, k, *_ in samples])[last]
    return trees, scale, {k: least_threshold(p[kinds == k], y[last][kinds == k], PRECISION) for k in ADDED_KINDS}


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], model) -> dict[str, list[tuple[int, int]]]:
    """Accepted candidates by kind, the likeliest of those that overlap, clear of the base spans."""
    found = candidates(text)
    out: dict[str, list[tuple[int, int]]] = {}
    if not found:
        return out
    trees, (slope, offset), least = model
    p = sigmoid(slope * trees.score(np.array([features(text, *c) for c in found])) + offset)
    taken: list[tuple[int, int]] = []  # disjoint stretches
    for start, end in sorted(span for spans in base.values() for span in spans):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    for k in sorted((i for i in range(len(found)) if p[i] >= least[found[i][0]]), key=lambda i: (-p[i], found[i][1], -found[i][2])):
        kind, start, end = found[k]
        if free(taken, start, end):
            out.setdefault(kind, []).append((start, end))
    return out


def free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps none of those taken, which are disjoint; if so it joins them."""
    from bisect import bisect_left, insort

    at = bisect_left(taken, (end, -1))
    if at and taken[at - 1][1] > start:
        return False
    insort(taken, (start, end))
    return True


def all_spans(text: str, model) -> list[tuple[str, int, int]]:
    """Kind, start and end of everything found, by kind as listed, then start."""
    base = base_spans(text)
    added = added_spans(text, base, model)
    return [(k, s, e) for k in BASE_KINDS for s, e in base[k]] + [(k, s, e) for k in ADDED_KINDS for s, e in sorted(added.get(k, ()))]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark for each stretch of overlapping spans, named by its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced by marks; null texts stay null."""
    model = train()
    schema = docs.schema
    at = docs.columns.index(text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, all_spans(t, model)) for t in batch.column(at).to_pylist()]
            cols = [*batch.columns]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every text."""
    model = train()
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t or "", model)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import documents

    found = find(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
