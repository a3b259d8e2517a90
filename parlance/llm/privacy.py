"""Personal data: base patterns that always count, and more spans that boosted trees accept.

Base spans follow fixed patterns per kind, leftmost and non-overlapping, and a match that fails its
check is dropped. High-recall generators then propose further, overlapping spans: written-out or
broken addresses, numbers in looser groupings, addresses with colons. Every proposal gets features
of its format and of what stands around it. Gradient-boosted trees learn from all texts how such
spans look: positives are base spans and the same spans written out, regrouped or without their plus, where
they stand; negatives are other proposals, except those that may well be such a form themselves. A threshold
per kind, set for a precision on the made forms and negatives of a third of the texts, which the trees do not learn from,
selects which proposals join the base spans.

Patterns are cut so that no text takes more than linear time.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import boxed, plain, slices, staged

KINDS = ("email", "ip", "card", "phone")

# The base patterns: fixed values.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# What the generators look for, looser than the base patterns.
_AT = re.compile(r"@|\(at\)|\[at\]| at (?=[\w-]{1,63} dot )")
_WIDE_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:(?:\.| dot |\(dot\)|\[dot\])[A-Za-z0-9-]{1,63}){0,5}")
_WIDE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\s?$")
_DIGITS = re.compile(r"\(?\+?[0-9](?:[\x20\t()./-]{0,2}[0-9]){6,24}")
_QUAD = re.compile(r"[0-9]{1,4}(?:\x20?(?:\[\.\]|\(\.\)|[.,])\x20?[0-9]{1,4}){3}")
_COLONS = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
# Words before a span that speak for it, in four languages.
_CUES = {"email": re.compile(r"mail|contact|write|schreib|correo|écri", re.I),
         "ip": re.compile(r"\bip\b|host|server|address|adres", re.I),
         "card": re.compile(r"card|visa|karte|carte|tarjeta|payment", re.I),
         "phone": re.compile(r"phone|call|tel\b|mobile|ruf|appel|llam|fax", re.I)}
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "length", "digits", "signs", "groups", "longest_group",
            "shortest_group", "plus", "brackets", "dots", "dashes", "spaces", "colons", "at_sign", "word_before",
            "word_after", "digit_before", "digit_after", "quote_near", "equals_before", "cue", "letters", "hex_letters", "check"]

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done, "email"
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end, "ip"
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    found: list[Span] = list(_emails(text))
    found += _addresses(text)
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap, and one place can be proposed as two kinds."""
    found: set[Span] = set()
    for m in _AT.finditer(text):
        before = _WIDE_LOCAL.search(text, max(0, m.start() - 66), m.start())
        after = _WIDE_DOMAIN.match(text, m.end())
        if before and after:
            found.add((before.start(), after.end(), "email"))
    for pattern in (_QUAD, _COLONS):
        found.update((m.start(), m.end(), "ip") for m in pattern.finditer(text))
    for m in _DIGITS.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if digits <= 15:
            found.add((m.start(), m.end(), "phone"))
        if 12 <= digits <= 19:
            found.add((m.start(), m.end(), "card"))
    return sorted(found, key=_order)


def span_features(text: str, span: Span) -> list[float]:
    """Format and context of a span, in the order of ``FEATURES``."""
    start, end, kind = span
    body = text[start:end]
    before, after = text[start - 1:start] if start else "", text[end:end + 1]
    context = text[max(0, start - 40):start]
    groups = [len(g) for g in re.findall("[0-9]+", body)] or [0]
    return [float(x) for x in (
        *(kind == k for k in KINDS), len(body), sum(c.isdigit() for c in body),
        sum(not c.isalnum() for c in body), len(groups), max(groups), min(groups), body[:2].count("+"), body.count("("),
        body.count("."), body.count("-"), body.count(" "), body.count(":"), body.count("@"), before.isalpha(),
        after.isalpha(), before.isdigit(), after.isdigit(), '"' in context[-12:] + after or "'" in context[-12:] + after,
        "=" in context[-12:], _CUES[kind].search(context) is not None, sum(c.isalpha() for c in body),
        sum(c in "abcdefABCDEF" for c in body), _checks(body, kind))]


def _checks(body: str, kind: str) -> bool:
    """Whether a span, read without its disguise, passes what its kind asks for."""
    if kind == "email":
        written = re.sub(r"\(at\)|\[at\]| at ", "@", body)
        written = re.sub(r"\(dot\)|\[dot\]| dot ", ".", written).replace(" ", "")
        return base_spans(written)[:1] == [(0, len(written), "email")]
    if kind == "ip":
        written = re.sub(r"[\[\]() ]", "", body).replace(",", ".")
        try:
            return ":" in written and bool(ipaddress.ip_address(written)) or all(int(p) <= 255 for p in written.split("."))
        except ValueError:
            return False
    digits = "".join(c for c in body if c in "0123456789")
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _disguised(body: str, kind: str) -> str:
    """A base span in a form that only the generators see; which one is a hash of it."""
    turn = zlib.crc32(body.encode())
    if kind == "email":
        local, domain = body.split("@", 1)
        forms = [f"{local} (at) {domain}", f"{local}(at){domain}", f"{local}[at]{domain}", f"{local} at {domain.replace('.', ' dot ')}",
                 f"{local} [at] {domain.replace('.', '[dot]')}", f"{local} @ {domain}"]
    elif kind == "ip":
        a, b, c, d = (int(p[-4:]) for p in body.split("."))
        forms = [body.replace(".", "[.]"), body.replace(".", "(.)"), body.replace(".", " . "), f"2002:{a:02x}{b:02x}:{c:02x}{d:02x}::1",
                 f"2001:db8:{a:x}:{b:x}:{c:x}:{d:x}:{turn & 0xffff:x}:1"]
    else:
        digits = "".join(c for c in body if c in "0123456789")
        if kind == "card":
            forms = [sign.join(digits[i:i + 4] for i in range(0, len(digits), 4)) for sign in (".", "/", "  ")]
        else:
            forms = [body[1:], "00" + body[1:], digits, f"{digits[:2]}/{digits[2:5]}/{digits[5:]}", f"({digits[:3]}) {digits[3:]}"]
    return forms[turn % len(forms)]


def lessons(text: str) -> list[dict]:
    """What a text teaches: kind, start, label, features, and whether it is a proposal that could be added."""
    base, more = scan_text(text)
    out = []
    for m in more:
        span = m["start"], m["end"], m["kind"]
        # A form that passes its check may be personal data, as may a number behind a cue: it teaches nothing.
        unknown = m["weak"] == 0 and _checks(text[span[0]:span[1]], span[2]) and (
            span[2] != "phone" or _CUES["phone"].search(text, max(0, span[0] - 40), span[0]))
        if not unknown:
            out.append({"kind": span[2], "start": span[0], "y": float(m["weak"] == 1), "free": m["weak"] != 1, "features": m["features"]})
    for start, end, kind in base:
        form = _disguised(text[start:end], kind)
        head = text[max(0, start - 80):start]
        window = head + form + text[end:end + 80]
        low, high = len(head), len(head) + len(form)
        if any(a < high and low < b for a, b, _ in base_spans(window)):
            continue
        found = [p for p in proposals(window) if p[2] == kind and p[0] < high and low < p[1]]
        if found:
            best = max(found, key=lambda p: min(p[1], high) - max(p[0], low))
            out.append({"kind": kind, "start": start, "y": 1.0, "free": True, "features": span_features(window, best)})
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_WIDE = pa.struct([*_SPAN, ("weak", pa.int32()), ("features", pa.list_(pa.float64()))])
_LESSONS = pa.schema([("_row", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("y", pa.float64()), ("free", pa.bool_()),
                      ("features", pa.list_(pa.float64()))])
_SCAN = ("n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,end:int,kind:string>>, "
         "more array<struct<start:int,end:int,kind:string,weak:int,features:array<double>>>")
_NEEDED = re.compile(r"[0-9@]|\(at\)|\[at\]| at ")


def scan_text(text: str) -> tuple[list[Span], list[dict]]:
    """Base spans, and proposals with features; ``weak`` is 1 where a base span of the kind overlaps."""
    if not _NEEDED.search(text):
        return [], []
    base = base_spans(text)
    more = []
    for span in proposals(text):
        overlap = [b[2] for b in base if b[0] < span[1] and span[0] < b[1]]
        more.append({"start": span[0], "end": span[1], "kind": span[2],
                     "weak": 1 if span[2] in overlap else 2 if overlap else 0, "features": span_features(text, span)})
    return base, more


def _scanned(rows: DataFrame) -> DataFrame:
    """Rows (_row, _t) with counts, base spans and proposals instead of the text; ``_row`` is of any type."""
    def run(batches):
        for batch in batches:
            base, more, counts = [], [], {k: [] for k in KINDS}
            for text in plain(batch, "_t").to_pylist():
                b, m = scan_text(text)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
                more.append(m)
                for kind in KINDS:
                    counts[kind].append(sum(k == kind for _, _, k in b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *[pa.array(counts[k], pa.int64()) for k in KINDS],
                 pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_WIDE))],
                ["_row", *[f"n_{k}" for k in KINDS], "base", "more"])

    kind = rows.schema["_row"].dataType.simpleString()
    return rows.select("_row", "_t").mapInArrow(run, f"_row {kind}, {_SCAN}")


@dataclass(frozen=True)
class SpanModel:
    """Trees and the least probability per kind; a kind without a threshold accepts nothing."""

    trees: Any
    thresholds: dict[str, float]


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", precision: float = 0.95,
        least_spans: int = 30, trees: int = 15, depth: int = 4) -> SpanModel:
    """Learns from every text that teaches something.

    A third of them, by a hash of the key, sets the thresholds, and the others the trees: per kind the smallest
    probability from which on made forms and negatives reach ``precision`` with ``least_spans`` spans. Every lesson counts in
    choosing the splits of the trees; MLlib proposes their values, 31 a feature at most, from at least 10 000 lessons.
    """
    place = F.pmod(F.xxhash64(F.lit("privacy"), F.col(key)), F.lit(1 << 32))
    useful = docs.filter(F.col(text).rlike(_NEEDED.pattern)).select(place.alias("_row"), F.col(text).alias("_t"))

    def teach(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                taught = [(row, lesson) for row, t in zip(part.column("_row").to_pylist(), plain(part, "_t").to_pylist()) for lesson in lessons(t)]
                yield pa.RecordBatch.from_pylist([{"_row": row, **lesson} for row, lesson in taught], _LESSONS)

    taught = useful.mapInArrow(teach, "_row long, kind string, start int, y double, free boolean, features array<double>")
    # In an order of their own, so that equal tables give equal trees.
    spans = staged(taught.select((F.col("_row") % 3 == 0).alias("_c"), "kind", F.col("y").alias("_y"), F.col("free").alias("_free"), "features",
                                 "start", "_row").orderBy("features", "_y", "start", "_row"), "privacy-lessons")
    rows = spans.select("_c", "kind", "_y", "_free", array_to_vector("features").alias("features"))
    if {r["_y"] for r in rows.filter("NOT _c").select("_y").distinct().collect()} != {0.0, 1.0}:
        return SpanModel(None, {})
    model = GBTClassifier(labelCol="_y", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3,
                          minInstancesPerNode=10, seed=7).fit(rows.filter("NOT _c"))
    # Probabilities in 200 steps, so that the counts are a bounded table.
    steps = (model.transform(rows.filter("_c AND _free")).groupBy("kind", F.floor(_probability() * 200).alias("step"))
             .agg(F.sum("_y").alias("good"), F.count(F.lit(1)).alias("n")).collect())
    thresholds = {}
    for kind in KINDS:
        good = n = 0
        for row in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            good, n = good + row["good"], n + row["n"]
            if n >= least_spans and good >= precision * n:
                thresholds[kind] = row["step"] / 200
    return SpanModel(model, thresholds)


def _probability() -> Column:
    return vector_to_array(F.col("probability"))[1]


def find(docs: DataFrame, model: SpanModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_email, n_ip, n_card, n_phone (base spans), base and spans.

    ``base`` and ``spans`` are arrays of (start, end, kind) by start, then kind as in ``KINDS``; positions count
    code points and ends are exclusive. ``spans`` holds the base spans and the accepted proposals, which
    overlap neither a base span nor each other (the likelier one wins, then the earlier, then the longer).
    Null and empty texts have none. Repeated rows repeat.
    """
    row = F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("id")).alias("_row")
    found = staged(_scanned(docs.select(row, F.col(text).alias("_t"))).select(
        "_row.key", F.col("_row.id").alias("_row"), *[f"n_{k}" for k in KINDS], "base", "more"), "privacy-scan")
    base = found.select(F.col("key").alias(key), "_row", *[f"n_{k}" for k in KINDS], "base")
    if not model.thresholds:
        return base.withColumn("spans", F.col("base")).drop("_row")
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in model.thresholds.items()])
    more = (found.select("_row", F.explode(F.filter("more", lambda s: s["weak"] == 0)).alias("s"))
            .select("_row", "s.start", "s.end", "s.kind", array_to_vector("s.features").alias("features")))
    accepted = model.trees.transform(more).select("_row", "start", "end", "kind", _probability().alias("p")).filter(
        F.col("p") >= least)
    # One row holds the accepted spans of one text.
    ranked = accepted.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("p")).alias("p"), "start", (-F.col("end")).alias("minus_end"), "kind"))).alias("_found"))
    chosen = ranked.select("_row", F.aggregate(
        "_found", F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < -s["minus_end"]) & (s["start"] < k["end"])), kept).otherwise(
            F.concat(kept, F.array(F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end"), s["kind"].alias("kind")))))
    ).alias("_more"))
    both = F.concat(F.col("base"), F.coalesce(F.col("_more"), F.array()))
    ordered = F.array_sort(both, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(
        (_place(a["kind"]) - _place(b["kind"])).cast("int")))
    return base.join(chosen, "_row", "left").withColumn("spans", ordered).drop("_row", "_more")


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by its kind in brackets; keys must be unique in ``found``."""
    @F.arrow_udf("string")
    def covered(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, every in zip(texts.to_pylist(), spans.to_pylist()):
            parts, done = [], 0
            for s in every or []:
                if t is not None and s["start"] >= done:
                    parts += [t[done:s["start"]], f"[{s['kind'].upper()}]"]
                    done = s["end"]
                elif t is not None:
                    done = max(done, s["end"])  # an overlapping span of another kind
            out.append(None if t is None else "".join(parts) + t[done:])
        return pa.array(out, pa.string())

    spans = found.select(F.col(key).alias("_k"), F.col("spans").alias("_spans"))
    joined = boxed(docs, _key=F.col(key), _t=F.col(text)).join(spans, F.col("_key").eqNullSafe(F.col("_k")), "left")
    made = joined.select("_row", covered("_t", "_spans").alias("_made"))
    return made.select(*[(F.col("_made") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
