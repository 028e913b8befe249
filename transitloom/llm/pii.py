"""Operator 7: personal data by a semi-Markov conditional random field beside fixed patterns.

The patterns of four kinds give the base spans. The random field then looks at regions of a
text that hold digits or an at-sign: it scores whole candidate segments by their composition,
checksums and surroundings, and a dynamic program over bounded segments chooses boundaries
and kinds together. What it finds besides the base spans is added: such as a phone number
without its plus, an account number that fails the checksum of cards, or a secret key. Base
spans never move: segments that touch one are left out of the program.

A segment is a candidate by its characters and its length alone; whether it is personal data
is the score's matter, in which features back off from a whole shape to digits, groups and
marks, so that a shape never seen is judged too. The weights are learned from a bounded
sample of regions: base spans are positive, as are variants and planted spans written by
rule; everything else there, and look-alikes written by rule, is negative. Regions with long
numbers or strings that no base span explains teach nothing, as nobody has labelled them.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, text_or_empty

#: The kinds of the fixed patterns, and those that the random field alone finds.
KINDS, MORE_KINDS = ["email", "ip", "card", "phone"], ["account", "secret"]
ALL_KINDS = KINDS + MORE_KINDS
Span = tuple[str, int, int]
#: Tokens of the longest segment, and of the longest secret.
LONGEST, LONGEST_SECRET = 20, 5
#: Digits of a candidate number, and characters of a candidate secret.
LEAST_DIGITS, MOST_DIGITS, LEAST_SECRET, MOST_SECRET = 7, 19, 16, 200
#: Characters before a segment that its features look at.
LEAD = 24
#: Characters of a sampled region, by default.
SAMPLE_CHARS = 400
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does: one that starts later in the run would end alike
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|\s+|.", re.S)
ANCHOR = re.compile(r"[0-9@]+")
NUMERIC = re.compile(r"[0-9]+|[ +().-]")
MAILISH = re.compile(r"[A-Za-z0-9]+|[._%+@-]")
KEYISH = re.compile(r"[A-Za-z0-9]+|[-_./+=]")
#: Words before a value that say what it is.
CUES = {
    "secret": "token key secret password passwd pwd api apikey auth bearer credential credentials",
    "phone": "tel telephone phone call mobile fax cell",
    "number": "card account acct iban no number",
    "address": "ip host addr address mail email",
}
_CUE = {word: kind for kind, text in CUES.items() for word in text.split()}
_LAST_WORD = re.compile(r"([A-Za-z]+)[\s\"'=:#(\[_-]*$")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append(("email", start, end))
        else:
            end = max(end, at + 1)  # nothing before this sign can belong to a later address
        at = text.find("@", end)
    found += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit or an at-sign, from white space to white space."""
    begin = end = -1
    for m in ANCHOR.finditer(text):
        if m.start() < end:
            continue
        left = m.start()
        while left > max(end, 0) and not text[left - 1].isspace():
            left -= 1
        right = m.end()
        while right < len(text) and not text[right].isspace():
            right += 1
        if begin >= 0 and left <= end + 1:
            end = right
        else:
            if begin >= 0:
                yield begin, end
            begin, end = left, right
    if begin >= 0:
        yield begin, end


def _class(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else "dot" if c in ".,;:!?" else "mark"


@lru_cache(maxsize=20_000)
def _lead(before: str) -> tuple[str, ...]:
    """What the characters before a segment tell: a cue word, an assignment."""
    word = _LAST_WORD.search(before)
    return (f"cue {_CUE.get(word[1].lower(), 'none') if word else 'none'}", f"assigned {bool(_ASSIGNED.search(before))}")


def _size(n: int) -> str:
    return str(n) if n < 20 else "20-39" if n < 40 else "40" if n == 40 else "41-63" if n < 64 else "64 or more"


@lru_cache(maxsize=50_000)
def segment_features(kind: str, segment: str, before: str, after: str) -> tuple[str, ...]:
    """Names of the features of a whole candidate segment; ``before`` holds up to LEAD characters."""
    groups = re.findall(r"[0-9]+", segment)
    digits, marks = "".join(groups), "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", segment))))
    found = ["bias", f"marks {marks}", f"before {_class(before[-1:])}", f"after {_class(after)}", *_lead(before)]
    if kind == "email":
        name, _, host = segment.partition("@")
        labels = host.split(".")
        found += [f"names {bool(name)} {segment.count('@')}", f"labels {min(4, len(labels))} {all(labels)}", f"last label {labels[-1].isalpha()} {min(6, len(labels[-1]))}"]
    elif kind == "secret":
        letters = len(segment) - len(digits) - len(re.sub(r"[0-9A-Za-z]", "", segment))
        turns = len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", segment))
        cases = f"{any(c.islower() for c in segment)}{any(c.isupper() for c in segment)}"
        found += [f"size {_size(len(segment))}", f"hex {bool(re.fullmatch('[0-9a-f]+|[0-9A-F]+', segment))}", f"cases {cases}", f"turns {min(8, 32 * turns // len(segment))}", f"digits {min(4, 8 * len(digits) // len(segment))}", f"letters {bool(letters)}"]
    else:
        shape = re.sub(r"[0-9]+", lambda m: str(len(m[0])), segment)
        octets = len(groups) == 4 and marks == "." and _octets(segment.split("."))
        n = len(digits)
        found += [f"shape {shape}", f"digits {n}", f"groups {min(6, len(groups))}", f"digits {n} in groups {min(6, len(groups))}", f"longest {max(map(len, groups))}", f"shortest {min(4, min(map(len, groups)))}"]
        found += [f"octets {octets}", f"luhn {13 <= n and luhn(digits)}", f"plus {segment[0] == '+'} {segment.count('+') > 1}", f"balanced {segment.count('(') == segment.count(')')}", f"touches {before[-1:].isalnum() or after.isalnum()}"]
    return tuple(f"{kind} {x}" for x in found)


class SemiMarkovField:
    """Weights of segment features; single tokens outside of segments score nothing."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def candidates(self, text: str, start: int, end: int, taken: list[tuple[int, int]] = ()) -> tuple[list[int], dict[int, list[tuple[int, str, tuple[str, ...]]]]]:
        """Token bounds of a region, and for each token the segments that end before it: (first token, kind, features).

        Segments that touch one of the sorted spans ``taken`` are none.
        """
        tokens = [(m[0], m.start()) for m in TOKEN.finditer(text, start, end)]
        bounds = [at for _, at in tokens] + [end]
        ending: dict[int, list] = defaultdict(list)
        for i, (first, at) in enumerate(tokens):
            numeric = first[0] in "+(" or "0" <= first[0] <= "9"
            mail = key = first.isalnum() and first.isascii()
            numbers = signs = 0
            for j in range(i, min(i + LONGEST, len(tokens))):
                token, to = tokens[j][0], bounds[j + 1]
                numeric = numeric and bool(NUMERIC.fullmatch(token)) and numbers <= MOST_DIGITS
                mail = mail and bool(MAILISH.fullmatch(token))
                key = key and j - i < LONGEST_SECRET and bool(KEYISH.fullmatch(token)) and to - at <= MOST_SECRET
                if not (numeric or mail or key) or (taken and _touches(taken, at, to)):
                    break
                numbers += len(token) if token[0].isdigit() and token.isdigit() else 0
                signs += token == "@"
                last = token[-1]
                kinds = []
                if numeric and last.isdigit() and LEAST_DIGITS <= numbers <= MOST_DIGITS:
                    kinds += ["ip", "card", "phone", "account"]
                if mail and signs and last.isalnum():
                    kinds.append("email")
                if key and last.isalnum() and to - at >= LEAST_SECRET and not (numeric and numbers):
                    kinds.append("secret")
                if kinds:
                    segment, before, after = text[at:to], text[max(0, at - LEAD) : at], text[to : to + 1]
                    ending[j + 1] += [(i, kind, segment_features(kind, segment, before, after)) for kind in kinds]
        return bounds, ending

    def score(self, features: tuple[str, ...]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def decode(self, text: str, start: int, end: int, taken: list[tuple[int, int]] = ()) -> list[Span]:
        """The segmentation of a region with the highest score."""
        bounds, ending = self.candidates(text, start, end, taken)
        if not ending:
            return []
        best, back = [0.0] * len(bounds), [None] * len(bounds)
        for j in range(1, len(bounds)):
            best[j] = best[j - 1]
            for i, kind, features in ending.get(j, ()):
                if (total := best[i] + self.score(features)) > best[j]:
                    best[j], back[j] = total, (i, kind)
        spans, j = [], len(bounds) - 1
        while j:
            if back[j]:
                i, kind = back[j]
                spans.append((kind, bounds[i], bounds[j]))
                j = i
            else:
                j -= 1
        return spans[::-1]

    def learn(self, cases: list[tuple[str, int, int, list[Span]]], epochs: int = 6, rate: float = 0.5, shrink: float = 1e-4, seed: int = 3) -> None:
        """Gradient ascent on the likelihood of the labelled segmentations of regions (text, start, end, spans)."""
        seen = []
        for text, start, end, spans in cases:
            bounds, ending = self.candidates(text, start, end)
            if ending:
                seen.append((bounds, ending, {(kind, a, b) for kind, a, b in spans}))
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(seen)
            for bounds, ending, wanted in seen:
                for features, step in self._gradient(bounds, ending, wanted):
                    for f in features:
                        old = self.weights.get(f, 0.0)
                        self.weights[f] = old + rate * (step / len(features) - shrink * old)

    def _gradient(self, bounds: list[int], ending: dict, wanted: set[Span]) -> list[tuple[tuple[str, ...], float]]:
        """For each segment, what it should have of the probability less what it has, by forward and backward sums."""
        n = len(bounds)
        scores = {j: [self.score(f) for _, _, f in ending[j]] for j in ending}
        forward, backward = [0.0] * n, [0.0] * n
        for j in range(1, n):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for (i, _, _), s in zip(ending.get(j, ()), scores.get(j, ()), strict=True))])
        starting = defaultdict(list)
        for j in ending:
            for (i, _, _), s in zip(ending[j], scores[j], strict=True):
                starting[i].append((j, s))
        for i in range(n - 2, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[j] + s for j, s in starting[i])])
        out = []
        for j in ending:
            for (i, kind, features), s in zip(ending[j], scores[j], strict=True):
                out.append((features, ((kind, bounds[i], bounds[j]) in wanted) - math.exp(forward[i] + s + backward[j] - forward[-1])))
        return out


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def _touches(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, disjoint spans meets [start, end)."""
    at = bisect_left(taken, (end, -1))
    return at > 0 and taken[at - 1][1] > start


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans of any kinds cover, as sorted disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digits(rng: random.Random, n: int, passes: bool | None = None) -> str:
    while True:
        made = "".join(rng.choices("0123456789", k=n))
        if passes is None or luhn(made) == passes:
            return made


def _grouped(digits: str, size: int, mark: str) -> str:
    return mark.join(digits[k : k + size] for k in range(0, len(digits), size))


def _phone(rng: random.Random) -> str:
    d = _digits(rng, 12)
    plain = [f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"{d[:3]}.{d[3:6]}.{d[6:10]}", f"{d[:3]} {d[3:6]} {d[6:10]}", f"1-{d[:3]}-{d[3:6]}-{d[6:10]}", f"00{d[:2]} {d[2:5]} {d[5:12]}", f"0{d[:3]} {d[3:10]}"]
    return rng.choice(plain)


def _secret(rng: random.Random) -> str:
    size = rng.choice([20, 24, 32, 40, 40, 48, 64])
    letters = rng.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789"])
    while True:
        made = "".join(rng.choices(letters, k=size))
        if re.search("[0-9]", made) and re.search("[A-Za-z]", made):
            return rng.choice(["", "", "", "sk-", "key_"]) + made


def _look_alike(rng: random.Random) -> str:
    """Numbers and strings that nobody owns: dates, times, amounts, versions, ranges, measures, identifiers of things."""
    d = lambda n: _digits(rng, n)
    return rng.choice([
        f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)} 1{d(1)}:3{d(1)}:0{d(1)}", f"20{d(2)}-0{d(1)}-2{d(1)}T1{d(1)}:2{d(1)}:0{d(1)}.{d(6)}", f"{d(3)},{d(3)},{d(3)}.00", f"3.{d(9)}", f"0.{d(14)}", f"{d(4)}-{d(4)}",
        f"v{d(1)}.{d(2)}.{d(3)}", f"10.0.1{d(4)}.{d(3)}", f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", f"{d(7)}", f"{d(8)}", f"{d(10)}", " ".join(d(1) for _ in range(9)), " ".join(d(2) for _ in range(8)), " ".join(d(4) for _ in range(2)), f"{d(5)} - {d(5)}",
        "internationalisation20", f"counterrevolutionary-{d(4)}", f"chapter-{d(2)}-of-the-second-volume", f"figure_{d(2)}_of_section_{d(3)}.png", f"windows-server-20{d(2)}-update", d(30), f"page {d(3)} of {d(4)}", f"{d(1)}.{d(4)} 20{d(2)}-0{d(1)}", f"{d(2)}.{d(2)} {d(3)}.{d(2)} {d(1)}.{d(3)}", f"20{d(2)}-1{d(1)} {d(3)}.{d(1)}", f"{d(3)}@{d(2)}",
    ])


def _variants(text: str, start: int, end: int, spans: list[Span], rng: random.Random) -> Iterator[tuple[str, int, int, list[Span]]]:
    """The same region with its first span written another way, made another kind, or made a look-alike; without spans, with one planted."""
    kind, a, b = spans[0] if spans else ("", end, end)
    whole = text[a:b]
    others: list[tuple[str, str, str]] = []  # lead, value, kind
    if kind == "phone":  # without the plus, or the country code too
        others = [("", whole[1:], kind), ("", re.sub(r"^\+[0-9]+ ?", "", whole), kind)]
    elif kind == "card":
        digits = re.sub("[^0-9]", "", whole)
        others = [("", _grouped(digits, 4, "-"), kind), ("", _grouped(digits, 4, "."), kind)]
    number = _digits(rng, rng.choice([12, 14, 15, 16, 16, 16, 18, 19]), False)
    others += [("", _phone(rng), "phone"), ("", rng.choice([number, number, _grouped(number, 4, " "), _grouped(number, 4, "-")]), "account")]
    cue = rng.choice([w for w in CUES["secret"].split()])
    others += [(rng.choice([f'{cue} = "', f"{cue}: ", f"{cue}=", f"{cue.upper()} = '", ""]), _secret(rng), "secret"), ("", _look_alike(rng), ""), ("", _look_alike(rng), "")]
    for lead, value, other in others:
        gap = "" if spans or text[a - 1 : a].isspace() or not a else " "
        left = text[:a] + gap + lead
        quote = lead[-1:] if lead[-1:] in "\"'" else ""
        yield left + value + quote + text[b:], start, len(left) + len(value) + len(quote) + end - b, [(other, len(left), len(left) + len(value))] if other else []


def _explained(field: SemiMarkovField, text: str, start: int, end: int, spans: list[Span]) -> bool:
    """Whether base spans cover all that could be a number or a secret of someone."""
    _, ending = field.candidates(text, start, end, _covered(spans))
    return not any(kind in ("account", "secret") for rows in ending.values() for _, kind, _ in rows)


def sampled_regions(docs: DataFrame, text_col: str, sample: int, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, int, int]]:
    """The ``sample`` regions of smallest hash, with their surroundings: (text, start, end). A task sends on as many at most."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[str, int, int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for start, end in regions(text):
                    end = min(end, start + sample_chars)
                    a = max(0, start - LEAD)
                    row = (text[a : end + 1], start - a, end - a)
                    kept[xxhash.xxh64_intdigest(row[0]) >> 1] = row
                if len(kept) > 4 * sample:
                    kept = dict(heapq.nsmallest(sample, kept.items()))
        least = heapq.nsmallest(sample, kept.items())
        columns = [pa.array([h for h, _ in least], pa.int64()), *(pa.array([row[k] for _, row in least], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32())))]
        yield pa.RecordBatch.from_arrays(columns, ["h", "region", "start", "end"])

    read = docs.select(text_or_empty(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    chosen = read.mapInArrow(pick, "h long, region string, start int, end int").dropDuplicates(["h", "region", "start", "end"]).orderBy("h", "region", "start", "end").limit(sample)
    return [(r.region, r.start, r.end) for r in chosen.collect()]


def learn_field(docs: DataFrame, text_col: str, sample: int, sample_chars: int = SAMPLE_CHARS) -> SemiMarkovField:
    """Learned from ``sample`` regions at most, chosen by a hash of their texts, and as many look-alikes and planted spans."""
    field, cases, rng = SemiMarkovField(), [], random.Random(11)
    found = sampled_regions(docs, text_col, sample, sample_chars)
    found += [("", 0, 0)] * max(0, min(sample, 200) - len(found))  # a small corpus teaches by rule alone
    for text, start, end in found:
        spans = sorted((s for s in base_spans(text) if start <= s[1] and s[2] <= end), key=lambda s: (s[1], -s[2]))
        apart = [s for k, s in enumerate(spans) if all(s[1] >= t[2] for t in spans[:k])]
        if _explained(field, text, start, end, apart):
            cases.append((text, start, end, apart))
            cases += _variants(text, start, end, apart, rng)
    field.learn(cases)
    return field


def find_private(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 1500, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, spans): spans array<struct<kind, start, end, base, value>>, by kind as in ALL_KINDS and then start.

    start and end are code points, end exclusive; base tells the fixed patterns' spans from
    those that the random field adds, which overlap none of them. Null and empty texts have
    none, and so has every text without digits and at-signs. Ids may be null or repeat. An
    empty table gives none. Whole texts are searched, in time linear in their length. What the
    field adds hangs on the sample of regions, which the table's texts alone decide: ``sample``
    of them at most, of which ``sample_chars`` characters teach; all regions are searched whole.
    """
    bounded_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(learn_field(docs, text_col, sample, sample_chars).weights)
    order = {kind: k for k, kind in enumerate(ALL_KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiMarkovField()
        own.weights = field.value
        for batch in batches:
            lists = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if ANCHOR.search(text) else []
                taken = _covered(base)
                added = [s for start, end in regions(text) for s in own.decode(text, start, end, taken)]
                spans = sorted([(order[k], a, b, True) for k, a, b in base] + [(order[k], a, b, False) for k, a, b in added])
                lists.append([{"kind": ALL_KINDS[k], "start": a, "end": b, "base": fixed, "value": text[a:b]} for k, a, b, fixed in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], ["id", "spans"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,value:string>>").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
