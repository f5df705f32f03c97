"""Personal data: patterns, and a semi-Markov conditional random field that adds to them.

The patterns give the base spans. The field works on stretches of text that hold digits or an @: its
segments are whole spans of up to MOST_TOKENS tokens, scored by features of the whole span (how many
digits, how grouped, check digits, what stands before), for every kind at once. One pass of dynamic
programming over a stretch chooses boundaries and kinds together; base spans are fixed, and a segment
is added only if it outweighs "no entity" by a margin. Kinds of neighbouring segments are scored too.

What the patterns find needs no field; it is there for the spellings that they miss: telephone numbers
without a plus sign, cards with dots, addresses of other alphabets. So it is trained on base spans that are spelt
anew (`respelt`), against stretches of the corpus without base spans and numbers that only look alike
(`lookalike`: dates, sums, versions, book numbers). The sample is at most TRAIN_STRETCHES stretches of at
most TRAIN_TOKENS tokens: digests deal all stretches into so many classes, and the least of each class is taken. That
sample is bounded by the parameter, whatever the corpus; everything else reads every text whole. A fifth of
it is held out, and the margin is the least at which PRECISION of the spans found there are right.

Defined cases: a null text is empty and has no spans. Segments are of at most MOST_TOKENS
tokens, for the field only. Of equal starts the kinds go in the order listed. Repeated rows each get their row. An empty table trains nothing and gives an empty result.
Extra columns are not read; `redact` carries those of the documents through.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# As in the contract; what stands before only says that a run of digits is tried from its first one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Parameters.
MOST_TOKENS = 6
GAP_TOKENS = 2
TRAIN_STRETCHES = 800
TRAIN_TOKENS = 40
EPOCHS = 4
SPELLINGS = 2
LOOKALIKES = 1
PRECISION = 0.98
MARGINS = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]
BATCH = 512

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, ordered by start and then kind."""
    spans = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# -- stretches, segments and features -----------------------------------------
TOKEN = re.compile(r"\S+")
SIGNAL = re.compile(r"[0-9@]")
HULL = "\"'<>[]{},;:!?"
TAIL = HULL + ".%&*#$|"


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens that begin and end with a digit or @ inside, with few others between.

    Only the neighbourhood of such characters is cut into tokens.
    """
    run: list[tuple[int, int]] = []
    pending: list[tuple[int, int]] = []
    at = 0
    while True:
        found = SIGNAL.search(text, at)
        if not found:
            break
        start = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, start).end()
        pending = []
        if run:
            for token in TOKEN.finditer(text, run[-1][1], start):
                pending.append(token.span())
                if len(pending) > GAP_TOKENS:
                    break
            if len(pending) > GAP_TOKENS:
                yield run
                run = []
            else:
                run += pending
        run.append((start, end))
        at = end
    if run:
        yield run


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in HULL:
        start += 1
    while end > start and text[end - 1] in TAIL:
        end -= 1
    return start, end


def features(text: str, start: int, end: int, tokens: int, before: str) -> list[str]:
    """Of one candidate span as a whole."""
    span = text[start:end]
    digits = _digits(span)
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    size = next((f"d<={k}" for k in (0, 2, 4, 8, 11, 12, 15, 16, 19) if n <= k), "d>19")
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d]+", "a", span))
    found = ["bias", size, f"tokens={tokens}", f"letters={'none' if not letters else 'few' if letters < n else 'many'}", f"before={before}"]
    if len(shape) <= 16:
        found.append(f"shape={shape}")
    if "@" in span:
        domain = span.rpartition("@")[2]
        found.append(f"at={span.count('@')},{'dotted' if '.' in domain.strip('.') else 'plain'},{'local' if span[0] != '@' else 'bare'}")
    if span.startswith("+"):
        found.append(f"plus,{size}")
    if n and not letters:
        groups = [len(g) for g in re.findall(r"\d+", span)]
        marks = "".join(sorted(set(re.sub(r"\d", "", span))))
        found += [f"marks={marks}", f"groups={','.join(map(str, groups[:6]))}", f"head={span[0] if not span[0].isdigit() else '00' if span.startswith('00') else '0' if span[0] == '0' else '9'}"]
        found.append(f"widest={max(groups)},{len(groups)},{marks}")
    elif "@" in span:
        found.append(f"domain={'plain' if DOMAIN.fullmatch(span.rpartition('@')[2]) else 'other'}")
    groups = span.split(".")
    if len(groups) == 4 and all(g.isascii() and g.isdigit() for g in groups):
        found.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "beyond octets")
    if 12 <= n <= 19 and not letters:
        found.append("luhn" if luhn(digits) else "not luhn")
    return found


def possible(text: str, start: int, end: int) -> list[int]:
    """The kinds a span can be at all: a card has its check digit, an address its parts."""
    span = text[start:end]
    digits = _digits(span)
    plain = not any(c.isalpha() for c in span)
    groups = span.split(".")
    local, at, domain = span.rpartition("@")
    may = {
        "email": bool(local and at and "." in domain.strip(".")),
        "ip": len(groups) == 4 and all(g.isascii() and g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups),
        "card": plain and 12 <= len(digits) <= 19 and luhn(digits),
        "phone": plain and "@" not in span and 9 <= len(digits) <= 15,
    }
    return [k for k, kind in enumerate(KINDS) if may[kind]]


def _candidates(text: str, run: list[tuple[int, int]], fixed: list[Span]) -> list[list[tuple[int, int, int, list[str], list[int]]]]:
    """For each end token: (first token, start, end, features, kinds) of every segment that may end there."""
    signal = [bool(SIGNAL.search(text, *t)) for t in run]
    ends: list[list] = [[] for _ in run]
    words = text[max(0, run[0][0] - 40) : run[0][0]].split()
    left = words[-1].lower().strip(HULL + ".=") if words else "^"
    for j, last in enumerate(run):
        if not signal[j]:
            continue
        for i in range(max(0, j - MOST_TOKENS + 1), j + 1):
            if not signal[i]:
                continue
            start, end = _trimmed(text, run[i][0], last[1])
            if start >= end or any(s < end and start < e for _, s, e in fixed):
                continue
            kinds = possible(text, start, end)
            if not kinds:
                continue
            before = left if i == 0 else text[slice(*run[i - 1])].lower().strip(HULL + ".=")
            ends[j].append((i, start, end, features(text, start, end, j - i + 1, before if before.isalpha() and len(before) < 12 else "*"), kinds))
    return ends


# -- examples -------------------------------------------------------------------
Example = tuple[str, list[tuple[int, int]], list[Span]]  # a text, its stretch, and the spans in it
UMLAUTS = {"a": "ä", "e": "é", "i": "í", "o": "ö", "u": "ü"}


def _grouped(digits: str, sizes: list[int], mark: str) -> str:
    parts, at = [], 0
    for size in sizes:
        parts.append(digits[at : at + size])
        at += size
    return mark.join([p for p in [*parts, digits[at:]] if p])


def respelt(kind: str, span: str, draw: random.Random) -> str:
    """The same datum as people write it where the patterns do not look."""
    digits = _digits(span)
    if kind == "phone":
        national = digits[-10:]
        return draw.choice(
            [
                f"({national[:3]}) {_grouped(national[3:], [3], '-')}",
                _grouped(national, [3, 3], draw.choice("-. ")),
                "00" + _grouped(digits, [2, draw.choice([2, 3])], draw.choice(" -")),
                "+" + _grouped(digits, [2, 3], "/"),
                "0" + _grouped(national, [2, draw.choice([3, 4])], draw.choice(" -/")),
            ]
        )
    if kind == "card":
        return _grouped(digits, [4, 4, 4], draw.choice("./_:"))
    if kind == "email":
        name, _, domain = span.rpartition("@")
        places = [k for k, c in enumerate(domain.split(".")[0]) if c in UMLAUTS]
        k = draw.choice(places) if places else 0
        return f"{name}@{domain[:k]}{UMLAUTS.get(domain[k], 'ø')}{domain[k + 1 :]}"
    return span


def lookalike(draw: random.Random) -> str:
    """A number that is nobody's."""
    some = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    year, month, day = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 28)
    return draw.choice(
        [
            f"{year}-{month:02d}-{day:02d} {draw.randint(0, 23):02d}:{draw.randint(0, 59):02d}:{draw.randint(0, 59):02d}",
            f"{year}{month:02d}{day:02d}{some(draw.randint(1, 7))}",
            f"{day:02d}.{month:02d}.{year} {day:02d}/{month:02d}/{year}",
            f"{some(3)},{some(3)},{some(3)}.{some(2)}",
            f"978-{some(1)}-{some(2)}-{some(6)}-{some(1)}",
            f"{year}-{year + draw.randint(1, 9)}",
            f"{some(1)}.{some(draw.randint(9, 14))}",
            f"{some(2)}.{some(2)}.{some(3)}.{some(4)}",
            f"#{some(draw.randint(9, 16))}",
            some(draw.randint(9, 19)),
            " ".join(some(draw.randint(1, 5)) for _ in range(4)),
            f"v{some(1)}.{some(2)}.{some(1)}-{some(8)}",
        ]
    )


def variants(example: Example, draw: random.Random) -> Iterator[Example]:
    """The example, and its spans spelt anew, or a number in the place of a span."""
    text, run, gold = example
    yield example
    if not gold:
        if draw.random() < 0.5:
            yield from _with(text, [(None, *run[draw.randrange(len(run))])], [lookalike(draw)])
        return
    for _ in range(SPELLINGS):
        yield from _with(text, gold, [respelt(kind, text[s:e], draw) for kind, s, e in gold])
    for _ in range(LOOKALIKES):
        yield from _with(text, [(None, s, e) for _, s, e in gold], [lookalike(draw) for _ in gold])


def _with(text: str, spans: list, written: list[str]) -> Iterator[Example]:
    """The text with other writings in place of some spans, which keep their kinds; each stretch is an example."""
    parts, gold, at, size = [], [], 0, 0
    for (kind, start, end), new in zip(spans, written):
        if start < at:
            return  # spans that overlap stay as they are
        parts += [text[at:start], new]
        size += start - at
        if kind is not None:
            gold.append((kind, size, size + len(new)))
        size, at = size + len(new), end
    made = "".join([*parts, text[at:]])
    for run in stretches(made):
        held = [g for g in gold if run[0][0] <= g[1] and g[2] <= run[-1][1]]
        base = [] if held else [s for s in base_spans(made) if run[0][0] <= s[1] and s[2] <= run[-1][1]]
        if len(run) <= TRAIN_TOKENS:
            yield made, run, held or base


# -- the field ------------------------------------------------------------------
class Field:
    """Weights by feature and kind, and by the kinds of neighbouring segments, and what a span must outweigh."""

    def __init__(self, weights: dict[str, list[float]] | None = None, margin: float = MARGINS[-1]):
        self.weights = weights or {}
        self.margin = margin

    def scores(self, found: list[str]) -> list[float]:
        rows = [self.weights[f] for f in found if f in self.weights]
        return [sum(r[k] for r in rows) for k in range(len(KINDS))] if rows else [0.0] * len(KINDS)

    def _after(self, kind: int) -> list[float]:
        return self.weights.get(f"after={kind}", [0.0] * len(KINDS))

    def decode(self, ends: list[list]) -> list[Span]:
        """The best segmentation: over tokens, and over the kind (or none) that was last."""
        none = len(KINDS)
        best = [[0.0 if k == none else -math.inf for k in range(none + 1)]]
        back: list[list] = [[None] * (none + 1)]
        for j, segments in enumerate(ends):
            row, trace = [-math.inf] * (none + 1), [None] * (none + 1)
            k = max(range(none + 1), key=lambda k: best[j][k])
            row[none], trace[none] = best[j][k], (j, k, None)
            for i, start, end, found, kinds in segments:
                scores = self.scores(found)
                for last in range(none + 1):
                    if best[i][last] == -math.inf:
                        continue
                    turn = self._after(last)
                    for kind in kinds:
                        value = best[i][last] + scores[kind] + turn[kind] - self.margin
                        if value > row[kind]:
                            row[kind], trace[kind] = value, (i, last, (KINDS[kind], start, end))
            best.append(row)
            back.append(trace)
        spans, j = [], len(ends)
        k = max(range(none + 1), key=lambda k: (best[j][k], k))
        while j:
            j, k, span = back[j][k]
            if span:
                spans.append(span)
        return spans[::-1]

    def _learn(self, ends: list[list], gold: set[Span], rate: float) -> None:
        """One step up the likelihood: features of the true segments less those expected."""
        none = len(KINDS)
        scored = [[(i, s, e, f, kinds, self.scores(f)) for i, s, e, f, kinds in segments] for segments in ends]
        turns = [self._after(k) for k in range(none + 1)]
        forward = [[0.0 if k == none else -math.inf for k in range(none + 1)]]
        for j, segments in enumerate(scored):
            row = [-math.inf] * none + [_sum(forward[j])]
            for i, _, _, _, kinds, scores in segments:
                for kind in kinds:
                    row[kind] = _sum([row[kind], _sum([forward[i][last] + turns[last][kind] for last in range(none + 1)]) + scores[kind]])
            forward.append(row)
        n = len(ends)
        backward = [[-math.inf] * (none + 1) for _ in range(n)] + [[0.0] * (none + 1)]
        starts: list[list] = [[] for _ in range(n)]
        for j, segments in enumerate(scored):
            for i, *segment in segments:
                starts[i].append((j + 1, *segment))
        for i in range(n - 1, -1, -1):
            for last in range(none + 1):
                ways = [backward[i + 1][none]]
                ways += [turns[last][kind] + scores[kind] + backward[j][kind] for j, _, _, _, kinds, scores in starts[i] for kind in kinds]
                backward[i][last] = _sum(ways)
        total = _sum(forward[n])
        step: dict[str, list[float]] = {}
        ended = {j: k for i in range(n) for j, s, e, *_ in starts[i] for k in range(none) if (KINDS[k], s, e) in gold}
        for i in range(n):
            for j, s, e, f, kinds, scores in starts[i]:
                for kind in kinds:
                    true = (KINDS[kind], s, e) in gold
                    for last in range(none + 1):
                        p = forward[i][last] + turns[last][kind] + scores[kind] + backward[j][kind] - total
                        p = math.exp(p) if p > -30 else 0.0
                        if p:
                            step.setdefault(f"after={last}", [0.0] * none)[kind] -= p
                            for name in f:
                                step.setdefault(name, [0.0] * none)[kind] -= p
                    if true:
                        for name in (f"after={ended.get(i, none)}", *f):
                            step.setdefault(name, [0.0] * none)[kind] += 1.0
        for name, change in step.items():
            row = self.weights.setdefault(name, [0.0] * none)
            for kind in range(none):
                row[kind] += rate * (change[kind] - 0.01 * row[kind])

    @classmethod
    def trained(cls, examples: list[Example]) -> Field:
        """Trained on four of five examples, each also spelt anew; the margin is found on the others."""
        field = cls()
        draw = random.Random(17)
        made = [variant for k, example in enumerate(examples) if k % 5 for variant in variants(example, draw)]
        prepared = [(_candidates(text, run, []), {tuple(s) for s in gold}) for text, run, gold in made]
        for epoch in range(EPOCHS):
            draw.shuffle(prepared)
            for ends, gold in prepared:
                field._learn(ends, gold, 0.3 / (1 + epoch))
        field.margin = field._least_margin([v for example in examples[::5] for v in variants(example, draw)])
        return field

    def _least_margin(self, held_out: list[Example]) -> float:
        prepared = [(_candidates(text, run, []), {tuple(s) for s in gold}) for text, run, gold in held_out]
        for self.margin in MARGINS:
            found = right = 0
            for ends, gold in prepared:
                spans = self.decode(ends)
                found, right = found + len(spans), right + len(gold.intersection(spans))
            if right >= PRECISION * found:
                break
        return self.margin


def _sum(logs: list[float]) -> float:
    top = max(logs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs))


def all_spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """The base spans and what the field adds."""
    base = base_spans(text) if base is None else base
    added: list[Span] = []
    if field.weights:
        for run in stretches(text):
            near = [s for s in base if s[1] < run[-1][1] and run[0][0] < s[2]]
            if len(near) == 1 and _trimmed(text, run[0][0], run[-1][1]) == near[0][1:]:
                continue
            added += field.decode(_candidates(text, run, near))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- jobs -----------------------------------------------------------------------
def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Short stretches of a batch, each with a little text before it and its base spans."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            if not text or not SIGNAL.search(text):
                continue
            base = base_spans(text)
            for run in stretches(text):
                if len(run) > TRAIN_TOKENS or run[-1][1] - run[0][0] > 2000:
                    continue
                cut = max(0, run[0][0] - 40)
                gold = [[k, s - cut, e - cut] for k, s, e in base if run[0][0] <= s and e <= run[-1][1]]
                shifted = [[s - cut, e - cut] for s, e in run]
                example = json.dumps([text[cut : run[-1][1]], shifted, gold])
                rows.append((hashlib.blake2b(example.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), example))
        yield pd.DataFrame(rows, columns=["mark", "example"])


def fit(documents: DataFrame) -> Field:
    """The field, trained on a bounded sample of stretches."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    drawn = documents.select("text").mapInPandas(_examples, "mark string, example string")
    # a row per class and task is all that is shuffled, one per class all that reaches the driver
    drawn = drawn.groupBy(F.pmod(F.xxhash64("mark"), F.lit(TRAIN_STRETCHES)).alias("class"))
    drawn = drawn.agg(F.min(F.struct("mark", "example")).alias("least")).orderBy("class").select("least.example").collect()
    return Field.trained([(t, [tuple(x) for x in run], [tuple(g) for g in gold]) for t, run, gold in (json.loads(r["example"]) for r in drawn)])


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def judge(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, the base spans by kind, their digest, and all spans."""
    field = field or fit(documents)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(all_spans(text or "", field, base))))
            made = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made

    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return documents.select("doc_id", "text").mapInPandas(found, RESULT)


def redacted(text: str, field: Field) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    parts, at = [], 0
    for kind, start, end in all_spans(text, field):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced in `text`; the other columns as they were."""
    field = field or fit(documents)

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, field))

    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return documents.withColumn("text", without("text"))
