"""Personal data: spans that fixed patterns find and check, and further ones that boosted trees accept.

Generators propose spans that may overlap: the base patterns' matches, and looser shapes (spelled-out or bracketed @ and
dots, other separators between digits, telephone numbers without a plus). Gradient boosted trees score each by its
format and its context; a threshold for each kind, set on spans that training did not see so that their precision
reaches a target, selects. Base spans always stay; accepted ones are added where they overlap no base span.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits either matches from its first digit or not at all, so later starts in it need no try.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in re.findall("[0-9]+", s))


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return octets(s)
    n = len(d := only_digits(s))
    return kind == "email" or (8 <= n <= 15 if kind == "phone" else 16 <= n <= 19 and luhn(d))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each @ back over the local part's characters, up to the match before, and forward over the
    domain.
    """
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield "email", start, m.end()
            free = at = m.end()
        else:
            at += 1


def base_spans(text: str, failing: list[Span] | None = None) -> list[Span]:
    """The fixed patterns' checked matches, by kind and then start. failing gets the matches that fail their check."""
    out = list(emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            if valid(kind, m.group()):
                out.append((kind, m.start(), m.end()))
            elif failing is not None and m.end() - m.start() > 5:
                failing.append((kind, m.start(), m.end()))
    return out


AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|\s(?:at|AT)\s)\s?"
DOT = r"(?:\.|\s\.\s|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)"
LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:\s?\.\s?|\[\.\]|\(\.\)|,)[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\s._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00|\+\s?|\()?[0-9](?:[\s()./-]{0,3}[0-9]){6,14}(?![0-9])"),
}
SPELLED = re.compile(r"\(at\)|\[at\]|\{at\}|\[dot\]|\(dot\)|\{dot\}|\s(?:at|AT|dot|DOT)(?=\s)|@")
HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobil")}


def proposals(text: str) -> list[Span]:
    """Spans that might be personal data, overlapping ones included."""
    out = []
    for kind, pattern in LOOSE.items():
        if kind != "email":
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        elif SPELLED.search(text):
            done = -1
            for trigger in SPELLED.finditer(text):  # only near a trigger: the pattern's first part would fit any word
                if trigger.start() >= done:
                    for m in pattern.finditer(text, max(0, trigger.start() - 130), min(len(text), trigger.end() + 130)):
                        out.append((kind, m.start(), m.end()))
                        done = m.end()
    return list(dict.fromkeys(out))


NAMES = (
    "kind", "length", "digits", "letters", "spaces", "separators", "different", "groups", "longest", "shortest", "first", "luhn", "octets", "plus",
    "at", "spelled", "tail", "before", "after", "digits_around", "hint", "brackets"
)


def describe(text: str, span: Span) -> list[float]:
    """Numbers about the span's format and the characters around it."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 24) : a], text[b : b + 24]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    d = only_digits(s)
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    klass = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5
    tail = re.search(r"([A-Za-z]+)$", s)
    return [
        KINDS.index(kind), len(s), len(d), sum(c.isalpha() for c in s), sum(c.isspace() for c in s), len(seps), len(set(seps)), len(groups),
        max(groups), min(groups), int(d[0]) if d else -1, bool(d) and luhn(d), octets(s), s[:1] == "+" or s[:2] == "00", "@" in s,
        bool(re.search(r"[\[({](?:at|dot)|\b(?:at|dot|AT|DOT)\b", s)), len(tail.group(1)) if tail else 0, klass(left[-1:]), klass(right[:1]),
        sum(c.isdigit() for c in left + right), any(h in left.lower() for h in HINTS[kind]), sum(s.count(c) for c in "()[]")
    ]


class Boosted:
    """Logistic gradient boosting of small trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="nearest")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, node = self._grow(binned, y - p, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            raw += tree[2][node]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """feature and bin of each inner node, value of each leaf, in heap order; and the leaf of each row."""
        size = 2**self.depth
        feature, cut, value, node = np.zeros(size, int), np.full(size, 99), np.zeros(2 * size), np.ones(len(g), int)
        for level in range(self.depth):
            for n in range(2**level, 2 ** (level + 1)):
                rows = np.flatnonzero(node == n)
                best = (1e-6, 0, 99)
                if len(rows) >= 2 * self.least:
                    for f in range(binned.shape[1]):
                        b = binned[rows, f]
                        gs, hs, cs = (np.cumsum(np.bincount(b, w, 34)) for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        gain[(cs < self.least) | (cs[-1] - cs < self.least)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                feature[n], cut[n] = best[1:]
                node[rows] = 2 * n + (binned[rows, feature[n]] > cut[n])
        for n in range(size, 2 * size):
            rows = node == n
            value[n] = self.rate * g[rows].sum() / (h[rows].sum() + 1)
        return (feature, cut, value), node

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        raw = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (binned[np.arange(len(x)), feature[node]] > cut[node])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


class Detector:
    def __init__(self, trees: Boosted | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, texts: list[str], seed: int = 7, precision: float = 0.995, leave: frozenset[str] = frozenset()) -> Detector:
        """From texts without labels.

        Right spans: base spans, and rewritings of them in their place (other separators, spelled-out signs), but for
        the families to leave. Wrong ones: matches that fail their check, spoiled rewritings, and proposals in texts
        without base spans. A kind has some 800 rewritings whether it has few spans or many, at least two and at most 60
        of each. Every fifth example sets the thresholds and is not trained on.
        """
        rng = np.random.default_rng(seed)
        x, y, kinds = [], [], []

        def add(text: str, span: Span, label: bool) -> None:
            x.append(describe(text, span))
            y.append(label)
            kinds.append(span[0])

        found = []
        for text in texts:
            failing: list[Span] = []
            found.append((text, base_spans(text, failing), failing))
        many = Counter(kind for _, right, _ in found for kind, _, _ in right)
        times = {k: min(60, max(2, -(-800 // n))) for k, n in many.items()}
        for text, right, failing in found:
            for span in failing:
                add(text, span, False)
            for kind, a, b in right:
                add(text, (kind, a, b), True)
                for _ in range(times[kind]):
                    s, label = rewritten(kind, text[a:b], rng, leave)
                    around, span = placed(text, (kind, a, b), s)
                    # A proposal of another extent that meets it is as right or wrong, so that is what is learned from;
                    # one of another kind is wrong.
                    meet = [p for p in proposals(around) if p[1] < span[2] and p[2] > span[1]]
                    add(around, next((p for p in meet if p[0] == kind), span), label)
                    for p in meet:
                        if label and p[0] != kind:
                            add(around, p, False)
            for span in proposals(text) if not right else []:
                add(text, span, False)
        x, y, kinds = np.array(x, float).reshape(-1, len(NAMES)), np.array(y, float), np.array(kinds, str)
        test = np.arange(len(y)) % 5 == 4
        if len(y) < 50 or y[~test].min() == y[~test].max():
            return cls(None, {})
        trees = Boosted().fit(x[~test], y[~test])
        p, thresholds = trees.predict(x[test]), {}
        for kind in KINDS:
            k = kinds[test] == kind
            order = np.argsort(-p[k])
            hits = np.cumsum(y[test][k][order]) / np.arange(1, k.sum() + 1)
            good = np.flatnonzero(hits >= precision)
            thresholds[kind] = max(0.9, float(p[k][order][good[-1]])) if len(good) else 2.0
        return cls(trees, thresholds)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, by kind and then start."""
        base = base_spans(text)
        extra: list[Span] = []
        if self.trees:
            held = Ranges()
            for _, a, b in sorted(base, key=lambda s: s[1]):
                held.cover(a, b)
            free = [s for s in proposals(text) if not held.meets(s[1], s[2])]
            for k in range(0, len(free), 4096):
                some = free[k : k + 4096]
                p = self.trees.predict(np.array([describe(text, s) for s in some], float))
                extra += [(-float(v), s) for v, s in zip(p, some) if v >= self.thresholds[s[0]]]
            extra = [s for _, s in sorted(extra, key=lambda t: (t[0], t[1][1] - t[1][2], t[1])) if held.add(s[1], s[2])]
        return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class Ranges:
    """Ranges that don't meet, sorted: whether another meets one takes a search, not a pass."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def cover(self, a: int, b: int) -> None:
        """Add a range that starts no earlier than all before; it may overlap the last."""
        if self.ends and a < self.ends[-1]:
            self.ends[-1] = max(self.ends[-1], b)
        else:
            self.starts.append(a)
            self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)  # those before it start before b
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> bool:
        """Add a range if it meets none."""
        if self.meets(a, b):
            return False
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def spelled(at: str, dot: str) -> Callable[[str, np.random.Generator], str]:
    return lambda s, rng: s.replace("@", at).replace(".", dot)


def in_groups(d: str, rng: np.random.Generator, sep: str) -> str:
    """Digits in groups of two to four."""
    out = []
    while d:
        n = len(d) if len(d) <= 4 else int(rng.integers(2, min(4, len(d) - 2) + 1))
        out.append(d[:n])
        d = d[n:]
    return sep.join(out)


# Ways to write a right span otherwise, by kind and name.
FAMILIES: dict[str, dict[str, Callable[[str, np.random.Generator], str]]] = {
    "email": {
        f"{at}{dot}": spelled(at, dot) for at in ("@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " at ", " AT ") for dot in (
            ".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ", "{dot}", " dot ", " DOT "
        ) if (at, dot) != ("@", ".")
    },
    "ip": {sep: (lambda s, rng, sep=sep: s.replace(".", sep)) for sep in ("[.]", " . ", "(.)", ". ", " .")},
    "card": {sep: (lambda s, rng, sep=sep: sep.join(only_digits(s)[i : i + 4] for i in range(0, len(only_digits(s)), 4))) for sep in (".", "  ", "/", "_", " - ")},
    "phone": {
        "00": lambda s, rng: "00" + only_digits(s),
        "00 groups": lambda s, rng: "00" + in_groups(only_digits(s), rng, " "),
        "00-groups": lambda s, rng: "00" + in_groups(only_digits(s), rng, "-"),
        "00.groups": lambda s, rng: "00" + in_groups(only_digits(s), rng, "."),
        "+/": lambda s, rng: "+" + only_digits(s)[0] + "/" + only_digits(s)[1:4] + "/" + only_digits(s)[4:],
        "()-": lambda s, rng: f"({only_digits(s)[1:4]}) {only_digits(s)[4:7]}-{only_digits(s)[7:]}",
        "() ": lambda s, rng: f"({only_digits(s)[1:4]}) {only_digits(s)[4:7]} {only_digits(s)[7:]}",
    },
}


def spoiled(kind: str, s: str, rng: np.random.Generator) -> str:
    """A span's text so changed that it is none of its kind any more: no address follows the sign, a part over 255, a
    wrong check digit, too few digits to call, or a date and a time.
    """
    if kind == "email":
        return s.replace("@", " at ").replace(".", ". ")
    if kind == "ip":
        return re.sub("[0-9]+", lambda m: str(int(m.group()) % 700 + 256), s)
    d = only_digits(s)
    if kind == "card":
        return d[:-1] + str((int(d[-1]) + int(rng.integers(1, 10))) % 10)
    day = f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(1, 29):02}/{rng.integers(1, 13):02}/{rng.integers(1900, 2100)}", f"{rng.integers(1, 29):02}.{rng.integers(1, 13):02}.{rng.integers(1900, 2100)}"
    return [d[: int(rng.integers(3, 7))], f"{day[rng.integers(3)]} {rng.integers(24):02}:{rng.integers(60):02}"][rng.integers(2)]


def rewritten(kind: str, s: str, rng: np.random.Generator, leave: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """A span's text written otherwise, and whether it is still right; none of the families to leave."""
    if rng.random() < 0.5:
        return spoiled(kind, s, rng), False
    names = [n for n in FAMILIES[kind] if n not in leave]
    return FAMILIES[kind][names[rng.integers(len(names))]](s, rng), True


def placed(text: str, span: Span, s: str) -> tuple[str, Span]:
    """The span's surroundings with another text in its place, and where that stands."""
    kind, a, b = span
    return text[max(0, a - 30) : a] + s + text[b : b + 30], (kind, min(30, a), min(30, a) + len(s))


def evidence(texts: list[str], fold: int = 3, seed: int = 7) -> list[dict]:
    """How the trees do on families of rewritings, and texts, that they haven't seen: for each kind, recall over right
    rewritings and precision over what is selected of them and of spoiled ones.

    Families and texts fall into `fold` parts; each part's families in its texts are tested with a detector that is
    fitted on the other texts and families.
    """
    rng = np.random.default_rng(seed)
    tally = {k: Counter() for k in KINDS}
    for part in range(fold):
        leave = {k: frozenset(n for i, n in enumerate(FAMILIES[k]) if i % fold == part) for k in KINDS}
        detector = Detector.fit([t for i, t in enumerate(texts) if i % fold != part], leave=frozenset().union(*leave.values()))
        for text in texts[part::fold]:
            for span in base_spans(text):
                kind = span[0]
                name = sorted(leave[kind])[int(rng.integers(len(leave[kind])))]
                for s, right in ((FAMILIES[kind][name](text[span[1] : span[2]], rng), True), (spoiled(kind, text[span[1] : span[2]], rng), False)):
                    around, at = placed(text, span, s)
                    hit = any(k == kind and a < at[2] and b > at[1] for k, a, b in detector.spans(around)[1])
                    tally[kind][right, hit] += 1
    return [
        {
            "kind": k, "right": c[True, True] + c[True, False], "recall": c[True, True] / max(1, c[True, True] + c[True, False]),
            "precision": c[True, True] / max(1, c[True, True] + c[False, True])
        } for k,
        c in tally.items()
    ]


def train(docs: DataFrame, most: int = 3000, longest: int = 200_000) -> Detector:
    """Fit on at most `most` rows that hold a digit or an @, those whose ids hash lowest, of texts of at most `longest`
    characters; their texts count whole, and of rows that agree in id and text one counts. These bounds, on rows and on
    bytes, are the only sample.
    """
    rows = docs.where((F.length("text") <= longest) & F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id", "text")
    keys = rows.select("doc_id", F.xxhash64("text").alias("row")).orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(most).collect()
    if not keys:
        return Detector(None, {})
    known = docs.sparkSession.createDataFrame(list({(r.doc_id, r.row) for r in keys}), "doc_id long, row long")
    return Detector.fit([r.text for r in S.sampled(rows, known)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def found(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) of each document (doc_id, text).
    Offsets are code points. A null text is empty. Nothing is shuffled.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            base, all_spans = detector.spans(text or "")
            rows.append((key, *(sum(s[0] == k for s in base) for k in KINDS), sha256(joined(base).encode()).hexdigest(), joined(all_spans)))
        if rows:
            yield S.batch(FOUND, *zip(*rows))

    return S.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in FOUND))


def redacted(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The documents with each selected span replaced by its kind in brackets."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t in b.column(text).to_pylist():
            pieces, end = [], 0
            for kind, a, e in sorted(detector.spans(t or "")[1], key=lambda s: s[1:]):
                if e > end:  # overlapping spans of several kinds leave one after the other
                    pieces += [t[end:a], f"[{kind}]"]
                    end = e
            out.append(t if t is None else "".join([*pieces, t[end:]]))
        yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return S.map_arrow(docs, run, docs.schema)


def detected(docs: DataFrame, most: int = 3000) -> DataFrame:
    """Train on documents and find personal data in all of them: a row for each row, as in `found`. Rows without an id
    or a text teach nothing; without any that teach, only base spans are found.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found(rows, train(rows, most))
