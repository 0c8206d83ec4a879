"""Personal data: a semi-Markov conditional random field over whole spans, beside fixed base patterns.

Base spans are fixed by four patterns (email, ip, card, phone) and always stay. The field reads zones: the stretches of a text around
words that hold a digit, "@" or "=", or that announce something ("password", "Mr", "SSN", ...). A zone is cut into tokens; a segmentation covers it with segments, each either
one token of no kind or up to MAX_TOKENS tokens of one kind. Whole-span features (shape, separators, digit count, checksum, entropy, what stands before) score each
candidate segment, and one Viterbi pass over bounded segment lengths chooses boundaries and kinds together. Its spans are added where
they touch no base span; its own kinds `secret` (keys, passwords, tokens), `ssn` and `name` (a person's, after what announces it) have no base pattern. Names that nothing announces,
and postal addresses, are not sought. Weights are fitted here, on sentences that `training_set` makes from a fixed seed, by gradient ascent on the exact conditional likelihood
(forward-backward over segments).

Defined results: a null text is empty and has no spans; zones, not texts, bound the work, and every zone is read to its end. Repeated rows are
judged alike, each on its own. An empty table gives an empty result. Columns other than those named are not read. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import change_rows, map_columns

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "name")
LABELS = ("none", *KINDS)
MAX_TOKENS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins: if it fails there, it fails at every later digit of the run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # "@" is no character of a local part
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field ---

_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@=]")
#: What announces a kind: the words, and how many tokens after one of them belong to its zone.
_CUES = {
    "secret": re.compile(r"(?i)(?:.*[_-])?(?:pass(?:word|wd|phrase|code)?|pwd|token|secret|(?:api|access|private)[_-]?key|key|auth)"),
    "phone": re.compile(r"(?i)phone|tel|telephone|call|mobile|fax|cell"),
    "ssn": re.compile(r"(?i)ssn|social|insurance"),
    "name": re.compile(r"(?i)mr|mrs|ms|miss|dr|prof|professor|name|named|dear|sincerely|regards"),
}
_REACH = 4
_TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof")
_SAID = ("passw", "passphrase", "passcode", "pwd", "secret", "ssn", "name", "dear", "sincerely", "regards")
_ANNOUNCED = re.compile(r"\b(?:(?i:pass(?:word|wd|phrase|code)|pwd|secret|ssn|named?|dear|sincerely|regards)|Mr|Mrs|Ms|Miss|Dr|Prof|Professor)\b")
_LINK = re.compile(r"(?i)[=:]+|is|was|to|are|number|no|security|me|at|on")
_SECRET_PAIR = re.compile(r"(?i)^[\"']?(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|key|auth)[\"']?[=:]\S{6,}$")
_SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")),
    ("ssn", re.compile(r"[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}")),
    ("phone", re.compile(r"(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}")),
    ("long", re.compile(r"\+?[0-9]{1,3}[\x20().0-9-]{7,17}[0-9]")),
    ("date", re.compile(r"[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}")),
    ("digits", re.compile(r"[0-9](?:[\x20-]?[0-9])+")),
    ("capkey", re.compile(r"[A-Z]{3,5}[A-Z0-9]{12,}")),
    ("hex", re.compile(r"[0-9A-Fa-f]{16,}")),
    ("mixed", re.compile(r"(?=\S*[0-9])(?=\S*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")),
    ("person", re.compile(r"[^\W\d_](?:[^\W\d_]*[a-z'’.-])?(?: [^\W\d_](?:[^\W\d_]*[a-z'’.-])?)*")),
)
_STRIP = "\"'.,;:()[]{}<>!?%*#$&"


def zones(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end): those that hold a hint with two tokens before and one after, and those that announce something with _REACH after."""
    out: list[list[tuple[int, int]]] = []
    if not _HINT.search(text):
        low = text.lower()
        if not any(w in text for w in _TITLES) and not any(w in low for w in _SAID) or not _ANNOUNCED.search(text):
            return out
    before: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    after = 0
    for m in _TOKEN.finditer(text):
        span = m.span()
        hint, said = _HINT.search(m[0]), _ANNOUNCED.search(m[0])
        if hint or said:
            run = [*(run or before), span]
            before, after = [], max(after - 1, _REACH if said else 1)
        elif run and after:
            run.append(span)
            after -= 1
            before = [*before[-1:], span]
        else:
            if run:
                out.append(run)
                run = []
            before = [*before[-1:], span]
    if run:
        out.append(run)
    return out


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in _STRIP:
        b -= 1
    while a < b and text[a] in _STRIP:
        a += 1
    if a and text[a - 1] == "(" and 0 <= text.find(")", a, b) and text.find("(", a, b) < 0:
        a -= 1  # an area code's bracket
    return a, b


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def _cue(text: str, run: list[tuple[int, int]], i: int) -> str:
    """What the words before token i announce: the word right before, or one or two further back with nothing but links between; and whether it is linked, as by a colon."""
    linked = ""
    for k in range(i - 1, max(-1, i - 4), -1):
        said = text[run[k][0] : run[k][1]]
        word = said.strip(_STRIP + "=")
        if said[-1] in ":=":
            linked = ":"
        for kind, words in _CUES.items():
            if words.fullmatch(word):
                return kind + linked
        if word and not _LINK.fullmatch(word):
            return ""
        linked = ":"
    return ""


def features(text: str, run: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Of the segment of tokens i to j - 1, whatever its label."""
    a, b = trim(text, run[i][0], run[j - 1][1])
    span = text[a:b]
    n = sum(c in "0123456789" for c in span)
    cue = _cue(text, run, i)
    out = [f"tokens={j - i}", f"digits={min(n, 20) // 2}", f"after={cue}"]
    if not span:
        return (*out, "blank")
    shapes = [name for name, p in _SHAPES if p.fullmatch(span)] or ["other"]
    out += [f"shape={name}" for name in shapes] + [f"after={cue}, shape={name}" for name in shapes]
    if n:
        out.append("parts=" + "".join(sorted({c for c in span if c in " .-()/:"})))
        out.append(f"dots={min(4, span.count('.'))}")
        if _SHAPES[1][1].fullmatch(span):
            out.append(f"octets={all(int(p) <= 255 for p in span.split('.'))}")
    if span[0] == "+":
        out.append("plus")
    if 14 <= n <= 19:
        out.append(f"luhn={luhn(re.sub('[^0-9]', '', span))}")
    if _SECRET_PAIR.match(span):
        out.append("pair")
    if j - i == 1 and len(span) >= 16:
        out.append(f"entropy={int(_entropy(span))}")
    words = [text[x:y].strip(_STRIP) for x, y in run[i:j]]
    if n == 0 and all(w[:1].isupper() for w in words):
        out.append(f"capitals={j - i}, after={cue}")
        out.append(f"title={bool(_CUES['name'].fullmatch(words[0]))}")
    elif n == 0 and j - i == 1:
        out.append(f"plain, after={cue}, length={min(3, len(span) // 4)}")
    if any(text[x:y][-1] in ",;:!?" for x, y in run[i : j - 1]):
        out.append("breaks")
    return tuple(out)


def _lattice(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """The candidate segments; those of several tokens start and end in a digit-bearing token, as phones, cards and such do, or are capitalised words throughout, as names are."""
    out = []
    digit = [bool(_DIGIT.search(text, a, b)) for a, b in run]
    capital = [text[a:b].strip(_STRIP)[:1].isupper() and not d for (a, b), d in zip(run, digit, strict=True)]
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MAX_TOKENS) + 1):
            if j == i + 1 or digit[i] and digit[j - 1] or j <= i + 4 and all(capital[i:j]):
                out.append((i, j, features(text, run, i, j)))
    return out


def _labels(i: int, j: int) -> range:
    return range(len(LABELS)) if j == i + 1 else range(1, len(LABELS))


class Field:
    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights  # weights: features by labels

    def scores(self, feats: tuple[str, ...]) -> np.ndarray:
        rows = [self.index[f] for f in feats if f in self.index]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(len(LABELS))

    def decode(self, text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        best, back = [-math.inf] * (len(run) + 1), [None] * (len(run) + 1)
        best[0] = 0.0
        for i, j, feats in sorted(_lattice(text, run), key=lambda s: (s[1], s[0])):
            s = self.scores(feats)
            for y in _labels(i, j):
                if best[i] + s[y] > best[j]:
                    best[j], back[j] = best[i] + float(s[y]), (i, y)
        out, j = [], len(run)
        while j:
            i, y = back[j]
            if y:
                a, b = trim(text, run[i][0], run[j - 1][1])
                if a < b:
                    out.append((a, b, LABELS[y]))
            j = i
        return out[::-1]


def training_set(n: int = 360, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with known spans, and much that only looks like them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(k))
    word = lambda: letters(rng.randrange(2, 10))
    plain = [
        lambda: rng.choice("the of and in on tion une der und las que with from this year page room call key name token dear to is was was at no".split()),
        word,
        lambda: word().capitalize() + rng.choice(["", "", ",", "."]),
        lambda: rng.choice(["2", "10", "2024", "3.5", "4.0", "1,200", "12", "a=b", "x=1", "12:30", "$45.00", "3.10.2", "50%", "#1042", "1999-2003", "(2)"]),
        lambda: f"{digits(4)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
        lambda: f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{digits(4)}",
        lambda: rng.choice([digits(rng.randrange(3, 10)), letters(3, "ABCDEFGHIJKLMNOP") + "-" + digits(4), "v" + digits(1) + "." + digits(2)]),
    ]

    def card() -> str:
        body = digits(rng.choice([14, 15, 15, 15, 17]))
        full = next(body + c for c in "0123456789" if luhn(body + c)) if rng.random() < 0.7 else body + digits(1)
        return rng.choice([full, " ".join(full[k : k + 4] for k in range(0, len(full), 4)), "-".join(full[k : k + 4] for k in range(0, len(full), 4))])

    def person() -> str:
        last = word().capitalize()
        return rng.choice([last, f"{word().capitalize()} {last}", f"{letters(1).upper()}. {last}", f"{word().capitalize()} {letters(1).upper()}. {last}"])

    def password() -> str:
        return rng.choice([letters(rng.randrange(7, 13)), letters(5) + digits(3), letters(6) + "!" + digits(2) + letters(2), letters(24, "abcdefghijklmnopqrstuvwxyz0123456789"), letters(4).capitalize() + letters(5)])

    make = {
        "email": lambda: ("", f"{letters(5)}.{digits(2)}@{letters(4)}{digits(1)}.example.{rng.choice(['com', 'org'])}"),
        "ip": lambda: ("", ".".join(str(rng.randrange(256)) for _ in range(4))),
        "card": lambda: (rng.choice(["", "", "card "]), card()),
        "phone": lambda: (rng.choice(["", "", "call ", "phone: ", "tel. ", "mobile "]), rng.choice(["+1 ({}) {}-{}", "+{}{}-{}", "+44 {} {} {}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(digits(3), digits(3), digits(4))),
        "secret": lambda: rng.choice(
            [
                lambda: ("", "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")),
                lambda: ("", "password=" + letters(18, "0123456789abcdef")),
                lambda: ("token = ", '"' + letters(40, rng.choice(["0123456789abcdef", "0123456789ABCDEF"])) + '"'),
                lambda: ("", "api_key=" + letters(24, "abcdefghijklmnopqrstuvwxyz0123456789")),
                lambda: (rng.choice(["password: ", "password is ", "pwd: ", "passphrase: ", "secret: ", "the password was "]), password()),
            ]
        )(),
        "ssn": lambda: (rng.choice(["", "", "SSN ", "SSN: ", "social security number "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "name": lambda: (rng.choice(["Mr. ", "Mrs ", "Dr. ", "Ms ", "Prof. ", "my name is ", "name: ", "Dear Mr. ", "Regards, "]), person()),
    }
    out = []
    for _ in range(n):
        text, spans = "", []
        for kind in [*rng.choices(KINDS, k=rng.randrange(1, 4)), None]:
            text += "".join(rng.choices(plain, [5, 6, 2, 1.5, 0.5, 0.5, 1])[0]() + " " for _ in range(rng.randrange(1, 7)))
            if kind:
                cue, said = make[kind]()
                a, b = trim(text + cue + said, len(text + cue), len(text + cue + said))
                text, spans = f"{text}{cue}{said}{rng.choice([' ', ' ', ', ', '. '])}", [*spans, (a, b, kind)]
        out.append((text.strip(), spans))
    return out


def lattices(rows: list[tuple[str, list[tuple[int, int, str]]]], index: dict[str, int]) -> list[tuple[int, list, list]]:
    """Of each zone: how many tokens, its candidate segments (i, j, features), and those of the true segmentation (features, label). Features get their numbers here."""
    out = []
    for text, spans in rows:
        gold = {(a, b): LABELS.index(k) for a, b, k in spans}
        for run in zones(text):
            segs = [(i, j, np.array([index.setdefault(f, len(index)) for f in feats]), gold.get(trim(text, run[i][0], run[j - 1][1]), 0)) for i, j, feats in _lattice(text, run)]
            inside = {t for i, j, _, y in segs if y and j > i + 1 for t in range(i, j)}
            true = [(f, y) for i, j, f, y in segs if y and (j > i + 1 or i not in inside) or j == i + 1 and not y and i not in inside]
            out.append((len(run), [(i, j, f) for i, j, f, _ in segs], true))
    return out


def likelihood(w: np.ndarray, data: list[tuple[int, list, list]], l2: float) -> tuple[float, np.ndarray]:
    """Mean conditional log-likelihood of the true segmentations, less its penalty, and its gradient by the weights: forward and backward over segments."""
    g, total = -l2 * w, -l2 / 2 * float((w * w).sum())
    for n, segs, true in data:
        for f, y in true:
            g[f, y] += 1 / len(data)
            total += float(w[f, y].sum()) / len(data)
        fore, rear = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fore[0] = rear[n] = 0.0
        s = [w[f].sum(axis=0) for _, _, f in segs]
        flat = []
        for (i, j, _), x in zip(segs, s, strict=True):
            x = x[_labels(i, j).start :]
            flat.append(x.max() + math.log(np.exp(x - x.max()).sum()))
        for k in sorted(range(len(segs)), key=lambda k: (segs[k][1], segs[k][0])):
            fore[segs[k][1]] = np.logaddexp(fore[segs[k][1]], fore[segs[k][0]] + flat[k])
        for k in sorted(range(len(segs)), key=lambda k: (-segs[k][0], -segs[k][1])):
            rear[segs[k][0]] = np.logaddexp(rear[segs[k][0]], rear[segs[k][1]] + flat[k])
        total -= float(fore[n]) / len(data)
        for (i, j, f), x in zip(segs, s, strict=True):
            first = _labels(i, j).start
            p = np.zeros(len(LABELS))
            p[first:] = np.exp(fore[i] + rear[j] - fore[n] + x[first:])
            g[f] -= p / len(data)
    return total, g


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 40, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """Gradient ascent on the likelihood, with Adagrad steps."""
    index: dict[str, int] = {}
    data = lattices(rows, index)
    w = np.zeros((len(index), len(LABELS)))
    seen = np.full_like(w, 1e-6)
    for _ in range(steps):
        _, g = likelihood(w, data, l2)
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return Field(index, w)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(training_set())


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those of the field that touch none of them."""
    base = base_spans(text)
    if not text:
        return [], []
    more = [s for run in zones(text) for s in field.decode(text, run)]
    taken = sorted((a, b) for a, b, _ in base)
    out, k, reach = list(base), 0, 0
    for a, b, kind in more:  # both by start; reach: how far the base spans that start before b go
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b, kind))
    return base, sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document. No shuffle; the weights (a few hundred numbers) travel with the task."""
    field = field or default_field()

    def start():
        def apply(cols):
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in cols["text"]:
                base, every = find(text, field)
                n = Counter(k for _, _, k in base)
                for k in KINDS[:4]:
                    out[f"n_{k}"].append(n[k])
                out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
                out["spans"].append(told(every))
                out["n_added"].append(len(every) - len(base))
            return out | {"doc_id": cols["doc_id"]}

        return apply

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), SCHEMA, start)


def redact_text(text: str | None, field: Field) -> str | None:
    """Each span gives way to its kind in angle brackets; of spans that overlap, one stretch under the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with the spans of `text` redacted; all other columns as they are."""
    field = field or default_field()

    at = docs.columns.index("text")

    def start():
        return lambda rows: rows.set_column(at, "text", pa.array([redact_text(t, field) for t in rows.column(at).to_pylist()], pa.string()))

    return change_rows(docs, start)
