"""Personal data: base patterns, and a linear-chain CRF over word shapes decoded by Viterbi."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from lawmesh.llm.common import broadcast_value, map_arrow

#: The base patterns' kinds, and one that only the CRF finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
O = 0
BUCKETS = 1 << 13

# The contract's base patterns. ip has a guard in front and
# possessive digits, which give the same matches in linear time; email is
# matched from each @ outwards for the same reason.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
#: Words in which addresses are spelled out; with NEAR tokens on either side they are looked at too.
SPELLED = re.compile(r"[(\[{<](?:at|dot)[)\]}>]|\bdot\b", re.I)
NEAR = 4


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def valid_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def valid_card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; offsets in code points."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if valid_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and valid_card(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# ---------------------------------------------------------------- the CRF


def shape(token: str) -> str:
    """Letters to a or A, digits to 0, each run of a class once; digits in groups keep their length."""
    out, last = [], ""
    for c in token:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == "0" or k != last:
            out.append(k)
        last = k
    return "".join(out)


STRIPPED = ".,;:!?\"'%$#&*"


def seen(token: str) -> tuple:
    """What is computed of a token once: its shape, this without outer signs, digits, letters, and its spelled word."""
    own = shape(token)
    bare = token.strip(STRIPPED)
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    mixed = digits >= 4 and letters >= 3 and bare.isascii() and bare.replace("-", "").replace("_", "").isalnum()
    word = bare.lower() if len(bare) <= 12 and not digits else ""
    return own, own.strip(STRIPPED), digits, letters, mixed and min(len(bare) // 8, 5), word


def features(tokens: list[str], i: int) -> list[int]:
    """Hashed features of one token: its own shape and counts, and the shapes beside it."""
    t = tokens[i]
    own, bare, n, letters, mixed, word = seen(t)
    before, last = (seen(tokens[i - 1])[0::5]) if i else ("^", "^")
    after, follows = (seen(tokens[i + 1])[0::5]) if i + 1 < len(tokens) else ("$", "$")
    earlier = seen(tokens[i - 2])[5] if i > 1 else "^"
    named = (
        f"s={bare}", f"n={min(n, 20)}", f"@={'@' in t}{t.count('.')}", f"d={min(t.count('.'), 5)}{n > 0}",
        f"+={t[:1] == '+'}{n}", f"p={before}|{bare}", f"x={bare}|{after}", f"r={re.sub('0+', '0', bare)}",
        f"rp={re.sub('0+', '0', before)}|{re.sub('0+', '0', bare)}", f"m={mixed}", f"mq={mixed}{t[:1] in QUOTES}{before == '='}",
        f"w={word if word in WORDS else '-'}", f"wb={last if last in WORDS else '-'}|{word if word in WORDS else '-'}|{follows if follows in WORDS else '-'}",
        f"we={earlier if earlier in WORDS else '-'}{last if last in WORDS else '-'}|{letters > 0}{n > 0}", "b",
    )
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in named]


QUOTES = frozenset("\"'`")
WORDS = frozenset("at dot (at) (dot) [at] [dot] {at} {dot} com org net edu = : is key token secret password".split())
N_FEATURES = len(features(["a"], 0))


def runs(text: str):
    """(tokens with their places, first, last): neighbouring tokens with a digit or an @, or near a spelled-out sign.

    All other tokens are O by construction, which cuts the chain: the best
    labels of a run, with O on both sides, are those of the whole text.
    """
    tokens = [(m[0], m.start()) for m in TOKEN.finditer(text)]
    words = [t for t, _ in tokens]
    marked = [TRIGGER.search(w) is not None for w in words]
    if SPELLED.search(text):
        for k, w in enumerate(words):
            if SPELLED.search(w):
                for j in range(max(0, k - NEAR), min(len(words), k + NEAR + 1)):
                    marked[j] = True
    i, n = 0, len(tokens)
    while i < n:
        if marked[i]:
            j = i + 1
            while j < n and marked[j] and "\n" not in text[tokens[j - 1][1] + len(words[j - 1]) : tokens[j][1]]:
                j += 1
            yield words, tokens, i, j
            i = j
        else:
            i += 1


def labelled_table(n: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A small labelled table, made by rule: texts with (start, end, kind) spans, and look-alikes without."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))

    def card(k: int) -> str:
        body = r.choice("3456") + d(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spaced(s: str, by: str) -> str:
        return by.join(s[i : i + 4] for i in range(0, len(s), 4))

    at, dot, tld = (lambda xs=x.split(): r.choice(xs) for x in ("(at) [at] {at}", "(dot) [dot] {dot}", "com org net edu"))
    hold = ("token = ", "key: ", "secret = ", "password: ", "api_key=", "token is ")

    def mix(least: int, most: int) -> str:
        """Letters and digits by chance: hexadecimal, or of both cases."""
        signs = r.choice(("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return d(2) + "".join(r.choice(signs) for _ in range(r.randint(least, most) - 6)) + r.choice("abcdef") + d(2) + r.choice("abc")

    wanted = [
        lambda: (0, f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com"), lambda: (0, f"{word()}@{word()}.org"), lambda: (0, f"{word()}_{word()}@{word()}-{word()}.co.uk"),
        lambda: (1, ".".join(str(r.randint(0, 255)) for _ in range(4))),
        lambda: (2, card(16)), lambda: (2, card(15)), lambda: (2, spaced(card(16), " ")), lambda: (2, spaced(card(16), "-")), lambda: (2, card(19)),
        lambda: (2, spaced(card(16), ".")), lambda: (3, f"{d(3)}-{d(3)}-{d(4)}"), lambda: (3, f"{d(3)}.{d(3)}.{d(4)}"),
        lambda: (0, f"{word()} {at()} {word()}.com"), lambda: (0, f"{word()}.{word()} {at()} {word()}.org"), lambda: (0, f"{word()} dot {word()} at {word()} dot {tld()}"), lambda: (0, f"{word()} {at()} {word()} {dot()} {tld()}"), lambda: (0, f"{word()} at {word()} dot {tld()}"),
        lambda: (4, f'"{mix(16, 44)}"'), lambda: (4, f'"{mix(16, 44)}"'), lambda: (4, mix(24, 44)),
        lambda: (3, f"+1 ({d(3)}) {d(3)}-{d(4)}"), lambda: (3, f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}"), lambda: (3, f"({d(3)}) {d(3)}-{d(4)}"), lambda: (3, f"({d(3)}){d(3)}-{d(4)}"), lambda: (3, f"+{d(11)}"),
    ]
    other = [
        lambda: f"{r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}",
        lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"#{d(5)}", lambda: d(r.randint(1, 9)), lambda: f"{d(1)}.", lambda: f"{d(2)}%", lambda: f"({d(1)})", lambda: f"{d(1)})", lambda: f"[{d(2)}]",
        lambda: f"{d(2)}-{d(2)}", lambda: f"{word()} at {word()}", lambda: f"the dot {word()} at {word()}", lambda: f"{word()} dot {word()}", lambda: f'"{word()}{d(3)}"', lambda: f"https://{word()}.org/{word()}{d(4)}", lambda: f"{word()}-{d(4)}-{word()}", lambda: f"@{word()}", lambda: f"{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)},{d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"{word()}{d(2)}", lambda: d(12), lambda: d(10),
    ]
    table = []
    for k in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if k % 2:
                kind, s = r.choice(wanted)()
                if kind == 4 and (r.random() < 0.7 or '"' not in s):
                    text += r.choice(hold)
                quoted = s[0] in QUOTES
                spans.append((len(text) + quoted, len(text) + len(s) - quoted, kind))
            else:
                s = r.choice(other)()
            text += s + r.choice(("", "", ".", ",", "%%%", "***", "!!")) + r.choice((" ", "\n", " "))
        table.append((text + word(), spans))
    return table


class Crf:
    """Weights: emit (BUCKETS x labels) and move (labels x labels); runs begin and end beside O."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """(runs, length, labels) -> (runs, length): the best labels of equally long runs at once."""
        n, length, _ = scores.shape
        best, back = self.move[O] + scores[:, 0], []
        for t in range(1, length):
            step = best[:, :, None] + self.move
            back.append(step.argmax(1))
            best = step.max(1) + scores[:, t]
        last = (best + self.move[:, O]).argmax(1)
        out = np.empty((n, length), dtype=np.int64)
        out[:, -1] = last
        for t in range(length - 1, 0, -1):
            last = back[t - 1][np.arange(n), last]
            out[:, t - 1] = last
        return out

    def label(self, of_runs: list[list[list[int]]]) -> list[list[int]]:
        """Labels of runs given as lists of features by token."""
        out: list = [None] * len(of_runs)
        by_length: dict[int, list[int]] = {}
        for k, run in enumerate(of_runs):
            by_length.setdefault(len(run), []).append(k)
        for ks in by_length.values():
            scores = self.emit[np.array([of_runs[k] for k in ks])].sum(2)
            for k, labels in zip(ks, self.viterbi(scores).tolist(), strict=True):
                out[k] = labels
        return out


def train(table, rounds: int = 120, rate: float = 0.15, decay: float = 0.002) -> Crf:
    """Maximum likelihood by forward and backward passes over the whole small table, with Adam steps."""
    xs, ys = [], []
    for text, spans in table:
        for words, tokens, i, j in runs(text):
            ys.append([])
            xs.append([features(words, k) for k in range(i, j)])
            for k in range(i, j):
                start, end = tokens[k][1], tokens[k][1] + len(words[k])
                hit = next(((s, kind) for s, e, kind in spans if s < end and start < e), None)
                ys[-1].append(O if hit is None else 1 + 2 * hit[1] + (start > hit[0]))
    groups = {}
    for x, y in zip(xs, ys, strict=True):
        groups.setdefault(len(x), ([], []))
        groups[len(x)][0].append(x)
        groups[len(x)][1].append(y)
    groups = {k: (np.array(a), np.array(b)) for k, (a, b) in groups.items()}
    size = len(LABELS)
    theta = [np.zeros((BUCKETS, size)), np.zeros((size, size))]
    m1, m2 = ([np.zeros_like(t) for t in theta] for _ in range(2))
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for step in range(1, rounds + 1):
        emit, move = theta
        g_emit, g_move = decay * emit, decay * move
        for length, (x, y) in groups.items():
            s = emit[x].sum(2)
            fwd = [move[O] + s[:, 0]]
            for t in range(1, length):
                fwd.append(lse(fwd[-1][:, :, None] + move, 1) + s[:, t])
            bwd = [np.broadcast_to(move[:, O], fwd[-1].shape)]
            for t in range(length - 1, 0, -1):
                bwd.append(lse(move + (s[:, t] + bwd[-1])[:, None, :], 2))
            bwd.reverse()
            z = lse(fwd[-1] + bwd[-1], 1)[:, None]
            for t in range(length):
                p = np.exp(fwd[t] + bwd[t] - z)
                p[np.arange(len(p)), y[:, t]] -= 1
                np.add.at(g_emit, x[:, t], p[:, None, :])
                if t == 0:
                    g_move[O] += p.sum(0)
                if t == length - 1:
                    g_move[:, O] += p.sum(0)
                if t:
                    q = np.exp(fwd[t - 1][:, :, None] + move + (s[:, t] + bwd[t])[:, None, :] - z[:, :, None])
                    g_move += q.sum(0)
                    np.add.at(g_move, (y[:, t - 1], y[:, t]), -1)
        for k, g in enumerate((g_emit, g_move)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            theta[k] = theta[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Crf(*theta)


EDGE = re.compile(r"^[^0-9A-Za-z+(@]+|[^0-9A-Za-z)]+$")
AT, DOT = re.compile(r"\s*[(\[{<]at[)\]}>]\s*|\s+at\s+", re.I), re.compile(r"\s*[(\[{<]dot[)\]}>]\s*|\s+dot\s+", re.I)
#: What a span must have, whatever the CRF says: an @ with a dot behind it, also spelled out; four parts; a valid number; enough digits; digits and letters.
FORMS = {
    0: lambda s: bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", DOT.sub(".", AT.sub("@", s)))),
    1: lambda s: bool(IP.fullmatch(s)) and valid_ip(s),
    2: lambda s: bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", s)) and valid_card(s),
    3: lambda s: bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", s)) and 10 <= len(digits_of(s)) <= 15,
    4: lambda s: bool(re.fullmatch(r"[0-9A-Za-z_-]{16,}", s)) and len(digits_of(s)) >= 3 and any(c.isalpha() for c in s),
}


def crf_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) by text: labelled runs that also hold what their kind must have."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where, xs = [], []
    for k, text in enumerate(texts):
        for words, tokens, i, j in runs(text):
            where.append((k, tokens, i))
            xs.append([features(words, t) for t in range(i, j)])
    for (k, tokens, i), labels in zip(where, crf.label(xs), strict=True):
        t = 0
        while t < len(labels):
            if labels[t] == O:
                t += 1
                continue
            kind, first = (labels[t] - 1) // 2, t
            t += 1
            while t < len(labels) and labels[t] == 2 + 2 * kind:
                t += 1
            start, last = tokens[i + first][1], tokens[i + t - 1]
            s = texts[k][start : last[1] + len(last[0])]
            s = s.rpartition("=")[2] if kind == 4 else s  # name=value in one token
            start = last[1] + len(last[0]) - len(s) if kind == 4 else start
            trimmed = EDGE.sub("", s)
            start += s.find(trimmed)
            if trimmed and FORMS[kind](trimmed):
                found[k].append((start, kind, start + len(trimmed)))
    return found


def find_spans(texts: list[str], crf: Crf):
    """By text: the base spans, and all spans: those plus the CRF's that touch none of them."""
    base = [[] if not t or not TRIGGER.search(t) else base_spans(t) for t in texts]
    busy = [k for k, t in enumerate(texts) if t and (TRIGGER.search(t) or SPELLED.search(t))]
    every = [list(b) for b in base]
    for k, more in zip(busy, crf_spans([texts[k] for k in busy], crf), strict=True):
        ends = sorted((s, e) for s, _, e in base[k])
        starts = [s for s, _ in ends]
        reach = np.maximum.accumulate([e for _, e in ends]).tolist() if ends else []
        for span in more:
            i = bisect.bisect_left(starts, span[2])
            if not i or reach[i - 1] <= span[0]:
                every[k].append(span)
        every[k].sort()
    return base, every


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame, table=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every whole text.

    The CRF is trained here from a small labelled table (`table`: texts with
    (start, end, kind) spans; by default labelled_table()) and broadcast; its
    size is fixed. One pass, no shuffle. The counts and the digest are those
    of the base patterns; spans has these and what the CRF adds where no base
    span is: numbers and addresses in other forms, and secrets (keys, tokens);
    n_spans counts them all. Null text counts as empty: no spans, the digest of nothing. Null
    ids, repeated rows and further columns pass or are ignored row by row.
    Time is linear in a text's length.
    """
    crf = train(table if table is not None else labelled_table())
    shipped = broadcast_value(docs, (crf.emit.astype("float32"), crf.move.astype("float32")))

    def make():
        model = Crf(*shipped.value)

        def step(batch):
            base, every = find_spans([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(BASE))]
            return {
                key: batch.column(0),
                **{f"n_{name}": c for name, c in zip(BASE, counts, strict=True)},
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(e) for e in every],
                "n_spans": [len(e) for e in every],
            }

        return step

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, " + "".join(f"n_{k} long, " for k in BASE)
    return map_arrow(docs.select(key, text), make, schema + "base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, table=None) -> DataFrame:
    """docs with every span of `text` replaced by its kind in capitals and brackets, and n_chars counted anew.

    All rows and columns stay; null text stays null.
    """
    crf = train(table if table is not None else labelled_table())
    shipped = broadcast_value(docs, (crf.emit.astype("float32"), crf.move.astype("float32")))
    names = docs.columns
    at = names.index("text")

    def make():
        model = Crf(*shipped.value)

        def step(batch):
            texts = batch.column(at).to_pylist()
            _, every = find_spans([t or "" for t in texts], model)
            out = {name: batch.column(i) for i, name in enumerate(names)}
            out["text"] = [t if not spans else covered(t, spans) for t, spans in zip(texts, every, strict=True)]
            if "n_chars" in out:
                out["n_chars"] = [n if t is None else len(t) for t, n in zip(out["text"], out["n_chars"].to_pylist(), strict=True)]
            return out

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, make, schema)


def covered(text: str, spans) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]
