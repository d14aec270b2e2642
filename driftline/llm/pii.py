"""Personal data (operator 10): fixed patterns and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers, leftmost and without overlap per kind. The
random field adds what they miss: numbers without their usual marks and secrets. It is trained on a small labelled
table, :data:`LABELLED`, whose rows are filled with seeded random words and digits, and decoded by Viterbi in numpy
over batches of sequences. Candidates are words with a digit, ``@``, ``=`` or an inner ``:``, the two words after a word
that announces a secret by itself or by a part of its own, and addresses spelled out with "at" and "dot"; all other words have the outside tag by
definition. A chain whose tag is given at a place falls into independent parts there, so only the runs of candidates,
with what stands around them, need decoding, and the result is that of the whole text. Features are of whole words.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as C

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
TAGS = ("O", *[f"{b}-{k}" for k in KINDS for b in "BI"])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@=]|:(?=[^\x20\x09-\x0D])")
_ANNOUNCED = re.compile(r"token|secret|key|passw|pwd|api|auth|credential|passphrase", re.IGNORECASE)
_SPELLED = re.compile(r"\bdot\b", re.IGNORECASE)

# The base patterns of the four kinds. The local part of an address is found from its ``@`` backwards.
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: kind (or None for what is no personal data) and a text: ``{ddd}`` digits, ``{h16-64}`` as many hexadecimal ones and
#: ``{k16-40}`` letters and digits in small or (``H``, ``K``) mixed and capital letters, ``{a9-20}`` small letters,
#: ``{w}`` a word, ``{W}`` a capitalised word, ``{p}`` a mark or none, ``{luhn}`` a card number, ``{bad}`` 16 digits that
#: fail its check, ``{b}`` 0 to 255. The labelled part stands between ``<`` and ``>``.
LABELLED: tuple[tuple[str | None, str], ...] = (
    ("email", "{w} <{w}.{dd}@{w}{d}.example.com> {w}"), ("email", "{w} <{w}@{w}.org>{p} {w}"), ("email", "mail <{w}_{w}@{w}>"), ("email", "({w} <{w}@{w}>) {w}"),
    ("email", "{w} <{w} at {w} dot com>{p} {w}"), ("email", "{w} <{w} (at) {w} (dot) org> {w}"), ("email", "{W} <{w} [at] {w} [dot] net>{p}"),
    ("ip", "{w} <{b}.{b}.{b}.{b}>{p} {w}"), ("ip", "{w} <{b}.{b}.{b}.{b}:{dddd}> {w}"), ("ip", "host <{b}.{b}.{b}.{b}/{dd}>{p} {w}"),
    ("card", "{w} <{luhn}>{p} {w}"), ("card", "{w} card <{luhn}>{p} {W}"), ("card", "{w} <{luhn4}>{p} {w}"),
    ("phone", "{w} <+{d} ({ddd}) {ddd}-{dddd}>{p} {w}"), ("phone", "{w} <({ddd}) {ddd}-{dddd}>{p} {w}"), ("phone", "call <{ddd}-{ddd}-{dddd}> {w}"),
    ("phone", "{w} <{ddd}-{ddd}-{dddd}>{p} {W}"), ("phone", "tel <{ddd}.{ddd}.{dddd}>{p} {w}"), ("phone", "phone: <{ddd} {ddd} {dddd}>{p} {w}"),
    ("secret", '{w} token = <"{h16-64}"> {w}'), ("secret", "key = <{h16-64}>{p} {w}"), ("secret", "{w} secret: <{h16-128}>{p} {w}"), ("secret", 'password = <"{k10-24}">'),
    ("secret", 'TOKEN = <"{H16-64}">{p} {W}'), ("secret", "{w} secret = <{K16-40}> {w}"), ("secret", "{w} auth: <{K16-40}>{p} {w}"), ("secret", 'token = <"{H16-64}"{p}> {W}'),
    ("secret", "{w} <password={k10-24}>{p} {w}"), ("secret", "{w} <api_key={h16-64}>{p} {w}"), ("secret", "{w} <token:{K16-40}> {w}"), ("secret", "<secret={a9-20}>{p} {w}"),
    ("secret", "password = <{a9-20}>{p} {w}"), ("secret", 'token = <"{a9-20}">{p} {w}'), ("secret", "{w} password: <{a9-20}>{p} {w}"), ("secret", "pwd = <{k10-24}> {w}"),
    ("secret", "{W}_PASSWORD: <{a9-20}>{p} {w}"), ("secret", "{w} {w}_secret = <{a9-20}> {w}"), ("secret", "{w} {w}_token: <{a9-20}>{p} {w}"), ("secret", "{w}_key = <{K16-40}> {w}"),
    (None, "{w} <n={ddd}> {w}"), (None, "{w} {w}={w} {w}"), (None, "{w} {w}:{w}{p} {w}"), (None, "{w} = {w}{p}"), (None, "{w} = {dd}{p}"), (None, "{w} key {w} {w} {w}"), (None, "a secret {w} {w}{p}"), (None, "the token {w} {w}"),
    (None, "{w} password {w} {w}"), (None, "{w} key{p} {W} {w}"), (None, "secret{p} {w} {w}"), (None, "{w} {w} dot {w}"), (None, "{w} at {w} {w} dot"), (None, "{w} at {w}, dot {w} {w}"),
    (None, "{w} {d}{p} {w}"), (None, "{w} {dd} {w}"), (None, "{W} {dddd}{p} {w}"), (None, "version {d}.{d} {w}"), (None, "Version {d}.{d}.{d}{p} {w}"), (None, "license {d}.{d}{p}"),
    (None, "{w} {dddd}-{dd}-{dd} {w}"), (None, "{w} {dd}:{dd} {w}"), (None, "{w} {d},{ddd} {w}"), (None, "{w} {dddddd} {w}"), (None, "{w} {dddddddd} {w}"), (None, "{w} {bad}{p} {w}"),
    (None, "{bad}{p} {W}"), (None, "{w} {dd}% {w}"), (None, "{w} ({dd}) {w}"), (None, "{w} [{d}] {w}"), (None, "{w}{d}{p} {w}"), (None, "{w} {dddd}/{dd} {w}"), (None, "{w} {dd} {dd} {dd} {w}"),
    (None, "{w} {dddd} {dddd} {w}"), (None, "{w} {ddd}-{dd} {w}"), (None, "{w} {d}.{dd}{p} {w}"), (None, "@{w} {w}"), (None, "{w} @ {w}"), (None, "{w} {dddddddddddd} {w}"), (None, "{w} {ddd} {ddd} {w}"),
    (None, "{w} {dddddddddddddddddddd} {w}"), (None, "{w} {bad4}{p} {w}"), (None, "{h12-15} {w}"), (None, "{w} {h16-64}{p} {w}"), (None, "{W}{dd}{p} {W}"), (None, "{W} = {w} {w}"), (None, "{w} {K16-40} {w}"),
)
_SMALL = "abcdefghijklmnopqrstuvwxyz"
COPIES, ROUNDS, RIDGE, SEED = 12, 150, 0.02, 7


def luhn(digits: str) -> bool:
    odd = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(2 * int(c) - 9 * (c > "4") for c in odd)) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds; matches that fail a check are dropped. Linear in the text."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out["email"].append((start, m.end()))
            done = m.end() if m else at + 1
            at = text.find("@", done)
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def _shape(word: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 2 else f"9{min(len(m[0]), 20)}", word)
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", out))


_EDGES = "\"'.,;:!?()[]{}<>|"
_CUES = frozenset("token secret key password passwd pwd api auth passphrase credential credentials api_key".split())
_PHONE_CUES = frozenset("call tel phone fax mobile".split())


def _plain(word: str) -> str:
    return word.strip(_EDGES + "=").lower()


_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def _announces(word: str) -> bool:
    """Whether a word is, or has among its parts (``DB_PASSWORD``, ``client-secret``, ``accessToken``), one that announces a secret."""
    if not _ANNOUNCED.search(word):
        return False
    parts = [p.lower() for p in _PARTS.findall(word)]
    return _plain(word) in _CUES or parts[-1] in _CUES or ("_" in word and not _CUES.isdisjoint(parts))


def _cue(words: list[str]) -> str:
    return "secret" if any(map(_announces, words)) else "phone" if not _PHONE_CUES.isdisjoint([_plain(w) for w in words]) else "none"


def _letters(word: str) -> str:
    """Which kinds of letters a word has."""
    return "".join(c for c, found in zip("aA9", (word.upper() != word, word.lower() != word, any(map(str.isdigit, word))), strict=True) if found)


def run_features(words: list[str], before: list[str], after: list[str]) -> list[list[str]]:
    """Features of each word of a run: shapes of it and its neighbours, its letters, checks of its digits, cues."""
    shapes = ["<", *map(_shape, words), ">"]
    out = []
    every = "".join(c for w in words for c in w if c.isdigit())
    around = [*before[-2:], *words]
    first = len(around) - len(words)
    plain = [_plain(w) for w in around]
    spelled: set[int] = set()
    for k, w in enumerate(plain):
        if w == "dot" and k >= 3 and plain[k - 2] == "at":
            spelled.update(range(k - 3 - first, k + 2 - first))
    for i, w in enumerate(words):
        bare = w.strip(_EDGES)
        digits = "".join(c for c in bare if c.isdigit())
        last = around[max(0, first + i - 2) : first + i]
        cue = _cue(last)
        joined = bool(last) and last[-1][-1:] in ("=", ":")
        letters, size = _letters(bare), min(len(bare) // 4, 6)
        f = [
            "1", f"shape={shapes[i + 1]}", f"bare={_shape(bare)}", f"prev={shapes[i]}", f"next={shapes[i + 2]}",
            f"n={min(len(digits), 20)}", f"run={min(len(words), 5)}", f"digits={min(len(every), 25)}", f"cue={cue}",
            f"letters={letters}", f"size={size}", f"cue={cue}, joined={joined}", f"cue={cue}, joined={joined}, size={size}", f"joined={joined}, letters={letters}, size={size}",
        ]
        if i in spelled:
            f.append("spelled")
        if re.fullmatch(r"[0-9A-Fa-f]{16,}", bare):
            f += ["hex", f"hex+{cue}"]
        keyed = re.fullmatch(r"([A-Za-z_]+)[=:](.+)", bare)
        if keyed:
            name = "secret" if _announces(keyed[1]) else "none"
            value = keyed[2].strip(_EDGES)
            f += ["keyed", f"keyed={name}", f"keyed-hex={bool(re.fullmatch('[0-9A-Fa-f]{12,}', value))}", f"keyed={name}, size={min(len(value) // 4, 6)}"]
        if 16 <= len(digits) <= 19:
            f.append(f"luhn={luhn(digits)}")
        if 16 <= len(every) <= 19:
            f.append(f"run-luhn={luhn(every)}")
        if re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:[:/][0-9]+)?", bare):
            f.append("four-parts")
        if "@" in bare[1:-1]:
            f.append("at")
        out.append(f)
    return out


def _filled(pattern: str, rng: random.Random) -> str:
    def card() -> str:
        body = "".join(rng.choice("0123456789") for _ in range(15))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fill(m: re.Match) -> str:
        what = m[1]
        if what in ("w", "W"):
            w = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
            return w if what == "w" else w.capitalize()
        if what[0] == "d":
            return "".join(rng.choice("0123456789") for _ in what)
        if what == "b":
            return str(rng.randint(0, 255))
        if what == "p":
            return rng.choice(["", "", "", ",", ".", ";", "!", "!!", "?"])
        if what[0] in "hHkKa" and what[1:2].isdigit():
            least, most = map(int, what[1:].split("-"))
            chars = {"h": "0123456789abcdef", "H": "0123456789ABCDEF", "k": _SMALL + "0123456789", "K": _SMALL + _SMALL.upper() + "0123456789", "a": _SMALL}[what[0]]
            return "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
        number = card()
        if what.startswith("bad"):
            number = number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)
        return " ".join(number[i : i + 4] for i in range(0, 16, 4)) if what.endswith("4") else number

    return re.sub(r"\{([\w-]+)\}", fill, pattern)


def has_candidates(text: str) -> bool:
    return bool(_MARK.search(text) or _ANNOUNCED.search(text) or _SPELLED.search(text))


def _runs(text: str) -> list[tuple[list[tuple[int, int]], list[str], list[str]]]:
    """Runs of candidate words: their places, the two words before and the one after."""
    places = [m.span() for m in _WORD.finditer(text)]
    marked = [_MARK.search(text, a, b) is not None for a, b in places]
    word = lambda k: text[places[k][0] : places[k][1]]
    if _ANNOUNCED.search(text):
        for i, (a, b) in enumerate(places):
            if _ANNOUNCED.search(text, a, b) and _announces(text[a:b]):
                marked[i + 1 : i + 3] = [True] * len(marked[i + 1 : i + 3])
    if _SPELLED.search(text):
        for i in range(3, len(places)):
            if _plain(word(i)) == "dot" and _plain(word(i - 2)) == "at":
                marked[i - 3 : i + 2] = [True] * len(marked[i - 3 : i + 2])
    out, i = [], 0
    while i < len(places):
        if not marked[i]:
            i += 1
            continue
        j = i
        while j < len(places) and marked[j]:
            j += 1
        out.append((places[i:j], [word(k) for k in range(max(0, i - 2), i)], [word(k) for k in range(j, min(len(places), j + 1))]))
        i = j
    return out


class Field:
    """A linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(TAGS)))
        for i, f in enumerate(features):
            out[i] = self.weights[[self.names[x] for x in f if x in self.names]].sum(0)
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each sequence of emissions; sequences of like length are decoded together."""
        out: list[np.ndarray | None] = [None] * len(sequences)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            by_size.setdefault(len(s), []).append(i)
        for size, at in by_size.items():
            for k in range(0, len(at), max(1, 65536 // size)):
                part = at[k : k + max(1, 65536 // size)]
                e = np.stack([sequences[i] for i in part])
                best, back = e[:, 0] + self.moves[0], np.zeros((len(part), size, len(TAGS)), dtype=np.int8)
                for t in range(1, size):
                    total = best[:, :, None] + self.moves[None, 1:, :]
                    back[:, t] = total.argmax(1)
                    best = total.max(1) + e[:, t]
                tag = best.argmax(1)
                tags = np.zeros((len(part), size), dtype=np.int8)
                for t in range(size - 1, -1, -1):
                    tags[:, t] = tag
                    tag = back[np.arange(len(part)), t, tag]
                for i, row in zip(part, tags, strict=True):
                    out[i] = row
        return out


def _allowed() -> np.ndarray:
    """Moves that tags permit: an inside tag follows its own kind. Row 0 is the start."""
    ok = np.ones((len(TAGS) + 1, len(TAGS)), dtype=bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = False
            ok[[1 + TAGS.index(f"{b}-{tag[2:]}") for b in "BI"], j] = True
    return ok


def train_field(table=LABELLED, copies: int = COPIES, rounds: int = ROUNDS, ridge: float = RIDGE, seed: int = SEED) -> Field:
    """Maximum likelihood with a ridge by Adam, with forward-backward sums over all sequences of a length at once."""
    rng = random.Random(seed)
    runs: list[tuple[list[list[str]], list[int]]] = []
    for kind, pattern in table:
        for _ in range(copies):
            text = _filled(pattern, rng)
            low, high = text.find("<"), text.find(">") - 1
            text = text.replace("<", "").replace(">", "")
            for places, before, after in _runs(text):
                tags, inside = [], False
                for a, b in places:
                    hit = kind is not None and a < high and b > low
                    tags.append(TAGS.index(f"{'I' if inside else 'B'}-{kind}") if hit else 0)
                    inside = hit
                runs.append((run_features([text[a:b] for a, b in places], before, after), tags))
    names: dict[str, int] = {}
    for features, _ in runs:
        for f in features:
            for x in f:
                names.setdefault(x, len(names))
    y = len(TAGS)
    forbidden = np.where(_allowed(), 0.0, -1e4)
    weights, moves = np.zeros((len(names), y)), np.zeros((y + 1, y))
    groups = []
    for size in sorted({len(t) for _, t in runs}):
        own = [(f, t) for f, t in runs if len(t) == size]
        x = np.zeros((len(own), size, len(names)), dtype=np.float32)
        for i, (features, _) in enumerate(own):
            for k, f in enumerate(features):
                x[i, k, [names[v] for v in f]] = 1
        groups.append((x, np.array([t for _, t in own])))
    state = [np.zeros_like(a) for a in (weights, weights, moves, moves)]
    for step in range(1, rounds + 1):
        g_w, g_m = -ridge * weights, -ridge * moves
        for x, tags in groups:
            n, size = tags.shape
            e = x @ weights
            m = moves + forbidden
            ahead = [e[:, 0] + m[0]]
            for t in range(1, size):
                ahead.append(np.logaddexp.reduce(ahead[-1][:, :, None] + m[None, 1:], axis=1) + e[:, t])
            behind = [np.zeros((n, y))]
            for t in range(size - 1, 0, -1):
                behind.insert(0, np.logaddexp.reduce(m[None, 1:] + (e[:, t] + behind[0])[:, None, :], axis=2))
            total = np.logaddexp.reduce(ahead[-1], axis=1)
            rows = np.arange(n)
            for t in range(size):
                p = np.exp(ahead[t] + behind[t] - total[:, None])
                d = -p
                d[rows, tags[:, t]] += 1
                g_w += x[:, t].T @ d
                if t == 0:
                    g_m[0] += d.sum(0)
                else:
                    pair = np.exp(ahead[t - 1][:, :, None] + m[None, 1:] + (e[:, t] + behind[t])[:, None, :] - total[:, None, None])
                    np.add.at(g_m, (1 + tags[:, t - 1], tags[:, t]), 1)
                    g_m[1:] -= pair.sum(0)
        for value, g, first, second in ((weights, g_w, state[0], state[1]), (moves, g_m, state[2], state[3])):
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            value += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(names, weights, moves + forbidden)


_EDGE_OF = {"phone": "\"'.,;:!?[]{}<>|", "secret": "\"'.,;:!?()[]{}<>|"}


def _trimmed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """A span without the marks around it; of a secret only what follows its name."""
    if kind == "secret" and (m := re.match(r"[\W_]*[A-Za-z_]+[=:]", text[a:b])):
        a += m.end()
    edge = _EDGE_OF.get(kind, _EDGES)
    while a < b and text[a] in edge:
        a += 1
    while b > a and text[b - 1] in edge:
        b -= 1
    if kind == "secret" and a and text[a - 1] in "\"'" and 0 <= (end := text.find(text[a - 1], a, b)):
        b = end
    return a, b


def find_spans(texts: list[str], field: Field) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Base spans by kind, and all spans, of each text."""
    out, sequences, owners = [], [], []
    for i, text in enumerate(texts):
        if not has_candidates(text):
            out.append(({k: [] for k in BASE_KINDS}, []))
            continue
        base = base_spans(text)
        out.append((base, [(k, a, b) for k in BASE_KINDS for a, b in base[k]]))
        for places, before, after in _runs(text):
            sequences.append(field.emissions(run_features([text[a:b] for a, b in places], before, after)))
            owners.append((i, places))
    for (i, places), tags in zip(owners, field.decode(sequences), strict=True):
        if not tags.any():
            continue
        text, spans = texts[i], out[i][1]
        covered = [(a, b) for k in BASE_KINDS for a, b in out[i][0][k] if b > places[0][0] and a < places[-1][1]]
        k = 0
        while k < len(tags):
            name = TAGS[tags[k]]
            j = k + 1
            if name != "O":
                while j < len(tags) and TAGS[tags[j]] == f"I-{name[2:]}":
                    j += 1
                a, b = _trimmed(text, places[k][0], places[j - 1][1], name[2:])
                if a < b and not any(x < b and a < y for x, y in covered):
                    spans.append((name[2:], a, b))
            k = j
    for _, spans in out:
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for each row.

    The counts and the digest are those of the base patterns; ``spans`` also has what the random field adds. A null
    text counts as empty. Repeated rows give repeated results; further columns are ignored. An empty table gives an
    empty result.
    """
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train_field())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for base, spans in find_spans([v.as_py().decode("utf-8", "replace") for v in part.column(1)], model):
                    own = [(kind, a, b) for kind in BASE_KINDS for a, b in base[kind]]
                    rows.append((*[len(base[kind]) for kind in BASE_KINDS], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans), len(spans) - len(own)))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [c.split()[0] for c in schema.split(", ")])

    return C.id_and_bytes(docs, id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans go as one. A null text stays null."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train_field())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(at).to_pylist()
                done = []
                for text, (_, spans) in zip(texts, find_spans([t or "" for t in texts], model), strict=True):
                    if spans:
                        parts, last = [], 0
                        for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
                            if a >= last:
                                parts += [text[last:a], f"[{kind.upper()}]"]
                            last = max(last, b)
                        text = "".join([*parts, text[last:]])
                    done.append(text)
                cols = list(part.columns)
                cols[at] = pa.array(done, pa.string())
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
