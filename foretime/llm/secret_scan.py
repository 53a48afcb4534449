"""Secret scans: three patterns, and a linear-chain conditional random field that adds spans.

Patterns, leftmost and non-overlapping for each kind, ASCII letters only:
assign (a secret-like name, `=` or `:`, a value of 12 or more characters), access (AKIA and more
upper-case letters and digits, 18 or more), hex (16 or more of [0-9a-f]).

The random field tags the tokens of a text, its runs of other than white space, as begin,
inside or outside of a secret. Its features are a token's shape, the words next to it and
features of the whole file; it is decoded by Viterbi over all tokens. Where the scores of a token
are so low that no best path can leave outside there (`Field.sure`), the chain falls apart, and each
run of the other tokens is decoded by itself, with the same result as the whole text. All spans of
the field are added with kind `crf`, also where they touch a pattern's span.

The field is trained here, by gradient descent on the likelihood with numpy, on sequences made by
rule: secrets of several forms after telling and untelling words, and look-alikes (numbers, cards,
phones, dates, mail addresses, urls, versions) among plain words.

Cases: a null or empty text has no spans. A null id is carried. Rows that repeat are scanned
each. Very long texts are read whole. An empty table gives an empty result. Other columns are
ignored by `find_secrets` and carried along by `mask_secrets`.
"""

from __future__ import annotations

import operator
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_of

KINDS = ("assign", "access", "hex", "crf")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_KINDS = str.maketrans(string.ascii_letters + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
_HEXED = frozenset(string.hexdigits)
_CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Words that the field looks for next to a token.
TELLING = ("key", "auth", "bearer", "credential", "private", "access", "login", "pass", "pwd", "signature", *NAMES)
PLAIN = ("phone", "tel", "call", "card", "date", "version", "page", "id", "order", "issue", "chapter", "mail", "isbn", "year")
_TELLING, _NAMED = re.compile("|".join(TELLING)), re.compile("|".join(NAMES))
_NUMBER, _LETTERS, _SIGNS = re.compile(r"[\d.,:/+()#-]+"), re.compile("[A-Za-z]{8}"), re.compile("[+/=]")
_PREFIXED = re.compile(r"[\"']?(AKIA|[a-z]{2,3}_[a-z]*_?[A-Za-z0-9]{8})")
OUT, BEGIN, INSIDE = range(3)
#: Sequences made for training, and the steps.
SEQUENCES, STEPS = 2_000, 120
#: Entries of a task's table of tokens.
TABLE_TOKENS = 200_000
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns. The expensive ones run only where their plain parts occur."""
    out = []
    if any(n in (low := text.lower()) for n in NAMES) or not low.isascii() and any(n in low.replace("ſ", "s") for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shape(token: str) -> list[str]:
    """The features of a token by itself."""
    core = "".join(_CORE.findall(token))
    n, signs = len(core), set(core)
    upper, lower = core != core.lower(), core != core.upper()
    digits = sum(map(core.count, string.digits)) if not core.isalpha() else 0
    digit = digits > 0
    length = min(n // 4, 12)
    kinds = core[:64].translate(_KINDS)
    turns = sum(map(operator.ne, kinds, kinds[1:])) / max(1, len(kinds) - 1)
    hexed = n > 0 and _HEXED.issuperset(signs)
    out = [
        "bias",
        f"mix{lower:d}{upper:d}{digit:d}",
        f"len{length}",
        f"mix{lower:d}{upper:d}{digit:d}len{min(length, 6)}",
        f"distinct{min(len(signs) // 3, 9)}",
        f"distinct{min(len(signs) // 3, 9)}len{min(length, 6)}",
        f"turns{int(turns * 5)}",
        f"digits{int(5 * digits / n) if n else 0}",
        f"hex{hexed:d}{min(length, 6)}",
    ]
    out += ["allnumber"] * bool(_NUMBER.fullmatch(token.strip("\"'")))
    out += ["mail"] * ("@" in token) + ["url"] * ("://" in token or token.startswith("www.")) + ["words"] * bool(digits < 3 and _LETTERS.search(core))
    out += ["named"] * bool(_NAMED.search(token.lower())) + ["prefixed"] * bool(_PREFIXED.match(token))
    out += ["quoted"] * (token[:1] in "\"'")
    if not digit:  # words have at most a first capital, or capitals only
        low, rest = token.lower(), token.lstrip("\"'([{<*_-#")[1:]
        out += ["cased"] * (token in (low, token.upper()) or rest == rest.lower()) + ["signs"] * bool(_SIGNS.search(core)) + ["foreign"] * (not token.isascii())
    return out


def near_word(token: str, at: str) -> list[str]:
    """The features that a neighbour gives; at tells where it stands."""
    low = token.lower().strip("\"'.,;()")
    out = [f"{at}sign"] * (low in ("=", ":", ":=", "=>")) + [f"{at}ends"] * (low[-1:] in ("=", ":") and len(low) > 1)
    low = low.rstrip("=:")
    return out + [f"{at}telling"] * bool(_TELLING.search(low)) + [f"{at}plain"] * (low in PLAIN) + [f"{at}digit"] * bool(_DIGIT.search(low)) + [f"{at}none"] * (not token)


def plain_form(token: str) -> tuple | None:
    """For words of letters, small but for the first, with a comma or full stop or without: all that the features of such a token depend on."""
    body = token[:-1] if token[-1:] in (".", ",") else token
    if not (body.isalpha() and (body.islower() or body[1:].islower())):
        return None
    low, core = body.lower(), body.encode("ascii", "ignore").decode()
    if low == "www":
        return None
    signs = set(core)
    telling = bool(_TELLING.search(low))
    return token[len(body) :], body.isascii(), core[:1].isupper(), len(core), len(signs), _HEXED.issuperset(signs), telling, telling and bool(_NAMED.search(low)), low in PLAIN


def file_features(text: str) -> list[str]:
    """Of the whole text: how much of it is signs, and whether it assigns anything."""
    signs = sum(text.count(c) for c in "={}[]();:_") / max(1, len(text))
    return [f"file{min(int(signs * 100), 5)}"] + ["fileassigns"] * (" = " in text or '": "' in text)


@dataclass
class Field:
    """weights: feature -> scores of the three tags; moves: scores from tag to tag."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def emission(self, feats: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for x in feats:
            w = self.weights.get(x)
            if w is not None:
                out += w
        return out

    def sure(self, emissions: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path: putting them outside gains more than the moves to and from them can lose, whatever stands next to them."""
        m = self.moves
        gain = [max(m[p, tag] + m[tag, q] - m[p, OUT] - m[OUT, q] for p in range(3) for q in range(3)) for tag in (BEGIN, INSIDE)]
        return (emissions[:, BEGIN] - emissions[:, OUT] + gain[0] < -1e-6) & (emissions[:, INSIDE] - emissions[:, OUT] + gain[1] < -1e-6)

    def decode(self, emissions: list[np.ndarray]) -> list[int]:
        """Viterbi; what stands before and after is outside."""
        best, back = emissions[0] + self.moves[OUT], []
        for e in emissions[1:]:
            all_ = best[:, None] + self.moves
            back.append(all_.argmax(0))
            best = all_.max(0) + e
        at = int((best + self.moves[:, OUT]).argmax())
        tags = [at]
        for b in reversed(back):
            at = int(b[at])
            tags.append(at)
        return tags[::-1]


class Scores:
    """For each token: what it adds to its own scores and to those of the tokens next to it."""

    def __init__(self, model: Field):
        self.model = model
        self.known: dict[tuple, np.ndarray] = {}  # by form or features, of which there are few
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, 4, 3))
        self.add("")

    def add(self, token: str) -> int:
        k = self.row[token] = len(self.row)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        form = plain_form(token) or (tuple(shape(token)), tuple(near_word(token, "")))
        scores = self.known.get(form)
        if scores is None:
            own, near = shape(token), near_word(token, "")
            scores = self.known[form] = np.array([self.model.emission(own), *(self.model.emission([at + x for x in near]) for at in ("b", "bb", "a"))])
        self.table[k] = scores
        return k

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.row) > TABLE_TOKENS:
            self.clear()
        row, add = self.row, self.add
        rows = [row[x] if x in row else add(x) for x in tokens]
        at = np.array([0, 0, *rows, 0])
        return self.table[at[2:-1], 0] + self.table[at[1:-2], 1] + self.table[at[:-3], 2] + self.table[at[3:], 3]


def field_spans(text: str, model: Field, scores: Scores | None = None) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    tokens = text.split()
    if not tokens:
        return out
    emissions = (scores or Scores(model)).emissions(tokens) + model.emission(file_features(text))
    open_ = np.flatnonzero(~model.sure(emissions)).tolist()
    tags = {}
    while open_:
        n = next((k for k in range(1, len(open_)) if open_[k] != open_[k - 1] + 1), len(open_))
        tags.update(zip(open_[:n], model.decode(list(emissions[open_[:n]]))))
        open_ = open_[n:]
    if not any(tags.values()):
        return out
    places = [m.span() for m in _TOKEN.finditer(text)]
    span: tuple[int, int] | None = None
    for k in [*sorted(tags), len(tokens)]:
        tag = tags.get(k, OUT)
        if span and (tag != INSIDE or k - 1 not in tags):
            core = [m.span() for m in _CORE.finditer(text, *span)]
            if core:
                out.append(("crf", core[0][0], core[-1][1]))
            span = None
        if tag != OUT:
            span = (span[0] if span else places[k][0], places[k][1])
    return out


def scan(text: str, model: Field, scores: Scores | None = None) -> list[tuple[str, int, int]]:
    """All spans in order: those of the patterns and those of the field."""
    return in_order(base_spans(text) + field_spans(text, model, scores))


#: Of the words in training sequences.
SYLLABLES = ("th", "er", "on", "an", "re", "en", "la", "de", "os", "ch", "ing", "tion", "heit", "eux", "ción", "über", "st", "ble", "ge", "un")


def _made(rnd: random.Random) -> tuple[list[str], list[int]]:
    """One training sequence: tokens and tags."""
    cased = lambda w: rnd.choices((w, w.capitalize(), w.upper(), f"{w}-{w[:4].capitalize()}", f"{w}{w[:5].capitalize()}"), (70, 22, 4, 2, 2))[0]
    words = lambda k: [cased("".join(rnd.choice(SYLLABLES) for _ in range(rnd.choices(range(1, 10), (8, 8, 8, 8, 4, 2, 1, 1, 1))[0]))) + rnd.choices(("", ",", ".", "?", ")", "..."), (80, 8, 8, 1, 1, 1))[0] for _ in range(k)]
    pick = lambda signs, lo, hi: "".join(rnd.choice(signs) for _ in range(rnd.randint(lo, hi)))
    digits, alnum = string.digits, string.ascii_letters + string.digits
    tokens, tags = words(rnd.randint(1, 12)), []
    tags = [OUT] * len(tokens)
    for _ in range(rnd.randint(0, 2)):
        if rnd.random() < 0.5:
            value = rnd.choice((
                lambda: pick("0123456789abcdef", 32, 64),
                lambda: pick(alnum, 20, 44) + rnd.choice(("", "=", "==")),
                lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16, 16),
                lambda: rnd.choice(("sk_live_", "ghp_", "xoxb-", "pk_test_")) + pick(alnum, 20, 36),
                lambda: pick(alnum + "+/", 30, 60),
                lambda: pick(alnum, 14, 20) + rnd.choice("!_-.") + pick(digits, 2, 4),
                lambda: pick(string.ascii_letters, 20, 44),
            ))()
            quote = rnd.choice(('"', "'", ""))
            name = rnd.choice(TELLING)
            lead = rnd.choice(([name, "="], [name + ":"], [name.upper(), "="], [name, ":"], words(1)))
            tokens += lead + [quote + value + quote + rnd.choice(("", "", ",", ";"))]
            tags += [OUT] * len(lead) + [BEGIN]
            if rnd.random() < 0.05:  # a secret that is broken by white space
                tokens.append(pick(rnd.choice((alnum, string.ascii_letters)), 12, 20))
                tags.append(INSIDE)
        else:
            value = rnd.choice((
                lambda: pick(digits, 1, 8),
                lambda: pick(digits, 13, 19),
                lambda: "-".join(pick(digits, 4, 4) for _ in range(4)),
                lambda: f"+{pick(digits, 1, 2)}-{pick(digits, 3, 3)}-{pick(digits, 3, 4)}-{pick(digits, 4, 4)}",
                lambda: f"{rnd.randint(1980, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}",
                lambda: f"{words(1)[0]}.{pick(digits, 1, 3)}@mail{pick(digits, 1, 1)}.example.com",
                lambda: f"https://www.{words(1)[0]}.example.com/en/{pick(digits, 1, 4)}",
                lambda: f"v{pick(digits, 1, 1)}.{pick(digits, 1, 2)}.{pick(digits, 1, 2)}",
                lambda: words(1)[0] + pick(digits, 1, 3),
                lambda: f"{words(1)[0]}_{words(1)[0]}{pick(digits, 1, 2)}()",
                lambda: ".".join(pick(digits, 1, 3) for _ in range(4)),
            ))()
            lead = rnd.choice(([rnd.choice(PLAIN)], [rnd.choice(PLAIN) + ":"], words(1), words(2)))
            tokens += lead + [value + rnd.choice(("", "", ".", ",", "###", "%%%"))]
            tags += [OUT] * (len(lead) + 1)
        more = words(rnd.randint(0, 8))
        tokens, tags = tokens + more, tags + [OUT] * len(more)
    return tokens, tags


def _token_features(tokens: list[str], k: int) -> list[str]:
    at = lambda j: tokens[j] if 0 <= j < len(tokens) else ""
    return shape(tokens[k]) + near_word(at(k - 1), "b") + near_word(at(k - 2), "bb") + near_word(at(k + 1), "a")


@cache
def train(sequences: int = SEQUENCES, steps: int = STEPS, seed: int = 7) -> Field:
    """The field, made once in a process, from so many sequences made by rule, each a chain of all its tokens."""
    rnd = random.Random(seed)
    runs: list[tuple[list[list[str]], list[int]]] = []
    for _ in range(sequences):
        tokens, tags = _made(rnd)
        of_file = file_features(" ".join(tokens))
        runs.append(([_token_features(tokens, j) + of_file for j in range(len(tokens))], tags))
    names = sorted({x for feats, _ in runs for f in feats for x in f})
    at, longest = {x: k for k, x in enumerate(names)}, max(len(t) for _, t in runs)
    n, f = len(runs), len(names)
    x = np.zeros((n, longest, f), np.float32)
    tags = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for r, (feats, t) in enumerate(runs):
        for j, names_j in enumerate(feats):
            x[r, j, [at[y] for y in names_j]] = 1
        tags[r, : len(t)], live[r, : len(t)] = t, True
    flat, gold = x[live], np.eye(3, dtype=np.float32)[tags[live]]
    w, moves = np.zeros((f, 3), np.float32), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    total = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    padded = np.c_[np.zeros(n, np.int64), tags, np.zeros(n, np.int64)]
    for step in range(1, steps + 1):
        e = np.full((n, longest, 3), (0.0, -1e4, -1e4))  # outside after the end
        e[live] = flat @ w
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0] + moves[OUT]
        for j in range(1, longest):
            alpha[:, j] = e[:, j] + total(alpha[:, j - 1, :, None] + moves, 1)
        beta[:, -1] = moves[:, OUT]
        for j in range(longest - 2, -1, -1):
            beta[:, j] = total(moves + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        z = total(alpha[:, -1] + moves[:, OUT], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        g_w = flat.T @ (p[live] - gold).astype(np.float32) / n + 1e-4 * w
        pairs = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1)) if longest > 1 else 0
        want = np.zeros((3, 3))
        np.add.at(want, (padded[:, :-1].ravel(), padded[:, 1:].ravel()), 1)
        g_m = np.zeros((3, 3)) + pairs
        g_m[OUT] += p[:, 0].sum(0)
        g_m[:, OUT] += p[:, -1].sum(0)
        g_m = (g_m - want) / n + 1e-4 * moves
        for value, g, m, v in ((w, g_w, state[0], state[1]), (moves, g_m, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({name: w[k].astype(float) for name, k in at.items()}, moves)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> in order of start, then kind: a row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value)
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, sent.value, scores)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with MASK in place of each span; spans that overlap are one."""
    out, at = [], 0
    for _, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], MASK]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, model: Field) -> DataFrame:
    """docs with MASK in place of every secret; a null text stays null. n_chars, if there, is the new length; other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value)
        for batch in slices(batches, at):
            texts = pa.array([None if t is None else masked(t, scan(t, sent.value, scores)) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
