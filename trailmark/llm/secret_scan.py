"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are outside a secret, begin one, or are inside one. A token's score for being part of a secret is the sum of weights
of its shape, of the words around it and of its file; beginning and being inside differ by the transitions alone. The
field is trained with numpy on a bounded sample of windows that the patterns label, varied so that it learns the look of
secrets rather than the patterns; texts are decoded whole by Viterbi.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, materialise, type_of

#: Fixed: the patterns, and the order of kinds.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: One of these is in every text that ASSIGN fits.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
TOKEN = re.compile(r"[\w+/.-]{16,}={0,2}|[\w+/-]+(?:\.[\w+/-]+)*|[^\w\s]")
#: Windows of either kind that the field is trained on at most, their reach in characters, and tokens of one.
SAMPLE, REACH, WINDOW = 1500, 150, 120
#: Times that an example is varied at most.
MOST_VARIED = 12
#: Weights of a block, which features' names are hashed to: one block for shapes, one for each place of a word beside the
#: token, one for files. Steps of training, their size, and the pull towards 0.
BLOCK, STEPS, RATE, PULL = 1 << 12, 150, 0.15, 2e-4
BESIDE = (-1, -2, -3, 1)
SPACE = BLOCK * (len(BESIDE) + 2)
#: Characters of a text that are tagged at once (cut where a token is outside for certain), and of a found secret at least.
SLICE, LEAST = 1 << 20, 8
#: Words that a task keeps the scores of.
KNOWN = 300_000
O, B, I = range(3)
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind's number, end of the patterns' matches, in order of start, then of kind.

    Matches of a kind don't overlap and are found from the left; an assignment whose value has under six characters is
    passed over with all its characters."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What of the patterns' matches is the secret itself."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [m.span() for x in (ACCESS, HEX) for m in x.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slot(block: int, name: str) -> int:
    return block * BLOCK + zlib.crc32(name.encode("utf-8", "replace")) % BLOCK


def bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def shape_features(token: str) -> list[int]:
    """Slots of a token's length, letters' case, digits, changes between kinds of characters, spread and alphabet."""
    n = len(token)
    names = [f"n{bucket(n, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64)}"]
    if token.isalpha():
        names.append("a" + ("lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed") + f"{bucket(n, 4, 8, 12, 16, 24)}")
        return [slot(0, x) for x in names]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token[:256]]
    digits, symbols = kinds.count("d") / len(kinds), kinds.count("s")
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    names += [f"d{bucket(digits, 0.01, 0.2, 0.4, 0.6, 0.8, 0.99)}", f"s{bucket(symbols, 1, 2, 3, 5)}", f"c{bucket(changes, 1, 2, 3, 5, 8, 12, 20)}", "k" + "".join(sorted(set(kinds)))]
    if n >= LEAST:
        counts = Counter(token[:256])
        spread = -sum(k / min(n, 256) * math.log2(k / min(n, 256)) for k in counts.values())
        names += [f"e{bucket(spread, 1.5, 2, 2.5, 3, 3.5, 4, 4.5)}", f"ce{bucket(changes / n, 0.1, 0.25, 0.4, 0.6)}{bucket(spread, 2.5, 3, 3.5, 4)}"]
        if symbols:
            names.append("marks" + "".join(sorted({c for c, k in zip(token, kinds, strict=False) if k == "s"})))
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
            names.append(f"x{bucket(n, 16, 24, 32, 40)}{bucket(digits, 0.99)}")
    return [slot(0, x) for x in names]


def beside_word(token: str) -> str:
    """What a token is to its neighbours: a short word without digits itself, others their length."""
    return token.lower() if len(token) <= 20 and (token.isalpha() or not any(map(str.isdigit, token))) else f"\n{bucket(len(token), 4, 8, 16, 32)}"


def beside_slots(word: str) -> list[int]:
    """Slots of a word at each place beside a token."""
    return [slot(1 + k, word) for k in range(len(BESIDE))]


def file_features(text: str) -> tuple[int, ...]:
    """Slots of a whole text's length, lines, digits and marks of code."""
    n = max(1, len(text))
    code = sum(map(text.count, "={};"))
    return tuple(slot(1 + len(BESIDE), x) for x in (f"fn{bucket(n, 200, 1000, 5000, 20000)}", f"fl{bucket(text.count(chr(10)) / n, 0.001, 0.005, 0.02, 0.04)}", f"fd{bucket(sum(map(text.count, '0123456789')) / n, 0.001, 0.01, 0.05, 0.1)}", f"fc{bucket(code / n, 0.0005, 0.005, 0.02)}"))


class Known(dict):
    """Token -> its row of `table`: its shape's score, and what it adds to tokens at each place beside it."""

    def __init__(self, field: Field) -> None:
        self.field, self.looks, self.rows, self.table = field, {}, 0, np.zeros((1024, 1 + len(BESIDE)))

    def __missing__(self, token: str) -> int:
        beside = self.field.beside.get(beside_word(token))
        if beside is None and token.isalpha():  # few different looks, a row for each
            look = (min(len(token), 64), token.islower(), token.isupper(), token.istitle())
            row = self.looks.get(look)
            if row is None:
                row = self.looks[look] = self.add(token, 0.0)
        else:
            row = self.add(token, 0.0 if beside is None else beside)
        self[token] = row
        return row

    def add(self, token: str, beside: np.ndarray | float) -> int:
        row = self.rows
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row, 0], self.table[row, 1:] = self.field.weights[shape_features(token)].sum(), beside
        self.rows += 1
        return row


@dataclass
class Field:
    """weights by slot; beside: what words that training has seen twice add to tokens at each place beside them; transitions
    (from, to) between O, B and I. A sequence comes from O and goes to O."""

    weights: np.ndarray
    beside: dict[str, np.ndarray]
    steps: np.ndarray

    @cached_property
    def sure(self) -> float:
        """A token with a score under this is outside in the best tagging, whatever stands beside it: making it so (and
        beginning anew behind it) gains more than transitions can lose."""
        t, gains = self.steps, []
        for before in range(3):
            for own in (B, I):
                if t[before, own] <= NEVER or t[before, O] <= NEVER:
                    continue
                gains += [t[before, own] + t[own, after] - t[before, O] - t[O, after] for after in (O, B)]
                gains += [t[before, own] + t[own, I] + t[I, last] - t[before, O] - t[O, B] - t[B, last] for last in range(3)]
        return -max(gains)

    def scores(self, tokens: list[str], before: list[str], file: float) -> np.ndarray:
        """Each token's score, given up to three tokens before them."""
        known = self.__dict__.get("known")
        if known is None or len(known) > KNOWN:
            known = self.__dict__["known"] = Known(self)
        n, lead = len(tokens), len(before)
        rows = np.fromiter(map(known.__getitem__, [*before, *tokens]), np.int64, lead + n)
        table = known.table[rows]
        out = table[lead:, 0] + file
        for k, by in enumerate(BESIDE):
            if by < 0:
                some = table[max(0, lead + by) : lead + n + by, 1 + k]
                out[n - len(some) :] += some
            else:
                out[: n - by] += table[lead + by :, 1 + k]
        return out

    def tag(self, tokens: list[str], before: list[str], file: float, more: bool) -> tuple[list[tuple[int, int]], int]:
        """First and last token of each secret, and how many tokens are settled; those after may depend on more to come."""
        scores = self.scores(tokens, before, file)
        exact = [(i, scores[i]) for i in np.flatnonzero(scores >= self.sure).tolist()]
        found, k, settled = [], 0, len(tokens)
        while k < len(exact):
            end = k + 1
            while end < len(exact) and exact[end][0] == exact[end - 1][0] + 1:
                end += 1
            if more and exact[end - 1][0] >= len(tokens) - 2:  # the last token's score needs the next
                settled = exact[k][0]
                break
            tags = self.viterbi(np.array([s for _, s in exact[k:end]]))
            for j, tag in enumerate(tags):
                if tag == B:
                    found.append((exact[k + j][0], exact[k + j][0]))
                elif tag == I:
                    found[-1] = (found[-1][0], exact[k + j][0])
            k = end
        return found, min(settled, len(tokens) - 1) if more else settled

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a sequence between two tokens outside."""
        best, back = self.steps[O] + [0.0, scores[0], scores[0]], []
        for s in scores[1:]:
            ways = best[:, None] + self.steps
            back.append(ways.argmax(0))
            best = ways.max(0) + [0.0, s, s]
        tags = [int((best + self.steps[:, O]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def secrets(self, text: str, size: int = SLICE) -> list[tuple[int, int]]:
        """Start and end of the secrets of a whole text, in characters."""
        file, out, before, at, ahead = float(self.weights[list(file_features(text))].sum()), [], [], 0, size
        while at < len(text):
            blank = re.compile(r"\s").search(text, at + ahead) if len(text) - at > ahead else None
            end = blank.start() if blank else len(text)
            tokens, more = TOKEN.findall(text, at, end), end < len(text)
            found, settled = self.tag(tokens, before, file, more)
            if more and settled <= 0 and tokens:
                ahead *= 2
                continue
            if found or more:
                places = [m.span() for m in TOKEN.finditer(text, at, end)]
                for a, b in found:
                    if a < settled:
                        start, stop = places[a][0], places[b][1]
                        stop -= len(text[start:stop]) - len(text[start:stop].rstrip(".-/"))
                        if stop - start >= LEAST:
                            out.append((start, stop))
                at = places[settled][0] if settled < len(places) else end
            else:
                at = end
            before, ahead = [*before, *tokens[:settled]][-3:], size
        return out


def fit_field(windows: list[tuple[str, list[tuple[int, int]], tuple[int, ...]]]) -> Field:
    """Largest likelihood of the tags of windows (text, secrets in it, file features), by gradient steps over all of them."""
    rows = []
    for text, secrets, file in windows:
        places = [m.span() for m in TOKEN.finditer(text)][:WINDOW]
        tokens = [text[a:b] for a, b in places]
        tags, last = [], -1
        for a, b in places:
            hit = next((k for k, (x, y) in enumerate(secrets) if a < y and b > x), -1)
            tags.append(O if hit < 0 else I if hit == last else B)
            last = hit
        if tokens:
            rows.append((tags, tokens, file))
    seen = Counter(beside_word(t) for _, tokens, _ in rows for t in tokens)
    slots_of = {w: beside_slots(w) for w, n in seen.items() if n > 1}
    field = Field(np.zeros(SPACE), {}, np.array([[0.0, 0.0, NEVER], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]))
    if not any(B in tags for tags, *_ in rows):
        field.weights[:] = -1.0  # nothing to learn from: every token is outside
        return field
    rows.sort(key=lambda r: -len(r[0]))
    n, length = len(rows), len(rows[0][0])
    counts = np.array([len(r[0]) for r in rows])
    live = [int((counts > t).sum()) for t in range(length)]  # rows that have a t-th token come first
    tags = np.zeros((n, length), int)
    flat, where = [], []
    for i, (own, tokens, file) in enumerate(rows):
        tags[i, : len(own)] = own
        near = [slots_of.get(beside_word(t)) for t in tokens]
        for t, token in enumerate(tokens):
            slots = [*shape_features(token), *file, *(near[t + by][k] for k, by in enumerate(BESIDE) if 0 <= t + by < len(near) and near[t + by])]
            flat += slots
            where += [i * length + t] * len(slots)
    flat, where = np.array(flat), np.array(where)
    there = np.arange(length) < counts[:, None]
    truth = np.zeros((3, 3))
    path = np.concatenate([np.zeros((n, 1), int), tags, np.zeros((n, 1), int)], 1)
    for t in range(length + 1):
        np.add.at(truth, (path[: n if t == 0 else live[t - 1], t], path[: n if t == 0 else live[t - 1], t + 1]), 1)
    moments = [np.zeros((2, SPACE)), np.zeros((2, 3, 3))]
    allowed = field.steps > NEVER
    secret = np.array([0.0, 1.0, 1.0])
    for step in range(1, STEPS + 1):
        score = np.bincount(where, field.weights[flat], minlength=n * length).reshape(n, length)
        emit = np.exp(np.clip(score, -30, 30)[:, :, None] * secret)
        move = np.where(allowed, np.exp(np.clip(field.steps, -30, 30)), 0.0)
        # Scaled forward and backward sums over the rows that are still running.
        ahead, back = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        for t in range(length):
            k = live[t]
            a = (move[O][None] if t == 0 else ahead[:k, t - 1] @ move) * emit[:k, t]
            ahead[:k, t] = a / a.sum(1, keepdims=True)
        expected = np.zeros((3, 3))
        for t in range(length - 1, -1, -1):
            k, on = live[t], live[t + 1] if t + 1 < length else 0
            b = np.tile(move[:, O], (k, 1))
            if on:
                b[:on] = (back[:on, t + 1] * emit[:on, t + 1]) @ move.T
            back[:k, t] = b / b.sum(1, keepdims=True)
            if on:
                pair = ahead[:on, t, :, None] * move[None] * (back[:on, t + 1] * emit[:on, t + 1])[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            final = ahead[on:k, t] * move[:, O]
            expected[:, O] += (final / final.sum(1, keepdims=True)).sum(0)
        mine = ahead * back
        mine /= np.maximum(mine.sum(2, keepdims=True), 1e-300)
        expected[O] += mine[:, 0].sum(0)
        wrong = np.where(there, (tags != O) - mine[:, :, 1:].sum(2), 0.0).ravel()
        slopes = [np.bincount(flat, wrong[where], minlength=SPACE) / n - PULL * field.weights, np.where(allowed, (truth - expected) / n - PULL * field.steps, 0.0)]
        for values, slope, (mean, square) in zip((field.weights, field.steps), slopes, moments, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            values += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(field.weights, {w: field.weights[x] for w, x in slots_of.items()}, np.where(allowed, field.steps, NEVER))


#: What examples are varied with: names, joints and alphabets of secrets. Fixed values.
NAMED = ("password", "passwd", "secret", "token", "api_key", "apikey", "access key", "auth", "bearer", "credential", "private_key", "client_secret")
JOINTS = (" = ", "=", ": ", ":", " is ", " => ", " ")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def varied(text: str, secrets: list[tuple[int, int]], file: tuple[int, ...], rng: random.Random, times: int = 1) -> Iterator[tuple]:
    """An example, and so many times three with another secret in its place and one with an ordinary word, which is none."""
    yield text, secrets, file
    if not secrets:
        return
    a, b = secrets[0]
    m = next((m for m in ASSIGN.finditer(text) if m.start(2) <= a < m.end(2)), None)
    head, tail = text[: m.start() if m else a], text[b:][:REACH]
    words = [w for w in re.findall(r"[^\W\d_]+", text) if w.lower() not in NAMES] or ["none"]
    for plain in (False, False, False, True) * times:
        quote = rng.choice(("", '"', "'"))
        lead = rng.choice(NAMED) + rng.choice(JOINTS) + quote
        value = rng.choice(words) if plain else "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(14, 48)))
        made = head + lead + value
        yield made + (quote if not m or not tail[:1] in "\"'" else "") + tail, [] if plain else [(len(head) + len(lead), len(made))], file


def learn_field(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field trained on at most `sample` windows with a match of the patterns and as many without, those of least hash.

    All texts are searched; equal windows count once. Without any match every token is outside."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            out = []
            for text in rows.column("text").to_pylist():
                spans = base_spans(text)
                # A window without a match: around the first digit after a place that the text's hash gives.
                at = zlib.crc32(text[:4096].encode("utf-8", "replace")) % max(1, len(text))
                digit = re.compile(r"\d").search(text, at, at + 20_000)
                at = digit.start() if digit else at
                for hit, a, b in [*((True, a, b) for a, _, b in spans[:20]), (False, at, at)]:
                    a, b = text.rfind(" ", 0, max(0, a - REACH)) + 1, text.find(" ", b + REACH)
                    window = text[a : b if b > 0 else len(text)][: 8 * REACH]
                    out.append((hit, zlib.crc32(window.encode("utf-8", "replace")), window, list(file_features(text)) if hit or not spans else None))
            out = [x for x in out if x[3] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32())))], ["hit", "hash", "window", "file"])

    made = map_batches(docs.select(F.col(text_col).alias("text")).where("text <> ''"), run, "hit boolean, hash long, window string, file array<int>")
    rng, windows = random.Random(13), []
    seen = materialise(made.groupBy("hit", "hash").agg(F.min(F.struct("window", "file")).alias("w")).select("hit", "hash", "w.*"), "secret-windows")
    for hit in (True, False):
        rows = seen.where(F.col("hit") == hit).orderBy("hash").limit(sample).collect()
        times = max(1, min(MOST_VARIED, sample // (4 * max(1, len(rows)))))  # few examples are varied more often
        for r in rows:
            secrets = secret_parts(r.window)
            if bool(secrets) == hit:
                windows += varied(r.window, secrets, tuple(r.file), rng, times)
    return fit_field(windows)


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_crf, base_sha256, spans for every row, over its whole text.

    spans: kind:start:end of all, comma-joined, by start, then kind; code points, end exclusive. The field's spans (crf)
    are those that no pattern's match overlaps. A null text is empty: no spans. Null ids and repeated rows stay; other
    columns aren't read.
    """

    def one(text: str) -> tuple:
        base = base_spans(text)
        more = [(a, 3, b) for a, b in field.secrets(text) if not any(a < y and b > x for x, _, y in base)]

        def write(spans: list[tuple[int, int, int]]) -> str:
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

        return (*(sum(k == kind for _, k, _ in base) for kind in range(3)), len(more), hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + more)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            made = [one(text or "") for text in rows.column("text").to_pylist()]
            types = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([r[i] for r in made], t) for i, t in enumerate(types))], ["id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    schema = f"id {type_of(docs, id_col)}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)
