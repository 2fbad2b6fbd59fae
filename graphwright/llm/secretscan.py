"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns find assignments, access keys and long hex strings in whole texts.
The CRF tags tokens as the beginning or the inside of a secret, or as outside,
from a token's shape, its neighbours and features of the whole text, and adds
what it decodes (Viterbi) beside the patterns' spans.

It is trained on the driver by maximum likelihood on windows of a few dozen
tokens: TRAIN_WINDOWS passages at most, chosen by the hash of their doc_id among
all documents and labelled by the patterns; and, so that it learns more than
the patterns know, the same passages with made-up secrets in them (PER_PASSAGE
each): other keywords, other signs or words between keyword and value, headers,
keys told by their prefix; and with what only looks like one: short hexadecimal
numbers, base64 in prose, versions, dates, names of files, keywords before plain
words.  All of it follows from the seed.

Decoding covers every token, but most need no work: a token is certain to be
outside if, with no keyword, assignment sign or quote among the four tokens
before it, its own weights for "outside" beat the others by more than any
neighbour, text feature or transition could make up.  An optimal path is
outside there, so only the stretches between such tokens are decoded.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import textvec as tv
from graphwright.llm.common import table

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
_HINTS = (b"passw", b"secret", b"token", b"api")
_LONG_HEX = re.compile(rb"[0-9a-f]{24}")

TRAIN_WINDOWS = 1200
#: Made-up secrets, and as many look-alikes, that a passage is used with.
PER_PASSAGE = 1
#: Words before and after the middle of a training window.
REACH = 12
CACHE_SIZE = 1 << 19

_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\x00-\x7F]+|[^\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEYWORD = re.compile(r"(?i:passw|passphrase|pwd$|secret|token|api_?key|credential|auth|bearer|private|^key$)", re.ASCII)
#: Some letters, a sign, and a long rest with letters and digits in one piece.
_PREFIXED = re.compile(r"[A-Za-z]{2,6}[_-](?:[a-z]{2,6}[_-])?(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}$")
B, I, O = 0, 1, 2  # noqa: E741

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches in code points, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _may_match(raw: bytes) -> bool:
    if b"AKIA" in raw or _LONG_HEX.search(raw):
        return True
    low = raw.lower()
    return any(h in low for h in _HINTS)


# --- features -------------------------------------------------------------

_LENGTHS = (2, 6, 12, 20, 32)
_SHAPES = ("lower", "title", "upper", "digits", "hexlike", "mixed", "sign", "beyond", "other")
_CONTEXTS = ("kw", "eq", "quote", "letters", "digits", "other", "none")
_LEADS = ("kw eq", "eq", "kw", "kw word", "none")
_FILE = ("digits", "code")


def _shape(tok: str) -> str:
    if len(tok) == 1 and not tok.isalnum():
        return "sign"
    if not tok.isascii():
        return "beyond"
    if tok.isdigit():
        return "digits"
    if tok.isalpha():
        return "lower" if tok.islower() else "upper" if tok.isupper() else "title" if tok[1:].islower() else "mixed"
    core = tok.strip("._-/+")
    if core.isalpha():
        return "lower" if core.islower() else "title"
    if re.fullmatch(r"[0-9a-f]+", core):
        return "hexlike"
    return "mixed" if any(c.isdigit() for c in core) and any(c.isalpha() for c in core) else "other"


def _context(tok: str) -> str:
    if tok in "=:":
        return "eq"
    if tok in "\"'":
        return "quote"
    if _KEYWORD.search(tok):
        return "kw"
    if tok.isalpha():
        return "letters"
    return "digits" if any(c.isdigit() for c in tok) else "other"


def _own_names(tok: str) -> list[str]:
    n = sum(len(tok) >= x for x in _LENGTHS)
    shape = _shape(tok)
    digits = sum(c.isdigit() for c in tok) / len(tok)
    out = ["bias", f"len{n}", f"shape {shape}", f"{shape} {n}", f"digits{min(3, int(digits * 4))}"]
    if len(tok) >= 12:
        out.append(f"varied{min(4, int(5 * len(set(tok)) / min(len(tok), 32)))}")
    if _KEYWORD.search(tok):
        out.append("keyword")
    if shape == "mixed":
        if _PREFIXED.match(tok):
            out.append("prefixed")
        if any(c.isupper() for c in tok) and any(c.islower() for c in tok):
            out.append("both cases")
        signs = sum(not c.isalnum() for c in tok)
        out.append(f"signs{min(3, signs)}")
    return out


NAMES = ["bias"]
NAMES += [f"len{n}" for n in range(6)] + [f"shape {s}" for s in _SHAPES] + [f"{s} {n}" for s in _SHAPES for n in range(6)]
NAMES += [f"digits{n}" for n in range(4)] + [f"varied{n}" for n in range(5)] + ["keyword", "prefixed", "both cases"] + [f"signs{n}" for n in range(4)]
NAMES += [f"lead {x}" for x in _LEADS] + [f"before {x}" for x in _CONTEXTS] + [f"after {x}" for x in _CONTEXTS] + [f"file {x}" for x in _FILE]
INDEX = {n: i for i, n in enumerate(NAMES)}


def _lead(before: list[str]) -> str:
    """What the contexts of the four tokens before lead to, quotes aside."""
    seen = [c for c in before[-4:] if c != "quote"]
    if seen and seen[-1] == "eq":
        return "kw eq" if "kw" in seen[:-1] else "eq"
    if seen and seen[-1] == "kw":
        return "kw"
    return "kw word" if len(seen) > 1 and seen[-2] == "kw" else "none"


def file_features(raw: bytes) -> list[str]:
    head = max(1, len(raw))
    digits = sum(raw.count(d) for d in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))
    code = raw.count(b"{") + raw.count(b";") + raw.count(b"=")
    return ["digits"] * (digits > 0.03 * head) + ["code"] * (code > 0.005 * head)


def _feature_rows(tokens: list[str], left: list[str], right: str, file: list[str]) -> list[list[int]]:
    """Feature numbers of each token; left: contexts of up to four tokens before, right: that of the one behind."""
    contexts = [*left, *[_context(t) for t in tokens], right]
    rows = []
    for k, tok in enumerate(tokens):
        at = k + len(left)
        names = [*_own_names(tok), f"lead {_lead(contexts[max(0, at - 4) : at])}", f"before {contexts[at - 1] if at else 'none'}", f"after {contexts[at + 1]}"]
        rows.append([INDEX[n] for n in [*names, *[f"file {x}" for x in file]]])
    return rows


# --- model ----------------------------------------------------------------


class CRF:
    """Weights of features by state, and of transitions from state to state."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 80, l2: float = 1e-3) -> CRF:
        """Maximum likelihood by Adam over all sequences at once; sequences are (feature rows, tags)."""
        n, longest = len(sequences), max((len(y) for _, y in sequences), default=0)
        w, t = np.zeros((len(NAMES), 3)), np.zeros((3, 3))
        if not n:
            w[INDEX["bias"], O] = 50.0
            return cls(w, t)
        x = np.zeros((n, longest, len(NAMES)), np.float32)
        tags = np.full((n, longest), -1)
        for i, (rows, y) in enumerate(sequences):
            for j, (row, tag) in enumerate(zip(rows, y, strict=True)):
                x[i, j, row] = 1
                tags[i, j] = tag
        mask = tags >= 0
        gold = np.eye(3)[np.maximum(tags, 0)] * mask[:, :, None]
        pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        moments = [np.zeros_like(v) for v in (w, w, t, t)]
        flat = x.reshape(-1, len(NAMES))
        for step in range(1, rounds + 1):
            scores = (flat @ w.astype(np.float32)).reshape(n, longest, 3).astype(np.float64)
            node, edge = cls._marginals(scores, t, mask)
            gw = flat.T @ (gold - node).reshape(-1, 3).astype(np.float32) / n - l2 * w
            gt = (pairs - edge) / n - l2 * t
            for v, g, k in ((w, gw, 0), (t, gt, 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
                v += 0.15 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)
        return cls(w, t)

    @staticmethod
    def _marginals(scores: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def total(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis=axis, keepdims=True)
            return np.log(np.exp(v - m).sum(axis=axis)) + m.squeeze(axis)

        n, longest, _ = scores.shape
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for j in range(1, longest):
            step = total(ahead[:, j - 1, :, None] + t, 1) + scores[:, j]
            ahead[:, j] = np.where(mask[:, j, None], step, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = total(t + (scores[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            behind[:, j] = np.where(mask[:, j + 1, None], step, 0.0)
        z = total(ahead[:, -1], 1)
        node = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
        both = ahead[:, :-1, :, None] + t + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
        edge = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        return node, edge

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best tags of a stretch with "outside" on both sides."""
        scores = np.array([self.weights[r].sum(axis=0) for r in rows])
        best, back = scores[0] + self.moves[O], []
        for s in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + s
        tags = [int((best + self.moves[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def slack(self) -> float:
        """What context (no lead), text features and transitions can add to a tag over "outside" at most."""
        gain = lambda name: float(max(0.0, (self.weights[INDEX[name], :2] - self.weights[INDEX[name], O]).max()))
        worst = lambda names: float(max((self.weights[INDEX[n], :2] - self.weights[INDEX[n], O]).max() for n in names))
        context = worst(["lead none"]) + worst([f"before {x}" for x in _CONTEXTS]) + worst([f"after {x}" for x in _CONTEXTS])
        through = max(self.moves[a, y] + self.moves[y, z] - self.moves[a, O] - self.moves[O, z] for a in range(3) for y in range(2) for z in range(3))
        return context + sum(gain(f"file {x}") for x in _FILE) + float(through)


#: What a word of letters must not hold to be judged by its shape alone.
_HINT = re.compile(rb"(?i:pass|pwd|secret|token|api|credential|auth|bearer|private|key)")


class Scanner:
    """Decodes texts with a CRF; keeps which words are certain to be outside."""

    def __init__(self, crf: CRF) -> None:
        self.crf, self.slack = crf, crf.slack()
        self.certain: dict[bytes, bool] = {}
        self.tokens: dict[str, bool] = {}
        self.shapes: dict[tuple, bool] = {}

    def _token_is_certain(self, tok: str) -> bool:
        known = self.tokens.get(tok)
        if known is None:
            if len(self.tokens) > CACHE_SIZE:
                self.tokens = {}
            known = _context(tok) not in ("kw", "eq", "quote")
            if known:
                own = self.crf.weights[[INDEX[n] for n in _own_names(tok)]].sum(axis=0)
                known = bool(own[O] - own[:2].max() > self.slack)
            self.tokens[tok] = known
        return known

    def _is_certain(self, word: bytes) -> bool:
        """Words of letters, with a full stop or comma behind or not, depend on shape, length and variety only."""
        core = word[:-1] if word[-1:] in (b".", b",") else word
        if core.isalpha() and not _HINT.search(core):
            dot = word[-1:] == b"."
            n = len(core) + dot
            shape = 0 if core.islower() else 1 if dot or core[1:].islower() and len(core) > 1 else 2 if core.isupper() else 3
            varied = len(set(core)) + dot if n >= 12 else 0
            key = (shape, n if n < 33 else 33, varied, word[-1:] == b",", dot)
            known = self.shapes.get(key) if n < 33 else None
            if known is None:
                known = all(self._token_is_certain(t) for t in _TOKEN.findall(word.decode()))
                if n < 33:
                    self.shapes[key] = known
            return known
        return all(map(self._token_is_certain, _TOKEN.findall(word.decode())))

    def open_words(self, words: set[bytes]) -> set[bytes]:
        """Those that need decoding."""
        if len(self.certain) > CACHE_SIZE:
            self.certain = {}
        for w in words:
            if w not in self.certain:
                self.certain[w] = self._is_certain(w)
        return {w for w in words if not self.certain[w]}

    def spans(self, raw: bytes, words: list[bytes], starts: np.ndarray, still: set[bytes]) -> list[Span]:
        """What the CRF finds in a text (UTF-8), whose words begin at `starts`; only stretches around words in `still` are decoded."""
        look: set[int] = set()
        for k, w in enumerate(words):
            if w in still:
                look.update(range(max(0, k - 1), min(len(words), k + 5)))
        file, out, order = file_features(raw), [], sorted(look)
        while order:
            n = 1
            while n < len(order) and order[n] == order[0] + n:
                n += 1
            out += self._stretch(raw, words, starts, order[0], order[n - 1], file)
            order = order[n:]
        return out

    def _stretch(self, raw: bytes, words: list[bytes], starts: np.ndarray, lo: int, hi: int, file: list[str]) -> list[Span]:
        begin = int(starts[lo])
        tokens = list(_TOKEN.finditer(raw[begin : int(starts[hi]) + len(words[hi])].decode()))
        left = [_context(t) for t in _TOKEN.findall(b" ".join(words[max(0, lo - 4) : lo]).decode())][-4:]
        right = _context(_TOKEN.findall(words[hi + 1].decode())[0]) if hi + 1 < len(words) else "none"
        tags = self.crf.decode(_feature_rows([t[0] for t in tokens], left, right, file))
        if all(tag == O for tag in tags):
            return []
        before, out = len(raw[:begin].decode()), []
        for k, (t, tag) in enumerate(zip(tokens, tags, strict=True)):
            if tag == I and k and tags[k - 1] != O and out:
                out[-1] = (out[-1][0], 3, before + t.end())
            elif tag != O:
                out.append((before + t.start(), 3, before + t.end()))
        return out


# --- training windows -------------------------------------------------------

#: Characters of a passage before and behind its middle.
_AROUND = 400


def labelled_window(text: str, spans: list[Span], word_at: int) -> tuple[list[str], list[int]]:
    """Tokens and tags of the words around the one at `word_at`; secrets are the spans, of assignments the value."""
    words = list(_WORD.finditer(text, max(0, word_at - _AROUND), min(len(text), word_at + _AROUND)))
    mid = next((k for k, m in enumerate(words) if m.end() > word_at), 0)
    near = words[max(0, mid - REACH) : mid + REACH]
    secret = [ASSIGN.match(text, a).span(2) if k == 0 else (a, z) for a, k, z in spans]
    tokens = [t for m in near for t in _TOKEN.finditer(text, m.start(), m.end())][:48]
    tags: list[int] = []
    for t in tokens:
        inside = next((s for s in secret if s[0] <= t.start() < s[1]), None)
        tags.append(O if inside is None else B if t.start() == inside[0] or not tags or tags[-1] == O else I)
    return [t[0] for t in tokens], tags


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_KEYS = "credential credentials pwd db_pwd passphrase auth authorization private_key client_secret secret_key access_token session_token password passwd api-key signing_key token secret".split()
_HEADERS = ("Bearer ", "bearer ", "Authorization: Bearer ", "authorization: Basic ", "x-api-key: ", "private_key ")
_SIGNS = ("=", ": ", " = ", ":", " : ", " is ", " was ", ' "', ": '", '="')
_PREFIXES = "gh sk pk xox glp npm key tok pat shp ak rk".split()
_PLAIN_WORDS = "none required missing stored expired unknown empty here below optional hidden rotated".split()


def _random(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def made_secret(rng: random.Random) -> tuple[str, str]:
    """A phrase, and the secret in it."""
    letters = rng.choice([_LOWER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "-_."])
    value = _random(rng, letters, rng.randint(10, 44))
    at = rng.randrange(1, len(value))
    value = rng.choice(_LOWER + _UPPER) + value[:at] + rng.choice(_DIGITS) + value[at:] + rng.choice(_LOWER + _DIGITS)
    form = rng.random()
    if form < 0.6:
        sign = rng.choice(_SIGNS)
        if sign[-1] in "\"'":
            return rng.choice(_KEYS) + sign + value + sign[-1], value
        return rng.choice(_KEYS) + sign + value, value
    if form < 0.8:
        if rng.random() < 0.5:
            value = "ey" + value + "." + _random(rng, _LOWER + _UPPER + _DIGITS + "-_", 30)
        return rng.choice(_HEADERS) + value, value
    value = rng.choice(_PREFIXES) + rng.choice(["_", "-", "p_", "b-", "_live_", "-test-"]) + _random(rng, _LOWER + _UPPER + _DIGITS, rng.randint(20, 40)) + rng.choice(_DIGITS)
    return rng.choice(["", "", "use ", "with "]) + value, value


def _plain_word(rng: random.Random) -> str:
    """A word of letters of any length and case, or a number, with signs around it or not."""
    word = _random(rng, _LOWER, rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 14, 17, 21, 26, 34]))
    word = rng.choice([word, word, word.upper(), word.capitalize(), word[:3].upper() + word[3:], str(rng.randint(0, 10 ** rng.randint(1, 6))), f"{rng.randint(0, 99)}.{rng.randint(0, 99)}", f"{word[:4]}-{word[4:]}x", f"{word[:6]}{rng.randint(0, 99)}"])
    return rng.choice(["", "", "", "(", "- "]) + word + rng.choice(["", "", "", ".", ",", "!!", "?", ";", ")", "'s", "..."])


def look_alike(rng: random.Random) -> str:
    """What is no secret: codes and numbers in prose, keywords before plain words."""
    code, n = _random(rng, "0123456789abcdef", rng.randint(6, 20)), rng.randint(1, 40)
    kind = rng.randrange(14) - 5
    if kind < 0:
        return " ".join(_plain_word(rng) for _ in range(rng.randint(6, 16)))
    if kind < 2:
        return f"{rng.choice(['the', 'a', 'no', 'your'])} {rng.choice(_KEYS)}{rng.choice([' ', ': ', ' is ', ' = ', ' was '])}{rng.choice(_PLAIN_WORDS)}"
    return [
        f"commit {code}", f"{rng.choice(['checksum', 'digest', 'id', 'build'])} {code.upper()}", f"v{n}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        f"20{n:02}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:00", f"data {_random(rng, _LOWER + _UPPER + _DIGITS + '+/', rng.randint(16, 60))}",
        f"{rng.choice(['report', 'img', 'table'])}_{n}_final{rng.randint(1, 9)}.pdf", f"{rng.choice(['id', 'ref', 'case', 'name'])}{rng.choice(['=', ': '])}{rng.choice(['AB', 'x', 'item'])}{rng.randint(100, 99999)}",
    ][kind - 2]


def examples(passages: list[tuple[str, int]], seed: int = 41) -> list[tuple[list[str], list[int]]]:
    """Labelled windows of passages, each (text, its middle): as they are, with made-up secrets, and with look-alikes."""
    rng, out = random.Random(seed), []
    for text, mid in passages:
        out.append(labelled_window(text, base_spans(text), mid))
        for k in range(2 * PER_PASSAGE):
            at = text.find(" ", min(mid + rng.randint(-60, 60), len(text) - 1) % max(1, len(text)))
            at = len(text) if at < 0 else at
            phrase, secret = made_secret(rng) if k % 2 == 0 else (look_alike(rng), None)
            whole = f"{text[:at]} {phrase}{rng.choice(['', '', '.', ','])} {text[at:]}"
            spans, start = base_spans(whole), at + 1
            if secret:
                start += phrase.index(secret)
                spans = [x for x in spans if x[2] <= at + 1 or x[0] >= at + 1 + len(phrase)] + [(start, 3, start + len(secret))]
            out.append(labelled_window(whole, sorted(spans), start))
    return [x for x in out if x[1]]


_DIGIT = re.compile(r"[0-9]")


def _windows(most: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the documents with the lowest hashes, `most` with a pattern's match (a passage around the first) and
        `most` without (one where a digit is, or at the start), one passage each."""
        best: dict[bool, list[tuple]] = {True: [], False: []}
        for batch in batches:
            data, offsets = tv.buffers(batch.column("text"))
            at = offsets.tolist()
            for k, rank in enumerate(batch.column("rank").to_pylist()):
                raw = data[at[k] : at[k + 1]].tobytes()
                may = bool(raw) and _may_match(raw)
                kept = best[False]
                if not raw or not may and len(kept) >= most and rank >= -kept[0][0]:
                    continue
                text = raw.decode()
                spans = base_spans(text) if may else []
                kept = best[bool(spans)]
                if len(kept) >= most and rank >= -kept[0][0]:
                    continue
                hit = _DIGIT.search(text)
                mid = spans[0][0] if spans else hit.start() if hit else 0
                lo = max(0, mid - _AROUND)
                heapq.heappush(kept, (-rank, text[lo : mid + _AROUND], mid - lo, file_features(raw)))
                if len(kept) > most:
                    heapq.heappop(kept)
        rows = [(-x[0], hit, *x[1:]) for hit, xs in best.items() for x in xs]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rank", "hit", "passage", "mid", "file"])

    return f


def train(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> CRF:
    """A CRF from at most `windows` passages, half of them with a match if there are so many."""
    slim = docs.select(F.xxhash64(F.col("doc_id")).alias("rank"), "text")
    kind = "rank long, hit boolean, passage string, mid int, file array<string>"
    found = table(slim.mapInArrow(_windows(windows // 2), kind), "windows").coalesce(8)
    sequences = []
    for hit in (True, False):
        rows = found.where(F.col("hit") == F.lit(hit)).orderBy("rank", "passage").limit(windows // 2).collect()
        for i, r in enumerate(rows):
            sequences += [(_feature_rows(t, ["none"], "none", r["file"]), y) for t, y in examples([(r["passage"], r["mid"])], 41 + i)]
    return CRF.fit(sequences)


_scanners: dict[str, Scanner] = {}


def scan(docs: DataFrame, crf: CRF | None = None) -> DataFrame:
    """Spans of every row of docs (doc_id, text); null texts count as empty.

    doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans.  Spans of the
    CRF that overlap a pattern's are left out: the pattern has found them.
    """
    crf = crf or train(docs)
    model, key = (crf.weights, crf.moves), uuid.uuid4().hex

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(CRF(*model))
        scanner = _scanners[key]
        for batch in batches:
            data, offsets = tv.buffers(batch.column("text"))
            counts: list[list[int]] = []
            digests, texts = [], []
            for lo, hi in tv.runs(offsets):
                part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, _, by_doc = tv.word_bounds(part, bounds)
                whole, at, first = part.tobytes(), bounds.tolist(), by_doc.tolist()
                docs_ = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                split = [d.split() for d in docs_]
                every: set[bytes] = set()
                for x in split:
                    every.update(x)
                still = scanner.open_words(every)
                for k, (raw, words) in enumerate(zip(docs_, split, strict=True)):
                    base = base_spans(raw.decode()) if _may_match(raw) else []
                    more = [] if still.isdisjoint(words) else scanner.spans(raw, words, starts[first[k] : first[k + 1]] - at[k], still)
                    more = [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
                    kinds = [s[1] for s in base]
                    counts.append([kinds.count(0), kinds.count(1), kinds.count(2), len(more)])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    texts.append(joined(sorted(base + more)))
            n = np.array(counts, np.int64).reshape(-1, 4)
            arrays = [batch.column("doc_id").cast(pa.int64()), *[pa.array(n[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(f, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")
