"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Texts are cut into runs of non-space characters and each is tagged as beginning, inside or outside of a secret.
Features are the token's shape (character classes, length, randomness, known prefixes), the same of both neighbours,
and features of the whole file. Everything but the file's features depends on one token only, so scores are kept by
token; Viterbi runs over those stretches only in which a secret could win: elsewhere "outside" leads by more than
all transitions together can make up, and decoding there is exact without running it.

The field is fitted by maximum likelihood on generated, labelled lines; the fit is deterministic.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
_KEYS = "(" + "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = re.compile(_KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"\S+")
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# features

_WORD = re.compile(r"[\"'(«]?[^\W\d_]{1,28}[.,;:!?\"')»]{0,2}\Z")
_KEYWORD = re.compile(r"passw|secret|token|api_?key|apikey|credential|passphrase|bearer|authorization|private|pwd|auth|access|signing|key\b", re.I)
_PREFIX = re.compile(r"""["'(=:]*(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|sk_test_|pk_live_|xox[abp]-|AIza|eyJ|glpat-|npm_|SG\.|ya29\.|hf_|-----BEGIN|-----END)""")
_KEY_HINT = re.compile("passw|secret|token|api|credential|passphrase|bearer|auth|private|pwd|access|sign|key")
_PROSE = re.compile("([A-ZÀ-ÖØ-Þ]?)([a-zß-öø-ÿ]{1,27})[.,;:!?]?\\Z")
_CAPITALS, _LETTERS, _DIGITS = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[^\\W\\dA]+"), re.compile(r"\d+")
_SIGNS, _AGAIN = re.compile("[^Aa0]+"), re.compile("(.{1,3}?)\\1+")
_URL_LOGIN = re.compile(r"(?<=[a-z0-9+.-])://[^/\s:@]++:[^/\s@]{3,}+@")
_DIGIT = re.compile(r"\d")
#: A change between digits, capitals and the rest.
_TURN = re.compile(r"(?<=\d)(?=\D)|(?<=[^\W\d])(?=\d)|(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])|(?<=[A-ZÀ-ÖØ-Þ])(?=[a-zß-öø-ÿ])")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[\d.,:/+()%-]+")
_KEY_VALUE = re.compile(r"[=:][\"']?[^\s\"']{6,}")
_RANDOM = re.compile(r"[A-Za-z0-9+/_.=~$!@%^&*#-]{12,}")


def _bucket(n: float, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def _shape(tok: str) -> str:
    """Classes of characters in turn, repetitions once; a long sequence counts by the classes it has."""
    s = _LETTERS.sub("a", _CAPITALS.sub("A", tok))
    s = _AGAIN.sub(r"\1", _SIGNS.sub("-", _DIGITS.sub("0", s)))
    return s if len(s) <= 10 else "mixed" + "".join(sorted(set(s)))


def token_features(tok: str) -> tuple[list[str], list[str]]:
    """(features of the token itself, features it gives its neighbours)."""
    core = tok.strip("\"'`,;()[]{}<>.:")
    n = len(core)
    word = bool(_WORD.match(tok))
    lower, upper, digit = core != core.upper(), core != core.lower(), bool(_DIGIT.search(core))
    turns = 0 if word else len(_TURN.findall(core))
    key = bool(_KEYWORD.search(tok))
    shape = "w" if word else _shape(tok)
    length = _bucket(n, (4, 8, 12, 16, 20, 24, 32, 40, 64, 100))
    random_ = not word and n >= 12 and bool(_RANDOM.fullmatch(core)) and (digit or (upper and lower and turns > 4))
    own = ["bias", f"shape={shape}", f"len={length}", f"classes={lower:d}{upper:d}{digit:d}"]
    if word:
        own.append("word")
    else:
        count = Counter(core).values()
        total = n or 1
        entropy = math.log2(total) - sum(c * math.log2(c) for c in count) / total
        own += [f"turns={_bucket(turns / max(1, n), (0.1, 0.2, 0.3, 0.4, 0.5))}", f"entropy={_bucket(entropy, (2, 2.6, 3, 3.4, 3.8, 4.2, 4.6))}"]
    if random_:
        own += ["random", f"random&len={length}"]
    if m := _PREFIX.match(tok):
        own += ["prefix", f"prefix={m[1][:6]}"]
    if _URL_LOGIN.search(tok):
        own.append("login")
    elif "://" in tok or core.startswith("www."):
        own.append("url")
    if _UUID.fullmatch(core):
        own.append("uuid")
    if _NUMBER.fullmatch(core):
        own.append("number")
    if "@" in core and "." in core:
        own.append("mail")
    if key:
        own.append("key")
        if _KEY_VALUE.search(tok):
            own.append("key&value")
    near = [f"shape={shape}", f"key={key:d}"]
    if key and (tok[-1:] in "=:" or tok in ("Bearer", "bearer")):
        near.append("key&opens")
    if tok in ("=", ":", "=>", ":=", "is"):
        near.append("opens")
    if random_:
        near.append("random")
    if _PREFIX.match(tok):
        near.append("prefix")
    if tok.startswith("-----"):
        near.append("fence")
    return own, near


def file_features(tokens: int, odd: int, keyed: bool) -> list[str]:
    return [f"odd={_bucket(odd / max(1, tokens), (0.02, 0.1, 0.3, 0.6))}", f"keyed={keyed:d}"]


def _plain(tok: str) -> bool:
    return bool(_WORD.match(tok)) and not _KEYWORD.search(tok)


# training lines

def _training(seed: int = 11, lines: int = 900) -> list[list[tuple[str, int]]]:
    rnd = random.Random(seed)
    parts = "the an re tion on er st ou le ent qu ci ón ar se von zu ein sch ich ver de la los ción et oi eau é es un a in".split()
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def word() -> str:
        w = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
        w = w.capitalize() if rnd.random() < 0.12 else w
        return w + (rnd.choice(".,;:") if rnd.random() < 0.12 else "")

    def chars(pool: str, lo: int, hi: int) -> str:
        return "".join(rnd.choice(pool) for _ in range(rnd.randint(lo, hi)))

    def secret() -> list[tuple[str, int]]:
        key = rnd.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "DB_PASSWORD", "auth_token", "private_key", "access_key", "pwd", "signing_key"])
        key = key.upper() if rnd.random() < 0.2 else key
        val = rnd.choice([lambda: chars("0123456789abcdef", 16, 40), lambda: chars(alnum, 12, 44), lambda: chars(b64, 20, 60) + rnd.choice(["", "=", "=="]),
                          lambda: chars(alnum + "!@#$%^&*", 10, 24)])()
        q = rnd.choice(["", '"', "'"])
        form = rnd.randrange(11)
        if form == 0:
            return [(f"{key}{rnd.choice('=:')}{q}{val}{q}", B)]
        if form == 1:
            return [(key, O), (rnd.choice(["=", ":", ":="]), O), (f"{q}{val}{q}", B)]
        if form == 2:
            return [(key + rnd.choice("=:"), O), (f"{q}{val}{q}", B)]
        if form == 3:
            return [("Authorization:", O), ("Bearer", O), (val, B)]
        if form == 4:
            p = rnd.choice(["ghp_", "gho_", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "glpat-", "npm_", "hf_", "sk-", "SG."])
            return [(q + p + chars(alnum, 20, 40) + q, B)]
        if form == 5:
            return [(rnd.choice(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + "234567", 16, 16), B)]
        if form == 6:
            return [(".".join(["eyJ" + chars(alnum, 15, 30), "eyJ" + chars(alnum, 30, 60), chars(alnum + "-_", 30, 50)]), B)]
        if form == 7:
            return [(f"{rnd.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{chars('abcdefgh', 3, 8)}:{chars(alnum, 6, 20)}@{chars('abcdefgh', 4, 8)}.example.com/{chars('abc', 2, 5)}", B)]
        if form == 8:
            out = [("-----BEGIN", B), ("RSA", I), ("PRIVATE", I), ("KEY-----", I)]
            out += [(chars(b64, 64, 64), I) for _ in range(rnd.randint(1, 5))]
            return [*out, ("-----END", I), ("RSA", I), ("PRIVATE", I), ("KEY-----", I)]
        if form == 9:
            return [(f'"{key}":', O), (f'"{val}"' + rnd.choice(["", ","]), B)]
        return [(key, O), ("is", O), (f"{q}{val}{q}", B)]

    def decoy() -> list[str]:
        h = "0123456789abcdef"
        return rnd.choice([
            lambda: ["-".join(chars(h, k, k) for k in (8, 4, 4, 4, 12))], lambda: [f"https://www.{chars('abcdef', 4, 9)}.example.com/{word()}/{rnd.randint(1, 9999)}?page={rnd.randint(1, 9)}&ref=x"],
            lambda: [f"{chars('abcdef', 3, 8)}.{chars('abc', 3, 8)}@example.org"], lambda: [f"+{rnd.randint(1, 99)}", f"({rnd.randint(200, 999)})", f"555-{rnd.randint(1000, 9999)}"],
            lambda: [".".join(str(rnd.randint(0, 255)) for _ in range(4))], lambda: [chars(h, 7, 10)], lambda: [f"v{rnd.randint(0, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}"],
            lambda: [f"20{rnd.randint(10, 29)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(0, 23):02d}:00:00Z"], lambda: [str(rnd.randint(0, 10**rnd.randint(1, 15)))],
            lambda: ["password", "is", "required"], lambda: ["token", "count:", str(rnd.randint(1, 4096))], lambda: ["the", "secret", "garden."], lambda: ["key:", word()], lambda: ["access", "to", "the", word()],
            lambda: ["api_key", "=", "None"], lambda: ["password:", "********"], lambda: ["|", word(), "|", word(), "|"], lambda: [f"src/{word()}/{word()}_{rnd.randint(1, 99)}.py"],
            lambda: [f"{word()}_{word()}_{word()}"], lambda: [f"get{word().title()}{word().title()}()"], lambda: [f"#{chars(h, 6, 6)}"], lambda: ["x" * rnd.randint(20, 200)], lambda: ["-" * rnd.randint(3, 60)],
            lambda: [word() + "&&&", word() + "***"], lambda: [word().upper() * 3], lambda: [word().upper() + "!!" for _ in range(rnd.randint(1, 5))], lambda: [word().upper().strip(".,;:") + rnd.choice([",!!", ".!!", "!!!", "?!"]) for _ in range(rnd.randint(1, 5))],
            lambda: [f"{word().strip('.,;:')}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com"], lambda: [word().title() + rnd.choice(["!!!", "???", "...", "###", "$$$", "%%%"]) for _ in range(rnd.randint(1, 4))], lambda: [f"{word()}-{word()}-{word()}-{word()}"], lambda: ["".join(rnd.choice(parts) for _ in range(rnd.randint(6, 12)))],
        ])()

    out = []
    for _ in range(lines):
        row: list[tuple[str, int]] = []
        for _ in range(rnd.randint(1, 4)):
            row += [(word(), O) for _ in range(rnd.randint(1, 9))]
            row += secret() if rnd.random() < 0.3 else [(t, O) for t in decoy()]
        row += [(word(), O) for _ in range(rnd.randint(0, 6))]
        out.append(row)
    return out


class Field:
    """Weights of the field: own and neighbour features by label, file features by label, and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray) -> None:
        self.index, self.weights, self.trans = index, weights, trans
        self.near: dict[tuple, np.ndarray] = {}
        self.margin = 2 * float(trans.max() - trans.min()) + 1e-9

    def emission(self, tok: str) -> np.ndarray:
        """3 x 3: scores by label for the token itself, for the one after it and for the one before it."""
        own, near = token_features(tok)
        key = tuple(near)
        if key not in self.near:
            self.near[key] = np.stack([np.zeros(3), self._sum("prev:" + f for f in near), self._sum("next:" + f for f in near)])
        out = self.near[key].copy()
        out[0] = self._sum(own)
        return out

    def _sum(self, features: Iterable[str]) -> np.ndarray:
        at = [self.index[f] for f in features if f in self.index]
        return self.weights[at].sum(0) if at else np.zeros(3)

    def file(self, features: list[str]) -> np.ndarray:
        return self._sum("file:" + f for f in features)


def _likelihood(em: np.ndarray, trans: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of padded sequences by emission and transition scores."""
    n, t, _ = em.shape
    e, go = np.exp(em - em.max(2, keepdims=True)), np.exp(trans)
    alpha, beta = np.ones_like(em), np.ones_like(em)  # each step's values up to a factor, which the shares below don't need
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        a = (alpha[:, k - 1] @ go) * e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], a / a.sum(1, keepdims=True), alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        b = (e[:, k + 1] * beta[:, k + 1]) @ go.T
        beta[:, k] = np.where(mask[:, k + 1, None], b / b.sum(1, keepdims=True), 1)
    p = alpha * beta
    p *= mask[..., None] / p.sum(2, keepdims=True)
    seen = np.eye(3)[y] * mask[..., None]
    pair = alpha[:, :-1, :, None] * go * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair *= (mask[:, 1:] / pair.sum((2, 3)))[:, :, None, None]
    seen_pair = np.zeros((3, 3))
    np.add.at(seen_pair, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    return seen - p, seen_pair - pair.sum((0, 1))


@functools.cache
def trained(seed: int = 11, rounds: int = 60, l2: float = 0.02) -> Field:
    """The field fitted on generated lines by adaptive gradient ascent."""
    data = _training(seed)
    index: dict[str, int] = {}
    t = max(map(len, data))
    ids, at, y, mask = [], [], np.zeros((len(data), t), int), np.zeros((len(data), t), bool)
    for r, row in enumerate(data):
        feats = [token_features(tok) for tok, _ in row]
        own_file = ["file:" + f for f in file_features(len(row), sum(not _plain(tok) for tok, _ in row), any("key=1" in n for _, n in feats))]
        for k, (_, label) in enumerate(row):
            fs = feats[k][0] + own_file
            fs = fs + ["prev:" + f for f in feats[k - 1][1]] if k else fs
            fs = fs + ["next:" + f for f in feats[k + 1][1]] if k + 1 < len(row) else fs
            got = [index.setdefault(f, len(index)) for f in fs]
            ids += got
            at += [r * t + k] * len(got)
            y[r, k], mask[r, k] = label, True
    ids_, at_ = np.array(ids), np.array(at)
    w, trans = np.zeros((len(index), 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(rounds):
        em = np.stack([np.bincount(at_, w[ids_, c], len(data) * t) for c in range(3)], 1).reshape(len(data), t, 3)
        d, dt = _likelihood(em, trans, y, mask)
        d = d.reshape(-1, 3)
        dw = np.stack([np.bincount(ids_, d[at_, c], len(index)) for c in range(3)], 1) - l2 * w
        dt = dt - l2 * trans
        gw, gt = gw + dw**2, gt + dt**2
        w, trans = w + 0.5 * dw / np.sqrt(gw), trans + 0.5 * dt / np.sqrt(gt)
    return Field(index, w, trans)


class Tagger:
    """Decodes texts; keeps the scores of tokens seen."""

    def __init__(self, field: Field, cache: int = 150_000) -> None:
        self.field, self.cache = field, cache
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.used = 0
        self.table = np.zeros((1024, 3, 3))
        self.info = np.zeros((1024, 2), bool)  # not a plain word, has a keyword

    def _add(self, tok: str, odd: bool, keyed: bool) -> int:
        k = self.used
        if k == len(self.table):
            self.table, self.info = np.concatenate([self.table] * 2), np.concatenate([self.info] * 2)
        self.table[k], self.info[k] = self.field.emission(tok), (odd, keyed)
        self.used += 1
        return k

    def _new(self, tok: str) -> int:
        m = _PROSE.match(tok)
        if m and tok != "is" and not _KEY_HINT.search(tok.lower()):
            # the features of such a word follow from its case and length: words alike share a row
            like = (m.end(1), m.end(2), tok[-1] == ":")
            k = self.alike.get(like)
            if k is None:
                k = self.alike[like] = self._add(tok, False, False)
        else:
            k = self._add(tok, not _plain(tok), bool(_KEYWORD.search(tok)))
        if len(tok) <= 256:
            self.row[tok] = k
        return k

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets that decoding finds."""
        toks = text.split()
        if not toks:
            return []
        if self.used > self.cache:
            self._reset()
        get = self.row.get
        idx = [get(t, -1) for t in toks]
        if -1 in idx:
            for k in [k for k, i in enumerate(idx) if i < 0]:
                idx[k] = get(toks[k], -1)
                if idx[k] < 0:
                    idx[k] = self._new(toks[k])
        return self._decode(text, np.array(idx))

    def _decode(self, text: str, ix: np.ndarray) -> list[tuple[int, int]]:
        info = self.info
        s = self.table[ix, 0]
        s[1:] += self.table[ix[:-1], 1]
        s[:-1] += self.table[ix[1:], 2]
        s += self.field.file(file_features(len(ix), int(info[ix, 0].sum()), bool(info[ix, 1].any())))
        open_ = s[:, O] - np.maximum(s[:, B], s[:, I]) < self.field.margin
        if not open_.any():
            return []
        edge = np.flatnonzero(np.diff(np.r_[0, open_.astype(np.int8), 0]))
        tags = np.zeros(len(ix), np.int8)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            tags[a:b] = self._viterbi(s[a:b], a > 0, b < len(ix))
        if not tags.any():
            return []
        at = [m.span() for m in _TOKEN.finditer(text)]
        out: list[list[int]] = []
        for k in np.flatnonzero(tags).tolist():
            if tags[k] == I and k and tags[k - 1] and out:
                out[-1][1] = at[k][1]
            else:
                out.append(list(at[k]))
        return [(a, b) for a, b in out]

    def _viterbi(self, s: np.ndarray, after: bool, before: bool) -> np.ndarray:
        """Best labels of a stretch whose neighbours, where there are any, are outside."""
        tr = self.field.trans
        v = s[0] + (tr[O] if after else 0)
        back = []
        for e in s[1:]:
            x = v[:, None] + tr
            back.append(x.argmax(0))
            v = x.max(0) + e
        k = int((v + (tr[:, O] if before else 0)).argmax())
        out = [k]
        for b in back[::-1]:
            k = int(b[k])
            out.append(k)
        return np.array(out[::-1], np.int8)


def all_spans(text: str, tagger: Tagger) -> list[tuple[int, int, str]]:
    """Base spans and all that the field finds, which may overlap them, by start, then kind as listed."""
    found = base_spans(text) + [(a, b, "crf") for a, b in tagger.spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) per document.

    Spans are code points, end exclusive; those of the field are added to the base spans, which they may overlap. Null
    texts count as empty; repeated rows and null ids keep their rows; an empty table gives none; other columns are ignored.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            found = [all_spans(t.as_py() or "", tagger) for t in b.column(1)]
            base = [[s for s in f if s[2] != "crf"] for f in found]
            n = {k: pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in KINDS}
            sha = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), n["assign"], n["access"], n["hex"], sha, pa.array(map(_joined, found), pa.string()), n["crf"]], names)

    shared = docs.sparkSession.sparkContext.broadcast(trained())
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by a mark; overlapping spans are replaced together. No row goes."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)

        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for a, b, _ in all_spans(text, tagger):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        for s in batches:
            yield s.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
