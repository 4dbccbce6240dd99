"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more token characters, named key formats, and values assigned to a telling name. Each is
described by its length, its character transitions (a Markov chain over the dictionary), how much of it dictionary words
cover, the path of the document and the words around it. The forest is trained in numpy from labelled findings:
``labelled_findings`` makes a stated set from a seed; findings reviewed by people have the same form and can take its place.
Scanning is one pass over whole texts without a shuffle; values leave it as digests only.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = 48, 16
TREES, DEPTH, LEAF, BINS = 48, 9, 4, 32
FINDINGS, SEED = 6_000, 29
_SCHEMA = "doc_id long, start long, length int, kind string, value_sha256 string, score double, secret boolean"

# Formats of keys that services hand out.
FORMATS = {
    "aws-access-key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github-token": r"gh[pousr]_[0-9A-Za-z]{36,}",
    "gitlab-token": r"glpat-[0-9A-Za-z_-]{20,}",
    "slack-token": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "google-api-key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe-key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "npm-token": r"npm_[0-9A-Za-z]{36}",
    "json-web-token": r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "private-key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[0-9A-Za-z+/=\s:,.-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?",
    "url-password": r"(?<=://)[^\s/:@]{1,64}:[^\s/@]{3,}(?=@)",
}
# Names that announce a secret, names that announce something harmless, and stand-ins.
TELLING = "token secret password passwd passphrase apikey api_key api-key access_key auth credential bearer private signing client_secret"
HARMLESS = "commit sha sha1 sha256 md5 hash checksum digest uuid guid revision version build id card number phone isbn etag integrity href src http https www mail"
STAND_INS = "example sample dummy placeholder changeme your xxxx redacted todo fake lorem"

_FORMAT = "|".join(f"(?P<k{n}>{p})" for n, p in enumerate(FORMATS.values()))
#: The telling name can follow other words: after a sign, an underscore or a hyphen, or with a capital after a small letter.
_ASSIGNED = (
    rf"(?:(?<![^\W_])|(?<=[a-z])(?=[A-Z]))(?i:{'|'.join(map(re.escape, TELLING.split()))})[\w-]{{0,20}}[\x22']?\s{{0,3}}(?:=|:|=>|:=)\s{{0,3}}[\x22']?(?P<assigned>[^\s\x22'<>,;(){{}}]{{8,}})"
)
_CANDIDATE = re.compile(_FORMAT + "|" + _ASSIGNED + r"|(?P<run>[0-9A-Za-z_+/=.@-]{16,})")
_INSIDE = re.compile(rf"(?<![0-9A-Za-z])(?:{_FORMAT})|{_ASSIGNED}")
#: From 51 characters on, any named value is known as such: name, signs, spaces and the first eight of the value.
_REACH = 64
_KINDS = [*FORMATS, "assigned", "run"]
_WORD = re.compile(r"[A-Za-z]+")
_SIGNS = string.ascii_lowercase + "0"
_CODES = np.array([_SIGNS.find("0" if chr(c).isdigit() else chr(c)) for c in range(128)])


@dataclass(frozen=True)
class Finding:
    value: str
    left: str
    right: str
    path: str
    kind: str


class Dictionary:
    """Words of a public vocabulary file, and the chain of their letters."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 4}
        sizes: dict[str, set[int]] = {}
        for w in self.words:
            sizes.setdefault(w[:4], set()).add(len(w))
        self.sizes = {head: sorted(own, reverse=True) for head, own in sizes.items()}
        counts = np.ones((27, 27))
        for w in self.words:
            codes = [ord(c) - 97 for c in w]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    @classmethod
    def load(cls, vocabulary: str) -> Dictionary:
        with open(vocabulary, encoding="utf-8") as f:
            pieces = json.load(f)["model"]["vocab"]
        return cls(sorted({w for p in pieces if (w := p.lstrip("Ġ").lower()).isascii() and w.isalpha()}))

    def coverage(self, text: str) -> float:
        """Share of the whole text that words cover, the longest word at each place."""
        covered = at = 0
        low = text.lower()
        while at < len(low):
            for n in self.sizes.get(low[at : at + 4], ()):
                if (word := low[at : at + n]) in self.words:
                    covered += len(word)
                    at += len(word)
                    break
            else:
                at += 1
        return covered / max(1, len(low))

    def chain(self, text: str) -> float:
        """Mean log chance of all transitions; digits are one sign."""
        codes = _CODES[np.frombuffer(text.lower().encode("ascii", "ignore"), np.uint8)]
        codes = codes[codes >= 0]
        return float(self.log[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else -3.0


def features(f: Finding, d: Dictionary) -> list[float]:
    v, n = f.value, max(1, len(f.value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v]
    share = [kinds.count(k) / n for k in "dulo"]
    counts = [v.count(c) for c in set(v)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    left, low, path = f.left.lower(), v.lower(), f.path.lower()
    near = left[-28:]
    words = _WORD.findall(left)[-4:]
    return [
        len(v), *share, entropy, len(counts) / n, max(counts, default=0) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        d.chain(v), d.coverage(v),
        float(all(c in "0123456789abcdefABCDEF" for c in v)), float(v.isdigit()),
        v.count("/") / n, v.count(".") / n, float("@" in v), v.count("-") / n,
        float(any(w in near for w in TELLING.split())), float(any(w in HARMLESS.split() for w in words)),
        float(any(w in low or w in near for w in STAND_INS.split())),
        float(bool(re.search(r"[=:]\s*[\x22']?$", f.left))), float(f.left[-1:] in "\"'" and f.right[:1] in "\"'" and bool(f.left)),
        float(any(w in path for w in ("env", "conf", "secret", "cred", "pem", "key"))), float(any(w in path for w in ("test", "doc", "example", "fixture"))),
        float(_KINDS.index(f.kind) if f.kind in _KINDS else -1),
    ]


def _inner(text: str, a: int, z: int) -> re.Match | None:
    """The first named value or key format that begins in the run text[a:z], whole, however far it goes.

    Of these, only a password in a URL and the head of a private key may need more than _REACH characters after the run to be
    known. A run holds no colon and no space, so the former begins right after ://, at most two places into the run, and the
    latter's -----BEGIN is the end of the run. These places are tried with the whole text.
    """
    near = _INSIDE.search(text, a, z + _REACH)
    first = near.start() if near and near.start() < z else z
    for p in (a, a + 1, a + 2, z - 10, first):
        if p <= first and p < z and (whole := _INSIDE.match(text, p)):
            return whole
    return None


def candidates(text: str | None, path: str | None) -> Iterator[tuple[int, Finding]]:
    """(start, finding) in the order of the text."""
    text, at = text or "", 0
    while m := _CANDIDATE.search(text, at):
        name = m.lastgroup
        a, z = m.span(name)
        at = m.end()
        if name == "run" and (inner := _inner(text, a, z)):
            z = at = inner.start()  # a run ends where a named value or a key format begins in it; that comes next
            if z - a < 16:
                name = inner.lastgroup
                (a, z), at = inner.span(name), inner.end()
        kind = name if name in ("assigned", "run") else _KINDS[int(name[1:])]
        yield a, Finding(text[a:z], text[max(0, a - LEFT) : a], text[z : z + RIGHT], path or "", kind)


def labelled_findings(dictionary: Dictionary, n: int = FINDINGS, seed: int = SEED) -> list[tuple[Finding, bool]]:
    """A stated training set, half secrets: random values in telling surroundings against look-alikes."""
    rng = random.Random(seed)
    words = sorted(dictionary.words)
    pick = lambda: rng.choice(words)
    prose = lambda k: " ".join(pick() for _ in range(k))
    chars = lambda a, k: "".join(rng.choices(a, k=k))
    hexa, both = "0123456789abcdef", string.ascii_letters + string.digits
    name = lambda ws: rng.choice(ws.split())
    out: list[tuple[Finding, bool]] = []
    while len(out) < n:
        secret = len(out) % 2 == 0
        path = rng.choice(["src/app.py", "config/settings.yml", ".env", "docs/guide.md", "tests/data.json", f"src{rng.randint(0, 99)}", ""])
        left, right = prose(4) + " ", " " + prose(2)
        if secret:
            value = rng.choice([chars(hexa, rng.choice([32, 40, 48, 64])), chars(both, rng.randint(20, 60)), chars(both + "+/", rng.randint(24, 86)) + "==", "AKIA" + chars(string.ascii_uppercase + string.digits, 16), "ghp_" + chars(both, 36), chars(both + "!#$%^*-_", rng.randint(10, 24))])
            key = rng.choice([name(TELLING), f"{pick()}_{name(TELLING)}", name(TELLING).upper()])
            if value[:4] in ("AKIA", "ghp_") and rng.random() < 0.5:  # such a key needs no name beside it
                key = None
            if rng.random() < 0.08:
                kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
                body = "\n".join(chars(both + "+/", 64) for _ in range(rng.randint(1, 26)))
                value, key = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", None
            elif rng.random() < 0.04:
                value = chars(both + "+/", rng.randint(200, 900))
            quote = rng.choice(['"', '"', "'", ""])
            left += "" if key is None else f"{key}{rng.choice([' = ', '=', ': ', ' := '])}{quote}"
            right = ("" if key is None else quote) + right
        else:
            what = rng.randint(0, 12)
            if what == 0:
                value, left = chars(hexa, rng.choice([32, 40, 64])), left + name(HARMLESS) + rng.choice([" ", ": ", "="])
            elif what == 1:
                value = chars(string.digits, rng.choice([16, 16, 18, 20]))
            elif what == 2:
                value = "".join(pick() for _ in range(rng.randint(3, 5)))
            elif what == 3:
                value = "/".join(pick() for _ in range(rng.randint(3, 6))) + rng.choice(["", ".py", ".html"])
            elif what == 4:
                value = f"{pick()}.{rng.randint(0, 99)}@{pick()}.{rng.choice(['com', 'org', 'example.org'])}"
            elif what == 5:
                value, left = rng.choice([name(STAND_INS) + "_" + pick() + pick(), "x" * rng.randint(16, 40), "0" * 32]), left + name(TELLING) + ' = "'
            elif what == 6:
                value = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))
            elif what == 7:
                value, left = "_".join(pick() for _ in range(4)), left + rng.choice(["def ", "", name(TELLING) + " = "])
            elif what > 10:  # long words of other languages
                value = "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "ei", "an", "er", "tion"]) for _ in range(rng.randint(7, 12)))
                value = rng.choice([value, value, value.capitalize(), value.upper(), value + rng.choice("-=_.") + pick()])
            elif what == 10:
                value = "AKIA" + chars(string.ascii_uppercase, 9) + "EXAMPLE"
            elif what == 8:
                value = rng.choice("=-_.+") * rng.randint(16, 60)
            else:
                value, left = f"self.{pick()}.{pick()}_{name(TELLING)}", left + name(TELLING) + " = "
        kind = next((f.kind for _, f in candidates(left + value, path)), "run")
        out.append((Finding(value, left[-LEFT:], right[:RIGHT], path, kind), secret))
    return out


class Forest:
    """Binary classification trees on bootstrap samples with random features at each split; nodes in flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        self.trees = [self._grow(binned, y, edges, rng) for _ in range(TREES)]

    @staticmethod
    def _grow(binned: np.ndarray, y: np.ndarray, edges: list, rng) -> tuple[np.ndarray, ...]:
        rows = rng.integers(0, len(y), len(y))
        feature, cut, left, value = [], [], [], []
        todo = [(rows, 0)]
        nodes: list[tuple[np.ndarray, int]] = []
        while todo:
            nodes += todo
            after = []
            for own, depth in todo:
                p = y[own].mean()
                value.append(p)
                best = None
                if depth < DEPTH and len(own) >= 2 * LEAF and 0 < p < 1:
                    for j in rng.choice(binned.shape[1], int(binned.shape[1] ** 0.5) + 1, replace=False):
                        width = len(edges[j]) + 1
                        n = np.cumsum(np.bincount(binned[own, j], minlength=width))[:-1]
                        s = np.cumsum(np.bincount(binned[own, j], y[own], width))[:-1]
                        ok = (n >= LEAF) & (len(own) - n >= LEAF)
                        if ok.any():
                            total = y[own].sum()
                            gain = np.where(ok, s * s / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(own) - n, 1), -1)
                            if best is None or gain.max() > best[0]:
                                best = (gain.max(), j, int(gain.argmax()))
                if best is None:
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(-1)
                else:
                    _, j, b = best
                    low = binned[own, j] <= b
                    feature.append(int(j))
                    cut.append(float(edges[j][b]))
                    left.append(len(nodes) + len(after))
                    after += [(own[low], depth + 1), (own[~low], depth + 1)]
            todo = after
        return np.array(feature), np.array(cut), np.array(left), np.array(value)

    def chance(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, left[at] + goes, at)
            out += value[at]
        return out / max(1, len(self.trees))


def train(findings: list[tuple[Finding, bool]], dictionary: Dictionary) -> Forest:
    x = np.array([features(f, dictionary) for f, _ in findings])
    return Forest(x, np.array([float(s) for _, s in findings]))


def find_secrets(docs: DataFrame, vocabulary: str, path_col: str | None = "source", findings: list[tuple[Finding, bool]] | None = None) -> DataFrame:
    """One row per candidate: doc_id, start and length (code points), kind, digest of the value, score, secret (score >= 0.5).

    Null and empty texts have no candidates; null ids and paths are kept as such; repeated rows give repeated rows; other
    columns are not read, and columns of the names of the result do no harm. Values are whole, whatever their length.
    """
    held = _held(docs, vocabulary, findings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forest = held.value
        for b in batches:
            where, found = [], []
            for i, text, path in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for start, f in candidates(text, path):
                    where.append((i, start))
                    found.append(f)
            score = forest.chance(np.array([features(f, words) for f in found])) if found else np.empty(0)
            cols = [[i for i, _ in where], [s for _, s in where], [len(f.value) for f in found], [f.kind for f in found], [hashlib.sha256(f.value.encode("utf-8", "surrogatepass")).hexdigest() for f in found], score, score >= 0.5]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "kind", "value_sha256", "score", "secret"])

    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")).mapInArrow(run, _SCHEMA)


def _held(docs: DataFrame, vocabulary: str, findings: list[tuple[Finding, bool]] | None):
    """The dictionary and the trained forest, on the workers: a vocabulary file and some thousand nodes."""
    dictionary = Dictionary.load(vocabulary)
    return docs.sparkSession.sparkContext.broadcast((dictionary, train(findings or labelled_findings(dictionary), dictionary)))


def redact(docs: DataFrame, vocabulary: str, mask: str = "[secret]", path_col: str | None = "source", findings: list[tuple[Finding, bool]] | None = None) -> DataFrame:
    """docs with the values that find_secrets finds to be secrets replaced; columns and rows as they were, nulls too."""
    held = _held(docs, vocabulary, findings)

    @F.pandas_udf("string")
    def cut(texts, paths):
        import pandas as pd

        words, forest = held.value
        out = []
        for t, path in zip(texts, paths, strict=True):
            found = list(candidates(t, path if isinstance(path, str) else None)) if isinstance(t, str) else []
            keep = forest.chance(np.array([features(f, words) for _, f in found])) >= 0.5 if found else []
            for (start, f), bad in reversed(list(zip(found, keep, strict=True))):
                if bad:
                    t = t[:start] + mask + t[start + len(f.value) :]
            out.append(t)
        return pd.Series(out, dtype=object)

    path = F.col(f"row.{path_col}").cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct("*").alias("row")).select(F.col("row").withField("text", cut("row.text", path)).alias("row")).select("row.*")
