"""Secret scans: three base patterns, and a battery of randomness tests for what has no keyword.

Base spans (assign, access, hex) come from regular expressions over the whole text. The method then takes every further
run of 20 or more token characters that overlaps no base span, infers its encoding (hex, letters, base32, base36, base62,
base64), and tests it in two directions:

* as random text of that alphabet: chi-squared uniformity over the alphabet's symbols, with the moments that it has in a
  text so short; the Wald-Wolfowitz runs test about the alphabet's middle; and the lag-1 serial correlation of the
  symbol ranks. Fisher's method joins the three p-values to one. Candidates that are not random go: those that
  Benjamini-Hochberg discovers by these p-values at `NOT_RANDOM`, so that of what it drops as not random few are random.
* as written text of that alphabet: a letter follows its predecessor as letter pairs do in words (English, some German,
  French and Spanish), and neighbours change between lower case, upper case, digit and sign at a rate of 0.12. Of a token
  that is written so, the ratio of this probability to that of random text is below x with a probability of x at most,
  whatever the alphabet and length, so it is the p-value of a discovery. Long texts offer more candidates, so discoveries are
  controlled per document in the same way at 1e-4. Both controls weigh by length, as longer candidates carry more evidence.

Nulls and edges: a null or empty text has no spans. Repeated rows each get their own row. Extra columns are not read.
Positions are code points. No text is cut; a batch holds as many texts as Arrow's limits allow.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: -ln of the probabilities of a class that stays or changes to a given other one, and of a digit or sign of its class.
STAY, CHANGE, DIGIT, SIGN = -math.log(1 - 0.12), -math.log(0.12 / 3), math.log(10), math.log(4)
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

NOT_RANDOM, DISCOVERY_RATE = 0.01, 1e-4
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Of written text, four times -ln of the probability of a letter, as digits of base 36, by alphabet: of a first letter, then of
#: one that follows a, b, c ...
WRITTEN = """
adbbbdgfbkjddddcicaaegekji
hdbcgggicli9c9iel9a8ehjjhn 9ieg6jkk9dn8ihchncdfamlncl
9lfi8kl8coccii7jmdg9dmmoko aeed5gii9mmegfafldbddjhmjm
chbadfhidnmdd9gei88bhhiejl 9iffabjj7ondhg8hmbebaljnhn
bgee7gfdanhdfbcflcacbihmlk 6jhh5ikj9onfhg9incfcflhnkn
egcebefliojcd6agnda9kfmjnh ckii5kllhojjji6jnibg7mlolo
chee5ghi9nmbgefdlf9dfjenkm 9igd6gkk9om9ih9gkgccdkjncm
7dhh5jlkaomhdha9nhefelknjn aiba9f9jcnjghebgmga7fhjnjm
feccfeikfoidc7edn7ccbgflmn 8khe7jlidonajh9cn8ebcjlnfo
imkiglmlipojkhjkohgi1nnono 9hed6gfjaojgedaglcbbeiingn
chce8gifanjfffccjfa7cjhmgm aief7hk98omfggbfmabcdkgmfl
efeh8ghleknbb8hdo89ajimijo 7ljj3lml9oojjiajoihhkmmono
8khh9kl95ongjd9inbdffmilmo ah9f8gkhanmgggg9mfe6ikihkk
bfcdbehhbmledbb9kea9giemjk cjgh4ikjbonifgehnhfe6ljnlm
""".split()
RANKS = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}


def kind_of(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


CLASS = [kind_of(chr(c)) for c in range(128)]


def written_costs() -> tuple[list[float], list[list[float]]]:
    """-ln of the probabilities in WRITTEN, each row made to sum to 1."""
    rows = [[math.exp(-int(c, 36) / 4) for c in row] for row in WRITTEN]
    rows = [[-math.log(p / sum(row)) for p in row] for row in rows]
    return rows[0], rows[1:]


FIRST, NEXT = written_costs()


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds all characters of the token."""
    seen = set(token.rstrip("="))
    return next((k for k, s in SETS.items() if seen <= s), None)


def chi2_sf(x: float, df: float) -> float:
    """P(chi-squared with df degrees of freedom > x), by Wilson and Hilferty's cube root."""
    if df <= 0 or x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(token: str, alphabet: str) -> float:
    """Chi-squared over the alphabet's symbols. Of n uniform symbols out of k its mean is k - 1 and its variance
    2 (k - 1) (n - 1) / n, less than that of its limit: a chi-squared distribution scaled to both moments tells p."""
    n, k = len(token), len(ALPHABETS[alphabet])
    x = sum(m * m for m in Counter(token).values()) * k / n - n
    if n < 2:
        return 1.0
    scale = (n - 1) / n
    return chi2_sf(x / scale, (k - 1) / scale)


def runs(ranks: np.ndarray, size: int) -> float:
    """Wald-Wolfowitz: runs of symbols below and above the alphabet's middle."""
    up = ranks * 2 >= size
    a = int(up.sum())
    b = len(up) - a
    if not a or not b:
        return 2.0 ** -(len(up) - 1)
    n, r = a + b, 1 + int((up[1:] != up[:-1]).sum())
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((r - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(ranks: np.ndarray) -> float:
    """Lag-1 correlation of the ranks, about -1/n with variance 1/n for random text."""
    x = ranks - ranks.mean()
    if not (v := float((x * x).sum())):
        return 0.0
    n = len(x)
    return two_sided((float((x[1:] * x[:-1]).sum()) / v + 1 / n) * math.sqrt(n))


def battery(token: str) -> tuple[str | None, float, float]:
    """(encoding, p as random text of it, p as written text)."""
    body = token.rstrip("=")
    if (alphabet := encoding(body)) is None:
        return None, 0.0, 1.0
    ranks = np.fromiter((RANKS[alphabet][c] for c in body), float, len(body))
    ps = [max(p, 1e-300) for p in (uniformity(body, alphabet), runs(ranks, len(ALPHABETS[alphabet])), serial(ranks))]
    joint = chi2_sf(-2 * sum(map(math.log, ps)), 6)
    return alphabet, joint, math.exp(min(0.0, len(body) * math.log(len(ALPHABETS[alphabet])) - written_cost(body)))


def written_cost(body: str) -> float:
    """-ln of the probability of written text: of each character's class, then of the character in it."""
    cost, before, last = 0.0, None, -1
    for c in body:
        k = CLASS[ord(c)]
        if before is not None:
            cost += STAY if k == before else CHANGE
        if k < 2:
            letter = ord(c) % 32 - 1
            # a capital amid small letters starts a word; after capitals small letters go on
            cost += FIRST[letter] if last < 0 or (before == 0 and k == 1) else NEXT[last][letter]
            last = letter
        else:
            cost += DIGIT if k == 2 else SIGN
            last = -1
        before = k
    return cost


def discoveries(ps: list[float], lengths: list[int], rate: float) -> set[int]:
    """Benjamini-Hochberg: numbers of the p-values that are discoveries, each divided by a weight by length whose mean is 1."""
    if not ps:
        return set()
    mean = sum(lengths) / len(lengths)
    ranked = sorted((min(1.0, p * mean / n), i) for i, (p, n) in enumerate(zip(ps, lengths)))
    last = max((k for k, (p, _) in enumerate(ranked, 1) if p <= rate * k / len(ranked)), default=0)
    return {i for _, i in ranked[:last]}


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order of start, then kind."""
    text = text or ""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    candidates, k, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            reach, k = max(reach, found[k][2]), k + 1
        if reach > m.start():
            continue
        candidates.append((m.start(), m.end(), *battery(m[0])[1:]))
    lengths = [e - s for s, e, *_ in candidates]
    not_random = discoveries([p for _, _, p, _ in candidates], lengths, NOT_RANDOM)
    secret = discoveries([1.0 if i in not_random else p for i, (_, _, _, p) in enumerate(candidates)], lengths, DISCOVERY_RATE)
    return sorted(found + [(s, 3, e) for i, (s, e, *_) in enumerate(candidates) if i in secret and i not in not_random])


def row(text: str | None) -> tuple[int, int, int, str, str]:
    all_spans = spans(text)
    names = list(KINDS)
    told = [(kind, f"{names[kind]}:{start}:{end}") for start, kind, end in all_spans]
    base = ",".join(x for kind, x in told if kind < 3)
    n = [sum(kind == k for kind, _ in told) for k in range(3)]
    return (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in told))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text)."""

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*(row(t.as_py()) for t in b.column(1))) if len(b) else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
